"""Frame selection, synchronisation and error statistics over clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import exact_percentiles


def joint_score(df: DataFrame, by: str, a: str, b: str, large: int | None = None) -> DataFrame:
    """df with joint: each series over its median, at least 1e-9, then their harmonic mean. With large, medians of longer clips are found by selection, with a bounded buffer."""
    if large is None:
        med = df.groupBy(by).agg(F.percentile(a, 0.5).alias("ma"), F.percentile(b, 0.5).alias("mb"))
    else:
        med = exact_percentiles(df, [by], a, {"ma": 0.5}, large).join(exact_percentiles(df, [by], b, {"mb": 0.5}, large), by)
    med = med.select(by, F.greatest("ma", F.lit(1e-9)).alias("ma"), F.greatest("mb", F.lit(1e-9)).alias("mb"))
    x, y = F.col(a) / F.col("ma"), F.col(b) / F.col("mb")
    return df.join(med, by).withColumn("joint", F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0)).drop("ma", "mb")


def select_bin_maxima(df: DataFrame, by: str, order: str, score: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Of each clip, the first maximum of each of n contiguous bins; and an issue for each clip of fewer than n rows, which has none."""
    w = W.partitionBy(by).orderBy(order)
    rows = df.withColumn("bin", F.ntile(n).over(w)).withColumn("rows", F.count("*").over(W.partitionBy(by))).where(F.col("rows") >= n)
    short = df.groupBy(by).agg(F.count("*").alias("rows")).where(F.col("rows") < n).select(F.lit("error").alias("level"), F.lit("fewer_rows_than_bins").alias("code"), by, "rows")
    return rows.groupBy(by, "bin").agg(F.max_by(F.col(order), F.struct(F.col(score), -F.col(order))).alias(order), F.max(score).alias(score)), short


def selected_frames(picked: DataFrame, by: str, order: str, fps: float) -> DataFrame:
    """Resequenced from 1, with filenames, times, and the time since the frame before."""
    w = W.partitionBy(by).orderBy(order)
    out = picked.withColumn("sequence", F.row_number().over(w)).withColumn("filename", F.format_string("%06d.png", "sequence"))
    out = out.withColumn("timestamp_seconds", F.round(F.col(order) / fps, 6))
    return out.withColumn("delta_seconds", F.round(F.abs(F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(w)), 6))


def lag_correlation(series: DataFrame, by: str, max_lag: int = 5) -> DataFrame:
    """series (by, t, a, b): correlation of a at t with b at t + lag; null for fewer than three points or a flat side."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    left = series.select(by, "t", "a", lags).withColumn("u", F.col("t") + F.col("lag"))
    both = left.join(series.select(by, F.col("t").alias("u"), "b"), [by, "u"])
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return both.groupBy(by, "lag").agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & (spread > 1e-12), F.try_divide(F.covar_pop("a", "b"), spread)).alias("r"))


def best_lag(correlations: DataFrame, by: str) -> DataFrame:
    """The lag of the highest correlation, the smallest among those equal to nine places."""
    return correlations.where("r is not null").groupBy(by).agg(F.max_by("lag", F.struct(F.round("r", 9), -F.col("lag"))).alias("best_lag"), F.max("r").alias("best_r"))


def sync_diagnostic(series: DataFrame, by: str, max_lag: int = 5, least: int = 9) -> DataFrame:
    """Best lag of the whole series and of its thirds; a warning if any lag isn't zero; neither is available below so many points."""
    n = F.count("*").over(W.partitionBy(by))
    i = F.row_number().over(W.partitionBy(by).orderBy("t")) - 1
    rows = series.withColumn("n", n).withColumn("i", i)
    third = F.when(F.expr("i < n div 3"), 1).when(F.expr("i < 2 * n div 3"), 2).otherwise(3)
    parts = rows.select(F.concat_ws("#", F.col(by).cast("string"), F.lit("0")).alias("part"), "t", "a", "b").union(rows.select(F.concat_ws("#", F.col(by).cast("string"), third.cast("string")), "t", "a", "b"))
    best = best_lag(lag_correlation(parts, "part", max_lag), "part").withColumn("key", F.substring_index("part", "#", 1)).withColumn("seg", F.substring_index("part", "#", -1))
    out = best.groupBy("key").agg(F.max(F.when(F.col("seg") == "0", F.col("best_lag"))).alias("lag"), F.bool_or(F.col("best_lag") != 0).alias("warning"))
    sizes = series.groupBy(F.col(by).cast("string").alias("key")).agg(F.count("*").alias("points"))
    given = F.col("points") >= least
    return sizes.join(out, "key", "left").select("key", "points", F.when(given, F.col("lag")).alias("lag"), F.when(given, F.col("warning")).alias("warning"), given.alias("available"))


def representatives(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first, the middle (n div 2, from 0) and the last row of each clip."""
    w = W.partitionBy(by)
    rows = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return rows.where(F.expr("i = 0 or i = n div 2 or i = n - 1")).select(by, order, F.expr("case when i = 0 then 'first' when i = n - 1 then 'last' else 'middle' end").alias("place"))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """key and its place in a permutation fixed by seed and epoch. Places are counted within ranges of the hash, so no task has all rows."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), 256)
    rows = df.select(key, h.alias("h")).withColumn("b", F.substring("h", 1, 3))
    before = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("b").orderBy("h", key))
    return rows.withColumn("i", inside).join(F.broadcast(before.select("b", "before")), "b").select(key, (F.col("before") + F.col("i")).cast("long").alias("place"))


def error_metrics(df: DataFrame, by: list[str], error: str = "e", large: int | None = None) -> DataFrame:
    """RMSE, median, 95th percentile (linear), maximum, and how many errors are at most 1.

    In one aggregation, whose buffers hold the distinct errors of a group; with large, groups of more errors than that get
    their percentiles by selection, with a bounded buffer and a few more passes.
    """
    e = F.col(error)
    rest = [F.sqrt(F.avg(e * e)).alias("rmse"), F.max(e).alias("max_error"), F.count_if(e <= 1).alias("within_1")]
    names = [*by, "rmse", "median", "p95", "max_error", "within_1"]
    if large is None:
        return df.groupBy(*by).agg(*rest, F.percentile(e, 0.5).alias("median"), F.percentile(e, 0.95).alias("p95")).select(*names)
    return _with_percentiles(df.groupBy(*by).agg(*rest), df, by, error, {"median": 0.5, "p95": 0.95}, large).select(*names)


def _with_percentiles(out: DataFrame, df: DataFrame, by: list[str], value: str, named: dict[str, float], large: int) -> DataFrame:
    """out, a row for each group of df, with percentiles of value; null keys meet null keys."""
    found = exact_percentiles(df, by, value, named, large)
    for i, c in enumerate(by):
        found = found.withColumnRenamed(c, f"_k{i}")
    return out.join(found, [out[c].eqNullSafe(found[f"_k{i}"]) for i, c in enumerate(by)], "left").drop(*(f"_k{i}" for i in range(len(by))))


def coverage_summary(df: DataFrame, by: str, ratio: str, least: float = 0.5) -> DataFrame:
    r = F.col(ratio)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(r).alias("min_ratio"), F.avg(r).alias("mean_ratio"), F.max(r).alias("max_ratio"), F.count_if(r < least).alias("warnings"))


def preflight(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows at every level of a hierarchy, and in all."""
    return df.rollup(*levels).agg(F.count("*").alias("pairs"))


def metric_history(log: DataFrame, run: str = "run") -> DataFrame:
    """log (run, epoch, loss, n): sample-weighted mean of each epoch, and whether it beats all before."""
    mean = log.groupBy(run, "epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("mean_loss"))
    before = F.min("mean_loss").over(W.partitionBy(run).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
    return mean.withColumn("improved", F.coalesce(F.col("mean_loss") < before, F.lit(True)))


def best_candidate(df: DataFrame, by: str, score: list[str], take: str) -> DataFrame:
    """The candidate of the lowest scores in order; take itself breaks ties."""
    return df.groupBy(by).agg(F.min(F.struct(*score, take)).alias("s")).select(by, f"s.{take}", *(f"s.{c}" for c in score))
