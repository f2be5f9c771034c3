"""Exact quantiles of groups of any size: the wanted ranks are found by narrowing ranges, not by sorting or holding values.

Every pass counts, for each wanted rank, how many values of its range lie in each of a few thousand bins, and goes on in
the bin that holds the rank; a task's counts are added up before they are shuffled. When few enough values are left, or all
are equal, they are looked at themselves.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.steps import discard, written

#: Bins that a pass divides a range into.
BINS = 4096


def exact_percentiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float], large: int = 1_000_000, buffer: int = 50_000) -> DataFrame:
    """by, and a column for each name of probabilities: values at (n - 1) * p, linear between neighbours, as percentile() gives them.

    Groups of at most large values go through percentile(), whose buffer holds all distinct values of a group; larger ones,
    of which there are few, through selection: no buffer holds more than buffer values of them. Nulls don't count; a group
    of nulls has null percentiles; NaN is the largest value. Null keys are a group.
    """
    named = list(probabilities.items())
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    sizes = written(rows.where("_v is not null").groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "group_sizes")
    plain = lambda d: d.groupBy(*by).agg(*(F.percentile("_v", p).alias(n) for n, p in named))
    big = sizes.where(F.col("_n") > large)
    if not big.limit(1).count():
        return plain(rows)
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    keys = big.select(*by)
    small = plain(rows.join(F.broadcast(keys), same(rows, keys), "left_anti"))
    return small.unionByName(selected(rows, big, by, named, buffer))


def selected(rows: DataFrame, sizes: DataFrame, by: list[str], named: list[tuple[str, float]], buffer: int) -> DataFrame:
    """The percentiles of the groups in sizes (by, _n, _lo, _hi) of rows (by, _v), by narrowing."""
    position = lambda p: (F.col("_n") - 1) * p
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(f(position(p)).cast("long")) for _, p in named for f in (F.floor, F.ceil)))))
    state = written(sizes.select(*by, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_left"), "_lo", "_hi"), "ranks")
    done, even, steps = None, False, [state]
    while True:
        settled = (F.col("_left") <= buffer) | F.col("_lo").eqNullSafe(F.col("_hi"))
        done = state.where(settled) if done is None else done.unionByName(state.where(settled))
        open_ = state.where(~settled)
        if not open_.limit(1).count():
            break
        even = not even
        o = open_.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_rank", "_below", "_lo", "_hi")
        inside = rows.join(F.broadcast(o), [rows[c].eqNullSafe(o[f"_k{i}"]) for i, c in enumerate(by)] + [rows["_v"] >= o["_lo"], rows["_v"] <= o["_hi"]])
        # in turn shares of the range, halved so that they don't overflow, and of its logarithms, for values of many magnitudes
        at = (lambda c: F.col(c) / 2) if even else (lambda c: F.signum(c) * F.greatest(F.coalesce(F.log(F.abs(c)), F.lit(-750.0)) + 750, F.lit(0.0)))
        share = F.try_divide(at("_v") - at("_lo"), at("_hi") - at("_lo"))
        bin_ = F.when(F.col("_v") == F.col("_hi"), BINS).when(F.col("_v") == F.col("_lo"), -1).when(share.isNull() | F.isnan(share), 0).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * BINS), F.lit(BINS - 1))))
        counts = inside.groupBy(*by, "_rank", bin_.cast("int").alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.min("_below").alias("_below"))
        upto = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(W.partitionBy(*by, "_rank").orderBy("_bin")))
        state = written(upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank"))).select(*by, "_rank", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_left"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi")), "ranks")
        steps.append(state)
    found = written(found_values(rows, done, by), "selected")
    discard(*steps)
    out = sizes.select(*by, "_n")
    for name, p in named:
        for side, f in (("_x", F.floor), ("_y", F.ceil)):
            at = found.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_rank").alias("_r"), F.col("_value").alias(f"{side}{name}"))
            cond = [out[c].eqNullSafe(at[f"_k{i}"]) for i, c in enumerate(by)]
            out = out.join(F.broadcast(at), [*cond, f(position(p)).cast("long") == at["_r"]]).drop("_r", *(f"_k{i}" for i in range(len(by))))
    value = lambda n, p: F.when(F.col(f"_x{n}").eqNullSafe(F.col(f"_y{n}")), F.col(f"_x{n}")).otherwise((F.ceil(position(p)) - position(p)) * F.col(f"_x{n}") + (position(p) - F.floor(position(p))) * F.col(f"_y{n}"))
    return out.select(*by, *(value(n, p).alias(n) for n, p in named))


def found_values(rows: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """by, _rank, _value of ranks whose range is one value, or holds few values, which are sorted."""
    one = done.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*by, "_rank", F.col("_lo").alias("_value"))
    few = done.where(~F.col("_lo").eqNullSafe(F.col("_hi"))).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_rank", "_below", "_lo", "_hi")
    inside = rows.join(F.broadcast(few), [rows[c].eqNullSafe(few[f"_k{i}"]) for i, c in enumerate(by)] + [rows["_v"] >= few["_lo"], rows["_v"] <= few["_hi"]])
    place = (F.col("_rank") - F.min("_below")).cast("int")
    return one.unionByName(inside.groupBy(*by, "_rank").agg(F.get(F.sort_array(F.collect_list("_v")), place).alias("_value")))
