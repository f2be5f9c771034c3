"""Quality rules whose thresholds come from the data: quantile sketches per language and source.

The sketch is a histogram with logarithmic buckets, each less than one part in 64 wide; sketches merge by adding
counts, so that they are built by partial sums on every task. A group's quantiles are drawn towards those of its
language's merged sketch, and these towards those of all documents, the more so the fewer documents stand behind them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, scratch, slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks")
#: Metric: (numerator, units for each word).
METRICS = {"symbols": ("n_symbols", 1000), "marks": ("n_marks", 1000), "dup_lines": ("n_dup_lines", 1000), "length": ("word_chars", 100)}
#: A limit is so many spreads beyond the quartile.
SPREADS = 8
QUANTILES = (10, 25, 50, 75)
#: A group of so many documents has the mean of its own quantiles and the wider group's; the weights are cubes, since a
#: third of a few documents may be junk, and a limit is several spreads beyond a quantile.
SHRINK = 24
#: More groups than these are joined by a shuffle, fewer by a broadcast.
MOST_BROADCAST = 20_000


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of width words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n <= 100_000:
        if len(set(zip(*(words[i:] for i in range(width)), strict=False))) == n:
            return 0
        times = Counter(zip(*(words[i:] for i in range(width)), strict=False))
        twice = np.fromiter((times[w] > 1 for w in zip(*(words[i:] for i in range(width)), strict=False)), bool, n)
    else:  # long texts: ranks of ever longer windows, which are exact and take a few numbers for each word
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
        ranks = ids
        for i in range(1, width):
            ranks = np.unique(ranks[:-1] * len(names) + ids[i:], return_inverse=True)[1].astype(np.int64)
        twice = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + n] |= twice
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8; words are what stands between the six ASCII blanks."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in BLANKS)
    return len(words), chars, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), text.count(b"!")


def counts_of(column: str) -> Column:
    @F.arrow_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(c, pa.int64()) for c in COUNTS])
        for texts in batches:
            yield pa.array([dict(zip(COUNTS, text_counts(t), strict=True)) for part in slices(texts) for t in as_bytes(part)], kind)

    return counts(column)


def failed_base() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(value: str) -> Column:
    """The lower end of a value's bucket: its first seven binary digits."""
    return F.expr("({0} >> greatest(length(bin({0})) - 7, 0)) << greatest(length(bin({0})) - 7, 0)".format(value))


def sketches(rows: DataFrame) -> DataFrame:
    """rows (lang, source, COUNTS) -> lang, source, metric, bucket, n: of the rows that don't fail the base rules."""
    values = {m: f"{k} * {c} div nullif(n_words, 0)" for m, (c, k) in METRICS.items()} | {"words": "n_words"}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(v).alias("value")) for m, v in values.items())))
    long = rows.where(~failed_base()).select("lang", "source", each.alias("m")).select("lang", "source", "m.metric", "m.value")
    return long.withColumn("bucket", bucket("value")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, metric, total, q10, q25, q50, q75: a sketch's windows are over its buckets, at most a few thousand whatever the rows."""
    group = W.partitionBy(*by, "metric")
    running = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    return running.groupBy(*by, "metric").agg(F.max("total").alias("total"), *(at(p).alias(f"q{p}") for p in QUANTILES))


def shrunk(own: str, wide: str) -> Column:
    """The mean of two quantiles, own with the weight of the cube of total, wide with that of SHRINK's."""
    n = F.col("total").cast("double") * F.col("total") * F.col("total")
    return F.floor((n * F.col(own) + SHRINK**3 * F.col(wide)) / (n + SHRINK**3)).cast("bigint")


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and a column <metric>_max for each metric, and length_min.

    An upper limit is the upper quartile plus SPREADS times its distance to the median, which junk that makes up
    less than a quarter of a group doesn't move. To each spread comes what one more occurrence, or one more word's
    length, makes in a text of the group's tenth-lowest number of words: where most texts have none, short ones with
    a few are not junk; and to the limit, one bucket of the sketch. The least length mirrors this below the median.
    Quantiles are shrunk() towards the language's and these, but for the lengths of words and texts, towards all documents'.
    """
    sketch = scratch(sketches(rows), "sketch")
    own, wide, all_ = quantiles(sketch, "lang", "source"), quantiles(merged(sketch, "lang"), "lang"), quantiles(merged(sketch))
    named = lambda df, c, *also: df.select(*also, F.col("metric").alias(f"{c}_metric"), F.col("total").alias(f"{c}_total"), *(F.col(f"q{p}").alias(f"{c}{p}") for p in QUANTILES))
    wide = wide.join(F.broadcast(named(all_, "a")), F.col("metric") == F.col("a_metric"))  # one row for each metric
    like_all = ~F.col("metric").isin("length", "words")
    wide = named(wide.select("lang", "metric", "total", *(F.when(like_all, shrunk(f"q{p}", f"a{p}")).otherwise(F.col(f"q{p}")).alias(f"q{p}") for p in QUANTILES)), "w", F.col("lang").alias("l"))
    both = own.join(wide, own.lang.eqNullSafe(wide.l) & (own.metric == wide.w_metric))
    both = both.select("lang", "source", "metric", *(shrunk(f"q{p}", f"w{p}").alias(f"q{p}") for p in QUANTILES))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.struct(*(f"q{p}" for p in QUANTILES)))).alias(m)
    each = both.groupBy("lang", "source").agg(*(of(m) for m in (*METRICS, "words")))
    one = lambda m: f"{SPREADS} * {'length.q50' if m == 'length' else METRICS[m][1]} div words.q10"
    upper = [F.expr(f"{m}.q75 + {m}.q75 div 64 + {SPREADS} * ({m}.q75 - {m}.q50) + {one(m)}").alias(f"{m}_max") for m in METRICS]
    return each.select("lang", "source", *upper, F.expr(f"length.q25 - {SPREADS} * (length.q50 - length.q25) - {one('length')}").alias("length_min"))


def _judged(rows: DataFrame, counts: str | None, limits: DataFrame) -> DataFrame:
    """rows with two more columns, _failed and _kept, by the limits of their language and source."""
    get = (lambda c: f"`{c}`") if counts is None else (lambda c: f"{counts}.{c}")
    limits = limits.select(F.struct("*").alias("_limits"))
    few = limits.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(limits) if few else limits, rows["lang"].eqNullSafe(F.col("_limits.lang")) & rows["source"].eqNullSafe(F.col("_limits.source")), "left")
    failed = F.expr(f"{get('n_words')} < 10 or 100 * {get('n_repeat_words')} > 20 * {get('n_words')}")
    tests = [F.expr(f"{k} * {get(c)} div nullif({get('n_words')}, 0) <= _limits.{m}_max") for m, (c, k) in METRICS.items()]
    tests.append(F.expr(f"100 * {get('word_chars')} div nullif({get('n_words')}, 0) >= _limits.length_min"))
    passed = tests[0]
    for t in tests[1:]:
        passed &= t
    return joined.withColumn("_failed", failed).withColumn("_kept", F.when(F.col("_failed"), False).otherwise(F.coalesce(passed, F.lit(True)))).drop("_limits")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_marks.

    A null text has no words and fails the base rules, as an empty one does. Null languages and sources are
    groups of their own; null doc_ids stay null; repeated rows are judged each; an empty table gives no rows.
    """
    rows = scratch(docs.select("doc_id", "lang", "source", counts_of("text").alias("c")).select("doc_id", "lang", "source", "c.*"), "counts")
    judged = _judged(rows, None, thresholds(rows))
    return judged.select("doc_id", *COUNTS[:5], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), "n_marks")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are; the counts are written beside the rows, so that texts are read once and never shuffled."""
    name = f"_c{uuid.uuid4().hex[:8]}"
    rows = scratch(docs.withColumn(name, counts_of("text")), "counted")
    return _judged(rows, name, thresholds(rows.select("lang", "source", f"{name}.*"))).where("_kept").select(*docs.columns)
