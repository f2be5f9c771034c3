"""Toxicity by non-negative learning from positive and unlabelled text.

Confirmed toxic documents are the positives; documents without a label are the unlabelled rest, of which a
share, the class prior, is toxic too. The risk of a classifier is then prior * R(positive as 1) + max(0,
R(unlabelled as 0) - prior * R(positive as 0)); where the second part falls below zero, the step goes against it,
so that a flexible model cannot fit the unlabelled rest as if it were clean. Some classifiers, linear over the
word parts that positives have far oftener, are trained with numpy on shards of the sample and averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_strings, scratch, slices

#: Buckets of the hash of word parts, and classifiers.
BUCKETS, SHARDS = 1 << 20, 4
#: A part is used if so many times as large a share of the positives has it, even with one standard deviation
#: fewer of them, and so large a share of the positives does.
LEAST_RATIO, LEAST_SHARE = 3.0, 0.005
_EDGE = ".,;:!?\"'()[]{}…»«"


def parts_of(word: str) -> list[int]:
    """Buckets of a word and of its four-letter parts, with marks for its start and end; of a word of any length, at most BUCKETS."""
    w = f"^{word.strip(_EDGE)}$"
    if len(w) <= 2:
        return []
    return list({xxhash.xxh32_intdigest(w) % BUCKETS, *(xxhash.xxh32_intdigest(w[i : i + 4]) % BUCKETS for i in range(len(w) - 3))})


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from: every fifth by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _share(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About most of n rows, by a hash of their id."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(frame: pd.DataFrame, n_parts: int, prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of the parts, then the bias, that have the least non-negative risk under the logistic loss, by Adam."""
    row = np.repeat(np.arange(len(frame)), frame["parts"].map(len))
    column = np.concatenate([np.asarray(p, np.int64) for p in frame["parts"]] or [np.empty(0, np.int64)]).astype(np.int64)
    positive = frame["positive"].to_numpy(bool)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w = np.zeros(n_parts + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(frame)) + w[-1]
        toxic = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        as_clean = np.logaddexp(0, z)
        rest = as_clean[~positive].sum() / n_u - prior * as_clean[positive].sum() / n_p
        # gradients by z of the positive part and of the part that must not be negative
        g_pos = np.where(positive, -prior * (1 - toxic) / n_p, 0.0)
        g_rest = np.where(positive, -prior * toxic / n_p, toxic / n_u)
        g = g_pos + g_rest if rest >= 0 else -g_rest
        grad = np.append(np.bincount(column, weights=g[row], minlength=n_parts), g.sum())
        grad[:-1] += decay * w[:-1] / n_parts
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 6_000, most_rest: int = 12_000, most_parts: int = 8_192) -> tuple[dict[int, float], float] | None:
    """Weight of each part's bucket, and the bias; None if no positive can be learnt from. If no document is without a label, all learnable ones are the rest.

    The prior is counted over all labels. The classifiers are fitted on a sample: about most_positive of the positives
    and most_rest of the rest, those of the lowest hash, or all of them if there are fewer; and on the most_parts parts
    that tell the two apart best. Larger bounds cost time in proportion, on SHARDS tasks.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    ids = scratch(ids.join(known, ids.id == known.doc_id, "left").select("id", "toxic"), "learnable")
    n = ids.agg(F.count_if(F.expr("toxic = 1")).alias("p"), F.count("toxic").alias("known"), F.count_if(F.expr("toxic is null")).alias("u")).first()
    if not n["p"]:
        return None
    rest, n_rest = (ids.where("toxic is null"), n["u"]) if n["u"] else (ids, n["known"])
    prior = min(0.95, max(0.001, n["p"] / n["known"]))
    sample = _share(ids.where("toxic = 1"), n["p"], most_positive).select("id", F.lit(True).alias("positive")).union(_share(rest, n_rest, most_rest).select("id", F.lit(False).alias("positive")))
    # the sample is bounded by most_positive and most_rest, but for the spread of the hash
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    texts = scratch(texts.select("id", "positive", F.coalesce("text", F.lit("")).alias("text")), "toxic_sample")

    def counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = Cache(parts_of, 100_000), np.zeros((2, BUCKETS), np.int64)
        for batch in frames:
            for text, positive in zip(as_strings(batch.column("text")), batch.column("positive").to_pylist(), strict=True):
                seen[int(positive), list({p for w in words_of(text) for p in parts[w]})] += 1
            parts.trim()
        bucket = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bucket, seen[1, bucket], seen[0, bucket], np.zeros_like(bucket))], names=["bucket", "p", "u", "zero"])
        bucket = np.flatnonzero((seen[0] > 0) & (seen[1] == 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (bucket, np.zeros_like(bucket), seen[0, bucket], np.zeros_like(bucket))], names=["bucket", "p", "u", "zero"])

    total = texts.agg(F.count_if(F.expr("positive")).alias("p"), F.count_if(F.expr("not positive")).alias("u")).first()
    table = texts.select("text", "positive").mapInArrow(counts, "bucket bigint, p bigint, u bigint, zero bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    if not n["u"]:  # of all documents' share of a part, what is not the positives'; else a common class would hide its own parts
        clean = (F.col("u") - prior * F.col("p") / max(1, total["p"]) * total["u"]) / (1 - prior)
        table = table.withColumn("u", F.greatest(F.lit(0.0), clean))
    ratio = ((F.col("p") - F.sqrt("p")) / max(1, total["p"])) / ((F.col("u") + 0.5) / max(1, total["u"]))
    used = table.where((F.col("p") >= max(2, LEAST_SHARE * total["p"])) & (ratio >= LEAST_RATIO)).orderBy(F.desc(F.col("p") * F.ln(ratio)), "bucket").limit(most_parts).toPandas()["bucket"].tolist()
    place = {b: i for i, b in enumerate(used)}

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = Cache(lambda w: [place[p] for p in parts_of(w) if p in place], 100_000)
        for frame in frames:
            yield pd.DataFrame({"shard": frame["shard"], "positive": frame["positive"], "parts": [sorted({p for w in words_of(t) for p in chosen[w]}) for t in frame["text"]]})
            chosen.trim()

    rows = texts.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SHARDS)).cast("int").alias("shard"), "positive", "text")
    rows = rows.mapInPandas(shorten, "shard int, positive boolean, parts array<int>")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"weights": [train(frame, len(used), prior)], "positives": [int(frame["positive"].sum())]})

    learnt = rows.groupBy("shard").applyInPandas(learn, "weights array<double>, positives bigint").where("positives > 0").toPandas()
    mean = np.mean(np.stack(learnt["weights"].tolist()), axis=0)
    return dict(zip(used, mean[:-1].tolist(), strict=True)), float(mean[-1])


def score_column(model: tuple[dict[int, float], float] | None, spark, column: str = "text") -> Column:
    """Probability, by the model, that a text is toxic; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        chosen = Cache(lambda w: tuple(p for p in parts_of(w) if p in weights), 300_000)
        for texts in batches:
            z = []
            for part in slices(texts):
                for text in as_strings(part):
                    z.append(bias + sum(weights[p] for p in sorted({p for w in words_of(text) for p in chosen[w]})))
                chosen.trim()
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -40, 40))), pa.float64())

    return score(column)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5). bounds are those of fit().

    Null and empty texts get the score of no words. Null doc_ids stay null, are not held out and have no label;
    where a doc_id has several labels, toxic wins; repeated rows are scored each. Without a positive label to
    learn from, all scores are 0. An empty table gives no rows.
    """
    score = score_column(fit(docs, labels, **bounds), docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of docs that score below 0.5, all columns as they are; edge cases as in toxicity()."""
    return docs.where(score_column(fit(docs, labels, **bounds), docs.sparkSession) < 0.5)
