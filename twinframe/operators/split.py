"""Leakage-safe splits: a seeded search over assignments of whole groups, scored by how well shares are balanced."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.steps import written

#: Weights of the squared relative errors.
WEIGHTS = {"pairs": 4.0, "experiments": 3.0, "category": 2.0, "metadata": 0.2}


def group_features(samples: DataFrame, metadata: tuple[str, ...] = ()) -> DataFrame:
    """leakage_group_id, kind, name, value, long: usable pairs, experiments, pairs of each category, and 1 for each metadata value that a group has, but for null and empty ones."""
    rows = samples.where("usable")
    g = "leakage_group_id"
    count = lambda kind, name: rows.groupBy(g, name.alias("name")).agg(F.count("*").cast("double").alias("value")).select(g, F.lit(kind).alias("kind"), "name", "value")
    out = count("pairs", F.lit("all")).union(rows.groupBy(g).agg(F.countDistinct("experiment_key").cast("double").alias("value")).select(g, F.lit("experiments"), F.lit("all"), "value"))
    out = out.union(count("category", F.col("category")))
    for m in metadata:
        name = F.concat(F.lit(f"{m}="), F.col(m))
        out = out.union(rows.where(F.col(m) != "").select(g, F.lit("metadata").alias("kind"), name.alias("name"), F.lit(1.0).alias("value")).distinct())
    return out


def target_groups(n: int, ratio: float) -> int:
    """Groups of the second outcome, at least one on either side: each outcome has the whole part of its share, and what is left over goes to the larger remainder, of equal ones to the larger share, then to the first outcome."""
    shares = [n * (1 - ratio), n * ratio]
    whole = [max(1, math.floor(x)) for x in shares]
    if sum(whole) < n:
        left = [(x - math.floor(x), r) for x, r in zip(shares, (1 - ratio, ratio), strict=True)]
        whole[1 if left[1] > left[0] else 0] += 1
    return min(n - 1, whole[1])


def stage_score(features: DataFrame, assigned: DataFrame, ratio: float) -> DataFrame:
    """trial, score of assigned (trial, leakage_group_id, second): weighted squared errors, for both outcomes and each feature, of what the outcome has against its share of the whole, relative to that or to 1 if it is less."""
    totals = features.groupBy("kind", "name").agg(F.sum("value").alias("total"))
    got = assigned.join(features, "leakage_group_id").groupBy("trial", "kind", "name").agg(F.sum(F.when(F.col("second"), F.col("value")).otherwise(0.0)).alias("got"))
    weight = F.expr("case kind " + " ".join(f"when '{k}' then {w}D" for k, w in WEIGHTS.items()) + " end")
    square = lambda have, share: F.pow((have - F.col("total") * share) / F.greatest(F.lit(1.0), F.col("total") * share), 2)
    both = square(F.col("got"), ratio) + square(F.col("total") - F.col("got"), 1 - ratio)
    return got.join(totals, ["kind", "name"]).groupBy("trial").agg(F.round(F.sum(weight * both), 9).alias("score"))


def trial_table(groups: DataFrame, seed: int, trials: int, second: int) -> DataFrame:
    """Every trial ranks the groups by a seeded hash; the first of them are the second outcome. One window for each trial, over the groups alone."""
    rows = groups.select("leakage_group_id").distinct().select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("trial"), "leakage_group_id")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), "leakage_group_id"), 256)
    rank = F.row_number().over(W.partitionBy("trial").orderBy(order))
    return rows.withColumn("second", rank <= second)


def greedy_table(features: DataFrame, seed: int, trials: int, second: int, ratio: float, most_groups: int = 5_000) -> DataFrame:
    """trial, leakage_group_id, second: every trial takes the groups one by one, those of most pairs, then of most experiments first, equals by a seeded hash, and puts each where the score is lower and there is room; ties by the hash.

    A trial is one task's work and needs all groups' features, which are sent to all: more than most_groups are refused,
    for which trial_table() is the way.
    """
    rows = features.groupBy("leakage_group_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "name"), "value"))).alias("f")).limit(most_groups + 1).collect()
    if len(rows) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    names = sorted({k for r in rows for k in r["f"]})
    ids = [r["leakage_group_id"] for r in rows]
    x = np.array([[r["f"].get(k, 0.0) for k in names] for r in rows]).reshape(len(ids), -1)
    weight = np.array([WEIGHTS[k.split(":", 1)[0]] for k in names])
    size = [tuple(r["f"].get(k, 0.0) for k in ("pairs:all", "experiments:all")) for r in rows]

    def run(frames):
        for frame in frames:
            for trial in frame["trial"]:
                draw = [hashlib.sha256(f"{seed}:{trial}:{g}".encode()).digest() for g in ids]
                target = np.array([1 - ratio, ratio])[:, None] * x.sum(axis=0)[None]
                have, room, chosen = np.zeros_like(target), [len(ids) - second, second], {}
                for g in sorted(range(len(ids)), key=lambda g: (-size[g][0], -size[g][1], draw[g])):
                    scores = []
                    for side in (0, 1):
                        have[side] += x[g]
                        scores.append((weight * ((have - target) / np.maximum(1.0, target)) ** 2).sum() if room[side] else np.inf)
                        have[side] -= x[g]
                    side = draw[g][0] & 1 if abs(scores[0] - scores[1]) < 1e-12 else int(scores[1] < scores[0])
                    have[side] += x[g]
                    room[side] -= 1
                    chosen[ids[g]] = bool(side)
                yield pd.DataFrame({"trial": trial, "leakage_group_id": list(chosen), "second": list(chosen.values())})

    return features.sparkSession.range(trials).select(F.col("id").alias("trial")).mapInPandas(run, "trial bigint, leakage_group_id string, second boolean")


def assign_stage(features: DataFrame, ratio: float, seed: int, trials: int = 256, greedy: bool = False, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """leakage_group_id, second: of the trials, the one of the lowest score; of equals, the one whose outcomes, by the names of outcomes in the order of the groups, come first; then the first trial."""
    features = written(features, "features")  # a few rows for each group, read many times
    n = features.select("leakage_group_id").distinct().count()
    if n < 2:
        raise ValueError("a split needs two groups or more")
    second = target_groups(n, ratio)
    table = greedy_table(features, seed, trials, second, ratio) if greedy else trial_table(features, seed, trials, second)
    scores = written(stage_score(features, table, ratio), "scores")
    lowest = scores.join(scores.agg(F.min("score").alias("low"))).where("score = low").select("trial")
    signature = F.transform(F.sort_array(F.collect_list(F.struct("leakage_group_id", "second"))), lambda x: F.when(x["second"], names[1]).otherwise(names[0]))
    best = table.join(lowest, "trial").groupBy("trial").agg(signature.alias("signature")).agg(F.min(F.struct("signature", "trial")).alias("best")).select(F.col("best.trial").alias("trial"))
    return table.join(best, "trial", "left_semi").select("leakage_group_id", "second")


def nested_group_split(samples: DataFrame, test_ratio: float = 0.2, val_ratio: float = 0.2, seed: int = 42, trials: int = 256, least_groups: int = 6, metadata: tuple[str, ...] = (), greedy: bool = False) -> DataFrame:
    """leakage_group_id, outer_split, inner_split: test against the pool, then validation against train within it, with a seed of its own."""
    features = written(group_features(samples, metadata), "features")
    if features.select("leakage_group_id").distinct().count() < least_groups:
        raise ValueError(f"fewer than {least_groups} usable groups")
    outer = assign_stage(features, test_ratio, seed, trials, greedy, ("train_pool", "test"))
    pool = features.join(outer.where("not second"), "leakage_group_id", "left_semi")
    inner = assign_stage(pool, val_ratio, seed * 7919 + 17, trials, greedy, ("train", "val")).withColumnRenamed("second", "val")
    return outer.join(inner, "leakage_group_id", "left").select("leakage_group_id", F.when(F.col("second"), "test").otherwise("train_pool").alias("outer_split"), F.when(F.col("second"), "test").when(F.col("val"), "val").otherwise("train").alias("inner_split"))


def experiment_assignments(samples: DataFrame, group_splits: DataFrame) -> DataFrame:
    return samples.select("experiment_key", "leakage_group_id").distinct().join(group_splits, "leakage_group_id")
