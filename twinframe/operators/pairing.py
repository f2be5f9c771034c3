"""Pairing of two modalities by keys, numbers, positions and clocks; each absence is a row with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import reasons


def pair_samples(ir: DataFrame, rgb: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing of three tables by keys; exclusion_reasons lists what is missing, usable says that nothing is."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = mark(ir, "has_ir").join(mark(rgb, "has_rgb"), keys, "full_outer").join(mark(frames, "has_frame"), keys, "full_outer")
    out = out.withColumn("exclusion_reasons", reasons(missing_ir=F.col("has_ir").isNull(), missing_rgb=F.col("has_rgb").isNull(), missing_frame_metadata=F.col("has_frame").isNull()))
    return out.drop("has_ir", "has_rgb", "has_frame").withColumn("usable", F.size("exclusion_reasons") == 0)


def pair_strict(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs, and an issue for each row whose key the other side doesn't have; a key with a null is never had.

    Issues need no join: the rows of both sides are counted by key, in tasks before they are shuffled.
    """
    codes = ("only_left", "only_right")
    counted = lambda df, code: df.select(*keys, *(F.lit(int(c == code)).alias(c) for c in codes))
    counts = counted(a, codes[0]).unionByName(counted(b, codes[1])).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in codes))
    unknown = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    n = lambda own, other: F.struct(F.lit(own).alias("code"), F.when(unknown | (F.col(other) == 0), F.col(own)).otherwise(0).alias("n"))
    issues = counts.select(*keys, F.inline(F.array(n(*codes), n(*codes[::-1])))).where("n > 0")
    # a row for each of n, by arrays of a bounded size
    issues = issues.select("code", *keys, "n", F.explode(F.expr("sequence(0, (n - 1) div 65536)")).alias("part"))
    return a.join(b, keys), issues.select("code", *keys, F.explode(F.expr("sequence(1, least(65536, n - part * 65536))")).alias("row")).drop("row")


def pair_numeric(files: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """files (group, modality, stem) paired by the number of the stem; stems that aren't numbers, numbers that a modality has twice, and leftovers are issues."""
    rows = files.withColumn("number", F.when(F.col("stem").rlike("^[0-9]{1,9}$"), F.col("stem").cast("int")))
    single = rows.where("number is not null").groupBy(*group, "modality", "number").agg(F.count("*").alias("n"), F.min("stem").alias("stem"))
    side = lambda m: single.where((F.col("modality") == m) & (F.col("n") == 1)).select(*group, "number", F.col("stem").alias(f"{m}_stem"))
    both = side("ir").join(side("rgb"), [*group, "number"], "full_outer")
    issue = lambda df, code: df.select(F.lit(code).alias("code"), *group, F.col("stem"))
    issues = issue(rows.where("number is null"), "not_a_number").unionByName(issue(single.where("n > 1"), "ambiguous_number"))
    left = both.where("ir_stem is null or rgb_stem is null").withColumn("stem", F.coalesce("ir_stem", "rgb_stem"))
    return both.where("ir_stem is not null and rgb_stem is not null"), issues.unionByName(issue(left, "unpaired"))


def pair_casefold(a: DataFrame, b: DataFrame, stem: str) -> DataFrame:
    """stem_key, a_stem, b_stem by stems without case; duplicates of a side are refused (is_duplicate), one side alone is tolerated."""
    side = lambda df, name: df.groupBy(F.lower(stem).alias("stem_key")).agg(F.min(stem).alias(f"{name}_stem"), F.count("*").alias(f"{name}_n"))
    both = side(a, "a").join(side(b, "b"), "stem_key", "full_outer")
    return both.select("stem_key", "a_stem", "b_stem", ((F.coalesce("a_n", F.lit(0)) > 1) | (F.coalesce("b_n", F.lit(0)) > 1)).alias("is_duplicate"))


def pair_or_zip(a: DataFrame, b: DataFrame, clip: str, key: str) -> DataFrame:
    """Per clip, pairs of a common key; a clip without any is paired by position in the order of its keys."""
    named = a.select(clip, F.col(key).alias("a_key")).join(b.select(clip, F.col(key).alias("b_key")), [clip]).where("a_key = b_key")
    order = W.partitionBy(clip).orderBy(key)
    numbered = lambda df, name: df.withColumn("pos", F.row_number().over(order)).select(clip, "pos", F.col(key).alias(name))
    common = a.select(clip, key).join(b.select(clip, key), [clip, key]).select(clip, F.col(key).alias("a_key"), F.col(key).alias("b_key"), F.lit("key").alias("how"))
    rest = numbered(a, "a_key").join(numbered(b, "b_key"), [clip, "pos"]).join(named.select(clip).distinct(), clip, "left_anti")
    return common.unionByName(rest.select(clip, "a_key", "b_key", F.lit("position").alias("how")))


def attach_groups(samples: DataFrame, assignments: DataFrame, keys: list[str], group: str = "leakage_group_id") -> DataFrame:
    """samples with their group and an issue: unmatched, empty group, or a key that is assigned twice (which doesn't multiply rows)."""
    one = assignments.groupBy(*keys).agg(F.min(group).alias(group), F.count("*").alias("times"))
    out = samples.join(one, keys, "left")
    issue = F.when(F.col("times").isNull(), "unmatched").when(F.col("times") > 1, "assigned_twice").when(F.coalesce(F.trim(group), F.lit("")) == "", "empty_group")
    return out.withColumn("issue", issue).drop("times")


def match_models(experiments: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: matched, experiment_without_model (fatal), or model_without_experiment (reported)."""
    a, b = experiments.select(*keys).distinct().withColumn("e", F.lit(1)), models.select(*keys).distinct().withColumn("m", F.lit(1))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("m").isNull(), "experiment_without_model").when(F.col("e").isNull(), "model_without_experiment").otherwise("matched").alias("status"))


def upsert_pairs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; where both have one, the new row wins, and of several the largest."""
    both = old.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("rank", *rest)).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest))


def align_streams(media: DataFrame) -> DataFrame:
    """media (clip, base_fps, base_frames, other_fps, other_frames), base the slower clock: for each base frame within both durations, its time and the nearest frame of the other, halves to the even one."""
    rows = media.withColumn("n", F.floor(F.least(F.expr("base_frames / base_fps"), F.expr("other_frames / other_fps")) * F.col("base_fps")).cast("int")).where("n > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("base_index"))
    t = F.col("base_index") / F.col("base_fps")
    nearest = F.least(F.col("other_frames") - 1, F.bround(t * F.col("other_fps")).cast("long"))
    return rows.select("clip", "base_index", F.round(t, 6).alias("t"), nearest.cast("long").alias("other_index"))


def align_by_index(a: DataFrame, b: DataFrame, clip: str, index: str) -> DataFrame:
    """Per clip, the frames that both streams have, and whether one ends early."""
    both = a.select(clip, index, F.lit(1).alias("a")).join(b.select(clip, index, F.lit(1).alias("b")), [clip, index], "full_outer")
    out = both.groupBy(clip).agg(F.count_if(F.expr("a = 1 and b = 1")).alias("common"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))
    return out.withColumn("ended_early", F.col("n_a") != F.col("n_b"))


def migrate_jobs(v1: DataFrame) -> DataFrame:
    """Version 1 jobs (task, files array<struct<modality, stem>>) as version 2: explicit pairs with literal provenance."""
    files = v1.select("task", F.explode("files").alias("f")).select("task", "f.modality", "f.stem")
    pairs, _ = pair_numeric(files, ["task"])
    one = F.struct(F.col("number").alias("clip"), F.col("ir_stem").alias("ir"), F.col("rgb_stem").alias("rgb"), F.lit("migrated").alias("provenance"))
    return pairs.groupBy("task").agg(F.sort_array(F.collect_list(one)).alias("pairs")).withColumn("schema_version", F.lit(2))


def split_members(samples: DataFrame, group_splits: DataFrame) -> DataFrame:
    """sample_id, split of the usable samples; the pool of train and validation comes as rows of its own; an unassigned group has a null split."""
    rows = samples.where("usable").join(group_splits, "leakage_group_id", "left")
    pool = rows.where("outer_split = 'train_pool'").select("sample_id", F.lit("train_pool").alias("split"))
    return rows.select("sample_id", F.col("inner_split").alias("split")).unionByName(pool)


def select_split(samples: DataFrame, members: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """The usable samples of a split, and issues: ids that are unknown, excluded or listed twice."""
    ids = members.where(F.col("split") == split).groupBy("sample_id").agg(F.count("*").alias("times"))
    rows = ids.join(samples, "sample_id", "left")
    code = F.when(F.col("usable").isNull(), "unknown").when(~F.col("usable"), "excluded").when(F.col("times") > 1, "listed_twice")
    return rows.where("usable").drop("times"), rows.select("sample_id", code.alias("code")).where("code is not null")
