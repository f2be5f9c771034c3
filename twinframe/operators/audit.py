"""Contracts, rollups, leaks and gates over samples, groups and splits; violations are rows (level, code, key)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import safe_path
from .pairing import select_split


def experiment_contract(samples: DataFrame, required: list[str], n_clips: int = 1) -> DataFrame:
    """Per experiment: categories that are missing or not allowed, categories with another number of clips, and the number of groups; ok if all is as asked."""
    cats = samples.groupBy("experiment_key", "category").agg(F.countDistinct("clip_id").alias("clips"))
    groups = samples.groupBy("experiment_key").agg(F.countDistinct("leakage_group_id").alias("n_groups"))
    want = F.array(*(F.lit(c) for c in sorted(required)))
    out = cats.groupBy("experiment_key").agg(F.sort_array(F.collect_set("category")).alias("have"), F.count_if(F.col("clips") != n_clips).alias("bad_clip_counts"))
    out = out.join(groups, "experiment_key").select("experiment_key", F.array_join(F.array_except(want, "have"), ",").alias("missing"), F.array_join(F.array_except("have", want), ",").alias("unexpected"), "bad_clip_counts", "n_groups")
    return out.withColumn("ok", F.expr("missing = '' and unexpected = '' and bad_clip_counts = 0 and n_groups = 1"))


def group_rollup(samples: DataFrame, lists: list[str], single: list[str]) -> DataFrame:
    """Per group: the sorted distinct values of lists, the number of usable pairs, and which of the columns in single have more than one value."""
    sets = [F.array_join(F.sort_array(F.collect_set(c)), ",").alias(f"{c}s") for c in lists]
    many = F.array_compact(F.array(*(F.when(F.countDistinct(c) > 1, F.lit(c)) for c in single)))
    return samples.groupBy("leakage_group_id").agg(*sets, F.count_if("usable").alias("pair_count"), F.array_join(many, ",").alias("not_single"))


def category_counts(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs and distinct groups of each split and category."""
    return members.join(samples, "sample_id").groupBy("split", "category").agg(F.count("*").alias("pairs"), F.countDistinct("leakage_group_id").alias("groups"))


def uncovered(counts: DataFrame) -> DataFrame:
    """Splits that lack a category; both lists are as small as the enumerations they name."""
    splits, cats = counts.select("split").distinct(), counts.select("category").distinct()
    return splits.join(cats).join(counts, ["split", "category"], "left_anti")


def sufficiency(samples: DataFrame, least: int) -> DataFrame:
    return samples.where("usable").agg(F.countDistinct("leakage_group_id").alias("groups")).withColumn("enough", F.col("groups") >= least)


def complete_experiments(samples: DataFrame, required: list[str], clips: int = 1) -> DataFrame:
    """experiment_key of those that have exactly the required categories, each with exactly so many clips."""
    counts = samples.groupBy("experiment_key", "category").agg(F.countDistinct("clip_id").alias("n"))
    right = F.col("category").isin(required) & (F.col("n") == clips)
    return counts.groupBy("experiment_key").agg(F.count("*").alias("all"), F.count_if(right).alias("right")).where((F.col("right") == len(required)) & (F.col("all") == len(required))).select("experiment_key")


def readiness(samples: DataFrame, required: list[str], clips: int = 1) -> DataFrame:
    """Per category: clips, and how many experiments are complete in all."""
    complete = complete_experiments(samples, required, clips).agg(F.count("*").alias("complete_experiments"))
    return samples.groupBy("category").agg(F.countDistinct("clip_id").alias("clips")).join(F.broadcast(complete))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """A SHA-256 of the rows whatever their order: of how many there are and, for four parts of their own digests, the sums. One aggregation with partial sums, so no task holds rows together."""
    row = F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))), 256)
    part = lambda i: F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)]
    return df.select(row.alias("h")).agg(F.count("*").cast("string").alias("n"), *sums).select(F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("digest"))


def exact_duplicates(samples: DataFrame, members: DataFrame, hashes: dict[str, str]) -> DataFrame:
    """Content that more than one group has, of each modality (hashes: its column): fatal if it is in two splits or more, else a warning. Unusable rows count too; null and empty hashes are none.

    Samples and their splits meet once by sample; contents are added up by group first, then over groups, each time within
    tasks before the shuffle, so that a content that most samples share is a few rows.
    """
    splits = members.where("split <> 'train_pool'").groupBy("sample_id").agg(F.collect_set("split").alias("in"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), F.col(c).alias("sha")) for m, c in sorted(hashes.items()))))
    rows = samples.select("sample_id", "leakage_group_id", *hashes.values()).repartition("sample_id").distinct().join(splits, "sample_id", "left")
    rows = rows.select("sample_id", "leakage_group_id", "in", each.alias("h")).select("sample_id", "leakage_group_id", "in", "h.modality", "h.sha").where("sha <> ''")
    own = rows.groupBy("modality", "sha", "leakage_group_id").agg(F.count("*").alias("copies"), F.array_distinct(F.flatten(F.collect_set("in"))).alias("in"))
    out = own.groupBy("modality", "sha").agg(F.count("leakage_group_id").alias("groups"), F.size(F.array_distinct(F.flatten(F.collect_set("in")))).cast("long").alias("splits"), F.sum("copies").alias("copies")).where("groups > 1")
    across = F.col("splits") > 1
    return out.withColumn("level", F.when(across, "fatal").otherwise("warning")).withColumn("code", F.when(across, "cross_split_exact_duplicate").otherwise("cross_group_exact_duplicate"))


def duplicate_media(files: DataFrame, digest) -> DataFrame:
    """Files of equal size, and only those hashed by digest(), that have equal content under two tasks or more."""
    sizes = files.groupBy("length").agg(F.countDistinct("task").alias("n")).where("n > 1").select("length")
    return digest(files.join(sizes, "length", "left_semi")).groupBy("sha").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("files")).where("tasks > 1")


def fingerprint_leaks(groups: DataFrame, group_splits: DataFrame) -> DataFrame:
    """groups (leakage_group_id, fingerprints): source fingerprints that occur in more than one split."""
    rows = groups.select("leakage_group_id", F.explode("fingerprints").alias("fp")).join(group_splits, "leakage_group_id")
    return rows.groupBy("fp").agg(F.countDistinct("inner_split").alias("splits")).where("splits > 1")


def split_overlaps(members: DataFrame, key: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """How many keys each two splits share."""
    sets = members.groupBy(key).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(splits, 2)))
    rows = sets.select("s", F.explode(pairs).alias("p")).where(F.expr("array_contains(s, p.a) and array_contains(s, p.b)"))
    return rows.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("shared"))


def pool_consistency(members: DataFrame) -> DataFrame:
    """Ids that break train_pool = train + val, or that are in train_pool and test."""
    ids = lambda *s: members.where(F.col("split").isin(*s)).select("sample_id").distinct()
    code = lambda df, c: df.select("sample_id", F.lit(c).alias("code"))
    pool, parts = ids("train_pool"), ids("train", "val")
    return code(pool.exceptAll(parts), "pool_only").union(code(parts.exceptAll(pool), "missing_in_pool")).union(code(pool.intersect(ids("test")), "pool_and_test"))


def assignment_coverage(expected: DataFrame, actual: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Keys that only one side has, that the assignment lists twice, or for which it has another value than expected."""
    of = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c), *([F.min(value).alias(f"{c}_v"), F.max(value).alias(f"{c}_w")] if value else []))
    code = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unknown").when(F.col("a") > 1, "duplicate")
    if value:
        code = code.when(~F.col("e_v").eqNullSafe(F.col("a_v")) | ~F.col("e_w").eqNullSafe(F.col("a_w")), "mismatch")
    return of(expected, "e").join(of(actual, "a"), key, "full_outer").select(key, code.alias("code")).where("code is not null")


def member_issues(members: DataFrame, samples: DataFrame) -> DataFrame:
    """Listed ids that are unknown, excluded, or listed twice in a split."""
    rows = members.groupBy("split", "sample_id").agg(F.count("*").alias("n")).join(samples.select("sample_id", "usable"), "sample_id", "left")
    return rows.select("split", "sample_id", F.when(F.col("usable").isNull(), "unknown").when(~F.col("usable"), "excluded").when(F.col("n") > 1, "duplicate").alias("code")).where("code is not null")


def row_issues(samples: DataFrame, rules: dict[str, tuple[str, object]], key: str = "sample_id") -> DataFrame:
    """key, level, code: one row for each rule (code: (level, condition)) that a sample breaks."""
    hits = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, (level, cond) in rules.items())))
    return samples.select(key, F.explode(hits).alias("i")).select(key, "i.level", "i.code")


def sample_issues(samples: DataFrame, groups: DataFrame, files: DataFrame, ir_modes: list[str], rgb_modes: list[str]) -> DataFrame:
    """key, level, code: all that is wrong with samples (sample_id, leakage_group_id, ir_path, rgb_path, usable).

    groups (leakage_group_id) are the known ones, files (path, readable, width, height, mode) what is there. Paths and
    files are only looked at for usable samples, files only where both paths are safe.
    """
    times = samples.groupBy("sample_id").agg(F.count("*").alias("times"))
    known = groups.select("leakage_group_id", F.lit(True).alias("known")).distinct()
    image = lambda m: files.select(F.col("path").alias(f"{m}_file"), *(F.col(c).alias(f"{m}_{c}") for c in ("readable", "width", "height", "mode")))
    rows = samples.join(times, "sample_id", "left").join(known, "leakage_group_id", "left").withColumns({f"{m}_safe": safe_path(F.col(f"{m}_path")) for m in ("ir", "rgb")})
    for m in ("ir", "rgb"):
        rows = rows.join(image(m), F.col(f"{m}_safe") == F.col(f"{m}_file"), "left")
    c = F.col
    safe = c("usable") & c("ir_safe").isNotNull() & c("rgb_safe").isNotNull()
    there = safe & c("ir_file").isNotNull() & c("rgb_file").isNotNull()
    seen = there & c("ir_readable") & c("rgb_readable")
    stem = lambda m: F.regexp_replace(f"{m}_safe", r"^.*/|\.[^./]*$", "")
    empty = F.coalesce(F.trim("leakage_group_id"), F.lit("")) == ""
    rules = {
        "duplicate_sample_id": ("fatal", c("times") > 1), "sample_missing_group": ("fatal", empty), "unknown_group": ("fatal", ~empty & c("known").isNull()),
        "preview_in_samples": ("fatal", F.coalesce("ir_path", F.lit("")).contains("sync_preview") | F.coalesce("rgb_path", F.lit("")).contains("sync_preview")),
        "excluded_sample": ("warning", ~c("usable")), "invalid_path": ("fatal", c("usable") & ~safe), "stem_mismatch": ("fatal", safe & (stem("ir") != stem("rgb"))),
        "missing_ir": ("fatal", safe & c("ir_file").isNull()), "missing_rgb": ("fatal", safe & c("rgb_file").isNull()), "unreadable_image": ("fatal", there & ~seen),
        "size_mismatch": ("fatal", seen & ((c("ir_width") != c("rgb_width")) | (c("ir_height") != c("rgb_height")))),
        "ir_mode_mismatch": ("fatal", seen & ~c("ir_mode").isin(*ir_modes)), "rgb_mode_mismatch": ("fatal", seen & ~c("rgb_mode").isin(*rgb_modes)),
    }
    return row_issues(rows, rules)


def registration_review(correlations: DataFrame, least: float = 0.10) -> DataFrame:
    """correlations (edge_correlation, and, if there, usable and preview_exists) of the usable samples with review and note: at least so much passes, for information only; less, or none, is reviewed by a person."""
    rows = correlations.where("usable") if "usable" in correlations.columns else correlations
    lacking = ~F.coalesce("preview_exists", F.lit(False)) if "preview_exists" in correlations.columns else F.lit(False)
    none = F.col("edge_correlation").isNull() | F.isnan("edge_correlation")
    passed = ~none & (F.col("edge_correlation") >= least)
    notes = F.concat_ws(";", F.when(lacking, "missing_sync_preview"), F.when(none, "edge_correlation_unavailable"))
    return rows.withColumn("review", F.when(passed, "pass_information_only").otherwise("manual_review")).withColumn("note", notes)


def audit_summary(issues: DataFrame, enough_groups: bool) -> DataFrame:
    out = issues.agg(F.count_if(F.expr("level = 'fatal'")).alias("fatals"), F.count_if(F.expr("level = 'error'")).alias("errors"), F.count_if(F.expr("level = 'warning'")).alias("warnings"))
    return out.withColumn("formal_ready", (F.col("fatals") == 0) & F.lit(enough_groups))


def shared_issues(samples: DataFrame, inner: DataFrame) -> DataFrame:
    """level, code, key: a fatal issue for each two splits that share samples or groups."""
    shared = lambda df, key, code: split_overlaps(df, key).select(F.lit("fatal").alias("level"), F.lit(code).alias("code"), F.concat_ws("/", "split_a", "split_b").alias("key"))
    groups = inner.join(samples.select("sample_id", "leakage_group_id"), "sample_id")
    return shared(inner, "sample_id", "shared_sample").union(shared(groups, "leakage_group_id", "shared_group"))


def basic_audit(samples: DataFrame, members: DataFrame) -> DataFrame:
    """Issues of a split: shared samples or groups, an inconsistent pool, splits without a category."""
    inner = members.where("split <> 'train_pool'")
    out = shared_issues(samples, inner).union(pool_consistency(members).select(F.lit("fatal"), "code", "sample_id"))
    return out.union(uncovered(category_counts(samples, inner)).select(F.lit("fatal"), F.lit("category_missing"), F.concat_ws("/", "split", "category")))


def raise_on_fatal(issues: DataFrame) -> None:
    found = issues.where("level = 'fatal'").groupBy("code").count().orderBy("code").collect()  # as many rows as there are codes
    if found:
        raise ValueError("; ".join(f"{r['code']}: {r['count']}" for r in found))


def assert_usable(version: DataFrame, digest: str, audit: DataFrame, about: DataFrame | None = None, algorithm: str | None = None, schema_version: int = 1) -> None:
    """version is the one-row metadata of a split, audit the issues found, about the audit's own row (digest, audit_level, formal_ready); raises with the names of what fails.

    The data's digest has to be the version's and the audit's, the split formal, of this schema version and, if named, of
    this algorithm; the audit full and ready, with no fatal issue.
    """
    row = version.first()
    fatal = audit.where("level = 'fatal'").limit(1).count()
    checks = {"digest": row["digest"] == digest, "formal": row["formal"], "schema": row["schema_version"] == schema_version, "audit": not fatal}
    if algorithm is not None:
        checks["algorithm"] = "algorithm" in row and row["algorithm"] == algorithm
    if about is not None:
        own = about.first()
        checks |= {"audit_digest": bool(own) and own["digest"] == digest, "audit_level": bool(own) and own["audit_level"] == "full", "audit_ready": bool(own) and bool(own["formal_ready"])}
    if failed := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"the split can't be used: {', '.join(failed)}")


def collect_heldout(version: DataFrame, digest: str, audit: DataFrame, samples: DataFrame, members: DataFrame, split: str = "test") -> tuple[DataFrame, DataFrame]:
    """The pairs of a split for evaluation, and one row of metadata: the version's, the split's name, its size and its digest.

    Refused, with the names of what fails, unless the version may be used, no split shares samples or groups with
    another, every split has members, and all members are known, usable and listed once.
    """
    assert_usable(version, digest, audit)
    inner = members.where(F.col("split").isin("train", "val", "test"))
    lacking = samples.sparkSession.createDataFrame([(s,) for s in ("train", "val", "test")], "key string").join(inner.select(F.col("split").alias("key")).distinct(), "key", "left_anti")
    bad = member_issues(inner, samples).select(F.lit("fatal").alias("level"), F.concat(F.lit("member_"), "code").alias("code"), F.col("sample_id").alias("key"))
    twice = samples.groupBy("sample_id").count().where("count > 1").select(F.lit("fatal"), F.lit("duplicate_sample_id"), "sample_id")
    raise_on_fatal(shared_issues(samples, inner).union(bad).union(twice).union(lacking.select(F.lit("fatal"), F.lit("empty_split"), "key")))
    rows = select_split(samples, members, split)[0]
    about = table_digest(rows, ["sample_id"]).select(F.lit(split).alias("split"), F.col("digest").alias("split_digest")).join(rows.agg(F.count("*").alias("pairs"))).join(version.select("digest"))
    return rows, about


def pending_tasks(tasks: DataFrame, outputs: DataFrame, forced: bool = False) -> DataFrame:
    """task, action: outputs (task, expected, present) that are complete are skipped, partial ones fail, unless forced; the others run."""
    rows = tasks.join(outputs, "task", "left")
    done, some = F.col("present") >= F.col("expected"), F.coalesce("present", F.lit(0)) > 0
    return rows.select("task", (F.lit("run") if forced else F.when(some & done, "skip").when(some, "fail").otherwise("run")).alias("action"))


def task_issues(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs (task, path, sha) against files (path, sha): missing or changed files."""
    rows = jobs.join(files.select("path", F.col("sha").alias("now")), "path", "left")
    return rows.select("task", "path", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha"), "changed").alias("code")).where("code is not null")


def output_validation(files: DataFrame, expected: int) -> DataFrame:
    """files (task, modality, name, readable): exact counts, equal names on both sides, all readable, of which nothing is known being not."""
    names = files.groupBy("task", "name").agg(F.countDistinct("modality").alias("m"), F.bool_and(F.coalesce("readable", F.lit(False))).alias("readable"))
    out = names.groupBy("task").agg(F.count("*").alias("names"), F.count_if(F.col("m") != 2).alias("one_sided"), F.count_if(~F.col("readable")).alias("unreadable"))
    return out.withColumn("valid", (F.col("names") == expected) & (F.col("one_sided") == 0) & (F.col("unreadable") == 0))


def check_media_pair(media: DataFrame, width: int, height: int, fps_tolerance: float = 0.001, categories: list[str] | None = None) -> DataFrame:
    """media (pair_key, modality, width, height, fps, frame_count, and category if categories are given): issues of each pair, a missing side among them."""
    own = ["category"] if categories else []
    side = lambda m: media.where(F.col("modality") == m).select("pair_key", F.lit(True).alias(m), *(F.col(c).alias(f"{m}_{c}") for c in ("width", "height", "fps", "frame_count", *own)))
    both = side("ir").join(side("rgb"), "pair_key", "full_outer")
    bad = lambda m: (F.col(f"{m}_width") != width) | (F.col(f"{m}_height") != height)
    rules = {"missing_ir": ("error", F.col("ir").isNull()), "missing_rgb": ("error", F.col("rgb").isNull()), "ir_size": ("error", bad("ir")), "rgb_size": ("error", bad("rgb")), "fps_differ": ("error", F.abs(F.col("ir_fps") - F.col("rgb_fps")) > fps_tolerance), "no_frames": ("error", (F.col("ir_frame_count") <= 0) | (F.col("rgb_frame_count") <= 0))}
    if categories:
        rules["unknown_category"] = ("error", ~F.coalesce(F.coalesce("ir_category", "rgb_category").isin(*categories), F.lit(False)))
    return row_issues(both, rules, "pair_key")
