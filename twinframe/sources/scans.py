"""Scans of files as tables: fingerprints, image headers, pixels, CSV, JSON, paths and task folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_category, norm_clip, norm_day, norm_experiment, safe_path
from ..operators.audit import complete_experiments, readiness
from ..operators.pairing import pair_numeric, pair_strict
from ..operators.resample import fitted, resampled
from .ranged import file_ranges
from .sinks import plan_copies


def scan_fingerprints(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime, sha256 of every file under root, of any size: tasks read their files in chunks."""
    return file_ranges(spark, root, glob, read="hash").select("path", "length", "modificationTime", "sha256")


def scan_png_headers(files: DataFrame) -> DataFrame:
    """files (path, content: the file, or at least its first 33 bytes): width, height, bit_depth, mode of PNG headers; readable is false for all else."""
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("int")
    head = (F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A") & (F.octet_length("content") >= 33)
    mode = F.create_map(*(F.lit(x) for kv in {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.items() for x in kv))
    when = lambda c: F.when(head, c)
    return files.select("path", head.alias("readable"), when(number(17, 4)).alias("width"), when(number(21, 4)).alias("height"), when(number(25, 1)).alias("bit_depth"), when(mode[number(26, 1)]).alias("mode"))


def read_png_headers(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """scan_png_headers() of all files under root, of each of which 33 bytes are read."""
    return scan_png_headers(file_ranges(spark, root, glob, read="head", bytes="33").withColumnRenamed("head", "content"))


def scan_grid(spark: SparkSession, root: str, size: int, how: str = "area") -> DataFrame:
    """Frames (frame_id: its path, height, width, v): grey values in [0, 1] of all images under root, shrunk to at most size on the longer side by the kernel how (area, bilinear or lanczos)."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).select("image.*")

    def pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                grey = (a[..., :3] @ [0.114, 0.587, 0.299] if r.nChannels >= 3 else a[..., 0]) / 255  # bytes are blue, green, red
                small = resampled(grey, *fitted(r.height, r.width, size), how)
                yield pd.DataFrame({"frame_id": [r.origin], "height": [small.shape[0]], "width": [small.shape[1]], "v": [small.ravel()]})

    return images.mapInPandas(pixels, "frame_id string, height int, width int, v array<double>")


def read_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all columns text, empty cells as empty text; a missing column is an error, others are kept."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_summaries(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one to a file, and issues for those that aren't an object of the schema."""
    df = file_ranges(spark, root, read="whole").select(F.col("head").cast("string").alias("value"), "path")
    df = df.withColumn("d", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.coalesce(F.col("d._corrupt_record").isNotNull() | ~F.col("value").rlike(r"^\s*\{"), F.lit(True))
    return df.where(~bad).select("d.*", "path").drop("_corrupt_record"), df.where(bad).select("path", F.lit("not_an_object").alias("code"))


def read_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frame metadata with the index column under either of its names, and issues: filenames that are empty, or twice in a clip."""
    if "source_frame_0_based" in frames.columns:
        frames = frames.withColumnRenamed("source_frame_0_based", "source_frame_index_0_based")
    counted = frames.groupBy("clip", "filename").agg(F.count("*").alias("n"))
    code = F.when(F.coalesce(F.trim("filename"), F.lit("")) == "", "empty_filename").when(F.col("n") > 1, "duplicate_filename")
    return frames, counted.select("clip", "filename", code.alias("code")).where("code is not null")


def parse_paths(files: DataFrame, column: str = "path") -> DataFrame:
    """day, experiment, category, clip, modality, file of .../day/experiment/category/clip/ir|rgb/file; parsed is false where a path isn't so."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/(ir|rgb)/([^/]+)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return files.withColumn("parsed", F.col(column).rlike(pattern)).withColumns({"day": norm_day(part(1)), "experiment": norm_experiment(part(2)), "category": part(3), "clip": norm_clip(part(4)), "modality": part(5), "file": part(6)})


def parse_loose_identity(folder: Column, categories: list[str]) -> tuple[Column, Column, Column]:
    """Of a folder: the day of its first segment dayN, the experiment if the next segment is one (else experiment1), and the first category named after that; all null without a day."""
    parts = F.split(folder, "/")
    at = F.array_position(F.transform(parts, lambda x: norm_day(x).isNotNull()), True).cast("int")
    after = F.when(at > 0, F.slice(parts, at + 1, F.size(parts)))
    own = norm_experiment(F.get(after, 0))
    rest = F.when(own.isNull(), after).otherwise(F.slice(after, 2, F.size(parts)))
    experiment = F.when(at > 0, F.coalesce(own, F.lit("experiment1")))
    return norm_day(F.get(parts, at - 1)), experiment, F.get(F.filter(rest, lambda x: x.isin(*categories)), 0)


def ready_tasks(files: DataFrame, marker: str = "READY", manifest: str = "job.json") -> DataFrame:
    """files (task, name): tasks that have both the marker and the manifest."""
    have = lambda n: files.where(F.col("name") == n).select("task").distinct()
    return have(marker).join(have(manifest), "task", "left_semi")


def read_job_pairs(jobs: DataFrame, files: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs of all jobs (task, category, clip, ir, rgb), and issues (task, clip, code) of those that are refused.

    jobs (task, job_type, schema_version, pairs array<struct<clip, category, ir, rgb, user_confirmed>>): version 2 lists
    its pairs; a missing version counts as 1, whose pairs are found among files (task, category, modality, stem) by the
    numbers of their stems. Calibrations have no categories. An issue of a clip is an unknown category, a name that isn't
    a number, a second entry, a pair that nobody confirmed, or a path that leaves the task's folder; of a task, another
    version or no pairs.
    """
    version = F.coalesce("schema_version", F.lit(1))
    experiment = F.col("job_type") == "experiment"
    rows = jobs.where(version == 2).select("task", experiment.alias("e"), F.explode("pairs").alias("p"))
    rows = rows.select("task", "e", norm_clip(F.col("p.clip")).alias("clip"), F.col("p.clip").alias("named"), F.when(F.col("e"), F.col("p.category")).alias("category"), "p.ir", "p.rgb", "p.user_confirmed")
    times = rows.groupBy("task", F.col("category").alias("c"), F.col("clip").alias("k")).agg(F.count("*").alias("times"))
    rows = rows.join(times, (rows.task == times.task) & rows.category.eqNullSafe(F.col("c")) & (F.col("clip") == F.col("k")), "left").select(rows["*"], "times")
    safe = safe_path(F.col("ir")).isNotNull() & safe_path(F.col("rgb")).isNotNull()
    code = F.when(F.col("clip").isNull(), "not_a_number").when(F.col("e") & ~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown_category").when(F.col("times") > 1, "duplicate_clip")
    code = code.when(~F.coalesce("user_confirmed", F.lit(False)), "not_confirmed").when(~F.coalesce(safe, F.lit(False)), "unsafe_path")
    rows = rows.withColumn("code", code)
    old = jobs.where(version == 1).select("task", experiment.alias("e"))
    found = files.join(old, "task").where(~F.col("e") | F.col("category").isin(*categories)).select("task", F.when(F.col("e"), F.col("category")).alias("category"), "modality", "stem")
    paired, odd = pair_numeric(found.withColumn("category", F.coalesce("category", F.lit(""))), ["task", "category"])
    from_v1 = paired.select("task", F.nullif("category", F.lit("")).alias("category"), F.format_string("%02d", "number").alias("clip"), F.col("ir_stem").alias("ir"), F.col("rgb_stem").alias("rgb"))
    pairs = rows.where("code is null").select("task", "category", "clip", "ir", "rgb").unionByName(from_v1)
    issues = rows.where("code is not null").select("task", F.coalesce("clip", "named").alias("clip"), "code").unionByName(odd.select("task", F.col("stem").alias("clip"), "code"))
    issues = issues.unionByName(jobs.where(~version.isin(1, 2)).select("task", F.lit(None).cast("string").alias("clip"), F.lit("unknown_version").alias("code")))
    listed = rows.select("task").union(found.select("task")).distinct()
    return pairs, issues.unionByName(jobs.where(version.isin(1, 2)).join(listed, "task", "left_anti").select("task", F.lit(None).cast("string").alias("clip"), F.lit("no_pairs").alias("code")))


def scan_pair_folders(a: DataFrame, b: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """Two listings (root, path) paired by the path below their roots: key, a_path, b_path; and an issue for each file that one side alone has."""
    key = F.expr(f"ltrim('/', substring({column}, length(root) + 1))")
    side = lambda df, name: df.select(key.alias("key"), F.col(column).alias(name))
    return pair_strict(side(a, "a_path"), side(b, "b_path"), ["key"])


def plan_import(files: DataFrame, present: DataFrame, slugs: dict[str, str], required: list[str], root: str, clips_each: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A dry run over files (path, sha256) of .../day/experiment/category/clip/ir|rgb/name: nothing is written.

    Returns what every clip would become (clip and target folder, pairs, one-sided files), the copies to make against
    present (path, sha256), and the readiness of each category.
    """
    rows = parse_paths(files).where("parsed").withColumn("category", norm_category(F.col("category"), slugs))
    own = ["day", "experiment", "category", "clip"]
    target = F.concat_ws("/", F.lit(root), *own)
    sides = rows.groupBy(*own, "file").agg(F.countDistinct("modality").alias("sides"))
    clips = sides.groupBy(*own).agg(F.count_if(F.col("sides") == 2).alias("pairs"), F.count_if(F.col("sides") < 2).alias("one_sided")).withColumn("target", target)
    wanted = rows.where("category is not null").select(F.concat_ws("/", target, "modality", "file").alias("path"), "sha256")
    return clips, plan_copies(wanted, present), readiness(_whole(clips), required, clips_each)


def _whole(clips: DataFrame) -> DataFrame:
    """The clips of plan_import() that have pairs alone, as samples."""
    return clips.where("category is not null and pairs > 0 and one_sided = 0").select(F.concat_ws("__", "day", "experiment").alias("experiment_key"), "category", F.col("target").alias("clip_id"))


def import_blockers(clips: DataFrame, required: list[str], clips_each: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Of the clips of plan_import(): the experiments that are complete, and what still keeps a formal split from being made (code, found, needed); groups are always named by a person, and edges audited after the import."""
    done = complete_experiments(_whole(clips), required, clips_each)
    n = done.agg(F.count("*").alias("found")).withColumn("needed", F.lit(least).cast("long"))
    none = F.lit(None).cast("long")
    few = n.where("found < needed").select(F.lit("too_few_complete_experiments").alias("code"), "found", "needed")
    return done, few.union(n.select(F.lit("group_assignments_missing"), none, none)).union(n.select(F.lit("edges_not_audited"), none, none))
