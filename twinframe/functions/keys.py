"""Columns that normalise identities, paths and flags; what cannot be normalised is null, and the caller makes an issue of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(col: Column, prefix: str, width: int = 3) -> Column:
    """'Day7', 'day007' or '7' -> 'day007'; wider numbers keep all their digits; anything else is null."""
    return _numbered(col, f"(?:{prefix})?", f"{prefix}%0{width}d")


def _numbered(col: Column, prefix: str, pattern: str) -> Column:
    """The number behind a prefix, in any case and between blanks, by a pattern; null for anything else or more than nine digits."""
    digits = F.regexp_extract(F.trim(col), f"^(?i:{prefix})0*([0-9]{{1,9}})$", 1)
    return F.when(digits != "", F.format_string(pattern, digits.cast("int")))


def norm_day(col: Column) -> Column:
    """'day07' -> 'day7'; the word is needed."""
    return _numbered(col, "day", "day%d")


def norm_experiment(col: Column) -> Column:
    return _numbered(col, "(?:experiment)?", "experiment%d")


def norm_clip(col: Column) -> Column:
    """'clip1' or '1' -> '01'."""
    return _numbered(col, "(?:clip)?", "%02d")


def norm_category(col: Column, slugs: dict[str, str]) -> Column:
    """Label, or slug, to slug by a fixed map of labels; an unknown name is null."""
    both = {slug: slug for slug in slugs.values()} | slugs
    return F.create_map(*(F.lit(x) for kv in sorted(both.items()) for x in kv))[F.trim(col)]


def category_label(col: Column, slugs: dict[str, str]) -> Column:
    """Label, or slug, to label; an unknown name is null."""
    both = {slug: label for label, slug in slugs.items()} | {label: label for label in slugs}
    return F.create_map(*(F.lit(x) for kv in sorted(both.items()) for x in kv))[F.trim(col)]


def sample_id(day: Column, experiment: Column, category: Column, clip: Column, sequence: Column) -> Column:
    return F.concat_ws("__", day, experiment, category, clip, F.format_string("%06d", sequence.cast("int")))


def experiment_key(day: Column, experiment: Column) -> Column:
    return F.concat_ws("__", day, experiment)


def parse_bool(col: Column) -> Column:
    """1/true/yes and 0/false/no/empty, in any case; anything else is null."""
    c = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(c.isin("1", "true", "yes"), True).when(c.isin("0", "false", "no", ""), False)


def safe_path(col: Column) -> Column:
    """A relative path with forward slashes; null if it is absolute, has a drive, or an empty, '.' or '..' part."""
    p = F.regexp_replace(col, r"\\", "/")
    bad = F.exists(F.split(p, "/"), lambda x: x.isin("", ".", "..")) | p.rlike("^[A-Za-z]:") | p.startswith("/")
    return F.when(~bad, p)


def source_ref(col: Column, marker: str = "input") -> Column:
    """What follows the first segment named marker, or else the last segment."""
    parts = F.split(F.regexp_replace(col, r"\\", "/"), "/")
    at = F.array_position(parts, marker)
    rest = F.slice(parts, at.cast("int") + 1, F.greatest(F.size(parts), F.lit(1)))
    return F.when((at > 0) & (at < F.size(parts)), F.array_join(rest, "/")).otherwise(F.element_at(parts, -1))


def stable_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def name_matches_sequence(filename: Column, sequence: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "") == F.format_string("%06d", sequence.cast("int"))


def preview_path(col: Column, folder: str = "previews") -> Column:
    """day/clip/ir/000001.png -> day/clip/previews/000001.png"""
    return F.regexp_replace(col, r"[^/]+/([^/]+)$", f"{folder}/$1")


def duration(frames: Column, fps: Column) -> Column:
    return F.try_divide(frames, fps)


def aspect_within(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.005) -> Column:
    return F.abs(w1 / h1 - w2 / h2) <= tolerance * (w2 / h2)


def padded(size: Column, factor: int) -> Column:
    return (F.ceil(size / factor) * factor).cast("long")


def inference_mode(width: Column, height: Column, factor: int = 16, most_tokens: int = 12_544) -> Column:
    """'full' if the padded image has few enough tokens of 4 x 4 pixels, else 'sliding'."""
    tokens = padded(width, factor) * padded(height, factor) / 16
    return F.when(tokens <= most_tokens, "full").otherwise("sliding")


def hamming(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def normalise_summary(sources: Column, task: Column) -> Column:
    """A summary's two sources with hashes kept and paths cut to their references, under the canonical task name."""
    side = lambda s: F.struct(source_ref(s["path"]).alias("path"), s["sha256"].alias("sha256"))
    return F.struct(F.lower(F.trim(task)).alias("task"), side(sources["ir"]).alias("ir"), side(sources["rgb"]).alias("rgb"))


def reasons(**rules: Column) -> Column:
    """The names, in order, of the rules that are true."""
    return F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules.items())))
