"""Sharding by extendible hashing, with DataFrame functions alone.

The directory is indexed by the leading bits of a hash of the key. Where the documents under a prefix exceed
the byte limit, that prefix alone is split on one more bit, until every shard fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, scratch

#: Bits of the hash; so many are added to the histogram in each pass.
BITS, STEP = 48, 12


def key_hash(key: Column) -> Column:
    """The first 48 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def prefix(hash_: Column, bits: Column | int) -> Column:
    width = bits if isinstance(bits, Column) else F.lit(bits)
    return F.call_function("shiftright", hash_, F.lit(BITS) - width)


def shard_directory(sizes: DataFrame, limit: int) -> DataFrame:
    """sizes (hash, n_bytes) -> fine, bits, depth, shard, shard_bytes, shard_rows: for each prefix of so many bits that has rows, its shard and the shard's depth.

    A pass counts the bytes under each prefix of STEP more bits, adds them up for all shorter prefixes, and
    takes for each the shortest that fits; only prefixes of which no part fits go into the next pass. A document
    larger than the limit is a shard of its own. Rows of one hash that together exceed the limit stay together at
    full depth, for overflow pages.
    """
    done, rest, bits = None, sizes, 0
    while bits < BITS and not is_empty(rest):
        last, bits = bits, bits + STEP
        fine = rest.groupBy(prefix(F.col("hash"), bits).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        each = fine.select("fine", "n_bytes", "n", F.explode(F.sequence(F.lit(0 if not last else last + 1), F.lit(bits))).alias("depth")).withColumn("shard", F.call_function("shiftright", F.col("fine"), F.lit(bits) - F.col("depth")))
        fits = each.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = fits.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
        best = each.select("fine", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("fine").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("s"))
        best = scratch(best.select("fine", F.lit(bits).alias("bits"), "s.*"), "directory")
        done = best if done is None else done.union(best)
        rest = scratch(rest.join(best.select("fine"), prefix(F.col("hash"), bits) == F.col("fine"), "left_anti"), "oversized")
    return done if done is not None else sizes.select(F.col("hash").alias("fine"), F.lit(0).alias("bits"), F.lit(0).alias("depth"), F.col("hash").alias("shard"), F.col("n_bytes").alias("shard_bytes"), F.col("n_bytes").alias("shard_rows")).limit(0)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of shards whose rows all have one hash: rows of up to half the limit by running bytes, others alone.

    The running sum is taken inside written parts, and again over the parts' totals, so no task holds a shard.
    """
    from pyspark.sql import Window as W

    parts = scratch(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "overflow")
    small = F.when(2 * F.col("n_bytes") <= limit, F.col("n_bytes")).otherwise(0)
    totals = parts.groupBy("shard", "part").agg(F.sum(small).alias("b"), F.count("*").alias("k"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("shard", "part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    inside = W.partitionBy("shard", "part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = parts.join(totals, ["shard", "part"]).withColumn("b", F.col("b0") + F.coalesce(F.sum(small).over(inside), F.lit(0))).withColumn("k", F.col("k0") + F.coalesce(F.count("*").over(inside), F.lit(0)))
    half = max(1, limit // 2)
    return placed.withColumn("page", F.when(2 * F.col("n_bytes") <= limit, F.floor(F.col("b") / half)).otherwise(-1 - F.col("k"))).drop("part", "place", "b0", "k0", "b", "k")


def _placed(rows: DataFrame, directory: DataFrame, limit: int) -> DataFrame:
    """rows (row, n_bytes, hash) -> row, n_bytes, shard, depth, shard_bytes, page; one row for each."""
    widths = [r["bits"] for r in directory.select("bits").distinct().collect()]  # at most BITS / STEP
    found = None
    for bits in widths:
        part = rows.join(directory.where(F.col("bits") == bits).drop("bits"), prefix(F.col("hash"), bits) == F.col("fine"))
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.join(directory, rows.hash == directory.fine)
    bits_of = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("shard").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    found = found.select("row", "n_bytes", bits_of.alias("shard"), "depth", "shard_bytes", F.lit(0).cast("bigint").alias("page"), "shard_rows")
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    if not is_empty(directory.where(over)):
        found = found.where(~over).unionByName(_pages(found.where(over).drop("page"), limit).withColumn("page", F.col("page").cast("bigint")))
    return found.drop("shard_rows")


def _with_hash(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as row, a struct of the columns, beside n_bytes and hash."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    return docs.select(row.alias("row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), key_hash(F.col("doc_id")).alias("hash"))


def assign_shards(docs: DataFrame, limit: int) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, shard (the prefix, as bits), depth, shard_bytes, page.

    n_bytes is the UTF-8 length of the text (null: 0). Every shard has at most limit bytes, but for a single
    larger document. page is 0, except where rows of one doc_id alone exceed the limit: such a shard is divided
    into pages that fit. A null doc_id hashes as empty text; an empty table gives no rows; other columns are not
    read.
    """
    rows = scratch(_with_hash(docs, "doc_id"), "sizes")
    placed = _placed(rows, shard_directory(rows.select("hash", "n_bytes"), limit), limit)
    return placed.select("row.doc_id", "n_bytes", "shard", "depth", "shard_bytes", "page")


def write_shards(docs: DataFrame, limit: int, path: str) -> tuple[str, str]:
    """The rows of docs, all columns, as Parquet under path, one folder for each shard and page; the two names of the folders' columns.

    Each row is placed by itself, by the hash of its doc_id, so rows of one doc_id stay as many as they are. The
    folders are named by shard, an s and the bits, and page; where docs has such columns, in any case, by these names with
    more underscores. An empty table writes no folders.
    """
    names, taken = ["shard", "page"], {c.lower() for c in docs.columns}
    for i in range(2):
        while names[i] in taken:
            names[i] = f"_{names[i]}"
    sizes = scratch(_with_hash(docs, "doc_id").select("hash", "n_bytes"), "sizes")
    placed = _placed(_with_hash(docs, *docs.columns), shard_directory(sizes, limit), limit)
    placed = placed.select("row.*", F.concat(F.lit("s"), "shard").alias(names[0]), F.col("page").alias(names[1]))
    placed.repartition(*names).write.partitionBy(*names).parquet(path)
    return names[0], names[1]
