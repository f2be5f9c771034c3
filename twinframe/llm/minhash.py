"""Near-duplicate documents by MinHash, banded candidates and odd sketches.

Each document's set of word shingles gives PERMUTATIONS MinHash samples. Bands of ROWS samples deal the
documents into buckets; the samples are also folded into an odd sketch, a bitmap of parities in which each
sample flips one bit, so that the population count of the XOR of two sketches estimates how many samples
differ, most precisely where the sets are very similar. A second odd sketch has the parities of the whole set:
its count is never more than the elements in which two sets differ, so that it excludes pairs for certain, and
nearly all of them where the sets are not much larger than the bitmap. Candidates whose counts are too high for
the asked similarity go without a look at their texts; the others are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_bytes, discard, is_empty, keep_rows, scratch, slices
from .components import connected_components

BANDS, ROWS, SKETCH_BITS, PARITY_BITS = 25, 4, 512, 1024
PERMUTATIONS = BANDS * ROWS
#: Buckets with more components than LARGE are divided: their documents are dealt again, by bands of FINE_ROWS other samples.
#: Up to there the sketches of all pairs are compared in less time than the other samples take.
LARGE, FINE_ROWS = 4096, 8
_MASK = (1 << 64) - 1
_draw = np.random.default_rng(20240607)
_MUL = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SALT = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_words = Cache(xxhash.xxh3_64_intdigest, 100_000)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles; A-Z count as a-z; fewer words make one shingle; no words, none."""
    words = text.lower().split()  # of bytes: A-Z alone, and splits at 0x20 and 0x09-0x0D alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = _mix(x) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(x))


def min_hashes(hashes: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    low = np.full(len(mul), _MASK, np.uint64)
    step = 800_000 // len(mul)  # a few megabytes at once
    for i in range(0, len(hashes), step):
        np.minimum(low, (mul[:, None] * hashes[None, i : i + step] + add[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = np.arange(1, len(low) // rows + 1, dtype=np.uint64)
    for column in low.reshape(-1, rows).T:
        x = _mix(x) + column
    return _mix(x).view(np.int64)


def fine_bands(percent: int) -> int:
    """So many bands of FINE_ROWS that they miss a pair at the limit with odds of one in a million."""
    return max(1, math.ceil(math.log(1e-6) / math.log1p(-((percent / 100) ** FINE_ROWS)))) if percent < 100 else 1


def odd_sketch(low: np.ndarray) -> np.ndarray:
    flips = np.bincount((_mix(low ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set."""
    flips = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float) -> int:
    """The most bits that differ between the sketches of sets at least this similar, but for odds of less than one in a million: five standard deviations of the differing samples, two bits for each."""
    p = 1 - similarity
    return int(2 * (PERMUTATIONS * p + 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5) + 1)


SIGNATURE = "n_shingles bigint, fp binary, bands array<bigint>, sketch array<bigint>, parity array<bigint>"
FIELDS = ("n_shingles", "fp", "bands", "sketch", "parity")


def _signatures(k: int):
    kind = pa.struct([("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    @F.arrow_udf(SIGNATURE)
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [pa.array([], kind)]
            for part in slices(texts):
                out = []
                for s in (shingle_set(t, k) for t in as_bytes(part)):
                    low = min_hashes(s) if len(s) else None
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(low), odd_sketch(low), parities(s)) if len(s) else (0, None, None, None, None))
                done.append(pa.array([dict(zip(FIELDS, x, strict=True)) for x in out], kind))
                _words.trim()
            yield pa.concat_arrays(done)

    return signature


def _fine_keys(k: int, bands: int):
    """Keys of other bands, for the documents of large buckets."""
    draw = np.random.default_rng(20240608)
    mul = draw.integers(0, 2**63, bands * FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**63, bands * FINE_ROWS, dtype=np.uint64)

    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for part in slices(texts):
                out += [band_keys(min_hashes(shingle_set(t, k), mul, add), FINE_ROWS) for t in as_bytes(part)]
                _words.trim()
            yield pa.array(out, pa.list_(pa.int64()))

    return keys


def _verifier(k: int, percent: int):
    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            out = []
            for x, y in zip(slices(one), slices(two), strict=True):
                for s, t in zip(as_bytes(x), as_bytes(y), strict=True):
                    s, t = shingle_set(s, k), shingle_set(t, k)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    out.append(100 * both >= percent * (len(s) + len(t) - both))
                _words.trim()
            yield pa.array(out, pa.bool_())

    return similar


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns))


def _may_link(percent: int) -> Column:
    """What the sizes and both sketches allow, of rows with n, sketch and parity on the sides a and b."""
    count = lambda c, bits: sum((F.bit_count(F.col(f"{c}_a")[i].bitwiseXOR(F.col(f"{c}_b")[i])) for i in range(bits // 64)), F.lit(0))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    differ = (100 + percent) * count("parity", PARITY_BITS) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return sizes & differ & (count("sketch", SKETCH_BITS) <= sketch_limit(percent / 100))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cid and text of the documents in ids (one column)."""
    return keep_rows(docs.select(F.col("doc_id").alias("cid"), "text"), ids.distinct(), "cid").groupBy("cid").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) that the sketches allow, those whose full sets are near enough; only their texts are fetched."""
    pairs = scratch(pairs, "pairs")
    texts = scratch(_texts(docs, pairs.select("a").union(pairs.select("b"))), "texts")
    ta, tb = (texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    links = scratch(pairs.join(ta, "a").join(tb, "b").where(_verifier(k, percent)("ta", "tb")).select("a", "b"), "links")
    discard(pairs, texts)
    return links


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (key, cid, comp and sketches) of different components with a key in common that sizes and sketches allow."""
    x, y = _side(rows, "a"), _side(rows, "b")
    return x.join(y, (F.col("key_a") == F.col("key_b")) & (F.col("comp_a") < F.col("comp_b")) & _may_link(percent)).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles;
    component_id is the smallest doc_id that links reach, and kept says that it is the row's own. Texts with
    equal sets are one class from the start, so copies cost one row each. Of any two texts at the limit, bands
    miss one pair in 10 ** 5 or fewer: (1 - s ** ROWS) ** BANDS is 9e-9 at 0.85 and 2e-6 at 0.8. A first pass
    links each class to the first one it shares a bucket with; then only pairs of a bucket that are not in one
    component yet are looked at, so a large group of near copies never becomes all its pairs. A bucket of more than
    LARGE components, as of documents that share a long passage, is not compared as such: its documents are dealt
    again by fine_bands() bands of FINE_ROWS other samples, which miss a pair at the limit with odds of one in a
    million and keep few of those that have less in common.

    Null or empty texts and texts without words have no shingles and link with nothing. Rows of one doc_id are
    one document: where their texts differ, it is linked with what any of them is linked with. A null doc_id links with
    nothing: component_id null, kept true. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    rows = scratch(docs.select("doc_id", _signatures(k)("text").alias("s")).select("doc_id", "s.*"), "signatures")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # 64 bits tell the sets of one doc_id apart, and sums of fixed width take no sorting
    set_of = F.xxhash64(F.coalesce("fp", F.lit(b"")))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(set_of).alias("x"), F.max(set_of).alias("y")).where("x <> y")
    if is_empty(several):
        found = rows.join(_components(full, docs, k, percent), "fp", "left")
    else:
        found = rows.join(_components_of_several(full, docs, k, percent), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of_several(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, comp of rows (doc_id, and signatures) of which some have one doc_id and different texts.

    Each pair of a doc_id and a set is a document with a number of its own; afterwards the documents of one doc_id are
    linked, and components take their smallest doc_id.
    """
    numbers = scratch(rows.select("doc_id", "fp").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    own = rows.join(numbers, ["doc_id", "fp"]).drop("doc_id").withColumnRenamed("number", "doc_id")
    texts = docs.where("doc_id is not null").select("doc_id", "text", _signatures(k)("text")["fp"].alias("fp"))
    texts = scratch(texts.join(numbers, ["doc_id", "fp"]).groupBy("number").agg(F.any_value("text").alias("text")).withColumnRenamed("number", "doc_id"), "numbered")
    comp = numbers.join(_components(own, texts, k, percent), "fp")
    same = numbers.groupBy("doc_id").agg(F.min("number").alias("a"))
    links = comp.select(F.col("number").alias("a"), F.col("comp").alias("b")).union(numbers.join(same, "doc_id").select("a", F.col("number").alias("b")))
    labels = scratch(connected_components(links), "components")
    named = numbers.join(labels, numbers.number == labels.node, "left").select("doc_id", F.coalesce("component", "number").alias("label")).distinct()
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("comp")), "label").select("doc_id", "comp")


def _components(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """fp, comp: the component of each set of rows (doc_id, and signatures), named by the smallest doc_id; docs have one text for each doc_id."""
    grouped = rows.groupBy("fp")
    classes = scratch(grouped.agg(F.min("doc_id").alias("cid"), *(F.any_value(c).alias(c) for c in ("bands", "sketch", "parity")), F.any_value("n_shingles").alias("n")), "classes")
    sketches = classes.select("cid", "n", "sketch", "parity")
    dealt = classes.select("cid", F.explode("bands").alias("key"))
    leaders = dealt.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = scratch(dealt.join(leaders, "key").select("key", "cid", "leader"), "buckets")
    first = buckets.where("cid <> leader").groupBy("cid").agg(F.min("leader").alias("b")).select(F.col("cid").alias("a"), "b")
    first = first.join(_side(sketches, "a"), F.col("a") == F.col("cid_a")).join(_side(sketches, "b"), F.col("b") == F.col("cid_b")).where(_may_link(percent)).select("a", "b")
    links = _confirmed(first, docs, k, percent)
    labels = scratch(connected_components(links), "components")

    named = buckets.join(labels, buckets.cid == labels.node, "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    named = scratch(named, "named")
    mixed = scratch(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.approx_count_distinct("comp").alias("n")).where("lo <> hi").select("key", "n"), "mixed")
    steps = [buckets, named, mixed, scratch(named.join(mixed.where(F.col("n") <= LARGE).select("key"), "key").join(sketches, "cid"), "open")]
    rest = _met(steps[-1], percent)
    again = named.join(mixed.where(F.col("n") > LARGE).select("key"), "key").select("cid", "comp").distinct()
    if not is_empty(again):
        again = scratch(again, "again")
        steps.append(again)
        fine = _texts(docs, again.select("cid")).join(again, "cid").select("cid", "comp", _fine_keys(k, fine_bands(percent))("text").alias("keys"))
        steps.append(scratch(fine, "fine"))
        fine = steps[-1].select("cid", "comp", F.explode("keys").alias("key"))
        shared = fine.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        steps.append(scratch(fine.join(shared, "key").join(sketches, "cid"), "open"))
        rest = rest.union(_met(steps[-1], percent))
    more = _confirmed(rest.distinct(), docs, k, percent)
    discard(*steps)
    if not is_empty(more):
        labels = scratch(connected_components(more.union(labels.select("node", "component"))), "components")

    return classes.join(labels, classes.cid == labels.node, "left").select("fp", F.coalesce("component", "cid").alias("comp"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, but of each group of near duplicates only the document of the smallest doc_id."""
    return keep_rows(docs, near_duplicates(docs, k, percent).where("kept").select("doc_id"))
