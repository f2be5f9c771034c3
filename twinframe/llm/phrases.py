"""Collocations by best-first branch and bound: only the phrases that can still reach a language's best are counted.

The tree grows from words to pairs to triples. A node is a pair (w1, w2); what its children can reach is bounded by prefix
counts: a triple found a times scores at most floor(10^6 * a / f(w1)), as f(w2 w3) >= a, and a is at most f(w1 w2) and at
most the count of the most frequent pair that begins with w2. Nodes are expanded from the highest bound down, whole levels
of a bound at a time, until a language's last wanted score, with its ties, is at or above the level; what lies below can't
reach it. An expansion counts, in one pass over the texts, the triples that begin or end with a node, so that a node also
learns which triples stand for it. Nodes travel to the tasks as a bitmap of fixed size: a bit that another node set costs
counting, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, discard, is_empty, scratch, slices, small_batches

SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes.maketrans(UPPER + b"\t" + SEPARATORS, LOWER + b" " + b"\n" * len(SEPARATORS))
#: Words that are counted together in a task, and bytes that are cut into words at once: three ids of a chunk fit in 64 bits.
CHUNK, PIECE = 1_500_000, 1 << 20
#: Ids that every chunk has: what lies between two blanks, and the end of a piece.
NOTHING, END = 0, 1


class _Stream:
    """The words of one language in the order of its texts, as ids of a vocabulary that lasts for a chunk."""

    def __init__(self):
        self.restart([])

    def restart(self, words: list[bytes]) -> None:
        self.vocabulary = defaultdict(count().__next__)
        self.parts = [np.array([self.vocabulary[w] for w in (b"", b"\n", *words)][2:], np.int64)]

    def add(self, data: bytes) -> int:
        """How many ids data gave."""
        tokens = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens))
        self.parts.append(ids[ids != NOTHING])
        return len(self.parts[-1])

    def take(self, last: bool) -> tuple[np.ndarray, int, list[bytes]]:
        """ids, how many of them begin phrases that are counted now, and the vocabulary; the last two wait for what follows."""
        ids, words = np.concatenate(self.parts), list(self.vocabulary)
        begin = len(ids) if last else max(0, len(ids) - 2)
        self.restart([words[i] for i in ids[begin:]])
        return ids, begin, words


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut before blanks, into parts of about PIECE bytes."""
    at = 0
    while len(data) - at > PIECE:
        cut = data.rfind(b" ", at + 1, at + PIECE)
        cut = cut if cut > 0 else data.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, int, list[bytes]]]:
    """lang and what _Stream.take() gives, for all texts (lang, text) of a task; memory is bounded by CHUNK words."""
    streams: dict[str, _Stream] = {}
    n = 0
    for batch in batches:
        for langs, texts in zip(slices(batch.column(0)), slices(batch.column(1)), strict=True):
            own = defaultdict(list)
            for lang, text in zip(langs.to_pylist(), as_bytes(texts), strict=True):
                own[lang].append(text)
            for lang, of in own.items():
                for piece in _pieces(b"\n".join([*of, b""]).translate(_PLAIN)):
                    n += streams.setdefault(lang, _Stream()).add(piece)
                    if n >= CHUNK:
                        n = 0
                        for k, s in streams.items():
                            yield k, *s.take(False)
    for k, s in streams.items():
        yield k, *s.take(True)


def _rows(lang: str, words: pa.Array, ids: list[np.ndarray | None], counts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts), 1 << 16):
        part = slice(i, i + (1 << 16))
        n = len(counts[part])
        columns = [pa.nulls(n, pa.binary()) if x is None else words.take(pa.array(x[part])) for x in ids]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *columns, pa.array(counts[part], pa.int64())], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def count_pairs(docs: DataFrame) -> DataFrame:
    """lang, w1, w2, c: how often each pair stands within pieces; each word, without w2; and all words of a language, without w1."""
    schema = pa.schema([("lang", pa.string()), ("w1", pa.binary()), ("w2", pa.binary()), ("c", pa.int64())])

    def run(batches):
        for lang, ids, begin, vocabulary in _chunks(batches):
            words, first = pa.array(vocabulary, pa.binary()), ids[:begin]
            times = np.bincount(first[first != END], minlength=1)
            yield from _rows(lang, words, [None, None], np.array([times.sum()]), schema)
            own = np.flatnonzero(times)
            yield from _rows(lang, words, [own, None], times[own], schema)
            a, b = first[: len(ids) - 1], ids[1 : len(first) + 1]
            inside = (a != END) & (b != END)
            pairs, times = np.unique(a[inside] * len(vocabulary) + b[inside], return_counts=True)
            yield from _rows(lang, words, [pairs // len(vocabulary), pairs % len(vocabulary)], times, schema)

    return _texts(docs).mapInArrow(run, "lang string, w1 binary, w2 binary, c bigint").groupBy("lang", "w1", "w2").agg(F.sum("c").alias("c"))


def _mixed(lang: str, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs of word hashes in a bitmap of 2^bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(xxhash.xxh64_intdigest(lang))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits as 64-bit words, those of the nodes (lang, w1, w2) set; the driver gets one row for each word of it at most."""
    def run(batches):
        for batch in batches:
            langs, a, b = (c.to_pylist() for c in batch.columns)
            place = np.zeros(len(langs), np.uint64)
            ha, hb = _hashes(a), _hashes(b)
            for lang in set(langs):
                own = np.fromiter((x == lang for x in langs), bool, len(langs))
                place[own] = _mixed(lang, ha[own], hb[own], bits)
            word, of = np.unique(place >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, of, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    with small_batches(nodes.sparkSession):
        rows = nodes.select("lang", "w1", "w2").mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return out


def count_triples(docs: DataFrame, nodes: np.ndarray) -> DataFrame:
    """lang, w1, w2, w3, c of the triples that begin or end with a pair of the bitmap."""
    schema = pa.schema([("lang", pa.string()), ("w1", pa.binary()), ("w2", pa.binary()), ("w3", pa.binary()), ("c", pa.int64())])
    bits = len(nodes).bit_length() + 5
    shared = docs.sparkSession.sparkContext.broadcast(nodes)

    def run(batches):
        marks = shared.value
        for lang, ids, begin, vocabulary in _chunks(batches):
            if len(ids) < 3:
                continue
            h, v = _hashes(vocabulary), len(vocabulary)
            at = _mixed(lang, h[ids[:-1]], h[ids[1:]], bits)
            hit = (marks[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
            word = ids != END
            chosen = (hit[:-1] | hit[1:]) & word[:-2] & word[1:-1] & word[2:]
            chosen[begin:] = False
            k = np.flatnonzero(chosen)
            triples, times = np.unique((ids[k] * v + ids[k + 1]) * v + ids[k + 2], return_counts=True)
            yield from _rows(lang, pa.array(vocabulary, pa.binary()), [triples // (v * v), triples // v % v, triples % v], times, schema)

    return _texts(docs).mapInArrow(run, "lang string, w1 binary, w2 binary, w3 binary, c bigint").groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("c"))


def score(a: str, l: str, r: str) -> Column:
    """floor(10^6 * a * a / (l * r)), exact: counts of up to 15 digits."""
    d = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * {d(a)} * {d(a)} div ({d(l)} * {d(r)})")


def _count_of(counts: DataFrame, name: str, w1: str, w2: str | None = None) -> DataFrame:
    """The counts of words, or pairs, as name, by columns w1 and w2."""
    rows = counts.where("w1 is not null").where("w2 is null" if w2 is None else "w2 is not null")
    return rows.select("lang", F.col("w1").alias(w1), *([F.col("w2").alias(w2)] if w2 else []), F.col("c").alias(name))


def pair_nodes(counts: DataFrame) -> DataFrame:
    """lang, w1, w2, a, l, r, score, bound of all pairs: bound is the highest score that the pair or a triple it begins can have."""
    pairs = counts.where("w2 is not null")
    most = pairs.groupBy("lang", F.col("w1").alias("w2")).agg(F.max("c").alias("most"))
    rows = pairs.withColumnRenamed("c", "a").join(_count_of(counts, "l", "w1"), ["lang", "w1"]).join(_count_of(counts, "r", "w2"), ["lang", "w2"]).join(most, ["lang", "w2"], "left")
    rows = rows.withColumn("score", score("a", "l", "r"))
    child = F.expr("cast(cast(1000000 as decimal(7,0)) * least(a, coalesce(most, 0)) div l as bigint)")
    return rows.select("lang", "w1", "w2", "a", "l", "r", "score", F.greatest("score", child).alias("bound"))


def scored_triples(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """triples (lang, w1, w2, w3, a) with l, r, score of the cut that scores lowest, the first of equals."""
    rows = triples.join(_count_of(counts, "l1", "w1"), ["lang", "w1"]).join(_count_of(counts, "r1", "w2", "w3"), ["lang", "w2", "w3"])
    rows = rows.join(_count_of(counts, "l2", "w1", "w2"), ["lang", "w1", "w2"]).join(_count_of(counts, "r2", "w3"), ["lang", "w3"])
    rows = rows.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select("lang", "w1", "w2", "w3", "a", either("l1", "l2").alias("l"), either("r1", "r2").alias("r"), either("s1", "s2").alias("score"))


def _ranked(survivors: DataFrame, top: int) -> DataFrame:
    w = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return survivors.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def phrases(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, first: int = 4, bits: int = 26, on_round: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    docs (lang, text): A-Z is lower-cased, texts are cut at SEPARATORS into pieces and those at blanks and tabs into words;
    phrases stay within a piece. a, l and r are the counts of the phrase and of the two parts of its lowest-scoring cut, n
    of all words of the language. Phrases found fewer than least times are none; a pair goes if a triple that contains it
    has share per cent of its count or more. Order: score, then a, both falling, then phrase by its UTF-8.

    The first round expands the levels that hold the first * top highest bounds of a language; where fewer than top survive
    at or above them, the next goes down to the score of the top-th survivor known, which can only rise, or, where fewer
    are known, to eight times as many nodes. bits sets the size of the bitmap (2^bits bits, at most 8 bytes of 64 to a row
    at the driver). on_round gets each round's frontier, for tests.

    Null languages are und, null texts empty; repeated rows count each time; empty tables, languages of few words, and
    texts without words give no rows; texts of any length are worked on in pieces. Columns beside lang and text aren't
    read. Windows run over a language's levels of scores (at most 1,000,001) and over rows that Spark has cut to top for
    each task, never over a language's texts or phrases.
    """
    counts = scratch(count_pairs(docs).where((F.col("c") >= least) | F.col("w1").isNull()), "pair_counts")
    nodes = scratch(pair_nodes(counts), "pair_nodes")
    level = nodes.groupBy("lang", "bound").agg(F.count("*").alias("n"))
    levels = scratch(level.withColumn("above", F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("bound")))), "levels")

    def cut(n: int) -> DataFrame:
        """lang, cut: the highest level down to which there are n nodes."""
        return levels.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= n, F.col("bound"))), F.lit(0).cast("long")).alias("cut"))

    def near(df: DataFrame) -> DataFrame:
        """A row for each language: sent to all where they are few."""
        return F.broadcast(df) if df.count() <= 10_000 else df

    wanted, known, used = first * top, None, [nodes, levels]
    state = scratch(cut(wanted).select("lang", "cut", F.lit(1_000_001).cast("long").alias("before")), "state")
    if is_empty(state):  # no pair is frequent enough
        return counts.where("false").select("lang", F.lit(0).cast("long").alias("rank"), F.lit("").alias("phrase"), *(F.col("c").alias(x) for x in ("a", "l", "r", "n", "score")))
    while True:
        used.append(state)
        frontier = nodes.join(near(state), "lang").where("bound >= cut and bound < before")
        if on_round:
            on_round(frontier)
        if known is None or not is_empty(frontier):
            found = count_triples(docs, bitmap(frontier, bits)).where(F.col("c") >= least).withColumnRenamed("c", "a")
            used.append(scratch(scored_triples(found, counts), "triples"))
            known = used[-1] if known is None else known.union(used[-1]).distinct()
        ends = F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))
        longest = known.select("lang", "a", F.explode(ends).alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
        pairs = nodes.join(near(state), "lang").where("bound >= cut").join(longest, ["lang", "w1", "w2"], "left")
        pairs = pairs.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
        spaced = lambda df, *w: df.select("lang", F.concat_ws(" ", *(F.col(c).cast("string") for c in w)).alias("phrase"), "a", "l", "r", "score")
        best = scratch(_ranked(spaced(known, "w1", "w2", "w3").union(spaced(pairs, "w1", "w2")), top), "best")
        used.append(best)
        wanted *= 8
        rows = state.join(best.groupBy("lang").agg(F.count("*").alias("found"), F.min("score").alias("last")), "lang", "left").join(cut(wanted).withColumnRenamed("cut", "wider"), "lang")
        lower = F.when(F.col("found") >= top, F.col("last")).otherwise(F.least("wider", F.col("cut") - 1))
        settled = (F.col("cut") == 0) | F.coalesce((F.col("found") >= top) & (F.col("last") >= F.col("cut")), F.lit(False))
        state = scratch(rows.select("lang", F.when(settled, F.col("cut")).otherwise(lower).alias("cut"), F.col("cut").alias("before")), "state")
        if is_empty(state.where("cut < before")):
            break
    discard(*(s for s in used if s is not best), state)
    n = counts.where("w1 is null").select("lang", F.col("c").alias("n"))
    return best.join(near(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
