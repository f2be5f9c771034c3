"""Packing of documents into fixed-length sequences by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into the other, drops the
bins that hold a document twice, and fits the documents so displaced anew: first they take the places of one or
two documents that fill a bin less, then the rest is best-fitted. Mutation empties the worst bins in the same
way. Blocks of a bounded number of pieces are packed apart, each by several islands, tasks of their
own; between epochs an island's elite moves to the next one. What the blocks leave badly filled is gathered
and packed again.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_strings, is_empty, scratch, slices

Bins = list[list[int]]
_encoders: dict[tuple[str, int], WordEncoder] = {}


def check_words(tokenizer, spec: dict) -> None:
    """Refuses a tokenizer whose ids of a text aren't those of its words one after another: one with added tokens that take blanks, one that cuts or fills texts, or one that shows it on pairs of odd words."""
    if any(set(t["content"]) & set(" \n") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []):
        raise ValueError("the tokenizer has added tokens that take blanks")
    if spec.get("truncation") or spec.get("padding"):
        raise ValueError("the tokenizer cuts or fills texts")
    odd = ["", "a", "The", "'s", "12", "é", "e\u0301", "\u0301", "中文", "!?", "<|a|>", "▁", "\t", "\u00a0", "😀"]
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for one in odd:
        for two in odd:
            if any(ids(one + blank + two) != ids(one) + ids(two) for blank in " \n"):
                raise ValueError(f"the tokenizer doesn't take {one!r} and {two!r} apart at a blank")


class WordEncoder:
    """Ids by a tokenizer that drops white space and never looks across it; what stands between blanks is encoded once for each worker."""

    def __init__(self, path: str, most_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as spec:
            check_words(self.tokenizer, json.load(spec))
        self.words = Cache(lambda word: self.encode_words([word])[0], most_words)

    def encode_words(self, words: list[str], together: int = 256) -> list[bytes]:
        """The ids of each word; words are encoded many to a call, and each token goes to the word in which it starts."""
        out = []
        for k in range(0, len(words), together):
            part = words[k : k + together]
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.searchsorted([a for a, _ in found.offsets], starts[1:]).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            out += [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.words.learn(set().union(*split), self.encode_words)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        self.words.trim()
        return out


def _encoder(path: str, most_words: int) -> WordEncoder:
    if (path, most_words) not in _encoders:
        _encoders[path, most_words] = WordEncoder(path, most_words)
    return _encoders[path, most_words]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, most_words: int = 1_000_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document's ids, then end_id, cut where they are longer than size."""
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    end = end_id.to_bytes(4, "little")

    @F.arrow_udf("array<struct<piece int, start bigint, length bigint, ids_crc32 bigint>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(tokenizer, most_words)
        for texts in batches:
            out = []
            for ids in (x + end for part in slices(texts) for x in own.encode(as_strings(part))):
                cuts = [ids[i : i + 4 * size] for i in range(0, len(ids), 4 * size)]
                out.append([{"piece": i, "start": i * size, "length": len(c) // 4, "ids_crc32": zlib.crc32(c)} for i, c in enumerate(cuts)])
            yield pa.array(out, kind)

    return docs.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")


def best_fit(bins: Bins, loads: list[int], items: list[int], lengths: list[int], size: int) -> None:
    """Put the items, longest first, each into the fullest bin that has room, or into a new one."""
    free = sorted((size - load, b) for b, load in enumerate(loads))
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        at = bisect.bisect_left(free, (lengths[i], -1))
        if at == len(free):
            bins.append([i])
            loads.append(lengths[i])
            bisect.insort(free, (size - lengths[i], len(bins) - 1))
        else:
            _, b = free.pop(at)
            bins[b].append(i)
            loads[b] += lengths[i]
            bisect.insort(free, (size - loads[b], b))


def _leaving(bins: Bins, lengths: np.ndarray, open_: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of open bins, and one or two places in each (the second -1 for one): every document alone, and the pairs of a bin's first breadth documents."""
    numbers, places = [], []
    sizes = np.array([len(bins[b]) for b in open_])
    for m in np.unique(sizes):
        own = open_[sizes == m]
        first, second = np.triu_indices(min(m, breadth), 1)
        at = np.concatenate([np.stack([np.arange(m), np.full(m, -1)], axis=1), np.stack([first, second], axis=1)])
        numbers.append(np.repeat(own, len(at)))
        places.append(np.tile(at, (len(own), 1)))
    return np.concatenate(numbers), np.concatenate(places)


def exchange(bins: Bins, loads: list[int], displaced: list[int], lengths: list[int], size: int, rng: random.Random, breadth: int = 12, pool: int = 160, rounds: int = 6) -> list[int]:
    """One or two documents of a bin make room for one or two displaced ones that fill it more, where the gain is greatest first; returns who is displaced then.

    In a round every bin and every displaced document takes part in one exchange at most; rounds end when none gains. Pairs
    are looked for among breadth documents of a bin and pool displaced ones, which are drawn anew each round; documents
    alone among all.
    """
    weight = np.asarray(lengths, np.int64)
    for _ in range(rounds):
        load = np.asarray(loads, np.int64)
        open_ = np.flatnonzero(load < size)
        if not displaced or not len(open_):
            break
        for b in open_[[len(bins[b]) > breadth for b in open_]]:
            rng.shuffle(bins[b])
        own = np.array(displaced)
        drawn = np.array(rng.sample(range(len(own)), min(pool, len(own))))
        i, j = np.triu_indices(len(drawn), 1)
        coming = np.concatenate([np.stack([np.arange(len(own)), np.full(len(own), -1)], axis=1), np.stack([drawn[i], drawn[j]], axis=1)])
        sums = weight[own[coming[:, 0]]] + np.where(coming[:, 1] >= 0, weight[own[coming[:, 1]]], 0)
        order = np.argsort(sums, kind="stable")
        sums, coming = sums[order], coming[order]
        number, place = _leaving(bins, weight, open_, breadth)
        start = np.cumsum([0, *map(len, bins)])
        flat = np.fromiter(itertools.chain.from_iterable(bins), np.int64, start[-1])
        one, two = flat[start[number] + place[:, 0]], flat[start[number] + np.maximum(place[:, 1], 0)]
        gone = weight[one] + np.where(place[:, 1] >= 0, weight[two], 0)
        at = np.searchsorted(sums, gone + size - load[number], "right") - 1
        gain = np.where(at >= 0, sums[np.maximum(at, 0)] - gone, 0)
        good = np.flatnonzero(gain > 0)
        good = good[np.argsort(-gain[good], kind="stable")]
        used, changed, freed = set(), set(), []
        rows = zip(number[good].tolist(), coming[at[good]].tolist(), one[good].tolist(), two[good].tolist(), (place[good, 1] >= 0).tolist(), gain[good].tolist(), strict=True)
        for b, (p, q), x, y, both, more in rows:
            if b in changed or p in used or q in used:
                continue
            out, into = (x, y) if both else (x,), (p, q) if q >= 0 else (p,)
            bins[b] = [i for i in bins[b] if i not in out] + [int(own[k]) for k in into]
            loads[b] += more
            used.update(into)
            changed.add(b)
            freed += out
        if not freed:
            break
        displaced = [x for k, x in enumerate(displaced) if k not in used] + freed
    return displaced


def _loads(bins: Bins, lengths: list[int]) -> list[int]:
    return [sum(lengths[i] for i in b) for b in bins]


def _refit(kept: Bins, loads: list[int], displaced: list[int], lengths: list[int], size: int, rng: random.Random | None = None, **breadths: int) -> tuple[Bins, list[int]]:
    bins, loads = [list(b) for b in kept], list(loads)
    if rng is not None:
        displaced = exchange(bins, loads, displaced, lengths, size, rng, **breadths)
    best_fit(bins, loads, displaced, lengths, size)
    return bins, loads


def fitness(loads: list[int], size: int) -> float:
    """Mean squared fill: of as many bins, those are better that are full or nearly empty."""
    return sum(x * x for x in loads) / size**2 / max(1, len(loads))


def crossover(one: Bins, two: Bins, lengths: list[int], size: int, rng: random.Random, loads: tuple[list[int], list[int]] | None = None, **breadths: int) -> tuple[Bins, list[int]]:
    """Some of the better-filled half of two's bins go whole into one; bins of one that hold any of their items go, and the rest of those is fitted anew. The child and its loads."""
    own, other = loads or (_loads(one, lengths), _loads(two, lengths))
    ranked = sorted(range(len(two)), key=lambda k: -other[k])
    better = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(better, max(1, len(better) // 2))
    taken = {i for k in injected for i in two[k]}
    bins, full, displaced = [two[k] for k in injected], [other[k] for k in injected], []
    for b, load in zip(one, own, strict=True):
        if taken.isdisjoint(b):
            bins.append(b)
            full.append(load)
        else:
            displaced += [i for i in b if i not in taken]
    return _refit(bins, full, displaced, lengths, size, rng, **breadths)


def mutate(bins: Bins, loads: list[int], lengths: list[int], size: int, rng: random.Random, **breadths: int) -> tuple[Bins, list[int]]:
    """The emptiest bins and a few others are dissolved and fitted anew."""
    ranked = sorted(range(len(bins)), key=lambda k: loads[k])
    n = max(2, len(bins) // 50)
    gone = set(ranked[:n]) | set(rng.sample(ranked[n:], min(n, len(ranked[n:]))))
    kept = [k for k in ranked if k not in gone]
    return _refit([bins[k] for k in kept], [loads[k] for k in kept], [i for k in gone for i in bins[k]], lengths, size, rng, **breadths)


def fewest(lengths: list[int], size: int) -> int:
    """No packing has fewer bins.

    Items over half a bin share none with each other, and where they are over size - k, none with an item of k or
    more; so for each k, the items from k to half a bin need what room those over half leave them, or bins of their own.
    """
    x = np.sort(np.array(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, size // 2, "right"))
    best = max(-(-int(total[-1]) // size), len(x) - half)
    for k in np.unique(x[:half]):
        low, high = int(np.searchsorted(x, k)), int(np.searchsorted(x, size - k, "right"))
        open_ = (high - half) * size - int(total[high] - total[half])
        best = max(best, len(x) - half + max(0, -(-(int(total[half] - total[low]) - open_) // size)))
    return best


def evolve(population: list[Bins], lengths: list[int], size: int, seed: int, generations: int, members: int = 4, patience: int = 40, **breadths: int) -> list[Bins]:
    """The population after some generations, best first; ends early where no packing can have fewer bins, and where patience generations have bettered neither the number of bins nor how full they are."""
    rng = random.Random(seed)
    n, least = len(lengths), fewest(lengths, size)
    whole = [(bins, _loads(bins, lengths)) for bins in population]
    if not whole:
        whole = [_refit([], [], list(range(n)), lengths, size)]
        while len(whole[0][0]) > least and len(whole) < members:  # best fit of a part first, then the rest
            part = set(rng.sample(range(n), n // 2))
            whole.append(_refit(*_refit([], [], list(part), lengths, size), [i for i in range(n) if i not in part], lengths, size))
    score = lambda x: (len(x[0]), -fitness(x[1], size))
    scored = sorted(((score(x), x) for x in whole), key=lambda x: x[0])
    since = 0
    for _ in range(generations):
        if scored[0][0][0] <= least or since == patience:
            break
        (_, one), (best, two) = rng.choice(scored), scored[0]
        child = crossover(one[0], two[0], lengths, size, rng, (one[1], two[1]), **breadths) if rng.random() < 0.7 else mutate(*one, lengths, size, rng, **breadths)
        known = {x[0] for x in scored}
        if (own := score(child)) not in known:  # copies would crowd the others out
            scored = sorted([*scored, (own, child)], key=lambda x: x[0])[:members]
        since = 0 if scored[0][0] < best else since + 1
    return [bins for _, (bins, _) in scored]


def packed(population: list[Bins], n: int) -> bytes:
    """A population of solutions over n items: for each solution, the number of each item's bin as a 32-bit integer."""
    out = np.empty((len(population), n), "<i4")
    for row, bins in zip(out, population, strict=True):
        for number, items in enumerate(bins):
            row[items] = number
    return out.tobytes()


def unpacked(data: bytes | None, n: int) -> list[Bins]:
    out = []
    for row in np.frombuffer(data or b"", "<i4").reshape(-1, n):
        order = np.argsort(row, kind="stable")
        out.append([x.tolist() for x in np.split(order, np.flatnonzero(np.diff(row[order])) + 1)])
    return out


_STATE = "block bigint, island int, uids array<bigint>, lengths array<int>, population binary, bins int, least int"


def _epoch(state: DataFrame, size: int, epoch: int, generations: int, **search: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                found = evolve(unpacked(row.population, len(lengths)), lengths, size, (row.block * 31 + row.island) * 31 + epoch, generations, **search)
                yield pd.DataFrame({"block": [row.block], "island": [row.island], "uids": [row.uids], "lengths": [row.lengths], "population": [packed(found, len(lengths))], "bins": [len(found[0])], "least": [fewest(lengths, size)]})

    return state.mapInPandas(run, _STATE)


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best solution of each row, one row for each item: its bin, where it starts there, and how full that is."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            lengths = np.asarray(row.lengths, np.int64)
            number = np.frombuffer(row.population, "<i4", len(lengths))
            order = np.argsort(number, kind="stable")
            load = np.bincount(number, weights=lengths).astype(np.int64)
            offset = np.cumsum(lengths[order]) - lengths[order] - np.repeat(np.cumsum(load) - load, np.bincount(number))
            yield pd.DataFrame({"block": row.block, "bin": number[order], "load": load[number[order]], "uid": np.asarray(row.uids)[order], "length": lengths[order], "offset": offset})


def _pack_blocks(items: DataFrame, size: int, per_block: int, islands: int, epochs: int, generations: int, level: int, **search: int) -> DataFrame:
    """items (uid, length) -> (uid, length, block, bin, offset, load); every level deals them to blocks anew."""
    n = items.count()
    blocks = max(1, -(-n // per_block))
    grouped = items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    state = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.uid").alias("uids"), F.col("x.length").cast("array<int>").alias("lengths"), F.lit(None).cast("binary").alias("population"))
    before = None
    for epoch in range(epochs):
        tasks = max(1, min(blocks * islands, -(-blocks * islands // 4)))
        state = scratch(_epoch(state.repartition(tasks, "block", "island"), size, epoch, generations, **search), "islands")
        best = state.groupBy("block").agg(F.min("bins").alias("n"), F.max("least").alias("least")).agg(F.sum("n").alias("n"), F.sum("least").alias("least")).first()
        if epoch == epochs - 1 or best["n"] in (best["least"], before):
            break
        before = best["n"]
        elites = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.expr("substring(population, 1, 4 * size(lengths))").alias("elite"))
        state = state.join(elites, ["block", "island"]).select("block", "island", "uids", "lengths", F.concat("population", "elite").alias("population"))
    best = state.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select("block", F.col("best.island").alias("island"))
    chosen = state.join(best, ["block", "island"]).select("block", "uids", "lengths", "population")
    return scratch(chosen.mapInPandas(_places, "block bigint, bin int, load bigint, uid bigint, length bigint, offset bigint"), "placed")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, per_block: int = 4096, islands: int = 2, epochs: int = 3, generations: int = 200, patience: int = 40, breadth: int = 12, pool: int = 160, most_words: int = 1_000_000) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most size tokens, its pieces without gaps from offset 0. Pieces of full size are
    sequences of their own. The others are dealt, by a hash of a row number, to blocks of about per_block;
    islands, epochs and generations bound the search in a block, which ends where it reaches the lower bound; an epoch
    ends where patience generations better nothing, and the search where an epoch saves no bin in any block. breadth and
    pool are the documents of a bin and the displaced ones among which exchange() looks for pairs.
    Bins that a block leaves with more than one part in 64 free are dissolved, and their pieces go through the
    same search again in new blocks, until there is one block or a round saves no bin.

    A worker keeps the ids of most_words words at most, about 200 MB for a million; fewer cost time, and change no result.

    Null texts count as empty: their one token is end_id. Null doc_ids stay null; repeated rows are packed
    each; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    pieces = scratch(token_pieces(docs, tokenizer, size, end_id, most_words).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < size).select("uid", "length")
    done, level, before = None, 0, None
    while not is_empty(items):
        placed = _pack_blocks(items, size, per_block, islands, epochs, generations, level, patience=patience, breadth=breadth, pool=pool).withColumn("sequence_id", F.lit(level << 56) + F.col("block") * (1 << 20) + F.col("bin"))
        bins = placed.groupBy("sequence_id", "block").agg(F.any_value("load").alias("load"))
        full = F.col("load") >= size - size // 64
        n = bins.agg(F.max("block").alias("last"), F.count("*").alias("all"), F.count_if(~full).alias("loose")).first()
        last = n["last"] == 0 or not n["loose"] or (before is not None and n["all"] >= before)
        own = (placed if last else placed.where(full)).select("uid", "sequence_id", "offset")
        done = own if done is None else done.union(own)
        if last:
            break
        items, level, before = placed.where(~full).select("uid", "length"), level + 1, n["loose"]
    if done is None:
        done = items.select("uid", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    whole = pieces.where(F.col("length") >= size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return pieces.where(F.col("length") < size).join(done, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").union(whole)
