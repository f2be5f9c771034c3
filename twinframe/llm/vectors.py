"""Near-duplicate vectors by product quantisation.

A bounded sample fits coarse centres and, for the residuals, a codebook for each subspace. Every vector is
then in the inverted list of its nearest centre, with the codes of its residual and the length of what the
codes miss. A query probes every list whose cell comes near enough, adds up table entries for the codes of a
list's vectors, and the vectors whose estimated distance allows it are compared exactly.

Two vectors at most r apart in different cells lie, together, at most r from the border between the cells of
their two centres. So one of them lies within r / 2 of it: if all vectors are queries and probe that far, every
pair meets, from one side at least, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .components import connected_components

#: The index is fitted on at most so many vectors, those of the lowest hash.
SAMPLE = 16_384
SUBSPACES, CODES = 8, 256
#: A list has about LIST_ROWS vectors, as long as there are not more than MOST_LISTS lists.
LIST_ROWS, MOST_LISTS = 256, 4096
#: Neighbouring lists form groups; about so many vectors of a group, and so many of its queries, meet in one task.
BLOCK, QUERIES = 8192, 16_384


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of each row to each centre, and the nearest centre."""
    d = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0)
    return d, d.argmin(axis=1)


def own_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([nearest(x[i : i + 1024], centres)[1] for i in range(0, len(x), 1024)])


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centres = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = own_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def unit_rows(vectors: pd.Series | np.ndarray) -> np.ndarray:
    """Vectors of one length, scaled to length 1; the largest component goes first, so that no square overflows."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]) if isinstance(vectors, pd.Series) else vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centres, their groups and codebooks, over the first size components.

    Vectors of another length are cut or filled with zeros for the index alone: that brings no two of one length
    further apart, so what it excludes is excluded for certain.
    """

    def __init__(self, sample: np.ndarray, total: int):
        self.size = sample.shape[1]
        self.centres = k_means(sample, int(min(MOST_LISTS, max(1, -(-total // LIST_ROWS)))))
        self.group = own_centre(self.centres, k_means(self.centres, int(min(len(self.centres), max(1, -(-total // BLOCK))))))
        residuals = self.split(sample - self.centres[own_centre(sample, self.centres)])
        self.books = [k_means(r, min(CODES, len(r))) for r in residuals]
        self.apart = np.sqrt(nearest(self.centres, self.centres)[0])

    def fitted(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, max(0, self.size - x.shape[1]))))[:, : self.size]

    @staticmethod
    def split(x: np.ndarray) -> list[np.ndarray]:
        wide = np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))
        return np.split(wide, SUBSPACES, axis=1)

    def encode(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """List, codes, length of what the codes miss, and lists whose border is within margin, of each vector."""
        x = self.fitted(x)
        d, own = nearest(x, self.centres)
        parts = self.split(x - self.centres[own])
        codes = np.stack([own_centre(p, b) for p, b in zip(parts, self.books, strict=True)], axis=1)
        missed = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(parts, self.books, codes.T, strict=True))
        rows = np.arange(len(x))
        to_border = (d - d[rows, own][:, None]) / (2 * self.apart[own] + 1e-12)
        to_border[rows, own] = 0
        return own, codes, np.sqrt(missed), [np.flatnonzero(r <= margin).tolist() for r in to_border]

    def offsets(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What of the squared distance of a query to each vector's code depends on the vector alone."""
        centres = self.split(self.centres[lists])
        return sum(((b[c] + 2 * part) * b[c]).sum(1) for b, c, part in zip(self.books, codes.T, centres, strict=True)).astype(np.float32)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace, a row for each code with what it takes from the squared distance to each query."""
        return [(2 * b @ part.T).astype(np.float32) for part, b in zip(self.split(self.fitted(q)), self.books, strict=True)]


def _forest(r: np.ndarray, c: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A forest with the components of the edges rows[r], columns[c]: (id, smallest id of its component) where they differ."""
    low_r, low_c = rows.copy(), columns.copy()
    while len(r):
        was = low_r.copy(), low_c.copy()
        np.minimum.at(low_c, c, low_r[r])
        np.minimum.at(low_r, r, low_c[c])
        if (was[0] == low_r).all() and (was[1] == low_c).all():
            break
    used_r, used_c = np.unique(r), np.unique(c)
    return [(int(i), int(m)) for i, m in zip(np.r_[rows[used_r], columns[used_c]], np.r_[low_r[used_r], low_c[used_c]], strict=True) if i != m]


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _marked(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """For each list of numbers below n, a row that is true at these."""
    flat = column.combine_chunks()
    out = np.zeros((len(flat), n), bool)
    out[np.repeat(np.arange(len(flat)), flat.value_lengths().to_numpy()), flat.flatten().to_numpy()] = True
    return out


def _counted(rows: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("id", "other", "links"))})


def _meet(index, least: float):
    """Of one block of a group and one block of its queries: links of both sides, and a forest of what they connect.

    Where both vectors of a pair probe the other's list, the pair counts in the list of the lower number alone.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least))

    def compare(key, queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return _counted([])
        fitted = index.value
        x, q = unit_rows(_rows(entries["v"])), unit_rows(_rows(queries["qv"]))
        ids, weight, lists, missed = (entries[c].to_numpy() for c in ("cid", "w", "list", "missed"))
        qids, qweight, home = (queries[c].to_numpy() for c in ("qid", "qw", "home"))
        codes = _rows(entries["codes"])
        allowed = ((reach + missed) ** 2 + 1e-4).astype(np.float32)  # beyond the rounding of single precision
        reached, asks = _marked(entries["probes"], len(fitted.centres)), _marked(queries["qprobes"], len(fitted.centres))
        places, where = np.unique(lists, return_inverse=True)
        asks = asks[:, places]
        offsets = fitted.offsets(lists, codes)
        found, other = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(home, kind="stable")
        for part in (some for same in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) for some in np.array_split(same, -(-len(same) // 256))):
            own = home[part[0]]  # queries of one list ask for much the same lists
            columns = np.flatnonzero(asks[part].any(0)[where] & ((lists <= own) | ~reached[:, own]))
            near = nearest(fitted.fitted(q[part]), fitted.centres[places])[0].T.astype(np.float32)[where[columns]]
            near += offsets[columns][:, None]
            for t, code in zip(fitted.tables(q[part]), codes[columns].T, strict=True):
                near -= t.take(code, axis=0)
            near = near <= allowed[columns][:, None]
            r, c = part[near.any(0)], columns[near.any(1)]
            if not len(r):
                continue
            linked = near[np.ix_(near.any(1), near.any(0))].T & (q[r] @ x[c].T >= least) & asks[np.ix_(r, where[c])]
            linked &= qids[r][:, None] != ids[c][None]
            found[r] += linked @ weight[c]
            other[c] += (linked & (lists[c] != own)[None]).T @ qweight[r]
            a, b = np.nonzero(linked)
            edges.append((r[a], c[b]))
        forest = _forest(*(np.concatenate(e) for e in zip(*edges, strict=True)), qids, ids) if edges else []
        counted = [(i, i, n) for of, k in ((qids, found), (ids, other)) for i, n in zip(of[k > 0].tolist(), k[k > 0].tolist(), strict=True)]
        return _counted(counted + [(a, b, 0) for a, b in forest])

    return compare


def near_vectors(vectors: DataFrame, least: float = 0.95, margin: float | None = None) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are the pairs found with cosine >= least, in double precision; n_links counts the other vectors linked
    directly, component_id is the smallest vec_id that links reach, kept says that it is the row's own. Equal
    vectors are one class with a weight. Neighbouring lists share a group, to which a query goes once; large
    groups, and the queries of those that many probe, are dealt to blocks that meet two by two, so no list has
    to fit in one task; a block yields counts and a forest, never its pairs.

    margin is how far from its border a query still probes a list. By default it is half the largest distance of
    a link, with which every link is found; a smaller one loses links whose direction is nearly that between two
    centres, and probes less.

    Vectors of different lengths never link. Vectors that are null, zero, or hold null or non-finite components
    link with nothing: 0 links, themselves as component. A null vec_id links with nothing (component_id null,
    kept true). Repeated rows of one vec_id count as vectors of their own. Where a cosine is within rounding of
    least, either verdict is right. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    half = float(np.sqrt(max(0.0, 2 - 2 * least)) / 2 if margin is None else margin) + 1e-9
    values = F.col("embedding").cast("array<double>")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    ok = sound & F.col("vec_id").isNotNull()
    # two 64-bit hashes name a vector, so that the vectors themselves are shuffled once
    rows = vectors.select("vec_id", values.alias("v"), F.when(ok, F.xxhash64(values)).alias("h"), F.when(ok, F.xxhash64(F.lit(1), values)).alias("g"))
    classes = scratch(rows.where("h is not null").groupBy("h", "g").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("cid"), F.count("*").alias("w")), "vector_classes")
    size = classes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    none = vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if size is None:
        return none
    sample = classes.where(F.size("v") == size["n"]).select("v").orderBy("h", "g").limit(SAMPLE).toPandas()
    index = spark.sparkContext.broadcast(Index(unit_rows(sample["v"]), classes.count()))

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["v"].map(len)):
                for i in range(0, len(same), 512):
                    part = same.iloc[i : i + 512]
                    own, codes, missed, probes = index.value.encode(unit_rows(part["v"]), half)
                    group = index.value.group
                    yield pd.DataFrame({"cid": part["cid"], "w": part["w"], "v": part["v"], "size": part["v"].map(len), "list": own, "grp": group[own], "codes": codes.tolist(), "missed": missed, "probes": probes, "groups": [np.unique(group[p]).tolist() for p in probes]})

    kinds = "cid bigint, w bigint, v array<double>, size int, list int, grp int, codes array<smallint>, missed double, probes array<int>, groups array<int>"
    coded = scratch(classes.select("cid", "w", "v").mapInPandas(encoded, kinds), "coded")
    # one row for each length and group, of which there are at most MOST_LISTS of a length
    cells = coded.groupBy("size", "grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    asked = coded.select("size", F.explode("groups").alias("grp")).groupBy("size", "grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("n_queries"))
    blocks = scratch(cells.join(asked, ["size", "grp"]), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    floats = F.col("v").cast("array<float>") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("v")
    entries = coded.join(blocks, ["size", "grp"]).select("size", "grp", dealt("n_blocks").alias("b"), each("n_queries").alias("q"), "cid", "w", floats.alias("v"), "list", "codes", "missed", "probes")
    queries = coded.select("size", "cid", "w", "list", "probes", floats.alias("v"), F.explode("groups").alias("grp")).join(blocks, ["size", "grp"])
    queries = queries.select(F.col("size").alias("qs"), F.col("grp").alias("qg"), each("n_blocks").alias("qb"), dealt("n_queries").alias("qq"), F.col("cid").alias("qid"), F.col("w").alias("qw"), F.col("v").alias("qv"), F.col("list").alias("home"), F.col("probes").alias("qprobes"))
    met = queries.groupBy("qs", "qg", "qb", "qq").cogroup(entries.groupBy("size", "grp", "b", "q")).applyInArrow(_meet(index, least), "id bigint, other bigint, links bigint")
    met = scratch(met, "met")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected_components(met.where("id <> other"), "id", "other")
    found = classes.select("h", "g", "cid", "w").join(links.withColumnRenamed("id", "cid"), "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    found = found.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "cid").alias("component"))
    named = rows.select("vec_id", "h", "g").join(found, ["h", "g"], "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
