"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_STEPS: dict[int, tuple[weakref.ref, str]] = {}
#: Rows, and bytes, that go to a Python worker at once: both sides hold a batch several times over, and texts are long.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a local session that has none, a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/twinframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs send Arrow batches of at most BATCH_ROWS and about BATCH_BYTES; afterwards the session's own settings hold again."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    spark.conf.set(rows, min(BATCH_ROWS, int(before[rows])) if int(before[rows]) > 0 else BATCH_ROWS)
    spark.conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    step = spark.read.schema(df.schema).parquet(path)
    _STEPS[id(step)] = (weakref.ref(step), path)
    return step


def discard(*steps: DataFrame) -> None:
    """Delete the files of written steps that no later job reads: what was made of them has been written itself."""
    for step in steps:
        known, path = _STEPS.pop(id(step), (None, None))
        if known is not None and known() is step:
            sc = step.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def as_strings(texts: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in as_bytes(texts)]


def slices(texts: pa.Array, rows: int = 256):
    """Parts of an Arrow array, so that only a few texts at a time are Python objects; after them, what Arrow holds of memory that is free again is given back."""
    for i in range(0, len(texts), rows):
        yield texts.slice(i, rows)
    pa.default_memory_pool().release_unused()


class Cache(dict):
    """A dict that computes what it lacks. Keys come as they are first met, so the frequent ones stay: trim() drops the newest beyond the size, and long keys are never kept."""

    def __init__(self, make, size: int = 500_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest = make, size, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def learn(self, keys, make_many) -> None:
        """Compute at once what is lacking of the short keys."""
        lacking = [k for k in keys if k not in self and len(k) <= self.longest]
        self.update(zip(lacking, make_many(lacking), strict=True))

    def trim(self) -> None:
        while len(self) > self.size:
            self.popitem()


def keep_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ids (one column); null matches null; all columns of docs, whatever their names."""
    name = f"_k{uuid.uuid4().hex[:8]}"
    return docs.join(ids.select(F.col(ids.columns[0]).alias(name)), docs[key].eqNullSafe(F.col(name)), "left_semi")
