"""Incremental intake: new files are fingerprinted, checked and added once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ranged import digest_of, file_ranges, file_system

#: State on disk, of which a batch looks up and writes what it needs; checkpoints hold what has changed since the last.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _listed(spark: SparkSession, root: str, glob: str, listed: str) -> None:
    """Adds to the tables of paths under listed those under root that none of them has; if there are none, no table is made."""
    paths = file_ranges(spark, root, glob, read="path").select("path")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(listed)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.schema("path string").option("recursiveFileLookup", True).parquet(listed)
        paths = paths.join(known.hint("merge"), "path", "left_anti")  # paths take little room on disk, and much as a broadcast
    paths.withColumn("run", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("run").parquet(listed)


def _digests(paths: DataFrame, root: str) -> DataFrame:
    """path, sha256, length of files by their paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, before = file_system(root)
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path.removeprefix(before)) as f:
                    found.append(digest_of(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "sha256", "length"])

    return paths.mapInArrow(run, "path string, sha256 string, length bigint")


def start_intake(spark: SparkSession, root: str, table: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Reads what is new under the folder root, keeps the first file of each content, and appends to the Parquet table path, sha256, length the contents it hasn't seen yet.

    Tasks list the files and write the paths that no earlier listing has to the checkpoint's folder listed, which the stream
    reads: the driver knows folders and listings, not files. A batch that is run again reads the same listing. Files are
    read in chunks, through Arrow's file systems, and can be of any size.

    The digests seen are the stream's state, dealt by digest, in a store on disk: a batch looks up its own digests and
    never reads the table. The table's log of batches makes a batch that is run again add nothing. The table belongs to the
    checkpoint: one that other writers have filled is refused. A checkpoint of an intake that kept no listings goes on: all
    files are read once more, and their digests are known.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = own.getFileSystem(hadoop)
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_spark_metadata")
    if fs.exists(own) and len(fs.listStatus(own)) and not fs.exists(log):
        raise ValueError(f"{table} wasn't written by an intake")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    root = folder.getFileSystem(hadoop).makeQualified(folder).toString()
    listed = f"{checkpoint}/listed"
    _listed(spark, root, glob, listed)
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # listings are never too old to be read
        paths = spark.readStream.schema("path string").option("recursiveFileLookup", True).option("maxFileAge", "36500d").parquet(listed)
        rows = _digests(paths.repartition("path"), root).dropDuplicates(["sha256"])
        return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
