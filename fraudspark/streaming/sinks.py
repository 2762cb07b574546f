"""Sinks of the monitor. Every batch can be written again without changing the result."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.operators.temporal import latest_version
from fraudspark.session import cut_lineage, path_exists, scratch_path


def _start(writer, trigger: str | None):
    """Run on a timer, or without one to the end of what has arrived."""
    return writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)


def append_rows(stream: DataFrame, path: str, checkpoint: str, *, trigger: str | None = None):
    """Start writing finished rows; the file sink commits each batch once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer.option("checkpointLocation", checkpoint), trigger).start()


def log_updates(stream: DataFrame, path: str, checkpoint: str, *, trigger: str | None = None):
    """Start writing changed rows, one folder per batch; read them with `read_updates`."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return _start(writer, trigger).start()


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of each row written by `log_updates`."""
    return latest_version(spark.read.parquet(path), list(keys), ["epoch"]).drop("epoch")


#: A table gets twice as many buckets when they hold more rows than this on average.
ROWS_PER_BUCKET = 1_000_000


class EntityTable:
    """An entity table of which the latest version of each key stays, replaced as a whole or not at all.

    Rows lie in folders by a hash of the key. A manifest, one small table for each merge, names the folder of every
    bucket; it counts once its write is complete, so readers see all of a merge or nothing. A merge rewrites only
    the buckets it touches. What a failed merge wrote is named by no manifest; `vacuum` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str]):
        self.spark, self.path, self.keys, self.version = spark, path.rstrip("/"), list(keys), list(version)

    def manifests(self) -> list[str]:
        """Complete manifests, the newest last."""
        folders = [f for f in _children(self.spark, f"{self.path}/manifests") if path_exists(self.spark, f"{f}/_SUCCESS")]
        return sorted(folders, key=lambda f: int(f.rsplit("/", 1)[1]))

    def _entries(self, manifest: str) -> list:
        # One row for each bucket.
        return self.spark.read.schema("buckets int, bucket int, rows long, folder string").json(manifest).collect()

    def read(self) -> DataFrame | None:
        """The rows of the newest complete merge; None before the first."""
        newest = self.manifests()[-1:]
        folders = [e["folder"] for e in self._entries(newest[0])] if newest else []
        return self.spark.read.parquet(*folders) if folders else None

    def merge(self, arrived: DataFrame) -> None:
        newest = self.manifests()[-1:]
        entries = self._entries(newest[0]) if newest else []
        buckets = entries[0]["buckets"] if entries else 1
        stored = cut_lineage(arrived, "arrived")
        rows = sum(e["rows"] for e in entries) + stored.count()
        grown = buckets
        while rows > grown * ROWS_PER_BUCKET:
            grown *= 2
        bucket = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(grown)).cast("int"))
        stored = bucket(stored)
        touched = {r["_bucket"] for r in stored.select("_bucket").distinct().collect()}
        if not touched:
            return
        old = [e for e in entries if grown != buckets or e["bucket"] in touched]
        merged = stored
        if old:
            current = self.spark.read.schema(arrived.schema).parquet(*[e["folder"] for e in old])
            merged = bucket(current).unionByName(stored)
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        latest_version(merged, ["_bucket", *self.keys], self.version).write.partitionBy("_bucket").parquet(folder)
        counts = self.spark.read.parquet(folder).groupBy("_bucket").count().collect()
        new = [(grown, r["_bucket"], r["count"], f"{folder}/_bucket={r['_bucket']}") for r in counts]
        self._commit(new + [tuple(e) for e in entries if e not in old], int(newest[0].rsplit("/", 1)[1]) + 1 if newest else 0)

    def _commit(self, entries: list[tuple], number: int) -> None:
        table = self.spark.createDataFrame(entries, "buckets int, bucket int, rows long, folder string")
        table.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete folders that none of the last `keep` manifests names, and the manifests before those."""
        manifests = self.manifests()
        named = {e["folder"].rsplit("/", 1)[0].rsplit("/", 1)[1] for m in manifests[-keep:] for e in self._entries(m)}
        _delete(self.spark, [f for f in _children(self.spark, f"{self.path}/rows") if f.rsplit("/", 1)[1] not in named])
        _delete(self.spark, manifests[:-keep])


def _children(spark: SparkSession, folder: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{folder}/{s.getPath().getName()}" for s in files.listStatus(target)] if files.exists(target) else []


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def upsert_rows(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: Sequence[str], *, trigger: str | None = None,
):
    """Start merging rows into an `EntityTable`. A batch that runs again changes nothing: the latest version stays."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table = EntityTable(batch.sparkSession, path, keys, version)
        table.merge(batch)
        table.vacuum()

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge)
    return _start(writer, trigger).start()


def finish(query) -> None:
    """Wait for a run to the end of the data."""
    query.awaitTermination()


def run_append(stream: DataFrame) -> DataFrame:
    """Run an append stream to its end and read what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    finish(append_rows(stream, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an update stream to its end and read the final rows."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    finish(log_updates(stream, f"{path}/rows", f"{path}/checkpoint"))
    return read_updates(spark, f"{path}/rows", keys)
