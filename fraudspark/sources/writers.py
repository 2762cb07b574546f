"""Sinks: graph tables, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables; writing again replaces them.

    Kinds are few, so a task keeps a file open for each instead of sorting its rows by kind.
    """
    conf = nodes.sparkSession.conf
    before = conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, "32")
    try:
        for df, kind, folder in ((nodes, "label", "nodes"), (edges, "rel_type", "edges")):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(kind).parquet(f"{path}/{folder}")
    finally:
        conf.set(OPEN_FILES, before)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
