"""Scans of raw files and incremental loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudspark.functions.patterns import dataset_category
from fraudspark.operators.temporal import latest_version
from fraudspark.sources.schemas import Spec, raw_schema


def csv_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All CSV files of a dataset, with a header row; without a schema every column is text."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("multiLine", False).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def raw_table(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    return csv_dataset(spark, path, raw_schema(spec))


def json_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed pages, each a JSON array of records."""
    reader = spark.read.schema(schema).option("multiLine", True)
    return reader.option("recursiveFileLookup", True).json(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, dataset, category, size_bytes, modified) of non-empty files, without reading them."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.filter("length > 0").select(
        "path",
        stem.alias("file"),
        F.element_at(F.split("path", "/"), -2).alias("dataset"),
        dataset_category(stem).alias("category"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def latest_files(files: DataFrame) -> DataFrame:
    """The newest file of each dataset."""
    return latest_version(files, ["dataset"], ["modified", "path"])


def first_rows(df: DataFrame, n: int = 10_000) -> DataFrame:
    return df.limit(n)


def load_cap(files: DataFrame, cap: int) -> DataFrame:
    """The first `cap` rows of file scan `files`, files in the order of their paths and rows in the order of a file.

    Rows are counted by file and block; counts are summed up in path order, whole blocks before the cap are taken
    and the one in which it lies is cut. Only one row for each block is ordered. `files` is a scan without filters.
    """
    at = F.col("_metadata")
    rows = files.select("*", at["file_path"].alias("_path"), at["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("_path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.join(starts, ["_path", "_block"])
    return placed.filter(F.col("_at") + F.col("_shift") < cap).select(*files.columns)


def sampled(df: DataFrame, keys: Sequence[str], share: float, *, seed: str = "sample") -> DataFrame:
    """Rows whose hash of the seed and the keys is in the lowest `share`: the same ones at any partitioning and in any run.

    Rows with equal keys are in or out together; NULL counts as an empty text.
    """
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.filter(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))


def since(df: DataFrame, date: str, last_load: str, *, overlap_days: int = 1) -> DataFrame:
    """Rows from the last load on, with an overlap for late records."""
    return df.filter(F.col(date) >= F.date_sub(F.lit(last_load).cast("date"), overlap_days))


def upsert(current: DataFrame, arrived: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Current rows with arrivals merged in; the latest version of a key stays."""
    return latest_version(current.unionByName(arrived), list(keys), list(version))
