"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Hot join keys are split even where that costs one more shuffle.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Deletes the shuffle files of an execution when it ends; without it they stay until the JVM happens to collect their owners.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The JVM never compiles a method of more than 8 000 bytes, as wide projections give; smaller ones are generated then.
CODEGEN_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "fraudspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **SKEW_SETTINGS,
        **CODEGEN_SETTINGS,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings that keep hot keys apart and wide projections compiled."""
    for key, value in {**SKEW_SETTINGS, **CODEGEN_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables and stream checkpoints.

    A cluster names it in `spark.checkpoint.dir`. Only a local session, which has one
    machine anyway, gets a folder of its own when the setting is missing.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="fraudspark-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Compared with `checkpoint()` the rows are computed once instead of twice, stay columnar,
    and survive the loss of any executor. What was shuffled for them is deleted once they are stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_paths_of(df: DataFrame) -> list[str]:
    """Folders of a frame made by `cut_lineage`."""
    return sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()})


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete superseded intermediate tables, and nothing outside the scratch folder."""
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in target.toUri().getPath():
            target.getFileSystem(conf).delete(target, True)
