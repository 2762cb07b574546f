"""Cases found in review: absent features, NULL groups, empty lists, a table that meets a new checkpoint."""

from pyspark.sql import functions as F

from fraudspark import session
from fraudspark.operators import aggregates, filters, graph, scoring, temporal
from fraudspark.streaming import sinks


def test_scorers_without_features(spark):
    for kind in scoring.FEATURES:
        rows = scoring.score(spark.createDataFrame([("a",)], "entity_id string"), kind).collect()
        assert [(r["entity_id"], r["risk_level"]) for r in rows] == [("a", "LOW")]
    assert scoring.score(spark.createDataFrame([(9,)], "violation_count long"), "person").first()["entity_id"] == "unknown"


def test_box_statistics_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in aggregates.box_statistics(df, "v", ["k"]).collect()}
    assert got == {"a": 2.0, None: 6.0}


def test_empty_bin_list_and_same_day(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "bin long, day string").withColumn("day", F.to_date("day"))
    assert filters.investigation(df, bins=[]).count() == 0 and filters.investigation(df).count() == 2
    other = df.withColumnRenamed("day", "later")
    assert temporal.within_days(df, other, "bin", "day", "later", 0).count() == 2


def test_report_names_every_pattern(spark):
    alerts = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "pattern string, risk_score double")
    got = {r["pattern"]: r["n_alerts"] for r in aggregates.alert_report(alerts, ["x", "z"]).collect()}
    assert got == {"x": 1, "y": 1, "z": 0}


def test_components_of_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)]
    found = graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()
    assert {r["component"] for r in found} == {0, 100} and len(found) == 61 + 17


def test_upsert_keeps_rows_under_a_new_checkpoint(spark, tmp_path):
    def load(first, last, name):
        source = str(tmp_path / name)
        spark.range(first, last).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit(first).alias("ver")).write.parquet(source)
        stream = spark.readStream.schema("k long, v int, ver int").parquet(source)
        sinks.finish(sinks.upsert_rows(stream, str(tmp_path / "table"), str(tmp_path / f"cp-{name}"), ["k"], ["ver"]))

    load(0, 20, "a")
    load(18, 24, "b")
    assert sinks.EntityTable(spark, str(tmp_path / "table"), ["k"], ["ver"]).read().count() == 24


def test_wide_projections_are_compiled(spark):
    session.prepare(spark)
    # The JVM leaves methods of more than 8 000 bytes uncompiled.
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
