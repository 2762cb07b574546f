"""Scan, incremental-load and sink queries (SRC, SNK). Files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.plans.entities import relationship_graph
from fraudspark.plans.raw import RAW_ECB_SQL, raw_ecb
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.session import scratch_path
from fraudspark.sources import readers, schemas, writers

CUSTOMERS = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src01_csv_dataset", "SELECT * FROM customer")
def src01(r: Roles):
    path = scratch_path(r.spark, "csv")
    writers.write_csv(r.table("customer").repartition(4), path)
    return readers.csv_dataset(r.spark, path, CUSTOMERS)


@query("src04_first_rows", "SELECT 1000 AS n_rows")
def src04(r: Roles):
    rows = readers.first_rows(r.table("lineitem"), 1000)
    return rows.agg(F.count("*").cast("int").alias("n_rows"))


@query("src04_load_cap", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= (SELECT count(*) FROM customer) * 2 // 3""")
def src04_cap(r: Roles):
    """Two thirds of the rows of several CSV files, which hold the customers in order."""
    customers = r.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = scratch_path(r.spark, "csv")
    writers.write_csv(customers.repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey"), path)
    return readers.load_cap(readers.csv_dataset(r.spark, path, CUSTOMERS), customers.count() * 2 // 3)


@query("src04_sample", """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE ('0x' || substr(md5('audit' || chr(31) || l_orderkey || chr(31) || l_linenumber), 1, 8))::BIGINT < 429496729""")
def src04_sample(r: Roles):
    lines = r.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return readers.sampled(lines, ["l_orderkey", "l_linenumber"], 0.1, seed="audit")


@query("src06_json_records", "SELECT event_id, user_id, event_type, value FROM events")
def src06(r: Roles):
    # Pages as the portal delivers them: one file with one JSON array each.
    path = scratch_path(r.spark, "json")
    record = F.struct("event_id", "user_id", "event_type", "value")
    pages = r.table("events").groupBy(F.floor(F.col("event_id") / 5000).alias("page"))
    arrays = pages.agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("page").text(path)
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    return readers.json_records(r.spark, path, schema)


@query("src08_since_last_load", "SELECT bin, job_id, filing_date FROM jobs WHERE filing_date >= DATE '1999-12-31'")
def src08(r: Roles):
    return readers.since(r.jobs().select("bin", "job_id", "filing_date"), "filing_date", "2000-01-01")


@query("src10_upsert", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'changed' ELSE event_type END AS event_type,
           CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM events""")
def src10(r: Roles):
    current = r.table("events").select("event_id", "event_type", F.lit(1).alias("version"))
    arrived = current.filter("event_id % 3 = 0").withColumns({"event_type": F.lit("changed"), "version": F.lit(2)})
    return readers.upsert(current, arrived, ["event_id"], ["version"])


@query("snk01_graph_tables", """
    SELECT 'nodes' AS kind, 'Owner' AS label, count(*) AS n FROM customer UNION ALL SELECT 'nodes', 'Property', count(*) FROM orders
    UNION ALL SELECT 'edges', 'applied_by', count(*) FROM jobs JOIN owns USING (bin) UNION ALL SELECT 'edges', 'contractor', count(*) FROM jobs JOIN owns USING (bin)
    UNION ALL SELECT 'edges', 'for_property', count(*) FROM jobs JOIN owns USING (bin) UNION ALL SELECT 'edges', 'owns', count(*) FROM jobs JOIN owns USING (bin)
    UNION ALL SELECT 'edges', 'issued_to', count(*) FROM violations UNION ALL SELECT 'edges', 'at_property', count(*) FROM violations
    UNION ALL SELECT 'edges', 'about_property', count(*) FROM complaints""")
def snk01(r: Roles):
    nodes = r.table("customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("Owner").alias("label")).unionByName(
        r.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("Property").alias("label"))
    )
    path = scratch_path(r.spark, "graph")
    for _ in range(2):  # Writing twice must not double anything.
        writers.write_graph(nodes, relationship_graph(r), path)
    count = lambda kind, label: r.spark.read.parquet(f"{path}/{kind}").groupBy(label).agg(
        F.count("*").alias("n")
    ).select(F.lit(kind).alias("kind"), F.col(label).alias("label"), "n")
    return count("nodes", "label").unionByName(count("edges", "rel_type"))


@query("snk02_report_and_export", """
    SELECT p_type, count(*) AS n_json, count(*) AS n_csv FROM part GROUP BY 1""")
def snk02(r: Roles):
    counts = r.table("part").groupBy("p_type").agg(F.count("*").alias("n"))
    json_path, csv_path = scratch_path(r.spark, "report"), scratch_path(r.spark, "export")
    writers.write_report(counts, json_path)
    writers.write_csv(counts, csv_path)
    schema = "p_type string, n bigint"
    as_json = r.spark.read.schema(schema).json(json_path).withColumnRenamed("n", "n_json")
    as_csv = readers.csv_dataset(r.spark, csv_path, schema).withColumnRenamed("n", "n_csv")
    return as_json.join(as_csv, "p_type")


@query("snk04_bad_rows", f"""
    WITH {RAW_ECB_SQL},
    m AS (SELECT isn, concat_ws(',', CASE WHEN issue_raw = 'JUNE 31' THEN 'issue_date' END,
                                CASE WHEN penalty_raw = 'n/a' THEN 'penalty_imposed' END) AS bad FROM raw_ecb)
    SELECT isn AS violation_id, bad AS bad_columns FROM m""")
def snk04(r: Roles):
    raw = raw_ecb(r)
    present = [c for c in schemas.ECB_VIOLATIONS if c[0] in raw.columns]
    good, bad = schemas.split_bad_rows(raw, present)
    return good.select("violation_id", F.lit("").alias("bad_columns")).unionByName(
        bad.select(F.col("ISN_DOB_BIS_EXTRACT").alias("violation_id"), F.array_join("bad_columns", ",").alias("bad_columns"))
    )
