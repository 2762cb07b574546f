"""The given tables in the roles the operators expect: owners, properties, jobs, violations.

Each role exists twice: as a DataFrame, and as SQL for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_SQL = {
    "owners": """
        SELECT c_custkey AS owner_id, c_name AS owner_name,
               n_name || ' ' || c_mktsegment AS owner_address
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "properties": """
        SELECT o_orderkey AS bin, o_custkey AS owner_id, r_name AS borough, n_name AS zipcode,
               CAST(o_orderkey AS VARCHAR) || ' ' || n_name || ' STREET' AS address
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "owns": "SELECT o_custkey AS owner_id, o_orderkey AS bin FROM orders",
    "jobs": """
        SELECT l_orderkey AS bin, l_suppkey AS contractor_id, l_linestatus AS job_type,
               l_returnflag AS job_status, CAST(l_shipdate AS DATE) AS filing_date,
               l_extendedprice AS initial_cost,
               concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                         strftime(l_shipdate, '%Y%m%d')) AS job_id
        FROM lineitem""",
    "violations": """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                         strftime(l_shipdate, '%Y%m%d')) AS violation_id,
               l_orderkey AS bin, CASE WHEN l_returnflag = 'R' THEN 'DOB' ELSE 'ECB' END AS agency,
               l_suppkey AS respondent_id, CAST(l_shipdate AS DATE) AS issue_date,
               l_extendedprice * l_discount AS penalty, l_partkey AS part_id
        FROM lineitem WHERE l_returnflag IN ('R', 'A')""",
    "typed_violations": """
        SELECT v.*, p_type AS violation_type FROM violations v JOIN part ON part_id = p_partkey""",
    "contractors": """
        SELECT s_suppkey AS contractor_id, s_name AS business_name, n_name AS license_type,
               s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "complaints": """
        SELECT event_id AS complaint_id, user_id AS bin, event_type AS category, ts,
               CAST(ts AS DATE) AS date_entered, value FROM events""",
}
_NEEDS = {"typed_violations": ["violations"]}


def with_roles(sql: str) -> str:
    """Put the role tables that `sql` mentions in front of it."""
    used = [r for r in ROLE_SQL if re.search(rf"\b{r}\b", sql)]
    wanted = {n for r in used for n in [*_NEEDS.get(r, []), r]}
    if not wanted:
        return sql
    heads = ", ".join(f"{r} AS ({ROLE_SQL[r]})" for r in ROLE_SQL if r in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


class Roles:
    """Tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def owners(self) -> DataFrame:
        nations = self.table("nation")
        return (
            self.table("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("owner_id"),
                F.col("c_name").alias("owner_name"),
                F.concat_ws(" ", "n_name", "c_mktsegment").alias("owner_address"),
            )
        )

    def properties(self) -> DataFrame:
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        residents = self.table("customer").join(
            places, F.col("c_nationkey") == F.col("n_nationkey")
        )
        return (
            self.table("orders")
            .join(residents, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("bin"),
                F.col("o_custkey").alias("owner_id"),
                F.col("r_name").alias("borough"),
                F.col("n_name").alias("zipcode"),
                F.concat_ws(" ", F.col("o_orderkey").cast("string"), "n_name", F.lit("STREET")).alias("address"),
            )
        )

    def owns(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("bin")
        )

    def _line_id(self):
        # (l_orderkey, l_linenumber) repeats in these tables; this combination does not.
        return F.concat_ws(
            "-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.date_format("l_shipdate", "yyyyMMdd"),
        )

    def jobs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("bin"),
            F.col("l_suppkey").alias("contractor_id"),
            F.col("l_linestatus").alias("job_type"),
            F.col("l_returnflag").alias("job_status"),
            F.col("l_shipdate").cast("date").alias("filing_date"),
            F.col("l_extendedprice").alias("initial_cost"),
            self._line_id().alias("job_id"),
        )

    def violations(self) -> DataFrame:
        return (
            self.table("lineitem")
            .filter(F.col("l_returnflag").isin("R", "A"))
            .select(
                self._line_id().alias("violation_id"),
                F.col("l_orderkey").alias("bin"),
                F.when(F.col("l_returnflag") == "R", "DOB").otherwise("ECB").alias("agency"),
                F.col("l_suppkey").alias("respondent_id"),
                F.col("l_shipdate").cast("date").alias("issue_date"),
                (F.col("l_extendedprice") * F.col("l_discount")).alias("penalty"),
                F.col("l_partkey").alias("part_id"),
            )
        )

    def typed_violations(self) -> DataFrame:
        types = self.table("part").select(
            F.col("p_partkey").alias("part_id"), F.col("p_type").alias("violation_type")
        )
        return self.violations().join(types, "part_id")

    def contractors(self) -> DataFrame:
        nations = self.table("nation")
        return (
            self.table("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("contractor_id"),
                F.col("s_name").alias("business_name"),
                F.col("n_name").alias("license_type"),
                F.col("s_acctbal").alias("balance"),
            )
        )

    def complaints(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("complaint_id"),
            F.col("user_id").alias("bin"),
            F.col("event_type").alias("category"),
            "ts",
            F.col("ts").cast("date").alias("date_entered"),
            "value",
        )
