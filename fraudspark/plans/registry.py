"""Names of queries, what they run, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudspark.plans.roles import Roles, with_roles
from fraudspark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Roles` as a query; `sql` may use the role tables."""

    def add(build: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, folder: build(Roles(prepare(spark), folder))
        if sql is not None:
            CHECKS[name] = with_roles(sql)
        return build

    return add
