"""Declarative filters and record queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "contains": lambda c, v: c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}


@dataclass(frozen=True)
class Where:
    """`field op value`."""

    field: str
    op: str
    value: Any

    def column(self) -> Column:
        return COMPARE[self.op](F.col(self.field), self.value)


@dataclass(frozen=True)
class All:
    parts: Sequence[Any]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.column() for p in self.parts])


@dataclass(frozen=True)
class Any_:
    parts: Sequence[Any]

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, [p.column() for p in self.parts])


@dataclass(frozen=True)
class Not:
    part: Any

    def column(self) -> Column:
        return ~self.part.column()


@dataclass(frozen=True)
class RecordQuery:
    """Select, where, order, limit and offset over one table.

    Paging needs an order that is total, so end `order` with a unique column.
    """

    select: Sequence[str] = ()
    where: Sequence[Any] = ()
    order: Sequence[tuple[str, str]] = field(default_factory=tuple)
    top: int | None = None
    skip: int | None = None

    def run(self, df: DataFrame) -> DataFrame:
        if self.where:
            df = df.filter(All(self.where).column())
        if self.order:
            df = df.orderBy(*[F.desc(c) if d == "desc" else F.asc(c) for c, d in self.order])
        if self.skip:
            df = df.offset(self.skip)
        if self.top is not None:
            df = df.limit(self.top)
        return df.select(*self.select) if self.select else df

    def page(self, number: int) -> RecordQuery:
        """The query for page 0, 1, 2, ... of size `top`."""
        start = (self.skip or 0) + number * self.top
        return RecordQuery(self.select, self.where, self.order, self.top, start)


def recent(df: DataFrame, date: str, since: Any) -> DataFrame:
    """Rows from `since` on, newest first."""
    return df.filter(F.col(date) >= F.lit(since)).orderBy(F.desc(date))


def investigation(
    df: DataFrame,
    *,
    name_fields: Sequence[str] = (),
    name: str | None = None,
    bin_field: str = "bin",
    bins: Sequence[Any] | None = None,
    date_field: str | None = None,
    since: Any = None,
) -> DataFrame:
    """Rows where any name field holds `name`, the BIN is listed, and the date is recent."""
    if name:
        df = df.filter(reduce(lambda a, b: a | b, [F.col(f).contains(name) for f in name_fields]))
    if bins is not None:
        df = df.filter(F.col(bin_field).isin(list(bins)))
    if since is not None:
        df = df.filter(F.col(date_field) >= F.lit(since))
    return df


def search_text(df: DataFrame, text: str) -> DataFrame:
    """Rows with `text` in any text column, ignoring case."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wanted = text.lower()
    return df.filter(reduce(lambda a, b: a | b, [F.lower(c).contains(wanted) for c in columns]))


def newest_matching(df: DataFrame, name_field: str, name: str, date: str, tie: str, top: int) -> DataFrame:
    return df.filter(F.col(name_field).contains(name)).orderBy(F.desc(date), tie).limit(top)


def alerts_by(
    alerts: DataFrame, *, status: str | None = "ACTIVE", severity: str | None = None, top: int | None = None
) -> DataFrame:
    """Alerts of one status and severity, newest first."""
    if status:
        alerts = alerts.filter(F.col("status") == status)
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    ordered = alerts.orderBy(F.desc("created_at"), "alert_id")
    return ordered.limit(top) if top is not None else ordered


def edges_between(edges: DataFrame, start: Any, end: Any, ts: str = "ts") -> DataFrame:
    """Edges in a time window, both ends included."""
    return edges.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).na.drop().distinct()
