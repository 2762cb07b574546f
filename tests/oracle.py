"""Compare a query with its SQL in DuckDB on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr
    )


SAME_KIND = {
    "bigint": {"BIGINT", "HUGEINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"},
    "date": {"DATE"}, "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want_cols, want = rows_of(names, cursor.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else []
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
        return f"rows {len(got)} != {len(want)}; missing {missing}; extra {extra}"
    for name, kind in df.dtypes:
        if kinds[name].upper() not in SAME_KIND.get(kind, {kinds[name].upper()}):
            return f"type of {name}: {kind} != {kinds[name]}"
    return None
