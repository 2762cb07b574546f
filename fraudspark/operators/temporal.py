"""Time-ordered analysis: follow-ups, versions, rolling counts, interval and as-of joins.

Time order within a key uses `ordered.running` and `ordered.range_counts`, which cut keys that
are too large for one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.functions.dates import MICROS_PER_DAY, micros
from fraudspark.operators.ordered import GROUP_LIMIT, range_counts, running
from fraudspark.session import cut_lineage


def follow_ups(
    events: DataFrame, ts: str, row_id: str, *, key: str | None = None, days: int = 30,
    at_least: int = 2, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Events followed by `at_least` later events within `days`: event_count and window_days.

    Events at the same time follow each other in the order of their ids. Without a key the
    whole table is one timeline.
    """
    keys = [key] if key else []
    counted = range_counts(events, keys, ts, row_id, days_after=days, group_limit=group_limit)
    later = F.col("upto_end") - F.col("position")
    span = F.floor((micros(F.col("last_ts")) - micros(F.col(ts))) / F.lit(MICROS_PER_DAY))
    return counted.filter(later >= at_least).select(
        *keys, row_id, ts, (later + 1).alias("event_count"), span.cast("bigint").alias("window_days")
    )


def first_version(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The first row per key; versions are aggregated, so no key is sorted as a whole."""
    return _one_version(df, keys, version, F.min_by)


def latest_version(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The last row per key."""
    return _one_version(df, keys, version, F.max_by)


def _one_version(df, keys, version, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*version)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top_entities(scores: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(score), tie).limit(k)


def top_per_type(scores: DataFrame, kind: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per type.

    Spark keeps only k rows per type in each task before the shuffle (window group limit), so a
    type never travels whole.
    """
    order = Window.partitionBy(kind).orderBy(F.desc(score), tie)
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def monthly_windows(end: str, count: int = 12, days: int = 30) -> list[tuple[int, date, date]]:
    """(window_no, start, end), oldest first, each ending where the next begins."""
    last = date.fromisoformat(end)
    back = lambda n: last - timedelta(days=n * days)
    return [(count - 1 - i, back(i + 1), back(i)) for i in reversed(range(count))]


def in_windows(df: DataFrame, day: str, end: str, *, count: int = 12, days: int = 30) -> DataFrame:
    """Rows with every window that holds them; a date on a border is in both windows.

    The windows are a short constant array, so each row finds its own without a join, and their
    outer limits reach the scan as a filter.
    """
    windows = monthly_windows(end, count, days)
    constant = F.array(*[
        F.struct(F.lit(n).alias("window_no"), F.lit(a).alias("window_start"), F.lit(b).alias("window_end"))
        for n, a, b in windows
    ])
    inside = F.filter(constant, lambda w: F.col(day).between(w["window_start"], w["window_end"]))
    placed = df.filter(F.col(day).between(F.lit(windows[0][1]), F.lit(windows[-1][2])))
    return placed.select("*", F.inline(inside))


def rolling_filings(
    facts: DataFrame, keys: Sequence[str], date: str, row_id: str, *, days: int = 183,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Facts of the key within the last `days` up to each fact, itself included."""
    counted = range_counts(facts, keys, date, row_id, days_before=days, group_limit=group_limit)
    return counted.select(*keys, date, row_id, F.col("in_range").alias("n_recent"))


def value_changes(
    facts: DataFrame, keys: Sequence[str], date: str, row_id: str, value: str, *, days: int | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(keys, changes): how often `value` differs from the row before, lately or ever.

    With `days`, changes within that time before the key's last row count.
    """
    ordered = running(
        facts.select(*keys, date, row_id, value), keys, [date, row_id],
        previous={"before": F.col(value)}, group_limit=group_limit,
    )
    changed = ordered.withColumn("_c", F.col("before").isNotNull() & (F.col("before") != F.col(value)))
    if days is None:
        return changed.groupBy(*keys).agg(F.count_if("_c").alias("changes"))
    # Stored, so that the join can split a hot key at run time.
    last = cut_lineage(facts.groupBy(*keys).agg(F.max(date).alias("_last")), "last")
    lately = F.col("_c") & (F.col(date) >= F.date_sub("_last", days))
    return changed.join(last, keys).groupBy(*keys).agg(F.count_if(lately).alias("changes"))


def repeat_history(
    facts: DataFrame, keys: Sequence[str], date: str, row_id: str, *, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """For each fact: how many the key has had so far, and the days since the one before."""
    ordered = running(
        facts.select(*keys, date, row_id), keys, [date, row_id],
        sums={"repeat_no": F.lit(1)}, previous={"before": F.col(date)}, group_limit=group_limit,
    )
    return ordered.select(
        *keys, date, row_id, F.col("repeat_no").cast("bigint").alias("repeat_no"),
        F.datediff(date, "before").cast("bigint").alias("days_since_previous"),
    )


def serial_filings(
    filings: DataFrame, keys: Sequence[str], date: str, row_id: str, status: str, *, days: int = 90,
    at_least: int = 3, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Keys with `at_least` filings within `days`, and their status changes."""
    burst = (
        rolling_filings(filings, keys, date, row_id, days=days, group_limit=group_limit)
        .groupBy(*keys)
        .agg(F.max("n_recent").alias("max_filings"))
        .filter(F.col("max_filings") >= at_least)
    )
    changes = value_changes(filings, keys, date, row_id, status, group_limit=group_limit)
    return burst.join(changes, list(keys))


def within_days(
    first: DataFrame, second: DataFrame, key: str, first_date: str, second_date: str, days: int
) -> DataFrame:
    """Pairs where a `second` follows a `first` of the same key within `days`.

    Time is cut into blocks of `days`; a row of `second` can only match its own block and the
    one before, so both sides meet on (key, block) and a hot key spreads over its blocks.
    """
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / max(days, 1))
    left = first.withColumn("_block", block(F.col(first_date)))
    own = block(F.col(second_date))
    right = second.withColumn("_block", F.explode(F.array(own, own - 1)))
    gap = F.datediff(second_date, first_date)
    return left.join(right, [key, "_block"]).filter(gap.between(0, days)).drop("_block")


def latest_before(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, left_id: str, right_ts: str, value: str,
    *, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """As-of join: for each left row the last right row of its key at or before it, the largest `value` of equal times.

    Both sides become one time line; the running last right value is what a left row sees. Ids keep their types.
    """
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    marks = left.select(
        key, F.col(left_ts).alias("at"), F.lit(1).alias("kind"), F.col(left_id).alias("row_id"),
        empty(right, right_ts).alias("found_ts"), empty(right, value).alias("found"),
    ).unionByName(
        right.select(
            key, F.col(right_ts).alias("at"), F.lit(0).alias("kind"), empty(left, left_id).alias("row_id"),
            F.col(right_ts).alias("found_ts"), F.col(value).alias("found"),
        )
    ).filter(F.col(key).isNotNull() & F.col("at").isNotNull())
    seen = F.when(F.col("kind") == 0, F.struct("found_ts", "found"))
    ordered = running(marks, [key], ["at", "kind", "row_id", "found"], lasts={"seen": seen}, group_limit=group_limit)
    return ordered.filter("kind = 1").select(
        key, F.col("row_id").alias(left_id), F.col("at").alias(left_ts),
        F.col("seen.found_ts").alias(right_ts), F.col("seen.found").alias(value),
    )
