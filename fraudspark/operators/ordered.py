"""Running values per key that do not depend on one task holding a whole key.

A plain window puts every row of a key in one task. When the largest key is small that is the
cheapest plan and it is used. Otherwise the rows are range-partitioned by (key, order), which
cuts a hot key into many slices; each slice is scanned on its own and receives the totals of
the slices before it. Both ways give the same rows. A table without a key is always sliced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.functions.dates import MICROS_PER_DAY, micros
from fraudspark.session import cut_lineage

# Largest key, in rows, that one task may hold.
GROUP_LIMIT = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key, by a partially aggregated count."""
    counts = df.groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add running columns to `df`.

    `order` must be a total order within a key. `sums` are totals up to and including the row,
    `lasts` the latest non-null value up to and including the row, `previous` the value on the
    row before. Keys must not be NULL.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    keys, order = list(keys), list(order)
    if keys and largest_group(df, keys) <= group_limit:
        return _scan(df, keys, order, sums, lasts, previous)

    # The slice of a row is stored with it, so a lost executor cannot move rows between slices.
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *keys, *order)
    sliced = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    position = F.struct(*order)
    totals = sliced.groupBy("_slice", *keys).agg(
        F.count("*").alias("_rows"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(f"_last_{n}") for n, c in lasts.items()],
        *[F.max_by(F.struct(c.alias("v")), position).alias(f"_prev_{n}") for n, c in previous.items()],
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice",
        *keys,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in lasts],
        *[F.last(f"_prev_{n}").over(before).alias(f"_prev_{n}") for n in previous],
    )
    scanned = _scan(sliced, ["_slice", *keys], order, sums, lasts, previous)
    first_in_slice = F.col("_row") == 1
    joined = scanned.withColumn(
        "_row", F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    ).join(offsets, ["_slice", *keys])
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"_sum_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(n), F.col(f"_last_{n}")).alias(n) for n in lasts],
        *[
            F.when(first_in_slice, F.col(f"_prev_{n}.v")).otherwise(F.col(n)).alias(n)
            for n in previous
        ],
    )


def _scan(df, keys, order, sums, lasts, previous) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        *[F.sum(c).over(upto).alias(n) for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()],
        *[F.lag(c).over(ordered).alias(n) for n, c in previous.items()],
    )


def range_counts(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    row_id: str,
    *,
    days_before: int = 0,
    days_after: int = 0,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """For each event: how many events of its key lie in [ts - before, ts + after].

    Adds `position` (1, 2, ... by ts then id), `in_range` (the event itself included),
    `upto_end` (events up to ts + after) and `last_ts` (the latest of them).
    A row enters with its key, time and id; other columns are dropped.
    """
    keys = list(keys)
    rows = events.select(*keys, ts, row_id).na.drop().withColumn("_at", micros(F.col(ts)))
    lower = F.col("_at") - days_before * MICROS_PER_DAY
    upper = F.col("_at") + days_after * MICROS_PER_DAY
    if keys and largest_group(rows, keys) <= group_limit:
        by_time = Window.partitionBy(*keys).orderBy("_at")
        upto_end = by_time.rangeBetween(Window.unboundedPreceding, days_after * MICROS_PER_DAY)
        inside = by_time.rangeBetween(-days_before * MICROS_PER_DAY, days_after * MICROS_PER_DAY)
        return rows.select(
            *keys,
            ts,
            row_id,
            F.row_number().over(Window.partitionBy(*keys).orderBy("_at", row_id)).alias("position"),
            F.count("*").over(inside).alias("in_range"),
            F.count("*").over(upto_end).alias("upto_end"),
            F.max(ts).over(upto_end).alias("last_ts"),
        )

    # Both ends of every range become marks in the event order; running counts at the marks
    # give the number of events before them.
    marks = rows.select(
        *keys,
        ts,
        row_id,
        F.explode(
            F.array(
                F.struct(lower.alias("at"), F.lit(0).alias("kind")),
                F.struct(F.col("_at").alias("at"), F.lit(1).alias("kind")),
                F.struct(upper.alias("at"), F.lit(2).alias("kind")),
            )
        ).alias("mark"),
    ).select(*keys, ts, row_id, "mark.at", "mark.kind")
    is_event = F.col("kind") == 1
    counted = running(
        marks,
        keys,
        ["at", "kind", row_id],
        sums={"seen": F.when(is_event, 1).otherwise(0)},
        lasts={"seen_ts": F.when(is_event, F.col(ts))},
        group_limit=group_limit,
    )
    return counted.groupBy(*keys, ts, row_id).agg(
        F.max(F.when(is_event, F.col("seen"))).alias("position"),
        (
            F.max(F.when(F.col("kind") == 2, F.col("seen")))
            - F.max(F.when(F.col("kind") == 0, F.col("seen")))
        ).alias("in_range"),
        F.max(F.when(F.col("kind") == 2, F.col("seen"))).alias("upto_end"),
        F.max(F.when(F.col("kind") == 2, F.col("seen_ts"))).alias("last_ts"),
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by `keys` in which NULL keys meet each other; the keys come once."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same).drop(*[f"_right_{k}" for k in keys])


# Digits of a number's image: sign, exponent and the first bits of the fraction, then three times 16 bits.
DIGITS = ["_d0", "_d1", "_d2", "_d3"]


def _image(value: Column) -> list[Column]:
    """Digits of a double that compare as the double does; only equal numbers have all of them in common.

    The logarithm only picks a power of two near the number, in order of size; scaling by it is exact, with one bit
    to spare where the logarithm was rounded to the next power. NaN is the largest value.
    """
    size = F.abs(value)
    finite = ~F.isnan(value) & (size < float("inf"))
    power = F.when(finite & (size > 0), F.floor(F.log2(size)))
    bits = (size / F.pow(F.lit(2.0), power) * float(1 << 53)).cast("long") - (1 << 52)
    head = F.when(finite, F.coalesce((power + 1080) * 64 + F.shiftright(bits, 48), F.lit(0))).when(F.isnan(value), 1 << 20).otherwise(1 << 19)
    rest = [F.coalesce(F.when(finite, F.shiftright(bits, k).bitwiseAND(F.lit(65535))), F.lit(0)) for k in (32, 16, 0)]
    below = value < 0
    return [F.when(below, -head).otherwise(head), *[F.when(below, 65535 - d).otherwise(d) for d in rest]]


def quantiles(df: DataFrame, keys: Sequence[str], column: str, cuts: dict[str, float], *, ends: bool = False, stored: bool = False) -> DataFrame:
    """Exact interpolated quantiles per key: one output column per entry of `cuts`; with `ends`, also n, low and high.

    Selection by digits: values are counted by their leading digit, and by the next one only within the
    buckets that hold a wanted rank, until each such bucket has one value. Nothing is sorted, no key is gathered, and
    a narrow copy of the input (or the input itself, where it is `stored`) is read at most four times. NULL keys are
    groups; NULL values are left out, and a key without values has no row.
    """
    keys = list(keys) or ["_all"]
    rows = df if keys != ["_all"] else df.withColumn("_all", F.lit(0))
    value = F.col("_v")
    narrow = rows.select(*keys, F.col(column).cast("double").alias("_v")).filter(value.isNotNull())
    digits = (narrow if stored else cut_lineage(narrow, "values")).select("*", *[d.alias(n) for n, d in zip(DIGITS, _image(value))])
    wanted, totals = None, None
    for k, digit in enumerate(DIGITS):
        known = [*keys, *DIGITS[:k]]
        inside = digits if k == 0 else join_null_safe(digits, wanted.select(*known).distinct(), known)
        counted = cut_lineage(inside.groupBy(*known, digit).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "digits")
        if k == 0:
            totals = cut_lineage(counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_low").alias("low"), F.max("_high").alias("high")), "totals")
            at = lambda q: (F.col("_total") - 1) * F.lit(q)
            ranks = [F.struct(F.lit(f"{side}{n}").alias("name"), edge(at(q)).cast("long").alias("rank"))
                     for n, q in cuts.items() for side, edge in (("lo_", F.floor), ("hi_", F.ceil))]
            wanted = totals.select(*keys, F.explode(F.array(*ranks)).alias("w")).select(*keys, "w.*")
        # One bucket has at most 65 536 digits, and the exponents that occur in the first turn.
        before = F.sum("_n").over(Window.partitionBy(*known).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.withColumn("_before", F.coalesce(before, F.lit(0)))
        held = join_null_safe(placed, wanted.select(*known, "name", "rank"), known)
        held = held.filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
        wanted = cut_lineage(held.select(*known, digit, "name", (F.col("rank") - F.col("_before")).alias("rank"), "_low", "_high"), "ranks")
        if wanted.filter("_low <> _high").isEmpty():
            break
    found = wanted.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == f"{side}{n}", F.col("_low"))).alias(f"_{side}{n}") for n in cuts for side in ("lo_", "hi_")])
    found = join_null_safe(found, totals, keys)
    part = lambda q: at(q) - F.floor(at(q))
    low, high = (lambda n: F.col(f"_lo_{n}")), (lambda n: F.col(f"_hi_{n}"))
    between = lambda n, q: F.when((part(q) == 0) | (low(n) == high(n)), low(n)).otherwise(low(n) + (high(n) - low(n)) * part(q))
    extra = [F.col("_total").alias("n"), "low", "high"] if ends else []
    return found.select(*[k for k in keys if k != "_all"], *[between(n, q).alias(n) for n, q in cuts.items()], *extra)
