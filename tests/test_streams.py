"""Sessions that close at the end, merges that fail half-way, load caps, samples and sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import aggregates
from fraudspark.sources import readers
from fraudspark.streaming import monitors, sinks

START = dt.datetime(2024, 1, 1)


def sessions_of(rows, gap):
    out, last = [], {}
    for key, at in sorted((k, t) for k, t in rows if k is not None and t is not None):
        if key in last and at < out[last[key]][2]:
            first, n = out[last[key]][1], out[last[key]][3]
            out[last[key]] = (key, first, at + gap, n + 1)
        else:
            last[key] = len(out)
            out.append((key, at, at + gap, 1))
    return sorted(out)


def test_sessions_over_several_arrivals(spark, tmp_path):
    """A hot key in every arrival, a session that goes on over two, and one that is open at the end."""
    draw, rows = random.Random(2), []
    for part in range(3):
        base = START + dt.timedelta(hours=12 * part)
        rows.append([("hot", base + dt.timedelta(minutes=draw.randrange(700))) for _ in range(300)]
                    + [(draw.choice("abc"), base + dt.timedelta(minutes=draw.randrange(700))) for _ in range(20)]
                    + [("over", base + dt.timedelta(minutes=m)) for m in (5, 715)] + [(None, base)])
    frames = [spark.createDataFrame(part, "k string, ts timestamp") for part in rows]
    got = monitors.closed_sessions(frames, str(tmp_path), "k", "ts", gap="30 minutes")
    want = sessions_of([r for part in rows for r in part], dt.timedelta(minutes=30))
    assert sorted(map(tuple, got.select("k", "session_start", "session_end", "n_events").collect())) == want
    assert sum(1 for w in want if w[0] == "over") == 4


def test_a_failed_merge_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = sinks.EntityTable(spark, str(tmp_path / "t"), ["k"], ["ver"])
    rows = lambda first, last, ver: spark.range(first, last).select(F.col("id").alias("k"), F.lit(ver).alias("ver"), F.lit(7).alias("bucket"))
    assert table.read() is None
    monkeypatch.setattr(sinks, "ROWS_PER_BUCKET", 10)
    table.merge(rows(0, 30, 1))
    before = sorted(map(tuple, table.read().collect()))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_commit", fail)
        with pytest.raises(OSError):
            table.merge(rows(0, 90, 2))
    assert sorted(map(tuple, table.read().collect())) == before
    # A manifest that was not completed does not count either.
    spark.createDataFrame([(1, 0, 1, "nowhere")], "buckets int, bucket int, rows long, folder string").write.json(str(tmp_path / "t/manifests/9"))
    (tmp_path / "t/manifests/9/_SUCCESS").unlink()
    assert sorted(map(tuple, table.read().collect())) == before
    for _ in range(2):  # the same batch twice
        table.merge(rows(20, 90, 2))
        table.vacuum()
    assert sorted(map(tuple, table.read().collect())) == sorted([(k, 1, 7) for k in range(20)] + [(k, 2, 7) for k in range(20, 90)])
    assert len(table.manifests()) == 2
    table.merge(rows(0, 0, 3))
    assert table.read().count() == 90


@pytest.mark.parametrize("cap", [0, 1, 9, 10, 11, 25, 47, 100])
def test_load_cap_cuts_inside_a_file(spark, tmp_path, cap):
    sizes, want = [10, 0, 15, 3, 19], []
    for i, n in enumerate(sizes):
        lines = [f"{i},{j}" for j in range(n)]
        (tmp_path / f"f{i}.csv").write_text("\n".join(["a,b", *lines]) + "\n")
        want += [(i, j) for j in range(n)]
    got = readers.load_cap(readers.csv_dataset(spark, str(tmp_path), "a int, b int"), cap)
    assert sorted(map(tuple, got.collect())) == want[:cap]


def test_sample_is_the_same_at_any_partitioning(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 7).alias("k"))
    one = sorted(r.id for r in readers.sampled(rows.coalesce(1), ["id"], 0.2).collect())
    assert one == sorted(r.id for r in readers.sampled(rows.repartition(13, "k"), ["id"], 0.2).collect()) and 700 < len(one) < 900
    assert set(one) < {r.id for r in readers.sampled(rows, ["id"], 0.3).collect()}
    assert readers.sampled(rows, ["id"], 0.0).count() == 0 and readers.sampled(rows, ["id"], 1.0).count() == 4000
    by_key = readers.sampled(rows, ["k"], 0.5).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in by_key}.items() <= {r.k: r["count"] for r in rows.groupBy("k").count().collect()}.items()


def test_merged_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 40).alias("day"), (F.col("id") * 7919 % 30_011).alias("v"), F.lit(None).cast("string").alias("n"))
    sketches = aggregates.distinct_sketches(rows, ["v", "n", "day"], ["day"])
    got = {r["column"]: r.n_distinct for r in aggregates.merged_distinct(sketches).collect()}
    assert abs(got["v"] - 30_011) <= 3 * aggregates.SKETCH_ERROR * 30_011 and got["day"] == 40 and got["n"] == 0
    some = aggregates.merged_distinct(sketches.filter("day < 20")).filter("column = 'day'").first()
    assert some.n_distinct == 20


def test_sketches_give_one_number_however_the_rows_are_dealt(spark):
    rows = spark.range(0, 60000, 1, 1).select((F.col("id") % 23011).alias("v"), (F.col("id") % 7).alias("day"), F.lit(1).alias("all"))
    counts = {aggregates.merged_distinct(aggregates.distinct_sketches(df, ["v"], by)).first().n_distinct
              for df, by in ((rows, ["all"]), (rows, ["day"]), (rows.repartition(5), ["all"]))}
    assert len(counts) == 1
