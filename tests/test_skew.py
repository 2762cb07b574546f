"""Hot keys: the ways taken for large groups give the same rows as the plain ones."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import patterns, temporal
from fraudspark.operators.documents import project_contents, project_documents, project_records
from fraudspark.operators.ordered import quantiles, range_counts, running
from fraudspark.operators.entities import potential_shells
from fraudspark.operators.pairs import group_members, similar_strings
from fraudspark.session import cut_lineage


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


@pytest.fixture(scope="module")
def hot(spark, folder):
    """Events with a third of all rows under one user, and many equal times."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return cut_lineage(events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id"))))


@pytest.mark.parametrize("keys", [["user_id"], ["user_id", "event_type"]])
def test_running(hot, keys):
    asked = dict(
        sums={"s": F.when(F.col("value") > 5, 1).otherwise(0)}, lasts={"l": F.when(F.col("event_type") == "click", F.col("event_id"))},
        previous={"p": F.when(F.col("event_id") % 2 == 0, F.col("event_type"))},
    )
    assert same(running(hot, keys, ["ts", "event_id"], **asked), running(hot, keys, ["ts", "event_id"], group_limit=5, **asked))


def test_range_counts(hot):
    asked = dict(days_before=2, days_after=3)
    assert same(range_counts(hot, ["user_id"], "ts", "event_id", **asked), range_counts(hot, ["user_id"], "ts", "event_id", group_limit=5, **asked))


def test_quantiles(hot):
    cuts = {"q1": 0.25, "m": 0.5, "q3": 0.75}
    got = quantiles(hot, ["user_id"], "value", cuts)
    want = hot.groupBy("user_id").agg(*[F.percentile("value", q).alias(n) for n, q in cuts.items()])
    rounded = lambda df: df.select("user_id", *[F.round(c, 6).alias(c) for c in cuts])
    assert same(rounded(want), rounded(got))


def test_quantiles_of_odd_numbers(spark):
    """Neighbouring doubles, all exponents, signs, zeros, infinities, NaN, NULL keys and values."""
    draw = random.Random(4)
    odd = [0.0, -0.0, float("inf"), -float("inf"), float("nan"), 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    for k in range(-1074, 1024, 3):
        x = 2.0 ** k
        odd += [x, math.nextafter(x, 0), math.nextafter(x, math.inf), -x, -math.nextafter(x, 0)]
    rows = [(key, v) for key in ("a", None) for v in odd + [draw.gauss(0, 1) for _ in range(50)]] + [("b", None), ("c", None), ("c", 2.5)]
    rows += [("h", float(draw.randrange(4))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    cuts = {f"q{i}": i / 40 for i in range(41)}
    got = {r.key: r for r in quantiles(df, ["key"], "v", cuts, ends=True).collect()}
    by_key = {}
    for key, v in rows:
        if v is not None:
            by_key.setdefault(key, []).append(v)
    assert set(got) == set(by_key)
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    same_number = lambda x, y: x == y or (math.isnan(x) and math.isnan(y))
    for key, values in by_key.items():
        values = sorted(values, key=order)
        assert got[key].n == len(values) and same_number(got[key].low, values[0]) and same_number(got[key].high, values[-1])
        for name, q in cuts.items():
            at = (len(values) - 1) * q
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want = low if at == math.floor(at) or low == high else low + (high - low) * (at - math.floor(at))
            assert same_number(got[key][name], want), (key, name)


def test_follow_ups_golden(spark):
    rows = [(f"2024-{d} 00:00:00", i, c) for i, (d, c) in enumerate([("01-01", "Fast"), ("01-05", "Fast"), ("01-10", "Fast"), ("02-01", "Normal"), ("03-15", "Normal")])]
    events = spark.createDataFrame(rows, "t string, id int, entity string").select(F.col("t").cast("timestamp").alias("ts"), "id", "entity")
    everyone = temporal.follow_ups(events, "ts", "id").orderBy("id").collect()
    assert [(r.id, r.event_count, r.window_days) for r in everyone] == [(0, 3, 9), (1, 3, 27)]
    for limit in (1, 100):
        per = temporal.follow_ups(events, "ts", "id", key="entity", group_limit=limit).collect()
        assert [(r.id, r.event_count) for r in per] == [(0, 3)]


def test_latest_before(hot):
    of = lambda kind, n: hot.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("ts").alias(f"{n}_ts"))
    args = (of("purchase", "p"), of("error", "e"), "user_id", "p_ts", "p_id", "e_ts", "e_id")
    assert same(temporal.latest_before(*args), temporal.latest_before(*args, group_limit=3))


def test_value_changes_and_repeats(hot):
    for fn, more in ((temporal.repeat_history, ()), (temporal.value_changes, ("event_type",))):
        assert same(fn(hot, ["user_id"], "ts", "event_id", *more), fn(hot, ["user_id"], "ts", "event_id", *more, group_limit=5))


def test_group_members(spark):
    """One form at every size: a key that holds most rows has one row per member, like all others."""
    rows = [("small", i) for i in range(4)] + [("big", i) for i in range(500)] + [("big", 7), ("one", 1), (None, 5), ("small", None)]
    df = spark.createDataFrame(rows, "k string, id int").withColumn("worth", F.col("id") + 1)
    got = group_members(df, "k", "id", ["worth"]).collect()
    assert sorted((r.k, r.id, r.worth) for r in got) == sorted((k, i, i + 1) for k, i in set(rows) if k in ("small", "big") and i is not None)
    assert {(r.k, r.n_members, r.first_member, r.total_worth) for r in got} == {("small", 4, 0, 10), ("big", 500, 0, 125250)}


def test_shells_by_classes(spark):
    """Links of each confidence, compared with all pairs, on an address of 300 owners."""
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(1, 14)) for i in range(300)] + [("two", 900, 1), ("two", 901, 1), ("far", 950, 40), ("far", 951, 1), (None, 1, 9)]
    members = spark.createDataFrame(rows, "address_key string, owner_id long, property_count long")
    want = {}
    for k, i, p in rows:
        for m, j, q in rows:
            if k and k == m and i != j and p + q >= 3:
                at = (k, i, 0.9 if p + q >= 10 else 0.7 if p + q >= 5 else 0.5)
                want[at] = want.get(at, 0) + 1
    got = potential_shells(members).collect()
    assert {(r.address_key, r.owner_id, r.confidence): r.n_links for r in got} == want and len(got) == len(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("limit", [1000, 3])
def test_similar_strings(spark, k, limit):
    rng = random.Random(k)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)} | {f"nation{i}house" for i in range(40)}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "s string")
    ordered = sorted(words)
    want = {(a, b, d) for i, a in enumerate(ordered) for b in ordered[i + 1:] if (d := distance(a, b)) <= k}
    assert {tuple(r) for r in similar_strings(df, "s", k, bucket_limit=limit).collect()} == want


@pytest.mark.parametrize("limit", [256, 5])
def test_similar_strings_with_a_segment_in_all(spark, limit):
    """One long part is common to all strings, so are two, and lengths differ."""
    rng = random.Random(11)
    words = {f"{rng.randint(1, 400)} {rng.choice(['main', 'mian', 'elm', 'oak'])} street new york ny 10{rng.randint(0, 9)}00" for _ in range(220)}
    words |= {w[1:] for w in list(words)[:30]} | {w + "ab" for w in list(words)[:30]}
    df = spark.createDataFrame([(w,) for w in words], "s string")
    ordered = sorted(words)
    want = {(a, b, d) for i, a in enumerate(ordered) for b in ordered[i + 1:] if abs(len(a) - len(b)) <= 3 and (d := distance(a, b)) <= 3}
    assert {tuple(r) for r in similar_strings(df, "s", 3, bucket_limit=limit).collect()} == want


@pytest.mark.parametrize("limit, variants", [(1000, 1), (3, 1), (3, 40)])
def test_similar_strings_by_segments_and_rests(spark, limit, variants):
    """All strings by segments, or the short ones by their rests: the same pairs, also across the border."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(150)} | {f"nation{i}house" for i in range(40)}
    df = spark.createDataFrame([(w,) for w in words], "s string")
    ordered = sorted(words)
    want = {(a, b, d) for i, a in enumerate(ordered) for b in ordered[i + 1:] if (d := distance(a, b)) <= 2}
    assert {tuple(r) for r in similar_strings(df, "s", 2, bucket_limit=limit, most_variants=variants).collect()} == want


def test_numbered_names_make_few_candidates(spark, monkeypatch):
    """Names that differ in a number only share most segments; not every pair of them is a candidate."""
    from fraudspark.operators import pairs

    looked = []
    near = pairs._near
    monkeypatch.setattr(pairs, "_near", lambda df, k: looked.append(df.count()) or near(df, k))
    names = [f"supplier{i * 7919 % 10**9:09d}" for i in range(2000)]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    want = {(a, b) for i, a in enumerate(sorted(names)) for b in sorted(names)[i + 1:] if sum(x != y for x, y in zip(a, b)) <= 2}
    got = {(r["a"], r["b"]) for r in pairs.similar_strings(df, "s", 2).collect()}
    assert want <= got
    assert sum(looked) < 300_000


@pytest.mark.parametrize("block_size", [2, 64])
def test_crowded_properties(spark, block_size):
    """Pairs that meet on a crowded property only are listed like all others, at any block size."""
    rows = [(1, c) for c in (1, 2, 2)] + [(9, c) for c in range(1, 41)] + [(9, 3), (9, None), (None, 4)]
    jobs = spark.createDataFrame(rows, "bin bigint, contractor_id bigint")
    want = {}
    works = {k: rows.count(k) for k in rows if None not in k}
    for (bin_x, x), n in works.items():
        for (bin_y, y), m in works.items():
            if bin_x == bin_y and x < y:
                times, shared = want.get((x, y), (0, 0))
                want[x, y] = times + n * m, shared + 1
    got = patterns.collaborations(jobs, at_least=1, block_size=block_size).collect()
    assert {(r.a, r.b): (r.times, r.n_properties) for r in got} == want and len(got) == len(want)
    often = patterns.collaborations(jobs, block_size=block_size).collect()
    assert {(r.a, r.b): (r.times, r.n_properties) for r in often} == {k: v for k, v in want.items() if v[0] >= 2}


def test_project_records(hot):
    """A building with a third of all records has one head and as many rows, numbered without gaps."""
    rows = hot.select(F.col("user_id").alias("bin"), F.col("event_id").alias("id"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("category"))
    args = rows, rows.filter("id % 5 = 0"), rows.limit(0)
    heads = {d.bin: d for d in project_documents(*args).collect()}
    counts = project_records(*args).groupBy("bin").agg(
        F.count("*").alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("places"),
        F.count_if(F.col("kind") == "violation").alias("violations")).collect()
    assert all(c.n == c.last == c.places for c in counts) and sum(c.n for c in counts) == rows.count() + args[1].count()
    assert all(heads[c.bin].n_permits + c.violations == c.n and heads[c.bin].n_violations == c.violations for c in counts if c.bin in heads)
    assert {c.bin for c in counts if c.n > 1} == set(heads)


def test_documents_hold_every_record_in_its_place(spark):
    hot = [(1, f"p{i}", None if i % 50 == 0 else f"2024-01-{i % 28 + 1:02d}", "A1") for i in range(400)] + [(2, "q", "2024-01-01", "A1"), (3, "s", "2024-01-02", "NB")]
    schema = "bin long, id string, date string, category string"
    args = [spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))
            for rows in (hot, [(2, "v", "2024-02-01", "DOB")], [(9, "c", "2024-02-02", "NOISE")])]
    rows = project_contents(*args).collect()
    assert sorted(r.position for r in rows if r.bin == 1) == list(range(1, 401)) and {r.id for r in rows if r.bin == 1} == {h[1] for h in hot[:400]}
    assert [(r.kind, r.id, r.n_violations, r.name) for r in sorted(rows, key=lambda r: r.position) if r.bin == 2] == [
        ("permit", "q", 1, "Building_Project_2"), ("violation", "v", 1, "Building_Project_2")]
    assert {r.bin for r in rows} == {1, 2}


def test_tasks_grow_with_the_rows_they_pair(spark, monkeypatch):
    """more rows are dealt to more tasks, with the same pairs and sums."""
    from fraudspark.operators import patterns

    jobs = spark.createDataFrame([(b, c, f"{b}-{c}") for b in range(40) for c in range(b % 7, 9)], "bin long, contractor_id long, job_id string")
    owners = spark.createDataFrame([(i, f"{i % 12} main street") for i in range(20)], "owner_id long, owner_address string")
    owns = spark.createDataFrame([(b % 20, b) for b in range(40)], "owner_id long, bin long")
    violations = spark.createDataFrame([(b,) for b in range(0, 40, 3)], "bin long")
    both = lambda: (patterns.collaborations(jobs), patterns.work_over_related_owners(owners, owns, jobs, violations))
    want = [sorted(map(tuple, df.collect())) for df in both()]
    monkeypatch.setattr(patterns, "WORKS_ROWS", 10)
    monkeypatch.setattr(patterns, "SERVED_ROWS", 5)
    dealt = both()
    for df in dealt:
        parts = [int(x) for x in re.findall(r"RepartitionByExpression \[.*\], (\d+)", df._jdf.queryExecution().analyzed().toString())]
        assert parts and min(parts) > 8
    assert [sorted(map(tuple, df.collect())) for df in dealt] == want


def test_project_records_are_not_stored(spark):
    """records are dealt by building once, and placed where they are; nothing is written on the way."""
    import os

    from fraudspark.operators.documents import project_records
    from fraudspark.session import scratch_root

    fields = "bin long, id string, date date, category string"
    permits = spark.createDataFrame([(1, "a", None, "NB"), (2, "b", None, "DM")], fields)
    others = spark.createDataFrame([(1, "c", None, "x"), (3, "d", None, "x")], fields)
    before = set(os.listdir(scratch_root(spark)))
    rows = project_records(permits, others, others.limit(0)).collect()
    assert set(os.listdir(scratch_root(spark))) == before
    assert {(r["bin"], r["id"], r["details"], r["position"]) for r in rows} == {
        (1, "a", "Permit a filed for NB", 1), (1, "c", "Violation c for x", 2), (2, "b", "Permit b filed for DM", 1)}
