import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import communities, graph, joins
from fraudspark.operators.filters import edges_between
from fraudspark.session import cut_lineage


def edge_table(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "src string, dst string, weight double")


def test_cycle(spark):
    cycle = edge_table(spark, ["ab", "bc", "cd", "ad"])
    row = graph.graph_summary(cycle).first()
    assert (row.nodes, row.edges, row.density) == (4, 4, 0.666667)
    parts = graph.component_summary(graph.connected_components(cycle)).first()
    assert (parts.n_components, parts.largest_component) == (1, 4)
    assert {r.degree for r in graph.degrees(cycle).collect()} == {2}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(70)] + [(names[0], n) for n in names[90:]] + list(itertools.pairwise(names[30:60]))
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    got = {r.node: r.component for r in graph.connected_components(edge_table(spark, pairs), nodes).collect()}
    assert got == {n: find(n) for n in names}


def test_time_window(spark):
    rows = [("a", "b", 0), ("b", "c", 10), ("c", "d", 20), ("d", "e", 40)]
    edges = spark.createDataFrame(rows, "src string, dst string, d int").withColumn("ts", F.date_add(F.lit("2023-01-01").cast("date"), F.col("d")))
    kept = edges_between(edges, "2023-01-06", "2023-01-26").collect()
    assert {(r.src, r.dst) for r in kept} == {("b", "c"), ("c", "d")}


def cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0")]
    return edge_table(spark, pairs)


def test_modularity_communities(spark):
    edges = cliques(spark)
    found = communities.modularity_communities(edges).select("node", "label")
    groups = {}
    for r in found.collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[f"{g}{i}" for i in range(5)] for g in "ab"]
    alone = found.select("node", F.col("node").alias("label"))
    q = graph.modularity(edges, found).first().modularity
    assert q > graph.modularity(edges, alone).first().modularity and abs(q - 0.452381) < 1e-5


def test_consensus_and_spectral(spark):
    edges = cliques(spark)
    runs = communities.multi_resolution(edges)
    assert runs.select("run").distinct().count() == 10 and runs.count() == 100
    assert graph.consensus(edges, runs).count() == 10
    split = {r.node: r.label for r in graph.spectral_communities(edges, 2).collect()}
    assert len(split) == 10 and len(set(split.values())) == 2


def test_metrics_of_a_clique(spark):
    edges = cliques(spark).withColumn("ts", F.lit("2024-01-01").cast("date"))
    labels = graph.both_ways(edges).select(F.col("src").alias("node")).distinct().withColumn("label", F.substring("node", 1, 1))
    rows = graph.community_metrics(edges, labels).collect()
    assert {(r.label, r.size, r.edges, r.density, r.clustering) for r in rows} == {("a", 5, 10, 1.0, 1.0), ("b", 5, 10, 1.0, 1.0)}


def test_mean_betweenness(spark):
    # Path of four: inner nodes lie on 2 of the 3 pairs that exclude them; star of three leaves: the hub on all.
    edges = edge_table(spark, ["ab", "bc", "cd", "wx", "wy", "wz"])
    rows = [(n, "path") for n in "abcd"] + [(n, "star") for n in "wxyz"]
    labels = spark.createDataFrame(rows, "node string, label string")
    got = {r.label: r.mean_betweenness for r in graph.mean_betweenness(edges, labels).collect()}
    assert got == {"path": round((2 / 3 * 2) / 4, 8), "star": 0.25}


def test_co_occurrence(spark):
    df = spark.createDataFrame([("x", "y", None), ("x", "y", "x"), ("x", "", "z")], "f1 string, f2 string, f3 string")
    nodes, edges = graph.co_occurrence(df, ["f1", "f2", "f3"], namespaced=False)
    assert {(r.node, r.record_count) for r in nodes.collect()} == {("x", 4), ("y", 2), ("z", 1)}
    assert {(r.src, r.dst, r.weight) for r in edges.collect()} == {("x", "y", 3.0), ("x", "z", 1.0)}


def test_shared_keys_golden(spark):
    rows = [("A", "123 Main St, NYC"), ("B", "9 Elm"), ("C", " 123 main st, nyc "), ("D", ""), ("E", "")]
    entities = spark.createDataFrame(rows, "name string, address string")
    assert sorted((r.name, r.n_members) for r in joins.shared_addresses(entities).collect()) == [("A", 2), ("C", 2)]
    firms = spark.createDataFrame([("Alpha", ["John Smith", "X"]), ("Beta", ["john smith"]), ("Gamma", ["Z"])], "name string, officers array<string>")
    assert sorted((r.officer, r.name) for r in joins.shared_officers(firms).collect()) == [("john smith", "Alpha"), ("john smith", "Beta")]


def test_changes(spark):
    rows = [(0, n, "p") for n in "abcd"] + [(0, n, "q") for n in "xy"] + [(1, n, "p") for n in "abcd"] + [(1, n, "r") for n in "mn"]
    df = spark.createDataFrame(rows, "window_no int, node string, label string")
    got = {(r.community_id, r.change_type, r.stability) for r in graph.community_changes(df).collect()}
    assert got == {("p", "stable", 1.0), ("r", "created", 0.0), ("q", "dissolved", 0.0)}


def test_relationship_graph_joins_its_tables_once(spark, folder):
    """the edges of a record come from one pass, and the counts from one pass over the edges."""
    from fraudspark.operators import entities
    from fraudspark.plans.entities import relationship_graph
    from fraudspark.plans.roles import Roles

    graph = relationship_graph(Roles(spark, folder))
    assert graph._jdf.queryExecution().analyzed().toString().count("Join ") == 1
    rows = spark.createDataFrame(
        [("p:1", "a:1", "owns", None, 0.8), ("p:1", "a:1", "owns", None, 0.8), ("p:1", "a:2", "at_property", None, 1.0)],
        "src string, dst string, rel_type string, ts date, weight double")
    found = {r["rel_type"]: (r["n"], r["total_weight"], r["n_sources"], r["n_targets"]) for r in entities.relationship_counts(rows).collect()}
    assert found == {"owns": (2, 1.6, 1, 1), "at_property": (1, 1.0, 1, 1)}


def test_components_of_many_named_nodes_are_found_on_numbers(spark, monkeypatch):
    """names that sort otherwise than by length, links given twice and both ways, a hub and a chain."""
    rng = random.Random(8)
    names = [f"{rng.choice('ab')}:{i}" for i in range(90)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(40)] + [(names[0], n) for n in names[60:]] + list(itertools.pairwise(names[10:30]))
    pairs += [p[::-1] for p in pairs[:20]] + pairs[:5] + [(names[3], names[3]), (None, names[4])]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    want = sorted((r.node, r.component) for r in graph.connected_components(edges).collect())
    links, ids = graph._numbered(edges.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    assert {t for _, t in links.dtypes} == {"bigint"} and links.count() == links.distinct().count()
    rows = [r.node for r in ids.orderBy("id").collect()]
    assert rows == sorted(rows)
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted((r.node, r.component) for r in graph.connected_components(edges).collect()) == want


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in name for name in files.mkString("|").split("|"))


def test_stored_tables_leave_no_shuffle_files(spark):
    """what was shuffled for a stored table is deleted with the end of its job."""
    before = shuffle_files(spark)
    stored = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.monotonic() + 5
    while shuffle_files(spark) > before and time.monotonic() < until:
        time.sleep(0.1)  # files are deleted beside the job
    assert shuffle_files(spark) <= before
    assert stored.count() == 7


def test_owners_stay_apart_in_graphs_over_time(spark):
    """Owners are nodes of their own, not put together by their number."""
    from fraudspark.plans import graphs

    class Tables:
        def jobs(self):
            return spark.createDataFrame([(1, 7, "1998-11-01"), (2, 7, "1998-12-01")], "bin bigint, contractor_id bigint, filing_date string").withColumn("filing_date", F.to_date("filing_date"))

        def owns(self):
            return spark.createDataFrame([(3, 1), (28, 2)], "owner_id bigint, bin bigint")

    assert {(r.src, r.dst) for r in graphs.dated_graph(Tables()).collect()} == {("owner:3", "contractor:7"), ("owner:28", "contractor:7")}
