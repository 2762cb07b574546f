"""Graph and community queries (GR), and patterns built on components (GP-22, RS-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.functions.dates import decay_weight
from fraudspark.operators import communities, scoring
from fraudspark.operators import graph as op
from fraudspark.operators.joins import shared_addresses, shared_officers
from fraudspark.operators.temporal import in_windows
from fraudspark.plans.entities import GRAPH_SQL, relationship_graph
from fraudspark.plans.joins import group_members_sql
from fraudspark.plans.registry import query
from fraudspark.plans.roles import Roles
from fraudspark.plans.scoring import LINKED_SQL, entity_links, linked_scores
from fraudspark.session import cut_lineage

PART_FIELDS = ["p_name", "p_brand", "p_type"]

PARTS_SQL = """
    rec AS (SELECT 'p_name:' || p_name AS a, 'p_brand:' || p_brand AS b, 'p_type:' || p_type AS c FROM part),
    edges AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, count(*)::DOUBLE AS weight
              FROM (SELECT a AS x, b AS y FROM rec UNION ALL SELECT a, c FROM rec UNION ALL SELECT b, c FROM rec) GROUP BY 1, 2),
    both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
"""


def part_graph(r: Roles):
    """Names, brands and types found on the same part."""
    return op.co_occurrence(r.table("part"), PART_FIELDS)


def address_graph(r: Roles):
    """Owners linked to their addresses."""
    return op.canonical(op.bipartite(r.owners(), "owner_id", "owner_address"))


ADDRESS_GRAPH_SQL = """
    edges AS (SELECT least('owner_id:' || owner_id, 'owner_address:' || owner_address) AS src,
                     greatest('owner_id:' || owner_id, 'owner_address:' || owner_address) AS dst, 1.0::DOUBLE AS weight FROM owners),
    both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
"""


@query("gr01_co_occurrence_nodes", "WITH " + PARTS_SQL + """
    SELECT node, count(*) AS record_count FROM (SELECT unnest([a, b, c]) AS node FROM rec) GROUP BY 1""")
def gr01_nodes(r: Roles):
    return part_graph(r)[0]


@query("gr01_co_occurrence_edges", "WITH " + PARTS_SQL + "SELECT * FROM edges")
def gr01_edges(r: Roles):
    return part_graph(r)[1]


@query("gr02_relationship_graph", "WITH " + GRAPH_SQL + """
    SELECT split_part(src, ':', 1) AS src_type, split_part(dst, ':', 1) AS dst_type, count(*) AS n_edges, round(sum(w), 4) AS weight
    FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS w FROM rel GROUP BY 1, 2) GROUP BY 1, 2""")
def gr02(r: Roles):
    graph = op.canonical(relationship_graph(r))
    kind = lambda c: F.split(c, ":")[0]
    return graph.groupBy(kind("src").alias("src_type"), kind("dst").alias("dst_type")).agg(
        F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("weight")
    )


@query("gr03_degrees", "WITH " + PARTS_SQL + """
    SELECT src AS node, count(*) AS degree, sum(weight) AS weighted_degree FROM both_ways GROUP BY 1""")
def gr03(r: Roles):
    return op.degrees(part_graph(r)[1])


@query("gr04_graph_summary", "WITH " + PARTS_SQL + """
    SELECT count(DISTINCT src) AS nodes, count(*) // 2 AS edges,
           round(count(*)::DOUBLE / (count(DISTINCT src) * (count(DISTINCT src) - 1)), 6) AS density FROM both_ways""")
def gr04(r: Roles):
    return op.graph_summary(part_graph(r)[1])


@query("gr05_components", "WITH " + ADDRESS_GRAPH_SQL + """
    , c AS (SELECT dst, min(least(src, dst)) AS component FROM edges GROUP BY 1)
    SELECT src AS node, src AS component FROM edges GROUP BY 1
    UNION ALL SELECT dst, any_value(src) FROM edges GROUP BY 1""")
def gr05(r: Roles):
    # 'owner_address:' sorts before 'owner_id:', so each address is the root of its owners.
    return op.connected_components(address_graph(r))


@query("gr05_component_summary", "WITH " + ADDRESS_GRAPH_SQL + """
    , s AS (SELECT src, count(*) + 1 AS size FROM edges GROUP BY 1)
    SELECT count(*) AS n_components, max(size) AS largest_component FROM s""")
def gr05_summary(r: Roles):
    return op.component_summary(op.connected_components(address_graph(r)))


def propagation_sql(key: str = "") -> str:
    """`labelled` (key, node, label): the rounds of label propagation to their end; `both_ways` must hold (key, src, dst, weight)."""
    k = f"{key}, " if key else ""
    of = lambda t: f"{t}.{key}, " if key else ""
    on = lambda a, b: f" AND {a}.{key} = {b}.{key}" if key else ""
    return f"""
    rounds(turn, {k}node, label) AS (
      SELECT DISTINCT 0, {k}src, src FROM both_ways
      UNION ALL (
      WITH votes AS (SELECT {k}node, label, sum(weight) AS w, bool_or(own) AS own FROM (
             SELECT {of("b")}b.src AS node, l.label, b.weight, false AS own FROM both_ways b JOIN rounds l ON l.node = b.dst{on("l", "b")}
             UNION ALL SELECT {k}node, label, 0.0, true FROM rounds) GROUP BY ALL),
      best AS (SELECT {k}node, max(label) FILTER (own) AS label, max(round(w, 9)) FILTER (own) AS held,
             arg_min({{'label': label, 'w': w}}, (-round(w, 9), label)) AS b FROM votes GROUP BY ALL),
      wishes AS (SELECT {k}node, label, b.label AS goal, b.w - held AS gain FROM best WHERE b.w - held > 1e-9 * b.w),
      net AS (SELECT {k}label, round(sum(net), 9) AS net FROM (SELECT {k}label, -gain AS net FROM wishes UNION ALL SELECT {k}goal, gain FROM wishes) GROUP BY ALL),
      sides AS (SELECT {k}label, net > 0 OR (net = 0 AND left(md5(label || ':' || (SELECT max(turn) FROM rounds)), 1) < '8') AS takes FROM net),
      goals AS (SELECT {of("w")}w.node, w.goal FROM wishes w JOIN sides x ON x.label = w.label{on("x", "w")} AND NOT x.takes
             JOIN sides y ON y.label = w.goal{on("y", "w")} AND y.takes)
      SELECT l.turn + 1, {of("l")}l.node, coalesce(g.goal, l.label) FROM rounds l LEFT JOIN goals g ON g.node = l.node{on("g", "l")}
      WHERE EXISTS (SELECT 1 FROM wishes))),
    labelled AS (SELECT {k}node, label FROM rounds WHERE turn = (SELECT max(turn) FROM rounds))"""


SETTLED_SQL = " SELECT node, label, true AS settled FROM labelled"


@query("gr06_label_propagation", "WITH RECURSIVE " + PARTS_SQL + ", " + propagation_sql() + SETTLED_SQL)
def gr06(r: Roles):
    """The label of every node; none has more weight towards another label than towards its own."""
    return communities.settled_labels(cut_lineage(part_graph(r)[1], "parts"))


def dated_graph(r: Roles):
    """Owners and contractors linked by the date of each job, for graphs over time."""
    jobs = r.jobs().join(r.owns(), "bin")
    return jobs.select(
        F.concat(F.lit("owner:"), F.col("owner_id").cast("string")).alias("src"),
        F.concat(F.lit("contractor:"), F.col("contractor_id").cast("string")).alias("dst"),
        F.col("filing_date").alias("ts"),
    )


DATED_SQL = """
    dated AS (SELECT 'owner:' || owner_id AS src, 'contractor:' || contractor_id AS dst, filing_date AS ts FROM jobs JOIN owns USING (bin))
"""


def borough_graph(r: Roles):
    """The same with owners put together in 25 groups."""
    jobs = r.jobs().join(r.owns(), "bin")
    return jobs.select(
        F.concat(F.lit("borough:"), F.col("owner_id") % 25).alias("src"),
        F.concat(F.lit("contractor:"), F.col("contractor_id").cast("string")).alias("dst"),
        F.col("filing_date").alias("ts"),
    )


BOROUGH_SQL = """
    dated AS (SELECT 'borough:' || (owner_id % 25) AS src, 'contractor:' || contractor_id AS dst, filing_date AS ts FROM jobs JOIN owns USING (bin))
"""


@query("gr07_temporal_label_propagation", "WITH RECURSIVE " + DATED_SQL + """
    , edges AS (SELECT src, dst, round(sum(0.7 + 0.3 / (1.0 + (ts - DATE '1990-01-01') / 365.0)), 6)::DOUBLE AS weight FROM dated GROUP BY 1, 2),
    both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), """ + propagation_sql() + SETTLED_SQL)
def gr07(r: Roles):
    base = F.lit("1990-01-01").cast("date")
    weighted = dated_graph(r).withColumn("weight", op.temporal_weight(decay_weight(F.col("ts"), base)))
    return communities.settled_labels(cut_lineage(op.canonical(weighted).withColumn("weight", F.round("weight", 6)), "dated"))


#: Every node in one community that hangs together, and modularity not below that of the components.
PARTITION_SQL = " SELECT DISTINCT src AS node, 1::BIGINT AS times, true AS connected, true AS better FROM both_ways"


def judged(edges, labels):
    labels = cut_lineage(labels, "judged")
    better = communities.not_below_components(edges, labels.select(F.lit("1.0").alias("run"), "node", "label"), {"1.0": 1.0})
    return communities.checked_partition(edges, labels).withColumn("better", F.lit(better.first()["better"]))


@query("gr08_modularity_communities", "WITH " + PARTS_SQL + PARTITION_SQL)
def gr08(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    return judged(edges, communities.modularity_communities(edges))


@query("gr09_greedy_modularity", "WITH " + PARTS_SQL + PARTITION_SQL)
def gr09(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    return judged(edges, communities.greedy_communities(edges))


@query("gr10_spectral_communities", "WITH " + PARTS_SQL + " SELECT DISTINCT src AS node, 1::BIGINT AS times, true AS in_range FROM both_ways")
def gr10(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    found = op.spectral_communities(edges).groupBy("node").agg(F.count("*").alias("times"), F.max("label").alias("label"), F.min("label").alias("least"))
    nodes = op.both_ways(edges).select(F.col("src").alias("node")).distinct()
    # At most ten clusters, numbered from 0.
    return nodes.join(found, "node", "left").select("node", F.coalesce("times", F.lit(0)).alias("times"), F.col("label").between(0, 9).alias("in_range"))


@query("gr11_infomap", "WITH RECURSIVE " + PARTS_SQL + ", " + propagation_sql() + SETTLED_SQL)
def gr11(r: Roles):
    # The map-equation name stands for label propagation here, as it does in the original.
    return communities.settled_labels(cut_lineage(part_graph(r)[1], "parts"))


RUNS = communities.resolution_steps()


@query("gr12_multi_resolution", "WITH " + PARTS_SQL + f"""
    , n AS (SELECT count(DISTINCT src) AS nodes FROM both_ways)
    SELECT run, nodes, nodes AS placements, true AS better FROM n, (SELECT unnest({list(RUNS)}) AS run)""")
def gr12(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    runs = communities.multi_resolution(edges)
    counted = runs.groupBy("run").agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("placements"))
    return counted.join(communities.not_below_components(edges, runs, RUNS), "run")


@query("gr13_consensus", "WITH " + PARTS_SQL + " SELECT DISTINCT src AS node, 1::BIGINT AS times, true AS connected, true AS agreed FROM both_ways")
def gr13(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    runs = communities.multi_resolution(edges)
    found = cut_lineage(op.consensus(edges, runs).select("node", F.col("component").alias("label")), "consensus")
    # Whoever has company in its group shares a community with a neighbour there in at least eight of the ten runs.
    at = lambda end: runs.select("run", F.col("node").alias(end), F.col("label").alias(f"{end}_r"))
    links = op.both_ways(op.inner_edges(edges, found).select("src", "dst"))
    shared = links.join(at("src"), "src").join(at("dst"), ["run", "dst"]).groupBy("src", "dst").agg(F.count_if(F.col("src_r") == F.col("dst_r")).alias("n"))
    most = shared.groupBy(F.col("src").alias("node")).agg(F.max("n").alias("most"))
    sizes = found.join(found.groupBy("label").agg(F.count("*").alias("size")), "label").join(most, "node", "left")
    agreed = sizes.select("node", ((F.col("size") == 1) | (F.coalesce("most", F.lit(0)) >= 8)).alias("agreed"))
    return communities.checked_partition(edges, found).join(agreed, "node")


def part_labels(r: Roles):
    """A fixed partition of the part graph, by the first letter after the kind of node."""
    return part_graph(r)[0].select("node", F.substring(F.element_at(F.split("node", ":"), 2), -1, 1).alias("label"))


LABELS_SQL = "labels_of AS (SELECT DISTINCT src AS node, right(split_part(src, ':', 2), 1) AS label FROM both_ways)"


@query("gr14_sized_communities", "WITH " + PARTS_SQL + f", {LABELS_SQL}" + """
    SELECT label, count(*) AS size FROM labels_of GROUP BY 1 HAVING count(*) >= 3""")
def gr14(r: Roles):
    return op.sized_communities(part_labels(r))


WEIGHTS_SQL = f"""
    {LABELS_SQL},
    placed AS (SELECT e.*, x.label AS sl, y.label AS dl FROM edges e JOIN labels_of x ON x.node = src JOIN labels_of y ON y.node = dst),
    cw AS (SELECT label, sum(CASE WHEN same THEN w ELSE 0 END) AS inside, sum(w) AS degree
           FROM (SELECT sl AS label, weight AS w, sl = dl AS same FROM placed UNION ALL SELECT dl, weight, false FROM placed) GROUP BY 1)
"""


@query("gr15_modularity", "WITH " + PARTS_SQL + ", " + WEIGHTS_SQL + """
    SELECT round(sum(inside / (t / 2) - pow(degree / t, 2)), 6) AS modularity, count(*) AS communities
    FROM cw, (SELECT sum(degree) AS t FROM cw)""")
def gr15(r: Roles):
    return op.modularity(part_graph(r)[1], part_labels(r))


@query("gr16_community_metrics", "WITH " + PARTS_SQL + ", " + WEIGHTS_SQL + """
    , ins AS (SELECT src, dst, sl AS label FROM placed WHERE sl = dl),
    ib AS (SELECT src, dst FROM ins UNION ALL SELECT dst, src FROM ins),
    deg AS (SELECT src AS node, count(*) AS d FROM ib GROUP BY 1),
    tri AS (SELECT a.src AS node, count(*) / 2 AS t FROM ib a JOIN ib b ON a.dst = b.src JOIN ib c ON b.dst = c.src AND c.dst = a.src GROUP BY 1),
    cl AS (SELECT label, count(*) AS size, avg(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS c
           FROM labels_of LEFT JOIN deg USING (node) LEFT JOIN tri USING (node) GROUP BY 1),
    ne AS (SELECT label, count(*) AS edges FROM ins GROUP BY 1), t AS (SELECT sum(degree) AS t FROM cw)
    SELECT label, size, coalesce(edges, 0) AS edges, round(coalesce(2.0 * edges / nullif(size * (size - 1), 0), 0), 6)::DOUBLE AS density,
           round(coalesce(inside / (t / 2) - pow(degree / t, 2), 0), 6) AS modularity_share,
           round(CASE WHEN size > 2 THEN c ELSE 0 END, 6)::DOUBLE AS clustering, DATE '2024-01-01' AS first_ts, DATE '2024-01-01' AS last_ts
    FROM cl LEFT JOIN ne USING (label) LEFT JOIN cw USING (label), t WHERE edges IS NOT NULL
    UNION ALL
    SELECT label, size, 0, 0, round(coalesce(inside / (t / 2) - pow(degree / t, 2), 0), 6), 0, NULL, NULL
    FROM cl LEFT JOIN ne USING (label) LEFT JOIN cw USING (label), t WHERE edges IS NULL""")
def gr16(r: Roles):
    edges = part_graph(r)[1].withColumn("ts", F.lit("2024-01-01").cast("date"))
    return op.community_metrics(edges, part_labels(r))


@query("gr17_mean_betweenness", "WITH RECURSIVE " + PARTS_SQL + f", {LABELS_SQL}" + """
    , ins AS (SELECT src, dst FROM both_ways JOIN labels_of x ON x.node = src JOIN labels_of y ON y.node = dst WHERE x.label = y.label),
    walk AS (SELECT node AS source, node, 0 AS d FROM labels_of UNION SELECT source, dst, d + 1 FROM walk JOIN ins ON walk.node = ins.src WHERE d < 8),
    dist AS (SELECT source, node, min(d) AS d FROM walk GROUP BY 1, 2),
    s AS (SELECT label, sum(d - 1) FILTER (d > 0) AS s FROM dist JOIN labels_of ON labels_of.node = source GROUP BY 1),
    n AS (SELECT label, count(*) AS size FROM labels_of GROUP BY 1)
    SELECT label, size, round(coalesce(s / nullif(size * (size - 1) * (size - 2), 0)::DOUBLE, 0), 8) AS mean_betweenness FROM n JOIN s USING (label)""")
def gr17(r: Roles):
    return op.mean_betweenness(part_graph(r)[1], part_labels(r))


def windowed_graph(dated):
    return in_windows(dated, "ts", "1998-12-31").select("window_no", "src", "dst")


WINDOWED_SQL = """
    , w AS (SELECT CAST(11 - i AS INTEGER) AS window_no, DATE '1998-12-31' - CAST((i + 1) * 30 AS INTEGER) AS a, DATE '1998-12-31' - CAST(i * 30 AS INTEGER) AS b FROM range(12) t(i)),
    edges AS (SELECT window_no, src, dst, count(*)::DOUBLE AS weight FROM dated JOIN w ON ts BETWEEN a AND b GROUP BY 1, 2, 3),
    both_ways AS (SELECT window_no, src, dst, weight FROM edges UNION ALL SELECT window_no, dst, src, weight FROM edges)"""


@query("gr18_windowed_communities", "WITH " + BOROUGH_SQL + WINDOWED_SQL + " SELECT DISTINCT window_no, src AS node, true AS settled FROM both_ways")
def gr18(r: Roles):
    edges = cut_lineage(windowed_graph(borough_graph(r)), "windowed")
    return communities.unsettled(op.canonical(edges, by=["window_no"]), communities.windowed_communities(edges), by=["window_no"])


#: What became of the communities of `c` (window_no, node, label) from one window to the next.
CHANGES_SQL = """ sz AS (SELECT window_no, label, count(*) AS size FROM c GROUP BY 1, 2),
    sh AS (SELECT c.window_no, c.label, p.label AS before, count(*) AS common FROM c JOIN c p ON p.window_no + 1 = c.window_no AND p.node = c.node GROUP BY 1, 2, 3),
    pr AS (SELECT sh.*, s.size, o.size AS size_before, round(common::DOUBLE / (s.size + o.size - common), 6) AS jaccard
           FROM sh JOIN sz s ON s.window_no = sh.window_no AND s.label = sh.label JOIN sz o ON o.window_no + 1 = sh.window_no AND o.label = sh.before),
    best AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY window_no, label ORDER BY jaccard DESC, before) = 1),
    agg AS (SELECT window_no, label, count(*) FILTER (common * 2 > size_before) AS parents FROM pr GROUP BY 1, 2),
    ch AS (SELECT window_no, before, count(*) AS children FROM pr WHERE common * 2 > size GROUP BY 1, 2),
    late AS (SELECT s.window_no, s.label, s.size, b.before, b.size_before, b.common, b.jaccard, a.parents, ch.children FROM sz s
             LEFT JOIN best b ON b.window_no = s.window_no AND b.label = s.label LEFT JOIN agg a ON a.window_no = s.window_no AND a.label = s.label
             LEFT JOIN ch ON ch.window_no = s.window_no AND ch.before = b.before WHERE s.window_no > (SELECT min(window_no) FROM c))
    SELECT window_no, label AS community_id, CASE WHEN before IS NULL THEN 'created' WHEN jaccard >= 0.7 THEN 'stable' WHEN parents >= 2 THEN 'merged'
             WHEN children >= 2 THEN 'split' ELSE 'changed' END AS change_type, coalesce(jaccard, 0) AS stability,
           size - coalesce(common, 0) AS members_new, coalesce(size_before, 0) - coalesce(common, 0) AS members_lost FROM late
    UNION ALL SELECT window_no + 1, label, 'dissolved', 0, 0, size FROM sz WHERE window_no < (SELECT max(window_no) FROM c)
      AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.window_no = sz.window_no + 1 AND sh.before = sz.label)"""


@query("gr19_community_changes", "WITH RECURSIVE " + DATED_SQL + WINDOWED_SQL + ", " + propagation_sql("window_no") + """,
    c AS (SELECT window_no, node, label FROM labelled),""" + CHANGES_SQL)
def gr19(r: Roles):
    """Changes of propagated communities, one row for each community and window."""
    return op.community_changes(cut_lineage(communities.windowed_communities(windowed_graph(dated_graph(r))), "windowed"))


def assigned(r: Roles):
    """A fixed partition of each window: every contractor with the borough that it has most links to."""
    links = op.canonical(windowed_graph(borough_graph(r)), by=["window_no"])
    main = links.groupBy("window_no", F.col("dst").alias("node")).agg(F.min_by("src", F.struct(-F.col("weight"), F.col("src"))).alias("label"))
    return main.unionByName(links.select("window_no", F.col("src").alias("node"), F.col("src").alias("label")).distinct())


@query("gr19_changes_of_assigned", "WITH " + BOROUGH_SQL + WINDOWED_SQL + """
    , c AS (SELECT window_no, dst AS node, arg_min(src, (-weight, src)) AS label FROM edges GROUP BY 1, 2
            UNION ALL SELECT DISTINCT window_no, src, src FROM edges),""" + CHANGES_SQL)
def gr19_assigned(r: Roles):
    return op.community_changes(cut_lineage(assigned(r), "assigned"))


ALGORITHMS = ["louvain", "greedy_modularity", "label_propagation", "infomap", "spectral_clustering", "multi_resolution_consensus"]


@query("gr20_all_algorithms", "WITH " + PARTS_SQL + f"""
    , n AS (SELECT count(DISTINCT src) AS nodes FROM both_ways)
    SELECT algorithm, nodes, nodes AS placements, true AS in_range FROM n, (SELECT unnest({ALGORITHMS}) AS algorithm)""")
def gr20(r: Roles):
    edges = cut_lineage(part_graph(r)[1], "parts")
    # The single resolution and those of the consensus move in the same rounds, as further runs of one job.
    found = communities.modularity_communities(edges, resolutions={**RUNS, "1.0": 1.0})
    several = found.filter("run <> '1.0'")
    runs = [
        found.filter("run = '1.0'"), communities.greedy_communities(edges), communities.label_propagation(edges),
        communities.infomap_communities(edges), op.spectral_communities(edges),
        op.consensus(edges, several).select("node", F.col("component").alias("label")),
    ]
    out = None
    for name, labels in zip(ALGORITHMS, runs):
        labels = cut_lineage(labels.select("node", F.col("label").cast("string").alias("label")), name)
        n = labels.agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("placements")).first()
        sane = (F.col("largest") <= n["nodes"]) & F.col("modularity").between(-0.5, 1.0)
        row = op.summarize(labels, edges, name).select(
            "algorithm", F.lit(n["nodes"]).cast("long").alias("nodes"), F.lit(n["placements"]).cast("long").alias("placements"), sane.alias("in_range"))
        out = row if out is None else out.unionByName(row)
    return out


@query("gr21_bipartite_graph", """
    SELECT DISTINCT 'bin:' || bin AS src, 'violation_type:' || violation_type AS dst FROM typed_violations""")
def gr21(r: Roles):
    return op.bipartite(r.typed_violations(), "bin", "violation_type")


CLUSTER_SQL = f"""
    WITH RECURSIVE o AS (SELECT p_partkey, unnest([lower(p_name || ' ' || p_brand), lower(p_type || ' ' || p_size)]) AS officer FROM part),
    {group_members_sql("o", "officer", "p_partkey")},
    deg AS (SELECT DISTINCT p_partkey FROM grouped)
    SELECT count(*) AS n_companies FROM deg"""


@query("gp22_network_clusters", CLUSTER_SQL)
def gp22(r: Roles):
    companies = r.table("part").select(
        F.col("p_partkey").alias("name"),
        F.array(F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_type", "p_size")).alias("officers"),
    )
    # The first company of each officer stands for the group: the others are linked to it.
    links = shared_officers(companies).filter("name <> first_member").select(F.col("first_member").alias("src"), F.col("name").alias("dst"))
    return op.clusters(links, at_least=2).agg(F.count("*").alias("n_companies"))


@query("gp22_address_clusters", "WITH " + ADDRESS_GRAPH_SQL + """
    , s AS (SELECT src, count(*) AS n, min(CAST(split_part(dst, ':', 2) AS BIGINT)) AS component FROM edges GROUP BY 1)
    SELECT CAST(split_part(dst, ':', 2) AS BIGINT) AS node, component, n AS size FROM edges JOIN s USING (src) WHERE n >= 5""")
def gp22_addresses(r: Roles):
    named = r.owners().select(F.col("owner_id").alias("name"), F.col("owner_address").alias("address"))
    links = shared_addresses(named).filter("name <> first_member").select(F.col("first_member").alias("src"), F.col("name").alias("dst"))
    return op.clusters(links, at_least=5).select("node", "component", "size")


NETWORK_SQL = LINKED_SQL + """
    , linked AS (SELECT a_type || ':' || a_id AS a, b_type || ':' || b_id AS b FROM corr WHERE strength >= 0.3),
    node AS (SELECT a AS n FROM linked UNION SELECT b FROM linked)
    SELECT count(*) AS members, count(*) FILTER (risk_score > 60) AS high_risk, round(max(risk_score), 6) AS max_risk
    FROM node JOIN scores ON entity_type || ':' || entity_id = n"""


@query("rs19_fraud_networks", "WITH " + NETWORK_SQL)
def rs19(r: Roles):
    networks = fraud_networks(r, at_least=1)
    return networks.agg(
        F.sum("size").alias("members"), F.sum("high_risk").alias("high_risk"), F.round(F.max("max_risk"), 6).alias("max_risk")
    )


@query("rs19_fraud_network_list", "WITH RECURSIVE " + LINKED_SQL + """
    , linked AS MATERIALIZED (SELECT a_type || ':' || a_id AS a, b_type || ':' || b_id AS b FROM corr WHERE strength >= 0.3),
    e AS MATERIALIZED (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
    cc(node, component) USING KEY (node) AS (
      SELECT DISTINCT a, a FROM e UNION
      SELECT e.b, min(cc.component) FROM cc JOIN e ON e.a = cc.node JOIN recurring.cc AS old ON old.node = e.b WHERE cc.component < old.component GROUP BY e.b)
    SELECT component, count(*) AS size, round(avg(risk_score), 4) AS mean_risk, max(risk_score) AS max_risk,
           count(*) FILTER (risk_score > 60) AS high_risk, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entity_types
    FROM cc JOIN scores ON entity_type || ':' || entity_id = node GROUP BY 1 HAVING count(*) >= 3""")
def rs19_list(r: Roles):
    return fraud_networks(r, at_least=3).withColumns({
        "entity_types": F.array_join("entity_types", ","), "max_risk": F.round("max_risk", 6)})


def fraud_networks(r: Roles, *, at_least: int):
    scores = linked_scores(r)
    linked = scoring.correlated_entities(scores, entity_links(r))
    node = lambda s: F.concat_ws(":", f"{s}_type", f"{s}_id")
    components = op.connected_components(linked.select(node("a").alias("src"), node("b").alias("dst")))
    named = components.select(
        "component", F.substring_index("node", ":", 1).alias("entity_type"), F.expr("substr(node, instr(node, ':') + 1)").alias("entity_id")
    )
    return scoring.fraud_networks(named, scores, at_least=at_least)
