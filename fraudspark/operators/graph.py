"""Graphs and communities as edge tables.

An edge table has (src, dst, weight) with src < dst. Several graphs can be worked on at once:
columns named in `by` (a window, a run) are part of every key. Iterations write each round to the
shared scratch folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fraudspark.functions.numbers import ratio
from fraudspark.session import cut_lineage, drop_scratch, scratch_paths_of


#: A graph of at most this many rows is worked on in one partition: its rounds then need no shuffle and no
#: broadcast, each of which would be a job of its own.
FEW = 100_000


def together(df: DataFrame, few: bool) -> DataFrame:
    """`df` in one partition, to be joined where it is, if it has `few` rows; as it stands otherwise."""
    return df.coalesce(1).hint("merge") if few else df


class Round:
    """Keeps the newest of a series of stored tables and deletes the one before."""

    def __init__(self, label: str, first: DataFrame | None = None, *, few: bool = False):
        self.label, self.few, self.df, self._paths = label, few, None, []
        if first is not None:
            self.replace(first)

    def replace(self, df: DataFrame) -> DataFrame:
        stored = cut_lineage(df, self.label)
        if self._paths:
            drop_scratch(stored.sparkSession, self._paths)
        self.df, self._paths = together(stored, self.few), scratch_paths_of(stored)
        return self.df

    def drop(self) -> None:
        """Delete the newest too, once nothing reads it any more."""
        if self._paths:
            drop_scratch(self.df.sparkSession, self._paths)
        self.df, self._paths = None, []


# --- building ---------------------------------------------------------------------------------

def co_occurrence(
    records: DataFrame, fields: Sequence[str], *, namespaced: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, record_count) and edges: values found in the same record are linked.

    Pairs are formed inside one record, so their number is fixed by the number of fields.
    """
    value = lambda f: F.col(f).cast("string")
    name = (lambda f: F.concat(F.lit(f"{f}:"), value(f))) if namespaced else value
    entities = F.array_compact(F.array(*[F.when(value(f) != "", name(f)) for f in fields]))
    # Equal records are counted once before they are taken apart.
    counted = records.select(entities.alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    nodes = counted.select(F.explode("e").alias("node"), "n").groupBy("node").agg(
        F.sum("n").alias("record_count")
    )
    pairs = F.expr("flatten(transform(e, (a, i) -> transform(slice(e, i + 2, size(e)), b -> struct(a, b))))")
    linked = counted.select(F.explode(pairs).alias("p"), "n").filter("p.a <> p.b")
    edges = linked.groupBy(F.least("p.a", "p.b").alias("src"), F.greatest("p.a", "p.b").alias("dst")).agg(
        F.sum("n").cast("double").alias("weight")
    )
    return nodes, edges


def canonical(edges: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Undirected edges: src < dst, weights of repeats added, self-loops dropped."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    return (
        edges.filter("src <> dst")
        .groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum(weight).alias("weight"))
    )


def both_ways(edges: DataFrame) -> DataFrame:
    other = {"src": "dst", "dst": "src"}
    return edges.unionByName(edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns]))


def bipartite(facts: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct links between two kinds of nodes."""
    return facts.select(
        F.concat(F.lit(f"{left}:"), F.col(left).cast("string")).alias("src"),
        F.concat(F.lit(f"{right}:"), F.col(right).cast("string")).alias("dst"),
    ).na.drop().distinct()


# --- simple measures --------------------------------------------------------------------------

def degrees(edges: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return both_ways(edges).groupBy(*by, F.col("src").alias("node")).agg(
        F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree")
    )


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges and density 2m / (n (n - 1))."""
    n = both_ways(edges).agg(F.countDistinct("src").alias("nodes"), (F.count("*") / 2).cast("bigint").alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.withColumn("density", F.round(F.coalesce(ratio(2 * F.col("edges"), pairs), F.lit(0.0)), 6))


# --- connected components ---------------------------------------------------------------------

def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    Alternating large-star and small-star (Kiveris et al., Connected Components in MapReduce and
    Beyond, 2014): each round relinks nodes to the smallest neighbour seen, and the graph ends as
    stars. Only minimums are aggregated, so a hub is never gathered.
    """
    start = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v")
    named = isinstance(edges.schema["src"].dataType, StringType)
    given = Round("components", start if named else start.distinct())
    first, ids = given.df, None
    few = first.count() <= FEW
    if named and not few:
        # Names cross the network twice here, and numbers in all rounds.
        first, ids = _numbered(first)
        few = first.count() <= FEW
    elif named:
        first = together(first, few).distinct()
    stored = Round("components", together(first, few), few=few)
    given.drop()
    lowest, larger, smaller = Round("lowest", few=few), Round("larger", few=few), Round("smaller", few=few)
    mark = None
    while True:
        stars = _large_star(stored.df, lowest)
        # Read twice by the small star; in one partition, making them again is cheaper than a job.
        stars = _small_star(stars if few else larger.replace(stars), smaller)
        current = stored.replace(stars)
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    for table in (lowest, larger, smaller):
        table.drop()
    stars = stored.df
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = found.unionByName(roots)
    if ids is not None:
        name = lambda c: ids.select(F.col("id").alias(c), F.col("node").alias("name"))
        groups = roots.select("component").join(name("component"), "component").withColumnRenamed("name", "c")
        out = out.join(groups, "component").join(name("node"), "node").select(F.col("name").alias("node"), F.col("c").alias("component"))
    if nodes is not None:
        alone = nodes.select("node").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("node")))
    return out


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between numbers that compare as the names do, and (node, id) of the names."""
    # Range partitions read their input twice.
    names = Round("names", links.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    ranged = names.df.repartitionByRange("node").sortWithinPartitions("node")
    ids = cut_lineage(ranged.withColumn("id", F.monotonically_increasing_id()), "numbers")
    names.drop()
    at = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    half = Round("half", links.join(at("u"), "u").select("u_id", "v"))
    whole = half.df.join(at("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v")).distinct()
    numbered = cut_lineage(whole, "numbered")
    half.drop()
    return numbered, ids


def _large_star(links: DataFrame, lowest: Round) -> DataFrame:
    around = together(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), lowest.few)
    # Stored, so that the join can split the links of a hub at run time.
    minimum = lowest.replace(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    larger = around.filter("v > u").join(minimum, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame, smaller: Round) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Stored, for the same reason.
    lowest = smaller.replace(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = lowest.select("u", F.col("m").alias("v"))
    return together(moved.unionByName(kept), smaller.few).filter("u <> v").distinct()


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"))


def clusters(edges: DataFrame, *, at_least: int = 5) -> DataFrame:
    """Connected groups with enough members: (node, component, size)."""
    members = connected_components(edges)
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= at_least)
    return members.join(sizes, "component")


# --- weights over time ------------------------------------------------------------------------

# Fixed value: share of an edge's weight that decays with age.
TEMPORAL_WEIGHT = 0.3


def temporal_weight(decay: Column, share: float = TEMPORAL_WEIGHT) -> Column:
    return F.lit(1 - share) + F.lit(share) * decay


# --- modularity -------------------------------------------------------------------------------

def modularity(edges: DataFrame, labels: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition labels(node, label)."""
    parts = _community_weights(edges, labels)
    total = parts.agg(F.sum("degree")).scalar()  # 2m
    share = F.col("inside") / (total / 2) - F.lit(resolution) * F.pow(F.col("degree") / total, 2)
    return parts.agg(F.round(F.sum(share), 6).alias("modularity"), F.count("*").alias("communities"))


def _community_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, inside, degree): edge weight within, and degrees summed, per community."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    placed = edges.join(at("src"), "src").join(at("dst"), "dst")
    # Weights between two communities are summed before they are given to both.
    between = placed.groupBy("src_label", "dst_label").agg(F.sum("weight").alias("w"))
    ends = between.select(
        F.explode(F.array(
            F.struct(F.col("src_label").alias("label"), "w", (F.col("src_label") == F.col("dst_label")).alias("same")),
            F.struct(F.col("dst_label").alias("label"), "w", F.lit(False).alias("same")),
        )).alias("x")
    ).select("x.*")
    return ends.groupBy("label").agg(
        F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree")
    )


# Fixed value: the agreement a consensus needs.
CONSENSUS = 0.8


def consensus(edges: DataFrame, runs: DataFrame, *, at_least: float = CONSENSUS) -> DataFrame:
    """Groups of nodes linked by edges whose ends share a community in most runs."""
    n_runs = runs.agg(F.countDistinct("run")).scalar()
    at = lambda end: runs.select("run", F.col("node").alias(end), F.col("label").alias(f"{end}_l"))
    together = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), ["run", "dst"])
    agreed = together.groupBy("src", "dst").agg(F.count_if(F.col("src_l") == F.col("dst_l")).alias("n"))
    kept = agreed.filter(ratio(F.col("n"), n_runs) >= at_least).select("src", "dst")
    nodes = runs.select("node").distinct()
    return connected_components(kept, nodes)


def spectral_communities(edges: DataFrame, n_clusters: int | None = None, *, iterations: int = 20) -> DataFrame:
    """(node, label) by power iteration clustering (Lin and Cohen, 2010).

    Without `n_clusters`, a tenth of the nodes, at least 2 and at most 10.
    """
    from pyspark.ml.clustering import PowerIterationClustering

    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    numbered = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    k = n_clusters or max(2, min(10, numbered.count() // 10))
    at = lambda end: numbered.withColumnsRenamed({"node": end, "id": f"{end}_id"})
    links = edges.join(at("src"), "src").join(at("dst"), "dst").select(
        F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight"
    )
    model = PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return model.assignClusters(links).join(numbered, "id").select("node", F.col("cluster").alias("label"))


# --- communities ------------------------------------------------------------------------------

def sized_communities(labels: DataFrame, *, at_least: int = 3) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") >= at_least)


def summarize(labels: DataFrame, edges: DataFrame, algorithm: str, *, at_least: int = 3) -> DataFrame:
    """One row: communities of at least a size, the largest, and modularity of the partition."""
    counts = sized_communities(labels, at_least=at_least).agg(
        F.count("*").alias("communities"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")
    )
    q = modularity(edges, labels).select("modularity").scalar()
    return counts.select(F.lit(algorithm).alias("algorithm"), "communities", "largest", q.alias("modularity"))


def inner_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends in one community, with its label."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_l"))
    placed = edges.join(at("src"), "src").join(at("dst"), "dst").filter("src_l = dst_l")
    return placed.drop("dst_l").withColumnRenamed("src_l", "label")


def node_triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles). Edges point to the end of higher degree, so no node has more than
    about the square root of all edges to follow, hubs included."""
    degree = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    at = lambda end: degree.withColumnsRenamed({"node": end, "d": f"{end}_d"})
    known = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    forward = (F.col("src_d") < F.col("dst_d")) | ((F.col("src_d") == F.col("dst_d")) & (F.col("src") < F.col("dst")))
    out = known.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"),
    )
    out = cut_lineage(out, "oriented")
    two = out.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
    closed = two.join(out.select("a", F.col("b").alias("c")), ["a", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("node"))
    return corners.groupBy("node").agg(F.count("*").alias("triangles"))


def community_metrics(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: size, edges, density, modularity share, mean clustering, time span.

    edges(src, dst, weight, ts).
    """
    inside = cut_lineage(inner_edges(edges, labels), "inside")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    links = inside.groupBy("label").agg(
        F.count("*").alias("edges"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    weights = _community_weights(edges, labels)
    total = weights.agg(F.sum("degree")).scalar()
    share = F.col("inside") / (total / 2) - F.pow(F.col("degree") / total, 2)
    local = both_ways(inside.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    triangles = node_triangles(inside)
    pairs = F.col("d") * (F.col("d") - 1)
    coefficient = F.coalesce(ratio(2 * F.col("triangles"), pairs), F.lit(0.0))
    clustering = (
        labels.join(local, "node", "left").join(triangles, "node", "left").groupBy("label").agg(F.avg(coefficient).alias("c"))
    )
    joined = sizes.join(links, "label", "left").join(weights, "label", "left").join(clustering, "label", "left")
    possible = F.col("size") * (F.col("size") - 1)
    return joined.select(
        "label", "size", F.coalesce("edges", F.lit(0)).alias("edges"),
        F.round(F.coalesce(ratio(2 * F.col("edges"), possible), F.lit(0.0)), 6).alias("density"),
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("modularity_share"),
        F.round(F.when(F.col("size") > 2, F.col("c")).otherwise(0.0), 6).alias("clustering"),
        "first_ts", "last_ts",
    )


def mean_betweenness(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, mean_betweenness) within each community, exact.

    A shortest path of length d has d - 1 inner nodes, so betweenness summed over the nodes of a
    community is the sum of (d - 1) over its ordered connected pairs: distances are enough, and no
    paths are counted. All nodes are sources of breadth-first searches that run side by side, 64 sources
    in one word of bits per node reached. A node at distance d from a source has neighbours at d - 1, d and
    d + 1 only, so the last two frontiers tell which bits are new and nothing else is kept.
    """
    links = cut_lineage(both_ways(inner_edges(edges, labels).select("src", "dst")).distinct(), "inside")
    # Members of a community share words: they follow each other in the ranges, and ids count on within one.
    ranged = cut_lineage(labels.select("label", "node"), "members").repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    placed = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()), "sources")
    own = placed.select("label", "node", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bits"))
    front, last, sums = Round("frontier", own), Round("frontier", own.filter("false")), None
    d = 0
    while True:
        d += 1
        ahead = front.df.join(links.withColumnRenamed("src", "node"), "node").select("label", F.col("dst").alias("node"), "word", "bits", F.lit(0).cast("long").alias("seen"))
        seen = front.df.unionByName(last.df).select("label", "node", "word", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("seen"))
        reached = ahead.unionByName(seen).groupBy("label", "node", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        fresh = reached.select("label", "node", "word", F.col("bits").bitwiseAND(F.bitwise_not("seen")).alias("bits")).filter("bits <> 0")
        front, last = last, front
        if front.replace(fresh).isEmpty():
            break
        step = cut_lineage(front.df.groupBy("label").agg((F.sum(F.bit_count("bits")) * (d - 1)).alias("s")), "step")
        sums = step if sums is None else cut_lineage(sums.unionByName(step).groupBy("label").agg(F.sum("s").alias("s")), "sums")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("s", F.lit(0).cast("long")) if sums is None else sizes.join(sums, "label", "left")
    n = F.col("size")
    value = F.coalesce(ratio(F.coalesce("s", F.lit(0)), n * (n - 1) * (n - 2)), F.lit(0.0))
    return sizes.select("label", "size", F.round(value, 8).alias("mean_betweenness"))


# --- change over time -------------------------------------------------------------------------

# Fixed value: overlap from which a community counts as the same one.
STABILITY = 0.7


def community_changes(communities: DataFrame, *, window: str = "window_no", stability: float = STABILITY) -> DataFrame:
    """What became of communities from one window to the next.

    Per community of the later window: 'stable' (overlap with one before of at least
    `stability`), 'merged' (two or more before gave most of their members to it), 'split' (the
    closest one before is the main origin of two or more), 'created' (no member was there before)
    or 'changed'; and 'dissolved' for communities none of whose members are in the next window.
    `members_new` and `members_lost` count against the closest one before.
    """
    sizes = communities.groupBy(window, "label").agg(F.count("*").alias("size"))
    moved = communities.select((F.col(window) + 1).alias(window), "node", F.col("label").alias("before"))
    shared = communities.join(moved, [window, "node"]).groupBy(window, "label", "before").agg(F.count("*").alias("common"))
    old = sizes.select((F.col(window) + 1).alias(window), F.col("label").alias("before"), F.col("size").alias("size_before"))
    pairs = shared.join(sizes, [window, "label"]).join(old, [window, "before"])
    jaccard = ratio(F.col("common"), F.col("size") + F.col("size_before") - F.col("common"))
    pairs = pairs.withColumn("jaccard", F.round(jaccard, 6))
    gave_most = F.col("common") * 2 > F.col("size_before")
    came_most = F.col("common") * 2 > F.col("size")
    closest = pairs.groupBy(window, "label").agg(
        F.max("jaccard").alias("stability"), F.count_if(gave_most).alias("parents"),
        F.min_by(F.struct("before", "size_before", "common"), F.struct(-F.col("jaccard"), F.col("before"))).alias("best"),
    )
    children = pairs.filter(came_most).groupBy(window, "before").agg(F.count("*").alias("children"))
    first = communities.agg(F.min(window)).scalar()
    last = communities.agg(F.max(window)).scalar()
    later = sizes.filter(F.col(window) > first).join(closest, [window, "label"], "left")
    later = later.withColumn("before", F.col("best.before")).join(children, [window, "before"], "left")
    kind = (
        F.when(F.col("best").isNull(), "created").when(F.col("stability") >= stability, "stable")
        .when(F.col("parents") >= 2, "merged").when(F.col("children") >= 2, "split").otherwise("changed")
    )
    common = F.coalesce(F.col("best.common"), F.lit(0))
    now = later.select(
        window, F.col("label").alias("community_id"), kind.alias("change_type"),
        F.coalesce("stability", F.lit(0.0)).alias("stability"), (F.col("size") - common).alias("members_new"),
        (F.coalesce(F.col("best.size_before"), F.lit(0)) - common).alias("members_lost"),
    )
    survived = shared.select((F.col(window) - 1).alias(window), F.col("before").alias("label")).distinct()
    gone = sizes.filter(F.col(window) < last).join(survived, [window, "label"], "left_anti").select(
        (F.col(window) + 1).alias(window), F.col("label").alias("community_id"), F.lit("dissolved").alias("change_type"),
        F.lit(0.0).alias("stability"), F.lit(0).cast("bigint").alias("members_new"), F.col("size").alias("members_lost"),
    )
    return now.unionByName(gone)
