"""Connected components, shared nodes and node-edge relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.operators.contract import CHUNK, contracted
from terralex.operators.meeting import BUCKETS, GROUP, counted_lists, dealt_lists, group_starts
from terralex.operators.skew import hub_keys, looked_up, with_groups
from terralex.staging import discard, stage


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its neighbours; a hub's pairs stay spread over the tasks."""
    return with_groups(pairs, ["u"], [F.min("v").alias("_v")]).withColumn("m", F.least("u", "_v")).drop("_v")


def _settled(edges: DataFrame) -> bool:
    """Whether edges from greater to lesser nodes are stars around the least node of each component: every node has one
    edge down, and none to a node that has one itself."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    onward = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.union(onward).isEmpty()


def _starred(edges: DataFrame) -> DataFrame:
    """Stars around the least node of each component, as staged edges from greater to lesser nodes: alternating large-star
    and small-star rounds (Kiveris et al., 2014) until they are, O(log^2 n) rounds. A node's neighbours are combined before
    the shuffle; those of a node with more than 1 / 256 of all pairs meet their least by broadcast. So no task holds a
    hub's neighbours."""
    current = edges
    while not _settled(current):
        # large star: greater neighbours go to the least
        large = _stars(_neighbours(current)).where("v > u AND v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = stage(large.distinct(), "components-large")
        # small star: the lesser neighbours and the node itself do
        small = _stars(pairs).select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b")
        following = stage(small.distinct(), "components")
        discard(current)
        discard(pairs)
        current = following
    return current


def _one_task(edges: DataFrame) -> DataFrame:
    """Stars around the least nodes of at most ``CHUNK`` edges, in one task."""
    return stage(edges.coalesce(1).mapInArrow(contracted, edges.schema), "components")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for each node of the edges (a, b); repeats and loops are harmless.

    Every task first replaces the edges it reads by stars, ``CHUNK`` edges at a time. Nodes that have one star left, and are
    no star's centre, wait until the others are told apart: those that several chunks name. These few are joined in one
    task if they have at most ``CHUNK`` edges, else by rounds over the shared folder.
    """
    looped = edges.select("a", "b").where("a <> b")
    current = stage(looped.mapInArrow(contracted, looped.schema).distinct(), "components")
    n = current.count()
    if n <= CHUNK:
        current = _one_task(current)
        return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b")).distinct()
    several = current.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    again = stage(several.union(current.select("b")).distinct().join(current.select("a").distinct(), "a"), "components-several")
    rest = stage(current.join(again, "a", "left_semi"), "components")
    leaves = current.join(again, "a", "left_anti")
    told = _one_task(rest) if rest.count() <= CHUNK else _starred(rest)
    centre = stage(told.select("a", "b").union(told.select("b", "b")).distinct().toDF("_n", "component"), "components-centres")
    far = looked_up(leaves.withColumnRenamed("b", "_n"), centre, "_n", hub_keys(leaves.withColumnRenamed("b", "_n"), "_n"), "left")
    placed = far.select(F.col("a").alias("node"), F.coalesce("component", "_n").alias("component"))
    centres = placed.select(F.col("component").alias("node"), "component")
    return placed.union(centre.select("_n", "component")).union(centres).distinct()


def largest_component(found: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes; the least component wins a tie."""
    top = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    return found.join(F.broadcast(top), "component").select("node", "component")  # one row


def shared_nodes(members: DataFrame, node: str, edge: str, least: int = 2) -> DataFrame:
    """Nodes that at least ``least`` distinct edges share."""
    return members.groupBy(node).agg(F.count_distinct(edge).alias("n_edges")).where(F.col("n_edges") >= least)


def edge_neighbours(members: DataFrame, node: str, edge: str) -> DataFrame:
    """(edge, n_neighbours): how many other edges meet each edge in some node.

    Edges are numbered in their order and each node becomes one row, the list of its edges. Ranges of edges make groups; a
    list goes once into each group that it has edges of, whatever their number there, and a group's unions are counted on
    marks in one call. A group holds about ``GROUP`` list entries at most. Edges whose lists alone hold more, fewer than one in ``GROUP``
    entries, are counted by distinct pairs instead.
    """
    held = members.select(F.col(node).alias("_node"), F.col(edge).alias("_edge")).where("_node IS NOT NULL AND _edge IS NOT NULL")
    ids = stage(compact_index(held.select("_edge").distinct(), "_edge", name="_id"), "edge-ids")
    pairs = held.join(ids, "_edge").select("_node", F.col("_id").cast("int").alias("_id")).repartition("_node").distinct()
    lists = stage(pairs.groupBy("_node").agg(F.collect_list("_id").alias("ids")).where("size(ids) > 1").select("ids"), "edge-lists")
    weights = stage(lists.select(F.explode("ids").alias("_id"), F.size("ids").cast("long").alias("w")).groupBy("_id").agg(F.sum("w").alias("w")), "edge-weights")
    hubs = [r["_id"] for r in weights.where(F.col("w") > GROUP).select("_id").collect()]  # fewer than all entries / GROUP
    width = -(-max(1, ids.count()) // BUCKETS)
    buckets = weights.where(F.col("w") <= GROUP).groupBy(F.expr(f"_id div {width}").alias("b")).agg(F.sum("w").alias("w")).collect()  # at most BUCKETS rows
    starts = group_starts({r["b"]: r["w"] for r in buckets}, width)
    dealt = lists.mapInArrow(dealt_lists(starts, hubs), "g int, ids array<int>")
    found = dealt.groupBy("g").applyInArrow(counted_lists(starts, hubs), "_id int, n_neighbours long")
    if hubs:
        own = F.array(*[F.lit(h) for h in hubs])
        met = lists.where(F.arrays_overlap("ids", own)).select(F.explode(F.array_intersect("ids", own)).alias("_id"), "ids").select("_id", F.explode("ids").alias("_other"))
        found = found.union(met.distinct().groupBy("_id").agg((F.count("*") - 1).alias("n_neighbours")))
    return found.join(ids, "_id").select(F.col("_edge").alias(edge), "n_neighbours")


def compact_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """A dense index from 0 in the stated order, by ranges: counts per range first, then ranks within each."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "index")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # one row per range
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + rank - 1).drop("_range", "_before")
