import random

from pyspark.sql import functions as F

from terralex.operators import graph, skew


def test_components_of_hubs_and_chains(spark):
    """A star that holds most edges, long chains through it and loose pieces, against a plain union of sets."""
    r = random.Random(7)
    edges = [(5000, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(6000, 6300)] + [(6300, 17), (9000, 9001), (9001, 9000), (8000, 8000)]
    edges += [(r.randrange(10_000, 12_000), r.randrange(10_000, 12_000)) for _ in range(900)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = {x.node: x.component for x in graph.components(df).collect()}
    assert found == {x: find(x) for x in parent if x not in alone}


def test_groups_of_hubs(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4010, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    made = skew.with_groups(rows, ["k"], [F.min("id").alias("low")])
    assert made.count() == 9990 and made.where("k = 1").agg(F.count("*"), F.max("low")).first() == (4000, 0)
    assert made.where("k <> 1 AND low <> id").count() == 0
    assert skew.with_groups(rows, ["k"], [F.min("id").alias("low")], "_rows > 1").count() == 4000
    assert skew.with_groups(rows, ["k"], [F.min("id").alias("low")], "_rows = 1").count() == 5990
    assert skew.with_groups(rows.where("id < 0"), ["k"], [F.min("id").alias("low")]).count() == 0


def test_a_hub_is_spread(spark):
    """No task of a star's rounds reads more than a small share of its rows from one shuffle."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pairs = spark.range(200_000).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v")).repartition(40)
        made = graph._stars(pairs)
        sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 200_000 and max(sizes) <= 10_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_edges_that_meet(spark, monkeypatch):
    """Against plain sets: small groups, cut buckets, a node and an edge that hold much, edges alone, nulls and repeats."""
    from terralex.operators import meeting

    r = random.Random(3)
    rows = [(r.randrange(300), f"e{r.randrange(200)}") for _ in range(1500)] + [(-1, f"e{i}") for i in range(150)] + [(i, "hub") for i in range(300)]
    rows += [(900, "alone"), (901, "x"), (901, "x"), (901, "y"), (None, "x"), (902, None), (902, "y")]
    held = {}
    for node, edge in rows:
        if node is not None and edge is not None:
            held.setdefault(node, set()).add(edge)
    met = {}
    for edges in held.values():
        for e in edges:
            met.setdefault(e, set()).update(edges - {e})
    df = spark.createDataFrame(rows, "node long, edge string").repartition(3)
    # 500: groups of a few edges and one hub; 50: mostly hubs
    for group, buckets in ((1 << 23, 4096), (500, 16), (50, 4096)):
        for module in (meeting, graph):
            monkeypatch.setattr(module, "GROUP", group)
            monkeypatch.setattr(module, "BUCKETS", buckets)
        found = {x.edge: x.n_neighbours for x in graph.edge_neighbours(df, "node", "edge").collect()}
        assert found == {e: len(o) for e, o in met.items() if o}


def test_lists_go_once_to_a_group():
    """A node's list goes to each group of its edges, not to each edge: rows do not grow with the square of a list."""
    import pyarrow as pa

    from terralex.operators import meeting

    starts = meeting.group_starts({0: 10, 1: meeting.GROUP, 2: 3 * meeting.GROUP}, 100)
    assert starts.tolist() == [0, 100, 200, 233, 266]
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(300)), [1, 2], [250, 299, 7]], pa.list_(pa.int32()))], ["ids"])
    dealt = [(g, len(x)) for b in meeting.dealt_lists(starts, [7])(iter([batch])) for g, x in zip(b.column("g").to_pylist(), b.column("ids").to_pylist())]
    assert sorted(dealt) == [(0, 2), (0, 300), (1, 300), (2, 300), (3, 3), (3, 300), (4, 3), (4, 300)]
