import pytest
from pyspark.sql import functions as F

from terralex.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target double"


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Clamp and reshare, round by round."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, closed, left = {s: 0.0 for s in names}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in closed]
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] = left * w[s] / total
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            closed.add(s)
            left -= target[s]
        if len(closed) == len(names):
            return target


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 100, "c": 30}, {"a": 10, "b": 500, "c": 90, "d": 40}, {"a": 100}, {"a": 7, "b": 7, "c": 7, "d": 7}])
def test_targets_and_taken(spark, sizes):
    rows = [(i * 1000 + j, "w " * n, s, "clash", 0.0) for i, s in enumerate(sizes) for j, n in enumerate([sizes[s] // 7] * 6 + [sizes[s] - sizes[s] // 7 * 6])]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = water(sizes)
    report = mixing.mix_report(docs).collect()
    source = {r[0]: r[2] for r in rows}
    for s in sizes:
        own = [r for r in report if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-9
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixing.mixed(docs.withColumn("_skey", F.lit(1)).withColumn("_times", F.lit(1)).withColumn("_whole", F.lit(1))).count() == mixed.count()
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.taken // r.size for r in report if r.taken}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, "x", 1.0), (None, "a b", None, None, None), (3, " \n", "s", "x", 1.0), (3, " \n", "s", "x", 1.0), (4, "é " * 9, "s", "x", 1.0)], SCHEMA)
    report = mixing.mix_report(docs)
    assert report.count() == 5
    assert [(r.size, r.taken) for r in report.where("doc_id = 1 OR doc_id = 3").collect()] == [(0, 0)] * 3
    assert sorted(map(tuple, report.collect()), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where(F.lit(False))).count() == 0
