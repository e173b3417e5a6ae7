"""Sharding, exact and near deduplication and the pipeline against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terralex.llm import exact_dedup, mixing, near_dedup, quality_classifier, sharding
from terralex.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, rep long, _sha string, sha int, n int, kept boolean"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, values):
    rows = [(i, t, ["en", "fr", None, "de"][i % 4], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", i, "x", 1, 2, False) for i, t in values]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def copies(seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice(["Alpha", "beta", "Élan", "élan", "x" * 30]) for _ in range(r.randint(0, 40))) for _ in range(15)]
    values = [(i, r.choice([t, t.upper() if t.isascii() else t, t.lower() if t.isascii() else t, t + " "])) for i, t in enumerate(r.choices(base, k=120))]
    return [*values, (200, None), (201, ""), (202, "É"), (203, "é"), (204, "long " * 60_000), (205, "LONG " * 60_000)]


def test_exact_dedup(spark):
    values = copies()
    groups = {}
    for i, t in values:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    docs = frame(spark, values)
    for capacity in (exact_dedup.CAPACITY, 2):  # the small one splits buckets
        got = {r.doc_id: r for r in exact_dedup.deduped(docs, capacity).collect()}
        for key, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(key.encode()).hexdigest())
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.dedup_report(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "A"), (None, "a"), (3, "a"), (3, "a"), (None, "lone")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.deduplicated(odd).orderBy("doc_id").collect()] == [(None, "lone"), (3, "a")]
    assert [(r.keep_id, r.group_size) for r in exact_dedup.dedup_report(odd).where("doc_id = 3").collect()] == [(3, 4)] * 2


def test_directory_doubles():
    depth, entries = exact_dedup.directory({0b0000: 4, 0b0001: 4, 0b1000: 3, 0b1100: 1}, 4, 4)
    assert depth == 4 and len(entries) == 16
    assert len({entries[k] for k in (0b0000, 0b0001)}) == 2 and entries[0b1000] == entries[0b1100]
    assert exact_dedup.directory({3: 1}, 5, 4) == (0, [0])


def test_sharding(spark):
    values = [(i, "wörd " * (i % 50)) for i in range(203)] + [(300, None), (300, None), (301, "")]
    docs = frame(spark, values)
    rows = sharding.shard_report(docs).collect()
    text = {(i, t) for i, t in values}
    size = {i: len((t or "").encode()) + 1 for i, t in text}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in text}
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(values) and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == size[r.doc_id] and r.text_crc32 == crc[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in rows)
    # runs of the curve: shard and slot follow it
    places = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert places == sorted(places)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharding.shard_report(docs.repartition(5)).collect()), key=str)
    assert sharding.shard_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4)])
def test_curve_visits_neighbours(dims, bits):
    table = sharding.hilbert_table(dims, bits)
    assert sorted(table) == list(range(1 << dims * bits))
    cell = {place: [(k >> bits * (dims - 1 - i)) & ((1 << bits) - 1) for i in range(dims)] for k, place in enumerate(table)}
    assert all(sum(abs(a - b) for a, b in zip(cell[i], cell[i + 1], strict=True)) == 1 for i in range(len(table) - 1))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(values, percent=85):
    sets = {i: shingles(t) for i, t in values}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_values(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    values, at = [], 0
    passage = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 60, 200, 400]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            values.append((at, " ".join(own).upper() if r.random() < 0.2 else "\n".join(own)))
            at += 1
        values.append((at, " ".join(passage + [r.choice(vocabulary) for _ in range(r.choice([2, 6, 12]))])))
        at += 1
    return [*values, (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "same " * 20_000), (907, "SAME " * 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    values = near_values(seed)
    docs = frame(spark, values)
    want = components(values)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.linked(docs).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    if seed == 1:
        kept = near_dedup.deduplicated(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_dedup_edges(spark):
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None)], "doc_id long, text string")
    rows = sorted(map(tuple, near_dedup.linked(odd).collect()), key=str)
    assert rows == sorted([(None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (3, 0, 3, True)], key=str)
    assert near_dedup.linked(odd.limit(0)).count() == 0


def test_near_dedup_removes_by_id_and_text(spark):
    a, b, c, d = ("{0}1 {0}2 {0}3 {0}4 {0}5 {0}6".format(x) for x in "abcd")
    odd = [(None, a.upper()), (9, a), (None, "clean words of no other document"), (None, b), (None, b.upper()), (None, b), (7, c), (7, d), (3, d.upper()), (5, None), (5, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = [(r.doc_id, (r.text or "").lower()) for r in near_dedup.deduplicated(docs).collect()]
    assert sorted(got, key=str) == sorted([(9, a), (None, "clean words of no other document"), (None, b), (7, c), (3, d), (5, ""), (5, "")], key=str)
    rows = {(r.doc_id, r.component_id) for r in near_dedup.linked(docs).where("doc_id = 7").collect()}
    assert rows == {(7, 7), (7, 3)}
    # two sets of one id that have near copies of their own
    long = [" ".join(f"{x}{i}" for i in range(60)) for x in "xy"]
    two = spark.createDataFrame([(7, long[0]), (7, long[1]), (8, long[0] + " end"), (9, long[1] + " end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(two).collect()) == [(7, long[0]), (7, long[1])]


def test_near_dedup_takes_a_threshold(spark):
    words = [f"w{i}" for i in range(504)]
    near = list(words)
    for i in range(10):
        near[25 + 50 * i] = f"changed{i}"
    values = [(1, " ".join(words)), (2, " ".join(near)), (3, "some other text of its own")]
    assert {c for _, c in components(values).values()} == {1, 2, 3} and {c for _, c in components(values, 80).values()} == {1, 3}
    docs = spark.createDataFrame(values, "doc_id long, text string")
    for percent, want in ((80, [1, 3]), (85, [1, 2, 3])):
        assert sorted(r.doc_id for r in near_dedup.deduplicated(docs, percent).collect()) == want


def test_pipeline_stages(spark):
    """Each stage of the pipeline against a restatement over its own input."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mix", "bpe_encoding"]
    columns = docs.columns
    score = {r.doc_id: r.score for r in quality_classifier.quality_report(docs, labels).collect()}
    one = steps["quality_classifier"](spark, docs, sf)
    rows = [tuple(r) for r in one.collect()]
    assert one.columns == columns and sorted(r[0] for r in rows) == sorted(i for i, s in score.items() if s >= 0.3)
    text = columns.index("text")
    frame1 = spark.createDataFrame(rows, docs.schema)
    largest = {}
    for r in rows:
        key = (r[text] or "").translate(LOWER)
        largest[key] = max(largest.get(key, -1), r[0])
    rows2 = [tuple(r) for r in steps["exact_dedup"](spark, frame1, sf).collect()]
    assert sorted(r[0] for r in rows2) == sorted(largest.values())
    frame2 = spark.createDataFrame(rows2, docs.schema)
    want = components([(r[0], r[text]) for r in rows2])
    rows3 = [tuple(r) for r in steps["near_dedup"](spark, frame2, sf).collect()]
    assert sorted(r[0] for r in rows3) == sorted(i for i, (_, c) in want.items() if i == c)
    frame3 = spark.createDataFrame(rows3, docs.schema)
    repeats = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in mixing.mix_report(frame3).collect()}
    rows4 = [tuple(r) for r in steps["source_mix"](spark, frame3, sf).collect()]
    assert Counter(r[0] for r in rows4) == Counter({i: n for i, n in repeats.items() if n})
    frame4 = spark.createDataFrame(rows4, docs.schema)
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    coded = steps["bpe_encoding"](spark, frame4, sf).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == Counter((r[0], len(tok.encode(r[text] or "", add_special_tokens=False).ids)) for r in rows4)
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, coded))


def test_queries_cover_all_operators():
    from terralex.llm import queries

    names = [re.match(r"op(\d+)_", n)[1] for n in queries.queries()]
    assert sorted(map(int, names)) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_no_python_in_native_plans(spark):
    docs = frame(spark, copies())
    for made in (sharding.shard_report(docs), exact_dedup.dedup_report(docs), mixing.mix_report(docs), mixing.mixed(docs.withColumn("source", F.lit("s")))):
        assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())


def test_index_lies_in_buckets(spark):
    """The documents of a supplied table on indexes of several sizes: folders by bucket, whole key ranges, equal results."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = {}
    for r in docs.collect():
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    for capacity in (1, 20, exact_dedup.CAPACITY):
        keys = docs.select(F.xxhash64(exact_dedup._normal(docs)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        owned = exact_dedup.Directory(keys, capacity)
        index = exact_dedup.build_index(docs, keys, owned)
        entries = index.collect()
        assert len(entries) == sum(len(g) > 1 for g in groups.values())
        held = [f.split("bucket=")[1].split("/")[0] for f in index.inputFiles()]
        assert len(held) == len(set(held)) == len({e.bucket for e in entries})  # one owner each
        assert all(owned.entries[(e.h & (1 << 64) - 1) >> (64 - owned.depth) if owned.depth else 0] == e.bucket for e in entries)
        assert owned.depth == 0 if capacity > len(want) else owned.depth > 2
        assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduped(docs, capacity).collect()} == want


def test_chains_tell_texts_of_one_key_apart(spark, monkeypatch):
    """With a key that all texts share, the owner's chain alone tells them apart."""
    values = [(i, f"text {i % 7}") for i in range(50)]
    docs = spark.createDataFrame(values, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "key_of", lambda body: F.lit(42).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.deduped(docs, 1).collect()}
    for i, t in values:
        own = [j for j, u in values if u == t]
        assert got[i] == (max(own), len(own), hashlib.sha256(t.encode()).hexdigest())


def test_filter_lets_all_shared_keys_through(spark):
    """No key that several rows have is held back, over the whole range of keys, and few others pass."""
    r = random.Random(3)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    counts = spark.createDataFrame([(h, 1 + i % 3 // 2) for i, h in enumerate(keys)], "h long, n long")
    texts = counts.select("h", F.lit("clash").alias("body"))
    got = Counter(x.h for x in exact_dedup.maybe_shared(texts, counts).collect())
    many = {h for i, h in enumerate(keys) if i % 3 == 2}
    assert many <= set(got) and len(got) < len(many) + 20 and set(got.values()) == {1}


def test_shards_are_written_and_skipped(spark, tmp_path):
    """Every row once, in the report's shards, sorted along the curve; a filter on any dimension rules out most shards."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("shard", F.lit("clash"))
    rows = docs.collect()
    for even in (False, True):
        path = str(tmp_path / f"s{even}")
        ranges = sharding.write_shards(docs, path, even=even).collect()
        back = spark.read.parquet(path)
        assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, rows))
        report = {r.doc_id: r.shard for r in sharding.sharded(docs, curve=sharding.curve_place(docs, even=even)).collect()}
        assert {r.doc_id: r["_shard"] for r in back.select("doc_id", "_shard").collect()} == report
        assert sorted((r.shard, r.n) for r in ranges) == sorted(Counter(report.values()).items())
    # shards that a filter on one value of a dimension can't rule out, of 8
    for dim in sharding.DIMS:
        values = [r[dim] for r in rows if r[dim] is not None]
        met = [sum(r[f"low_{dim}"] <= x <= r[f"high_{dim}"] for r in ranges) for x in values]
        print(dim, sum(met) / len(met))
        assert sum(met) / len(met) <= 6
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sum(r.n for r in sharding.write_shards(odd, str(tmp_path / "o")).collect()) == 3
    assert sharding.write_shards(odd.limit(0), str(tmp_path / "e")).count() == 0
