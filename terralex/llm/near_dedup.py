"""MinHash near-deduplication with tensored banding and exact verification.

Documents are linked when their sets of distinct 5-word shingles have a Jaccard similarity of at least ``percent`` / 100
(0.85 unless said); a document's component is the smallest id reachable over links. Banding finds the candidates and their
first links; the links among candidates are completed by prefix filtering, which misses none.

1. One pass over the texts makes, per document, the set's size and fingerprint and two collections of ``BANDS`` small
   hashes of ``ROWS`` minhashes each. The ``BANDS ** 2`` table keys are all pairs of one hash of either collection, so
   2 * BANDS * ROWS minhashes serve keys of 2 * ROWS rows in BANDS ** 2 tables. A pair of similarity s is missed with
   probability below 2 * (1 - s ** ROWS) ** BANDS: 6e-4 at 0.8, 7e-5 at 0.85, 3e-6 at 0.9.
2. Equal sets are one class. Small hashes that only one class has can't take part in a shared key, so they are dropped
   before the keys are formed.
3. Classes that share a key with another are candidates. Each is linked to the least class of each of its tables and to
   the least class that shares one of its rare shingles, links are verified on the full sets, and components are formed.
4. What is left is exact: two sets of similarity t share a shingle among the n - ceil(t n) + 1 rarest of each. Only
   buckets of such shingles that still hold several components give pairs, and only between components that their
   sizes, places and parity maps allow; these are verified on the full sets too. A parity map has one bit for each of
   PARITY hash ranges, which tells whether the set has an odd number of shingles there: two maps differ in no more bits
   than their sets have shingles in only one of them, so no similar pair is lost. Copies are thus never expanded into
   all pairs, and no verified link depends on luck.

Buckets, shingles, components and classes that many rows name are hubs: their rows stay spread over the tasks
(``terralex.operators.skew``).

Defined results: without words a document has no shingles, links with nothing and is its own component; fewer than
five words make one shingle; null ids come after all others and never represent documents that have one; rows that
repeat an id with the same text are one document; an empty table gives no rows; a very long text is read in pieces and
its set is one value of a column; columns other than doc_id and text, whatever their names, are only handed on by
``deduplicated``. An id with several texts has one decision for each of them; ``deduplicated`` leaves one row of each
component, also where all its ids are null or equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm import words
from terralex.llm.arrow import mapped
from terralex.llm.keys import unused
from terralex.llm.storage import discard, stage
from terralex.operators.graph import components
from terralex.operators.skew import hub_keys, looked_up, with_groups

SHINGLE = 5
#: Least similarity of a link in op2_near_dedup and in the pipeline's stage.
PERCENT = 85
BANDS = 8
ROWS = 2
#: Bits of a set's parity map.
PARITY = 512
#: A class with more than this share of all rows is hot; fewer than HOT_CLASSES can be.
HOT_CLASSES = 256
#: Stand-ins for missing ids lie above this.
NO_ID = 0x7000000000000000

_RANDOM = np.random.default_rng(0xBADC0DE)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(1, 1 << 63, 2 * BANDS * ROWS, dtype=np.uint64)


def shingle_sets(w: words.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice, one after the other, and their bounds."""
    n, counts = len(w.offsets) - 1, w.counts
    grams, valid = words.grams(w, k)
    at = np.flatnonzero(valid)
    values, doc = grams[at], w.doc[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = []
            for d in short:
                h = w.hashes[w.offsets[d] : w.offsets[d + 1]]
                weights = np.array([pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(len(h))], np.uint64)
                whole.append((h * weights).sum(dtype=np.uint64) + np.uint64(len(h)))
        values, doc = np.concatenate([values, words.mix(np.array(whole, np.uint64))]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        values, doc = values[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def _fingerprints(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(words.mix(values ^ np.uint64(c)), starts) for c in (0x8F14E45FCEEA167A, 0x3C6EF372FE94F82B))


def _small_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row per set: BANDS hashes of either collection, each of ROWS minhashes."""
    out = np.empty((len(starts), 2 * BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(2 * BANDS):
            h = np.full(len(starts), band + 1, np.uint64)
            for r in range(ROWS):
                k = band * ROWS + r
                h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], starts))
            out[:, band] = h
    return out


def _parity(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of PARITY / 64 words per set; sets come one after the other."""
    out, bounds = np.empty((len(sizes), PARITY // 64), np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sizes), 2048):  # bounds the counters' memory
        k = min(2048, len(sizes) - i)
        own = np.repeat(np.arange(k), sizes[i : i + k])
        place = (values[bounds[i] : bounds[i + k]] >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(own * PARITY + place, minlength=k * PARITY) & 1
        out[i : i + k] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(k, -1)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _each(batch: pa.RecordBatch, full: bool) -> list:
    """Size, both fingerprints, and the small hashes or the whole set and its map of each text; empty sets have none."""
    size, first, second, lists, maps = [], [], [], [], []
    for w in words.split(batch.column("text")):
        values, bounds = shingle_sets(w)
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        own: list = [None] * len(n)
        bits: list = [None] * len(n)
        if len(some):
            starts = bounds[some]
            a[some], b[some] = _fingerprints(values, starts)
            rows = [values[s:e] for s, e in zip(starts, bounds[some + 1], strict=True)] if full else _small_hashes(values, starts)
            for d, row in zip(some, rows, strict=True):
                own[d] = _signed(row)
            if full:
                for d, row in zip(some, _parity(values, n[some]), strict=True):
                    bits[d] = row
        size.append(n)
        first.append(_signed(a))
        second.append(_signed(b))
        lists += own
        maps += bits
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return [join(size), join(first), join(second), lists, *([maps] if full else [])]


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, set_a, set_b and the small hashes, staged: the one pass over all texts."""
    keyed = docs.select("doc_id", "text", _text_key().alias("text_key"))
    return stage(mapped(keyed, ["doc_id", "text_key"], "n long, set_a long, set_b long, hashes array<long>", lambda b: _each(b, False)), "near-sketch")


def classes_of(sketch: DataFrame) -> DataFrame:
    """One row per distinct set: its least id, its representative, number of rows and small hashes. The representative is
    the least id, or a stand-in where that is missing or another set has it too."""
    grouped = sketch.where("n > 0").groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("own"), F.count("*").alias("members"), F.first("hashes").alias("hashes"))
    grouped = stage(grouped, "near-grouped")
    taken = stage(grouped.where("own IS NOT NULL").groupBy("own").agg(F.count("*").alias("k")).where("k > 1").select("own", F.lit(True).alias("taken")), "near-taken")
    rep = F.when(F.col("taken").isNull(), F.col("own"))
    return grouped.join(taken, "own", "left").withColumn("rep", F.coalesce(rep, F.expr(f"(set_a & {0x0FFFFFFFFFFFFFFF}L) | {NO_ID}L"))).drop("taken")


def table_keys(classes: DataFrame) -> DataFrame:
    """(rep, key) of all tables in which the class may meet another."""
    small = classes.select("rep", F.posexplode("hashes").alias("band", "h"))
    live = with_groups(small, ["h"], [], "_rows > 1").groupBy("rep").agg(
        F.collect_list(F.when(F.col("band") < BANDS, F.col("h"))).alias("left"), F.collect_list(F.when(F.col("band") >= BANDS, F.col("h"))).alias("right")
    )
    pairs = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b))))
    return stage(live.select("rep", F.explode(pairs).alias("key")), "near-keys")


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """(a, b): each class and the least class of its bucket."""
    met = with_groups(rows.select("rep", key), [key], [F.min("rep").alias("b"), F.max("rep").alias("_top")], "b < _top")
    return met.where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def full_sets(docs: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(rep, n, shingles, bits) of the candidate classes, each read from one of its documents."""
    wanted = classes.join(candidates, "rep", "left_semi").select("rep", "own", "n", "set_a", "set_b")
    ids = wanted.select(F.col("own").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = mapped(texts, ["doc_id"], "n long, set_a long, set_b long, shingles array<long>, bits array<long>", lambda b: _each(b, True))
    named = sets.join(wanted, ["n", "set_a", "set_b"])
    # the representative's own row; classes without ids, and repeated rows, keep any of their equal sets
    own = named.where(F.col("doc_id").eqNullSafe(F.col("own")))
    return stage(own.select("rep", "n", "shingles", "bits").dropDuplicates(["rep"]), "near-sets")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, t, place): of each set the n - ceil(percent / 100 n) + 1 rarest shingles with their places in that order, without
    those that no other set has (they come first)."""
    tokens = sets.select("rep", F.explode("shingles").alias("t"))
    shared = with_groups(tokens, ["t"], [F.count("*").alias("df")], "df > 1")
    found = shared.join(sets.select("rep", "n"), "rep")
    own = Window.partitionBy("rep")
    ranked = found.withColumn("i", F.row_number().over(own.orderBy("df", "t"))).withColumn("m", F.count("*").over(own))
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    placed = ranked.withColumn("place", F.col("n") - F.col("m") + F.col("i"))
    return stage(placed.where(F.col("place") <= length).select("rep", "n", "t", "place"), "near-rare")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _in_reach(x: str, y: str, percent: int) -> Column:
    """Whether the first shingle that two similar sets share could stand at these places: enough must follow in both."""
    need = F.expr(f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}")
    return (F.col(f"{x}.place") <= F.col(f"{x}.n") - need + 1) & (F.col(f"{y}.place") <= F.col(f"{y}.n") - need + 1)


def _maps_fit(x: str, y: str, percent: int) -> Column:
    """Whether few enough bits of the parity maps differ; a lower bound of the shingles that only one of the sets has."""
    differing = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(PARITY // 64)), F.lit(0))
    return differing * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a staged table whose full sets are similar enough. A class that many pairs name, such as the
    least of a large group, is handed to their tasks; the pairs stay where they are."""
    often = {side: hub_keys(pairs, side) for side in ("b", "a")}
    one = {side: sets.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}")) for side in ("a", "b")}

    def joined(rows: DataFrame, *columns: str) -> DataFrame:
        for side, hubs in often.items():
            rows = looked_up(rows, one[side].select(side, *[f"{c}_{side}" for c in columns]), side, hubs)
        return rows

    sized = stage(joined(pairs, "n").where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "near-sized")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return joined(sized, "n", "s").where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _decided(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """``linked`` with the text's key and the component's node."""
    sketch = sketched(docs)
    classes = stage(classes_of(sketch), "near-classes")
    keys = table_keys(classes)
    first = stage(_stars(keys, "key"), "near-stars")
    candidates = stage(first.select(F.col("a").alias("rep")).union(first.select("b")).distinct(), "near-candidates")
    sets = full_sets(docs, classes, candidates)
    rare = rare_shingles(sets, percent)
    stars = stage(first.union(_stars(rare, "t")).distinct(), "near-star-pairs")
    links = stage(verified(stars, sets, percent), "near-links")
    groups = stage(components(links), "near-groups")
    placed = rare.join(groups, rare["rep"] == groups["node"], "left").select("rep", "n", "t", "place", F.coalesce("component", "rep").alias("c"))
    open_ = with_groups(stage(placed, "near-placed"), ["t"], [F.min("c").alias("_low"), F.max("c").alias("_high")], "_low < _high").drop("_low", "_high")
    mixed = stage(open_.join(sets.select("rep", "bits"), "rep"), "near-open")
    x, y = mixed.alias("x"), mixed.alias("y")
    across = x.join(y, F.col("x.t") == F.col("y.t")).where("x.rep < y.rep AND x.c <> y.c").where(_sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _in_reach("x", "y", percent) & _maps_fit("x", "y", percent))
    pairs = stage(across.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "near-pairs")
    groups = stage(components(links.union(verified(pairs, sets, percent))), "near-groups")
    for done in (keys, first, candidates, sets, rare, stars, links, mixed, pairs):
        discard(done)
    return assigned(sketch, classes, groups)


def assigned(sketch: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Give every row its component by its set; hot classes, fewer than HOT_CLASSES, are looked up by broadcast."""
    total = sketch.count()
    found = classes.join(groups, classes["rep"] == groups["node"], "left").select("n", "set_a", "set_b", "members", "rep", "own", F.coalesce("component", "rep").alias("component"))
    found = stage(found, "near-found")
    # ids behind stand-ins count for their component's least id
    stood = found.where((F.col("rep") >= NO_ID) & F.col("own").isNotNull()).groupBy("component").agg(F.min("own").alias("low"))
    least = F.least(F.when(F.col("component") < NO_ID, F.col("component")), F.col("low"))
    found = looked_up(found, stood, "component", hub_keys(found, "component"), "left").select("n", "set_a", "set_b", "members", F.struct(F.col("component").alias("node"), least.alias("id")).alias("component"))
    key = ["n", "set_a", "set_b"]
    hot = found.where(F.col("members") * HOT_CLASSES > total).drop("members").withColumnRenamed("component", "hot")
    cool = found.where(F.col("members") * HOT_CLASSES <= total).drop("members")
    rows = sketch.drop("hashes").join(F.broadcast(hot), key, "left")
    # rows of hot classes and empty rows get a key that nothing matches, so that they spread
    spread = F.col("hot").isNotNull() | (F.col("n") == 0)
    rows = rows.withColumn("size", F.col("n")).withColumn("n", F.when(spread, -1 - F.abs(F.xxhash64("doc_id") % 1_000_003)).otherwise(F.col("n")))
    rows = rows.join(cool, key, "left").withColumn("group", F.coalesce("hot", "component"))
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("group.id"))
    return rows.select("doc_id", "text_key", F.col("group.node").alias("node"), F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``: of each component one, and all without words."""
    decided = stage(_decided(docs, percent).where("n_shingles > 0").select("doc_id", "text_key", "node", "kept"), "near-decided")
    kept = decided.where("kept")
    # several kept rows: all without ids, or one id's; the least text stays
    several = stage(kept.groupBy("node").agg(F.count("*").alias("k"), F.min("text_key").alias("least")).where("k > 1").drop("k"), "near-several")
    gone = decided.where("NOT kept").select("doc_id", "text_key")
    more = kept.join(several, "node").where("text_key <> least").select("doc_id", "text_key")
    gone = stage(gone.union(more).distinct(), "near-gone")
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, _text_key())
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[key] == other["text_key"])
    left = keyed.join(gone, same(gone), "left_anti")
    if not several.isEmpty():
        twins = stage(kept.join(several, "node").where("text_key = least").select("doc_id", "text_key").distinct(), "near-twins")
        once = left.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", key])
        left = left.join(twins, same(twins), "left_anti").unionByName(once)
    return left.select(*docs.columns)


#: All pairs that share a shingle, by counting; DuckDB needs the time of the square of a common passage's documents.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS here FROM pairs UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON pairs.a = reach.here),
low AS (SELECT node, min(here) AS here FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(here, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(here, doc_id)) AS kept FROM sets LEFT JOIN low ON node = doc_id
"""
