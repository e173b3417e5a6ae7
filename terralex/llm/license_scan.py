"""Licence scan by diagonal voting.

Hashes of all rolling windows of ``K`` words are joined to their places in licence templates; a hit at word p of a
document and word t of a template votes for the diagonal p - t. Votes are counted by document, template and diagonal,
diagonals at most the template's length apart are merged (words were put in or left out between them), and every span is
verified word by word: the label holds if the longest common subsequence covers ``COVERAGE`` of the template. A template
so short that its changed words could break every window of ``K`` has shorter windows.

Where texts are read, a Bloom filter of the template hashes, as runtime filters of joins are, leaves out most windows
that can't join; the join decides. Base phrases are counted in the same pass.

Defined results: null counts as empty; repeated rows get equal labels; ``score`` is the best coverage of any candidate
span, at least 0.5 where a base phrase stands, else 0; an empty table gives no rows; a very long text is read in pieces,
and only its spans and words, as hashes, go on; columns other than doc_id and text, whatever their names, are not read.
Rows meet their spans by two 64-bit hashes of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm import words
from terralex.llm.arrow import mapped
from terralex.llm.licenses import TEMPLATES
from terralex.llm.storage import stage

K = 3
#: The columns that tell rows apart.
ROW = ["row_key", "row_check"]
#: Words within which notices begin at the same place.
GAP = 3
COVERAGE = 0.8
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def hashed(text: str) -> words.Words:
    return next(words.split(pa.array([text]), words.ALNUM_WORD))


_PHRASES = [(hashed(p).hashes, label) for p, label in PHRASES]
_TEMPLATES = [(label, hashed(text)) for label, text in TEMPLATES]
LABELS = sorted({label for _, label in PHRASES})


def window(n: int) -> int:
    """Words of the windows of a template of ``n`` words: ``K``, or the longest run that as many changed words as
    ``COVERAGE`` allows leave in any case."""
    changed = int(n * (1 - COVERAGE) + 1e-9)
    return min(K, -(-(n - changed) // (changed + 1)))


_WINDOWS = sorted({window(len(t.hashes)) for _, t in _TEMPLATES})


def _grams(w: words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows, apart for each size, and whether they lie in one document."""
    grams, valid = words.grams(w, k)
    return grams ^ words.mix(np.array([k], np.uint64)), valid


def template_rows() -> list[tuple[int, int, int]]:
    """(hash, template, place) of all windows of all templates."""
    return [(int(h.astype(np.int64)), i, p) for i, (_, t) in enumerate(_TEMPLATES) for p, h in enumerate(_grams(t, window(len(t.hashes)))[0])]


_FILTERS = np.zeros((2, 1 << 16), bool)
for _i, _shift in enumerate((48, 32)):
    _FILTERS[_i, [(h >> _shift) & 0xFFFF for h, _, _ in template_rows()]] = True


def _read(batch: pa.RecordBatch) -> list:
    """Base columns, windows that may join (places and hashes) and, where there are any, the hashes of all words."""
    out: list[list] = [[] for _ in range(8)]
    for w in words.split(batch.column("text"), words.ALNUM_WORD):
        n = len(w.offsets) - 1
        places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for phrase, label in _PHRASES:
            k = len(phrase)
            if len(w.hashes) >= k:
                at = w.hashes[: len(w.hashes) - k + 1] == phrase[0]
                for i in range(1, k):
                    at &= w.hashes[i : len(w.hashes) - k + 1 + i] == phrase[i]
                for p in np.flatnonzero(at):
                    d = int(np.searchsorted(w.offsets, p, "right")) - 1
                    if p + k <= w.offsets[d + 1]:
                        places[d].append((int(p - w.offsets[d]), label))
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in _WINDOWS:
            grams, valid = _grams(w, k)
            own = np.flatnonzero(valid & _FILTERS[0, grams >> np.uint64(48)])
            own = own[_FILTERS[1, (grams[own] >> np.uint64(32)) & np.uint64(0xFFFF)]]
            at.append(own)
            found.append(grams[own])
        hits, grams = np.concatenate(at), np.concatenate(found)
        order = np.argsort(hits, kind="stable")
        hits, grams = hits[order], grams[order]
        cut = np.searchsorted(hits, w.offsets)
        for d in range(n):
            a, b = w.offsets[d], w.offsets[d + 1]
            mine, own = hits[cut[d] : cut[d + 1]], grams[cut[d] : cut[d + 1]]
            starts = [p for p, _ in places[d]]
            row = (b - a, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places[d]})), (mine - a), own.astype(np.int64), w.hashes[a:b].astype(np.int64) if len(mine) else [])
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, and the place in ``b`` where the first prefix that holds it ends; ``a``
    is a template and so is short."""
    best, end = np.zeros(len(a) + 1, np.int64), 0
    for i in np.flatnonzero(np.isin(b, a)):
        step = best.copy()
        step[1:] = np.maximum(step[1:], best[:-1] + (a == b[i]))
        step = np.maximum.accumulate(step)
        if step[-1] > best[-1]:
            end = int(i) + 1
        best = step
    return int(best[-1]), end


def match(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence and where in ``b`` it begins: the last place for the least end."""
    n, end = common_length(a, b)
    return n, end - common_length(a[::-1], b[:end][::-1])[1]


def _verify(batch: pa.RecordBatch) -> list:
    label, score, common, begin = [], [], [], []
    for i, span in zip(batch.column("template").to_pylist(), batch.column("span"), strict=True):
        name, t = _TEMPLATES[i]
        label.append(name)
        n, at = match(t.hashes.astype(np.int64), span.values.to_numpy())
        score.append(n / len(t.hashes))
        common.append(n)
        begin.append(at)
    return [label, score, common, begin]


def read(docs: DataFrame) -> DataFrame:
    """One row per document with its base columns and hits, staged: the one pass over the texts."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("row_check"))
    columns = "n_words long, n_base long, first_word long, last_word long, base_labels string, places array<long>, grams array<long>, words array<long>"
    return stage(mapped(keyed, ["doc_id", *ROW], columns, _read), "license-read")


def spans(table: DataFrame) -> DataFrame:
    """(row_key, row_check, start, length, label, score, common, begin) of every candidate span, verified; ``begin`` is from ``start``."""
    templates = table.sparkSession.createDataFrame(template_rows(), "gram long, template int, tplace int")
    hits = table.where(F.size("places") > 0).select(*ROW, F.explode(F.arrays_zip("places", "grams")).alias("hit"))
    hits = hits.select(*ROW, F.col("hit.places").alias("place"), F.col("hit.grams").alias("gram")).distinct()
    # the templates are a fixed list
    joined = hits.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("place") - F.col("tplace"))
    votes = joined.groupBy(*ROW, "template", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    order = Window.partitionBy(*ROW, "template").orderBy("diagonal")
    sizes = F.element_at(F.expr(f"array({','.join(str(len(t.hashes)) for _, t in _TEMPLATES)})"), F.col("template") + 1)
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > sizes, F.lit(True)).cast("int")
    merged = votes.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order)).groupBy(*ROW, "template", "run")
    merged = merged.agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("last"))
    # words may have been put in before the first hit and after the last
    slack = F.ceil(sizes / 4) + 2
    start = F.greatest(F.lit(0), F.col("diagonal") - slack)
    length = F.col("last") + sizes + slack - start
    texts = table.where(F.size("places") > 0).select(*ROW, "words").dropDuplicates(ROW)
    found = merged.join(texts, ROW).select(*ROW, "template", start.alias("start"), length.cast("long").alias("length"), F.slice("words", (start + 1).cast("int"), length.cast("int")).alias("span"))
    return mapped(found, [*ROW, "start", "length"], "label string, score double, common long, begin long", _verify)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: base columns, all labels and a score."""
    table = read(docs)
    # notices that differ in a word or two match at the same place: the best one there counts, of equals the longest
    there = Window.partitionBy(*ROW).orderBy(F.col("start") + F.col("begin")).rangeBetween(-GAP, GAP)
    rank = F.struct("score", "common")
    found = spans(table).withColumn("rival", F.max(rank).over(there)).where(rank >= F.col("rival"))
    best = found.groupBy(*ROW).agg(F.max("score").alias("best"), F.collect_set(F.when(F.col("score") >= COVERAGE, F.col("label"))).alias("more"))
    rows = table.drop("places", "grams", "words").join(best, ROW, "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
