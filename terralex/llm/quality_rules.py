"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared to those of its language by
Jensen-Shannon distance. A language's reference is the sum over all its documents that pass the base rules, in whole
numbers, so that reruns agree; documents without a language have one of their own. A reference counts from
``REFERENCE_WORDS`` words on. Where a language has fewer there is nothing to compare with: the base rules decide and the
distances are null. So a verdict depends on its own language's documents only, at any size of the others. ``reference``
takes a trusted corpus in place of the judged one. Documents under ``MIN_WORDS`` fail the base rules, so every verdict
rests on enough words; the distances of others are still given.

A language with more than 1 / ``HOT_LANGUAGES`` of all rows, of which there are fewer than that, is looked up in a table
that goes with the tasks; the other languages' rows meet their references in a join.

Defined results: null counts as empty and fails; repeated rows are judged alike; an empty table gives no rows; a very
long text is one row of fixed-size histograms; columns other than doc_id, lang and text, whatever their names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm import words
from terralex.llm.arrow import mapped
from terralex.llm.storage import stage

MIN_WORDS = 50
#: Words of documents that pass the base rules from which a language's reference counts.
REFERENCE_WORDS = 5000
HOT_LANGUAGES = 256
#: Largest distances of a document that stays, for character classes and for common words; a short document's word
#: histogram is far from any by chance, so SHORTNESS / sqrt(words) is added to the latter.
MAX_CHARS = 0.3
MAX_WORDS = 0.22
SHORTNESS = 1.0

CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "control", "other")
COMMON = {
    "en": "the of and to in a is that it was for on as with be by at this from are or an not which have has but they his her you were had all their there can been one more we",
    "fr": "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux elle mais nous cette d'un être",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei einer um am sind noch wie",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre",
}


def _classes() -> np.ndarray:
    """Class of each byte; bytes that continue a character have class -1."""
    out = np.full(256, CLASSES.index("control"), np.int64)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9]], out[[10, 11, 12, 13]] = 3, 4
    for chars, k in ((".,;:!?", 5), ("\"'()-", 6), ("#*$%&|<>@^~_=+/\\{}[]`", 7)):
        out[[ord(c) for c in chars]] = k
    out[128:] = CLASSES.index("other")
    out[128:192] = -1
    return out


_CLASS = _classes()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _common() -> tuple[np.ndarray, np.ndarray]:
    listed = sorted({w for ws in COMMON.values() for w in ws.split()})
    hashes = np.concatenate([w.hashes for w in words.split(pa.array([" ".join(listed)]))])
    order = np.argsort(hashes)
    return hashes[order], order


_HASHES, _PLACES = _common()
N_CHARS, N_LISTED = len(CLASSES), len(_HASHES)
N_COMMON = N_LISTED + 1  # the last one stands for all other words
BLANK = " \t\n\v\f\r"


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def repeated_words(w: words.Words) -> np.ndarray:
    """Per document: words in 3-word windows that the text holds twice or more."""
    n = len(w.offsets) - 1
    keys, valid = words.grams(w, 3)
    covered = np.zeros(len(w.hashes), bool)
    at = np.flatnonzero(valid)
    if len(at):
        with np.errstate(over="ignore"):
            own = words.mix(keys[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        s = own[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:].copy()
        twice = at[order[same]]
        for i in range(3):
            covered[twice + i] = True
    return np.bincount(w.doc[covered], minlength=n)


def features(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words, class histogram and common-word histogram of each text."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    cased = words.split(column, lower=False)
    for w, low in zip(cased, words.split(column), strict=True):
        n = len(w.offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(w.bounds))
        kinds = _CLASS[w.data]
        inside = (kinds >= 0) & words.TEXT_WORD[w.data]
        place = np.minimum(np.searchsorted(_HASHES, low.hashes), N_LISTED - 1)
        hit = _HASHES[place] == low.hashes
        lead = kinds >= 0
        out[0].append(w.counts)
        out[1].append(np.bincount(doc[inside], minlength=n))
        out[2].append(np.bincount(doc[_SYMBOL[w.data]], minlength=n))
        out[3].append(repeated_words(w))
        out[4].append(np.bincount(doc[lead] * N_CHARS + kinds[lead], minlength=n * N_CHARS).reshape(n, N_CHARS))
        own = np.where(hit, _PLACES[place], N_LISTED)
        out[5].append(np.bincount(low.doc * N_COMMON + own, minlength=n * N_COMMON).reshape(n, N_COMMON))
    return [np.concatenate(x) if x else np.zeros((0, 1), np.int64) for x in out]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).astype(np.int64)))


def _failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


def _measure(batch: pa.RecordBatch) -> list:
    text = batch.column("text")
    n_words, chars, symbols, repeat, kinds, common = features(text)
    lines = [duplicate_lines(t or "") for t in text.to_pylist()]
    return [n_words.ravel(), chars.ravel(), symbols.ravel(), lines, repeat.ravel(), _failed(n_words, repeat).ravel(), _lists(kinds), _lists(common)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and both histograms, staged: the one pass over the texts."""
    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kinds array<long>, common array<long>"
    return stage(mapped(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"], columns, _measure), "rules-measured")


def _key(lang: str | None) -> str:
    return "" if lang is None else f"={lang}"


def references(measured: DataFrame) -> DataFrame:
    """(key, words, sums): both histograms' sums, one after the other, of each language with enough words, staged. Batches
    are summed by language before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            rows = np.concatenate([b.column("n_words").to_numpy().reshape(n, 1), *(np.asarray(b.column(c).flatten()).reshape(n, -1) for c in ("kinds", "common"))], axis=1)
            keys, own = np.unique([_key(x) for x in b.column("lang").to_pylist()], return_inverse=True)
            for i, key in enumerate(keys.tolist()):
                sums[key] = sums.get(key, 0) + rows[own == i].sum(0)
            if len(sums) > 1024:  # bounds memory; the shuffle adds what is handed on
                yield packed(sums)
                sums = {}
        yield packed(sums)

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["key", "sums"])

    parts = measured.where("NOT base_failed").select("lang", "n_words", "kinds", "common").mapInArrow(partial, "key string, sums array<long>")
    entries = parts.select("key", F.posexplode("sums").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
    lists = entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("key", F.col("s.v").alias("s"))
    counted = lists.select("key", F.col("s")[0].alias("words"), F.slice("s", 2, N_CHARS + N_COMMON).alias("sums"))
    return stage(counted.where(F.col("words") >= REFERENCE_WORDS), "rules-references")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in bits, of each row of ``p`` from the rows of ``q``; 0 where a row is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
        m = (p + q) / 2
        half = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
        d = np.sqrt(np.maximum(0.0, (half(p) + half(q)) / 2))
    return np.nan_to_num(d)


def judged(docs: DataFrame, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS, reference: DataFrame | None = None) -> DataFrame:
    """One row per document: base counts, base_failed, both distances and whether it is kept."""
    table = measured(docs)
    known = references(table if reference is None else measured(reference))
    by_key = table.withColumn("key", F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))).drop("lang")
    counts = stage(by_key.groupBy("key").agg(F.count("*").alias("n")), "rules-languages")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = [r["key"] for r in counts.where(F.col("n") * HOT_LANGUAGES > total).select("key").collect()]
    hot = {r["key"]: np.array(r["sums"], np.float64) for r in known.where(F.col("key").isin(often)).collect()}
    width = N_CHARS + N_COMMON

    def compared(batch: pa.RecordBatch, refs: list, has: np.ndarray) -> list:
        n = batch.num_rows
        failed = np.asarray(batch.column("base_failed").to_numpy(zero_copy_only=False), bool)
        against = np.stack([r if r is not None else np.ones(width) for r in refs]) if n else np.ones((0, width))
        kinds = np.asarray(batch.column("kinds").flatten(), np.float64).reshape(n, N_CHARS)
        common = np.asarray(batch.column("common").flatten(), np.float64).reshape(n, N_COMMON)
        chars, told = distance(kinds, against[:, :N_CHARS]), distance(common, against[:, N_CHARS:])
        near = (chars <= max_chars) & (told <= max_words + SHORTNESS / np.sqrt(np.maximum(1, batch.column("n_words").to_numpy())))
        return [pa.array(chars, mask=~has), pa.array(told, mask=~has), ~failed & (near | ~has)]

    def of_hot(batch: pa.RecordBatch) -> list:
        refs = [hot.get(k) for k in batch.column("key").to_pylist()]
        return compared(batch, refs, np.fromiter((r is not None for r in refs), bool, len(refs)))

    def of_row(batch: pa.RecordBatch) -> list:
        refs = [None if r is None else np.array(r, np.float64) for r in batch.column("sums").to_pylist()]
        return compared(batch, refs, np.fromiter((r is not None for r in refs), bool, len(refs)))

    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    columns = "char_distance double, word_distance double, kept boolean"
    out = mapped(by_key.where(F.col("key").isin(often)), keep, columns, of_hot)
    rare = by_key.where(~F.col("key").isin(often)).join(known.select("key", "sums"), "key", "left")
    return out.union(mapped(rare, keep, columns, of_row)).select(*keep, "kept", "char_distance", "word_distance")
