"""Exact deduplication on an extendible-hash index kept in the shared folder, with DataFrame functions only.

1. One pass over the texts makes (doc_id, h, text_sha256); h is a 64-bit hash of the normalised text, its key.
2. A directory over the first bits of the keys is grown from counts per ``MAX_DEPTH``-bit prefix: a bucket with more than
   ``CAPACITY`` keys splits by its next bit, and the directory doubles where that bit is new to it. So a bucket owns a range
   of keys.
3. Texts of keys that more than one row has, and of few others, are looked up in the directory and dealt to their bucket's owner, after equal
   ones of a share of the tasks were combined. The owner compares their bytes; different texts of one key form a chain. The
   index has one folder of files per bucket.
4. Every row finds its bucket in the directory and its entry in the bucket's chain.

Texts are equal when identical after lower-casing A-Z. Defined results: null text counts as empty; of equal texts the
row with the largest doc_id stays, null ids losing to any other; rows that repeat both id and text are one document
(the report marks them alike, ``deduplicated`` returns one of them); an empty table gives no rows; a very long text is
one value of a column; columns other than doc_id and text, whatever their names, are handed on by ``deduplicated`` only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.keys import ascii_lower, unused
from terralex.llm.storage import stage, stage_by

#: Bits of the hash that the directory may use; it has at most 2**MAX_DEPTH entries at any size of input.
MAX_DEPTH = 14
#: Keys that a bucket holds before it splits. Buckets that use all MAX_DEPTH bits grow beyond it.
CAPACITY = 4096
#: A group with more than this share of all rows is hot; at most HOT_GROUPS groups can be.
HOT_GROUPS = 256
#: Rows of equal texts that a bucket's owner gets at most.
SHARES = 16
#: Bits of the filter of keys that more than one row has: 2**FILTER_BITS / 8 bytes go with the tasks.
FILTER_BITS = 26


def directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Grow an extendible-hash directory: (global depth, bucket of each entry).

    ``histogram`` counts keys by their first ``max_depth`` hash bits. An overfull bucket splits by its next bit; when
    it already uses as many bits as the directory, the directory doubles.
    """
    before = [0, *accumulate(histogram.get(k, 0) for k in range(1 << max_depth))]
    depth, buckets, entries = 0, [(0, 0)], [0]

    def load(level: int, prefix: int) -> int:
        rest = max_depth - level
        return before[(prefix + 1) << rest] - before[prefix << rest]

    todo = [0]
    while todo:
        b = todo.pop()
        level, prefix = buckets[b]
        if level == max_depth or load(level, prefix) <= capacity:
            continue
        if level == depth:
            entries = [e for e in entries for _ in (0, 1)]
            depth += 1
        buckets[b] = (level + 1, prefix * 2)
        buckets.append((level + 1, prefix * 2 + 1))
        first = (prefix * 2 + 1) << (depth - level - 1)
        for i in range(first, first + (1 << (depth - level - 1))):
            entries[i] = len(buckets) - 1
        todo += [b, len(buckets) - 1]
    return depth, entries


def _normal(docs: DataFrame) -> Column:
    return F.coalesce(ascii_lower(F.col("text")), F.lit(""))


def key_of(body: Column) -> Column:
    """The index key of a normalised text."""
    return F.xxhash64(body)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)


class Directory:
    """The directory as a table (entry, bucket) of at most 2**MAX_DEPTH rows, which goes with every task."""

    def __init__(self, keys: DataFrame, capacity: int):
        counts = keys.groupBy(_prefix(MAX_DEPTH).alias("p")).agg(F.count("*").alias("n")).collect()
        self.depth, self.entries = directory({r["p"]: r["n"] for r in counts}, capacity)
        listed = F.split(F.lit(",".join(map(str, self.entries))), ",")
        rows = keys.sparkSession.range(1).select(F.posexplode(listed).alias("entry", "bucket"))
        self.table = stage(rows.withColumn("bucket", F.col("bucket").cast("int")), "dedup-directory")

    def owners(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that owns their key ``h``."""
        return rows.withColumn("entry", _prefix(self.depth)).join(F.broadcast(self.table), "entry").drop("entry")


def _slot(h: str = "h") -> tuple[Column, Column]:
    """(bitmap, bit in it) of a key: its first FILTER_BITS bits."""
    slot = F.shiftrightunsigned(h, 64 - FILTER_BITS)
    return F.shiftright(slot, 15).cast("int").alias("map"), slot.bitwiseAND(F.lit(32767)).alias("bit")


def maybe_shared(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``texts`` without most of those whose key ``h`` no other row has: a bit set is kept of the keys that more have, in
    bitmaps of 32768 bits, 2**FILTER_BITS bits in all at any size of input."""
    many = keys.where("n > 1").select(*_slot())
    maps = stage(many.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")), "dedup-filter")
    byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return texts.select("*", *_slot()).join(F.broadcast(maps), "map").where(f"shiftright({byte}, cast(bit % 8 as int)) % 2 = 1").select(*texts.columns)


def build_index(docs: DataFrame, keys: DataFrame, owned: Directory) -> DataFrame:
    """The index over keys that more than one row has: (bucket, h, chain, text_sha256, keep_id, group_size), a folder for
    each bucket. Few texts whose key is unique are moved while such keys are fewer than 2**FILTER_BITS; they make entries
    of one row."""
    texts = maybe_shared(docs.select("doc_id", _normal(docs).alias("body")).withColumn("h", key_of(F.col("body"))), keys)
    # equal texts of a share of the tasks become one row, so that a bucket gets few rows of a text that very many rows have
    share = F.spark_partition_id() % SHARES
    runs = owned.owners(texts).withColumn("share", share).groupBy("share", "bucket", "h", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    dealt = runs.drop("share").repartition("bucket")
    groups = dealt.groupBy("bucket", "h", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256"))
    chained = groups.select("bucket", "h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size").withColumn("chain", chain)
    return stage_by(chained, "dedup-index", "bucket")


def deduped(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: its group's surviving id and size.

    Groups above 1 / HOT_GROUPS of all rows, of which there are fewer than HOT_GROUPS, are looked up by broadcast; the
    other rows are dealt to the owners of their buckets.
    """
    slim = stage(docs.select("doc_id", _normal(docs).alias("body")).select("doc_id", key_of(F.col("body")).alias("h"), F.sha2("body", 256).alias("text_sha256")), "dedup-slim")
    keys = stage(slim.groupBy("h").agg(F.count("*").alias("n")), "dedup-keys")
    owned = Directory(keys, capacity)
    index = build_index(docs, keys, owned)
    total = slim.count()
    entry = ["h", "text_sha256", "keep_id", "group_size"]
    hot = F.broadcast(index.where(F.col("group_size") * HOT_GROUPS > total).select(*entry))
    cool = index.where(F.col("group_size") * HOT_GROUPS <= total).select("bucket", *entry).repartition("bucket")
    common = slim.join(hot, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    rest = owned.owners(slim.join(hot, ["h", "text_sha256"], "left_anti")).repartition("bucket").join(cool, ["bucket", "h", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    rest = rest.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return common.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too."""
    return deduped(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rows that repeat an id with equal text come out once."""
    decided = stage(deduped(docs, capacity).where("group_size > 1").select("doc_id", F.xxhash64("text_sha256").alias("sha"), "kept"), "dedup-decided")
    gone = decided.where("NOT kept").select("doc_id", "sha").distinct()
    twins = decided.where("kept").groupBy("doc_id", "sha").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sha = unused(docs, "_sha")
    keyed = docs.withColumn(sha, F.xxhash64(F.sha2(_normal(docs), 256)))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[sha] == other["sha"])
    left = keyed.join(gone, same(gone), "left_anti")
    if not twins.isEmpty():
        twins = stage(twins, "dedup-twins")
        once = left.join(twins, same(twins), "left_semi").dropDuplicates(["doc_id", sha])
        left = left.join(twins, same(twins), "left_anti").unionByName(once)
    return left.select(*docs.columns)


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size, sha256(body) AS text_sha256 FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256 FROM n JOIN g USING (body)
"""
