"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Defined results: null or empty text has size 0 and takes nothing; null sources form one source, last in order; rows that
repeat an id with the same text are decided together; an empty table gives an empty mix; a very long text is counted where
it lies and moved only by readers of the mix; columns other than doc_id, text and source, whatever their names, are only
handed on by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.keys import WORD, seeded_key, unused
from terralex.llm.storage import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Slices of the seeded order in each source: the unit of the first, small prefix sum.
SLICES = 1024


def source_key(source: Column) -> Column:
    """Never null, in the order of code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(skey, source_size) -> with ``target``: weights times one level, but no more than ``max_epochs`` sizes.

    Redistributing the excess by weight until no source is above its cap ends where every open source stands at the
    same level; sources fill in the order of cap / weight, so the level is found by prefix sums over that order.
    The table has one row per source.
    """
    order = Window.orderBy("skey")
    fill = Window.orderBy("_ratio", "skey")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    weighted = sources.withColumn("_place", (F.row_number().over(order) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") + 1).cast("int"))
    everything = Window.partitionBy()
    levels = (
        weighted.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * float(max_epochs))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * share)
        .withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_filled")) / F.col("_open"))
        # the first source whose cap lies above the level that the open sources would have; later levels are lower
        .withColumn("_water", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    )
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_water") * F.col("_weight")))
    return levels.select("skey", "source_size", target.alias("target"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source key, number of words and place in the seeded order, staged: the one pass over the texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select("doc_id", source_key(F.col("source")).alias("skey"), size.alias("size"), seeded_key(seed, F.col("doc_id"), F.col("text")).alias("place"))
    return stage(slim, "mix-sized")


def plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Decide repetitions of every sized row: ``repeats`` whole copies, at most ``max_epochs``.

    Every row gets floor(target / source size) copies; one more goes to the rows that come first in the seeded order,
    up to the row whose middle passes the rest of the target. Sums run over (source, slice) first, so that no task
    orders more than a thousandth of a source.
    """
    # slices follow the order of places
    slim = slim.withColumn("slice", (F.conv(F.substring("place", 1, 4), 16, 10).cast("int") / (65536 // SLICES)).cast("int"))
    slices = slim.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    sources = water_fill(slices.groupBy("skey").agg(F.sum("slice_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    earlier = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        slices.join(sources, "skey")
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("earlier", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .drop("slice_size")
    )
    upto = F.sum("size").over(Window.partitionBy("skey", "slice").orderBy("place"))
    middle = F.col("earlier") + upto - F.col("size") / 2
    more = F.when((F.col("size") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    return slim.join(ranges, ["skey", "slice"]).withColumn("repeats", (F.col("whole") + more).cast("int"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    return plan(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row as often as its source's target asks for, with the columns of ``docs``.

    The decisions come down to one row per source (copies of all rows, and the last place that gets one more), so the
    texts aren't shuffled.
    """
    decided = plan(sized(docs), **settings)
    key, whole, last, times = (unused(docs, f"_{n}") for n in ("skey", "whole", "last", "times"))
    final = F.max(F.when(F.col("repeats") > F.col("whole"), F.col("place"))).alias(last)
    cuts = stage(decided.groupBy(F.col("skey").alias(key)).agg(F.min("whole").alias(whole), final), "mix-cuts")
    place = seeded_key(SEED, F.col("doc_id"), F.col("text"))
    words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    repeats = F.when(words, F.col(whole) + F.when(place <= F.col(last), 1).otherwise(0)).otherwise(0)
    rows = docs.join(cuts, source_key(docs["source"]) == cuts[key]).withColumn(times, repeats.cast("int"))
    copies = rows.where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*[docs[c] for c in docs.columns])


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS place
  FROM documents),
sources AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w
  FROM weighted),
water AS (SELECT *, max(CASE WHEN (total - filled) / open_w <= ratio THEN (total - filled) / open_w END) OVER () AS level FROM levels),
targets AS (
  SELECT skey, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM water),
wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.place) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN wholes t USING (skey))
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN size > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""
