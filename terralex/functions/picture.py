"""Bounds within pictures, from shares of dark points by column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widest_run(on: Column) -> Column:
    """(x0, x1): the widest run of true values, the first on ties, end exclusive; everything where none is true."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("x0"), F.lit(0).alias("x1"))

    def step(s: Column, hit: Column) -> Column:
        run = F.when(hit, s["run"] + 1).otherwise(0)
        wider = run > s["x1"] - s["x0"]
        at = s["at"] + 1
        return F.struct(at.alias("at"), run.alias("run"), F.when(wider, at - run).otherwise(s["x0"]).alias("x0"), F.when(wider, at).otherwise(s["x1"]).alias("x1"))

    best = F.aggregate(on, start, step)
    return F.when(best["x1"] > 0, F.struct(best["x0"].alias("x0"), best["x1"].alias("x1"))).otherwise(F.struct(F.lit(0).alias("x0"), F.size(on).alias("x1")))


def panel_bounds(dark: Column) -> Column:
    """(x0, x1) to crop a picture to: its widest band of columns whose dark share is above 0.3 and half of the largest,
    with 13 % of its width on either side; the whole width where the band has less than a fifth of it."""
    width = F.size(dark)
    limit = F.greatest(F.lit(0.3), F.array_max(dark) * 0.5)
    band = widest_run(F.transform(dark, lambda v: v > limit))
    size = band["x1"] - band["x0"]
    pad = F.floor(size * 0.13).cast("int")
    padded = F.struct(F.greatest(F.lit(0), band["x0"] - pad).alias("x0"), F.least(width, band["x1"] + pad).alias("x1"))
    return F.when(size < width * 0.2, F.struct(F.lit(0).alias("x0"), width.alias("x1"))).otherwise(padded)
