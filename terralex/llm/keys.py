"""Column helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` folds every script, but on pure ASCII (as many bytes as characters) it is the same and several
    times faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def seeded_key(seed: int, doc_id: Column, text: Column) -> Column:
    """A 32-digit hexadecimal key: a fixed pseudo-random order of rows that reruns and other engines repeat."""
    row = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(row.cast("binary"))


def lookup(table, index: Column) -> Column:
    """``table[index]`` for a table of integers that is part of the plan."""
    return F.element_at(F.expr(f"array({','.join(map(str, table))})"), (index + 1).cast("int"))
