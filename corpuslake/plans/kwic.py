"""Keyword in context: every match of a regular expression with its surroundings.

The exact form runs Python's own ``re`` over Arrow batches, in the stage that scans
the text, so nothing is exchanged.  The native form builds the same rows in the JVM
with regular expressions that Java and Python read alike and that cannot match
the empty string.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.plans.errors import QueryError

COLUMNS = ("source", "match_no", "left", "match", "right")
LABELS = ("uri", "id", "layer_uri")


def label_column(df: DataFrame) -> str:
    """The column that names a row: the first of the usual ones, else the first column."""
    return next((c for c in LABELS if c in df.columns), df.columns[0])


def literal_in(pattern: str) -> str | None:
    """The longest run of plain characters that every match must hold, or null if that is not plain to see."""
    if re.search(r"[|()\[\]{}?*+^$.]", pattern):
        return None
    bare = re.sub(r"\\[bB]", "\0", pattern)
    if "\\" in bare:
        return None
    return max(bare.split("\0"), key=len) or None


def kwic(df: DataFrame, pattern: str, column: str = "text", label: str | None = None, window: int = 48, ignore_case: bool = True) -> DataFrame:
    """``source, match_no, left, match, right`` for every match; nulls are skipped, blanks collapsed on each side."""
    if not pattern.strip():
        raise QueryError("the pattern is empty")
    if column not in df.columns:
        raise QueryError(f"no column {column}; there are {', '.join(df.columns)}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"not a regular expression: {e}") from e
    label = label or label_column(df)
    rows = df.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("source"), F.col(column).cast("string").alias("text")).filter("text is not null")
    if (known := literal_in(pattern)) and (known.isascii() or not ignore_case):
        # a necessary condition that Catalyst can evaluate before rows are sent to Python; non-ASCII letters that fold to ASCII ones are let through
        plain = F.contains(F.lower("text"), F.lit(known.lower())) if ignore_case else F.contains("text", F.lit(known))
        rows = rows.filter(plain | F.col("text").rlike(r"[ıſK]")) if ignore_case else rows.filter(plain)
    flags = re.IGNORECASE if ignore_case else 0

    def run(batches):
        find, blank = re.compile(pattern, flags).finditer, re.compile(r"\s+")
        for batch in batches:
            out = [[], [], [], [], []]
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, m in enumerate(find(text)):
                    a, b = m.span()
                    for values, v in zip(out, (source, k, blank.sub(" ", text[max(a - window, 0) : a]), blank.sub(" ", m[0]), blank.sub(" ", text[b : b + window])), strict=True):
                        values.append(v)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], list(COLUMNS))

    return rows.mapInArrow(run, "source string, match_no long, left string, match string, right string")


def kwic_native(df: DataFrame, pattern: str, key: str, column: str = "text", window: int = 48, ignore_case: bool = True) -> DataFrame:
    """The same rows without Python, for patterns that never match the empty string; ``key`` must be unique."""
    p = f"(?{'i' if ignore_case else ''}U)" + pattern
    hits = F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0))
    gaps = F.split(F.col(column), p, -1)
    parts = df.filter(F.col(column).isNotNull()).select(F.col(key), F.col(column).alias("_t"), F.posexplode(F.arrays_zip(hits.alias("hit"), gaps.alias("gap"))).alias("n", "x"))
    before = Window.partitionBy(key).orderBy("n")
    at = F.sum(F.length("x.gap")).over(before) + F.coalesce(F.sum(F.length("x.hit")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    placed = parts.withColumn("at", at).filter("x.hit is not null")
    left = F.substring(F.col("_t"), F.greatest(F.col("at") - window, F.lit(0)).cast("int") + 1, F.least(F.col("at"), F.lit(window)).cast("int"))
    right = F.substring(F.col("_t"), (F.col("at") + F.length("x.hit")).cast("int") + 1, F.lit(window))
    return placed.select(F.col(key).cast("string").alias("source"), F.col("n").cast("long").alias("match_no"), squeeze(left).alias("left"), squeeze(F.col("x.hit")).alias("match"), squeeze(right).alias("right"))
