"""Bounded training samples and hold-out rules shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, rest: int):
    """True where the remainder is ``rest``; rows with a null id are not held out."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


def bounded(df: DataFrame, id_col: str, rows: int, *ties: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, spread by a hash of their id (a bound on what a model is fitted to)."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(id_col)), F.col(id_col), *ties).limit(rows)


def chosen_labels(labels: DataFrame, label: str, id_col: str, rows: int) -> DataFrame:
    """``_id, y`` of at most ``rows`` labels that are not null."""
    return bounded(labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id is not null and y is not null"), "_id", rows, "y")


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, text`` and the other columns of ``chosen``, which is bounded and broadcast by ``_id``; one scan of ``docs``."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")


def within(sample: DataFrame, rows: int, points: int, *ties: str) -> DataFrame:
    """At most ``rows`` rows of ``_id, text, ...``, and of those as many, shortest first, as have ``points`` code points in all.

    Ids may be repeated in the documents, so the rows are bounded here once more;
    with the bound on the points, what reaches the driver is bounded as well.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    order = [size, F.xxhash64(F.lit("sample"), "_id"), "_id", "text", *ties]
    so_far = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return bounded(sample, "_id", rows, "text", *ties).withColumn("_points", so_far).filter(F.col("_points") <= points).drop("_points")
