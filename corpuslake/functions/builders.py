"""Anchors and layers built from columns, with their constraints."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.anchors import ANCHOR, SPAN, TIME


def _require(ok: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def _anchor(**variant: Column) -> Column:
    return F.struct(*[variant.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANCHOR.fields])


def span(start: Column, end: Column) -> Column:
    """A text span; the end must not be before the start, nor the start negative."""
    value = F.struct(start.cast("long").alias("byteStart"), end.cast("long").alias("byteEnd"), F.lit(None).cast("long").alias("charStart"), F.lit(None).cast("long").alias("charEnd")).cast(SPAN)
    return _anchor(textSpan=_require((start >= 0) & (end >= start), "a span needs 0 <= start <= end", value))


def token_ref(tokenization: Column, index: Column) -> Column:
    value = F.struct(F.struct(tokenization.cast("string").alias("value")).alias("tokenizationId"), index.cast("long").alias("tokenIndex"))
    return _anchor(tokenRef=_require(index >= 0, "a token index must not be negative", value))


def temporal(start: Column, end: Column) -> Column:
    value = F.struct(start.cast("long").alias("start"), end.cast("long").alias("ending")).cast(TIME)
    return _anchor(temporalSpan=_require((start >= 0) & (end >= start), "a time span needs 0 <= start <= end", value))


class LayerBuilder:
    """An annotation layer put together one annotation at a time; ids are made for those without one."""

    def __init__(self, expression: str, kind: str, subkind: str | None = None, formalism: str | None = None, tokenization: str | None = None):
        for name, value in (("expression", expression), ("kind", kind)):
            if not value:
                raise ValueError(f"a layer needs its {name}")
        self.head = {"expression": expression, "kind": kind, "subkind": subkind, "formalism": formalism, "tokenizationId": tokenization}
        self.annotations: list[dict] = []

    def add(self, anchor: dict | None = None, label: str | None = None, value: str | None = None, token_index: int | None = None, confidence: int | None = None, uuid: str | None = None) -> dict:
        """``anchor`` is an ``ANCHOR`` as a dictionary; a token index must not be negative, a confidence lies in 0..1000."""
        if token_index is not None and token_index < 0:
            raise ValueError("a token index must not be negative")
        if confidence is not None and not 0 <= confidence <= 1000:
            raise ValueError("a confidence lies between 0 and 1000")
        made = {"uuid": uuid or str(uuid4()), "anchor": anchor, "label": label, "value": value, "tokenIndex": token_index, "confidence": confidence}
        self.annotations.append(made)
        return made

    def build(self) -> dict:
        if not self.annotations:
            raise ValueError("a layer needs an annotation")
        return {**self.head, "annotations": list(self.annotations)}


LAYER = T.StructType([
    T.StructField("uri", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("expression", "kind", "subkind", "formalism", "tokenizationId")),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("uuid", T.StringType()), T.StructField("anchor", ANCHOR), T.StructField("label", T.StringType()), T.StructField("value", T.StringType()),
        T.StructField("tokenIndex", T.LongType()), T.StructField("confidence", T.LongType()),
    ]))),
])


def layers(spark, built: dict[str, dict]) -> DataFrame:
    """Built layers by uri as rows."""
    return spark.createDataFrame([{"uri": uri, **layer} for uri, layer in built.items()], LAYER)


def with_references(records: DataFrame, published: DataFrame, value: str = "value") -> DataFrame:
    """Records with the uris of what they refer to in place of pending names.

    A record that is not published yet is referred to as ``pending:name``; ``published``
    has ``name, uri``, the uri null while there is none.  A reference to a name that is
    not known, or not published, is an error.
    """
    quoted = r'"pending:((?:[^"\\]|\\.)*)"'
    named = records.select("uri", F.explode(F.array_distinct(F.regexp_extract_all(value, F.lit(quoted), F.lit(1)))).alias("name")).join(published.select("name", F.col("uri").alias("to")), "name", "left")
    checked = F.coalesce("to", F.raise_error(F.concat(F.lit("no record is published as "), "name")).cast("string"))
    pairs = named.groupBy("uri").agg(F.collect_list(F.struct("name", checked.alias("to"))).alias("_pairs"))
    filled = F.aggregate("_pairs", F.col(value), lambda text, p: F.replace(text, F.concat(F.lit('"pending:'), p["name"], F.lit('"')), F.concat(F.lit('"'), p["to"], F.lit('"'))))
    return records.join(pairs, "uri", "left").withColumn(value, F.when(F.col("_pairs").isNull(), F.col(value)).otherwise(filled)).drop("_pairs")


def violations(layers: DataFrame) -> DataFrame:
    """``uri, problem`` of layers that break a rule: no annotation, no expression, or a confidence outside 0..1000."""
    bad = F.exists("annotations", lambda a: (a["confidence"] < 0) | (a["confidence"] > 1000))
    checks = [("no annotation", F.coalesce(F.size("annotations"), F.lit(0)) < 1), ("no expression", F.coalesce(F.col("expression"), F.lit("")) == ""), ("confidence out of range", F.coalesce(bad, F.lit(False)))]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in checks]), lambda m: m.isNotNull())
    return layers.select("uri", F.explode(found).alias("problem"))
