"""What a record's page shows: its own fields and the records that point to it, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.uri import truncate
from corpuslake.operators import analytics


def detail(records: DataFrame) -> DataFrame:
    """``uri, field, value`` of every field that is not empty; nested ones as JSON."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.when(F.size(c) > 0, F.to_json(c))
        return F.to_json(c) if isinstance(f.dataType, (T.StructType, T.MapType)) else F.nullif(c.cast("string"), F.lit(""))

    fields = [f for f in records.schema if f.name != "uri"]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), shown(f).alias("value")) for f in fields])
    return records.select("uri", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def experiment(sets: DataFrame, reports: DataFrame, uri: str) -> dict[str, DataFrame]:
    """Judgment sets and agreement reports of an experiment."""
    own = lambda df: df.filter(F.col("experimentRef") == uri)
    return {"sets": own(sets), "reports": own(reports)}


def judgment_set(judgments: DataFrame, expressions: DataFrame) -> DataFrame:
    """Items of a set with their response: a scalar before a category before free text."""
    text = expressions.select(F.col("uri").alias("item"), F.col("text").alias("item_text"))
    return judgments.withColumn("response", analytics.response("scalarValue", "categoricalValue", "freeText")).join(text, "item", "left")


def corpus(memberships: DataFrame, uri: str) -> DataFrame:
    """Members of a corpus by split."""
    return memberships.filter(F.col("corpusRef") == uri).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def expression(expressions: DataFrame, layers: DataFrame, edges: DataFrame, uri: str) -> dict[str, DataFrame]:
    """Children, layers and graph edges of an expression."""
    return {
        "children": expressions.filter(F.col("parentRef") == uri),
        "layers": analytics.layers_roster(layers.filter(F.col("expression") == uri)),
        "edges": edges.filter(analytics.property_of("properties", "uds_expression") == uri),
    }


def _license() -> Column:
    return F.coalesce(F.nullif("licensing.expression", F.lit("")), F.array_join(F.transform("licensing.licenses", lambda x: x["spdx"]), ", "))


def media(records: DataFrame) -> DataFrame:
    """A medium's technical data: its title, else its kind, heads it."""
    return records.select("uri", F.coalesce(F.nullif("title", F.lit("")), "kind").alias("heading"), "kind", F.col("mimeType").alias("mime"), F.col("durationMs").alias("duration_ms"), F.col("externalUri").alias("external"), _license().alias("licensing"))


def persona(records: DataFrame, preview: int = 600) -> DataFrame:
    """A persona's frame and the beginning of its guidelines."""
    return records.select("uri", F.col("name").alias("heading"), "description", "domain", "kind", F.array_join("ontologyRefs", ", ").alias("ontologies"), _license().alias("licensing"), truncate("guidelines", preview).alias("guidelines"))


def eprint(records: DataFrame) -> DataFrame:
    """A paper's citation: headed by its title, else the citation as text, else its identifier."""
    filled = lambda c: F.nullif(c, F.lit(""))
    creator = lambda c: F.coalesce(filled(c["literal"]), filled(c["family"]), filled(c["given"]))
    names = F.array_join(F.transform("citation.creators", creator), ", ")
    heading = F.coalesce(filled("citation.title"), filled("citation.raw"), F.col("eprintIdentifier"))
    return records.select("uri", heading.alias("heading"), F.col("eprintIdentifier").alias("identifier"), F.col("eprintIdentifierType").alias("id_type"), F.col("linkType").alias("link_type"), names.alias("creators"), F.col("citation.doi").alias("doi"), F.col("citation.containerTitle").alias("venue"))


def edge_cards(edge_sets: DataFrame) -> DataFrame:
    """Edges of edge sets with the names of their ends."""
    each = edge_sets.select("uri", "edgeType", F.posexplode("edges").alias("edge_no", "e"))
    return each.select("uri", "edgeType", "edge_no", analytics.object_ref("e.source").alias("source"), analytics.object_ref("e.target").alias("target"))


class ViewRegistry:
    """Views by record kind; only those with rows are offered, the detail always and last."""

    def __init__(self):
        self._makers: dict[str, list[tuple[str, Callable[[str], DataFrame]]]] = {}

    def add(self, kind: str, name: str, make: Callable[[str], DataFrame]) -> None:
        self._makers.setdefault(kind, []).append((name, make))

    def views(self, kind: str, uri: str, record: DataFrame) -> list[tuple[str, DataFrame]]:
        made = [(name, make(uri)) for name, make in self._makers.get(kind, [])]
        return [(n, df) for n, df in made if not df.isEmpty()] + [("Detail", detail(record))]
