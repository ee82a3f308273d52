"""Dataset cards: summaries, facets, ranked search, merge into an index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.kinds import DATASET_KINDS, kind_of
from corpuslake.functions.uri import authority_of, card_uri, nsid_of
from corpuslake.operators.versions import VersionStore, diff


@dataclass(frozen=True)
class Facets:
    """What a dataset must be like; a field that is null is not asked for."""

    text: str | None = None
    language: str | None = None
    domain: str | None = None
    license: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    adjudicated: bool | None = None
    metric: str | None = None
    min_rounds: int | None = None


def summary_columns() -> list[Column]:
    return [
        F.col("uri"), F.col("name"), F.col("description"), F.col("domain"), F.coalesce("language", F.get("languages", F.lit(0))).alias("language"), F.col("languages"),
        F.coalesce(F.nullif("licensing.expression", F.lit("")), F.get("licensing.licenses", F.lit(0))["spdx"]).alias("license"),
        F.col("expressionCount").alias("expression_count"), F.col("annotationDesign.adjudication").isNotNull().alias("has_adjudication"),
    ]


def summary(corpora: DataFrame) -> DataFrame:
    """Flat summaries of corpus records: the first language, and the license expression or else the first license."""
    return corpora.select(*summary_columns())


def _has(column: str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(needle.lower())), F.lit(False))


def _facets(f: Facets) -> list[Column]:
    asked = []
    if f.language is not None:
        asked.append((F.col("language") == f.language) | F.coalesce(F.array_contains("languages", f.language), F.lit(False)))
    asked += [F.col(c) == v for c, v in (("domain", f.domain), ("license", f.license), ("has_adjudication", f.adjudicated)) if v is not None]
    if f.min_count is not None:
        asked.append(F.col("expression_count") >= f.min_count)
    if f.max_count is not None:
        asked.append(F.col("expression_count") <= f.max_count)
    if f.metric is not None:
        asked.append(F.array_contains("quality_metrics", f.metric))
    if f.min_rounds is not None:
        asked.append(F.col("annotation_rounds") >= f.min_rounds)
    return asked


def _where(df: DataFrame, asked: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, asked)) if asked else df


def filter_summaries(df: DataFrame, f: Facets) -> DataFrame:
    """Facets, and a text found in name and description put together, where it may span both."""
    asked = _facets(f)
    if f.text:
        joined = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
        asked.append(F.contains(F.lower(joined), F.lit(f.text.lower())))
    return _where(df, asked)


def prefiltered(view: DataFrame, f: Facets) -> DataFrame:
    """Cards of a Parquet view that may be hits: only what a scan can tell by plain columns, so never fewer than the hits.

    As text patterns, ``%`` and ``_`` of the text match anything; ``search`` tells exactly.
    """
    asked = [F.col(c) == v for c, v in (("domain", f.domain), ("license", f.license)) if v is not None]
    if f.min_count is not None:
        asked.append(F.col("expression_count") >= f.min_count)
    if f.max_count is not None:
        asked.append(F.col("expression_count") <= f.max_count)
    if f.text:
        like = f"%{f.text.lower()}%".replace("\\", "_")
        asked.append(F.lower("name").like(like) | F.lower(F.coalesce("description", F.lit(""))).like(like))
    return _where(view, asked)


def search_accelerated(view: DataFrame, f: Facets) -> DataFrame:
    """``search`` behind ``prefiltered``: the same hits."""
    return search(prefiltered(view, f), f)


def search(cards: DataFrame, f: Facets) -> DataFrame:
    """Cards with a score: 2 for the text in the name, 1 in the description, and a half each for a count, metrics and rounds."""
    asked = _facets(f)
    in_name, in_description = (_has(c, f.text) if f.text else F.lit(False) for c in ("name", "description"))
    if f.text:
        asked.append(in_name | in_description)
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    score = (
        F.when(in_name, 2.0).otherwise(0.0) + F.when(in_description, 1.0).otherwise(0.0)
        + half(F.col("expression_count").isNotNull()) + half(F.coalesce(F.size("quality_metrics") > 0, F.lit(False))) + half(F.col("annotation_rounds").isNotNull())
    )
    return _where(cards, asked).withColumn("score", score).orderBy(F.desc("score"), "name")


def card(corpora: DataFrame) -> DataFrame:
    """Cards: summaries with rounds, method, redundancy and metrics of the annotation design, in one projection."""
    design = "annotationDesign"
    extra = {
        "annotation_rounds": F.col(f"{design}.rounds"), "adjudication_method": F.col(f"{design}.adjudication.method"), "redundancy_count": F.col(f"{design}.redundancy.count"),
        "quality_metrics": F.transform(f"{design}.qualityCriteria", lambda x: x["metric"]),
    }
    return corpora.select(*summary_columns(), *(c.alias(n) for n, c in extra.items()))


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by aggregation (no sort of whole groups)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def discover(parts: list[DataFrame], key: str = "uri") -> DataFrame:
    """The union of several actors' datasets; of one uri, the first actor's."""
    numbered = [p.withColumn("actor_no", F.lit(k)) for k, p in enumerate(parts)]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered), key, ["actor_no"]).drop("actor_no")


def using_ontology(cards: DataFrame, ontology: str) -> DataFrame:
    return cards.filter(F.array_contains("ontology_refs", ontology))


def linking(rows: DataFrame, field: str, target: str, **equal) -> DataFrame:
    """Rows whose ``field`` is ``target``, and whose other fields are as asked where asked."""
    return _where(rows, [F.col(field) == target, *[F.col(k) == v for k, v in equal.items() if v is not None]])


def contents(records: DataFrame, nsid: str = "nsid", counts: bool = True, namespace: str | None = None) -> DataFrame:
    """Collections with their counts, if these are asked for, and whether they belong to a dataset."""
    found = records.groupBy(nsid).agg(F.count(F.lit(1)).alias("n")) if counts else records.select(nsid).distinct()
    return found.withColumn("dataset_like", F.coalesce(kind_of(nsid, namespace).isin(*DATASET_KINDS), F.lit(False)))


def list_datasets(records: DataFrame, actor: str, schema: T.StructType, f: Facets | None = None, namespace: str | None = None) -> DataFrame:
    """Summaries of an actor's corpora that the facets let through, from ``uri, value`` (JSON); what cannot be read is left out."""
    corpora = _corpora(records.filter(authority_of("uri") == actor), schema, namespace)
    found = summary(corpora).withColumn("did", F.lit(actor))
    return filter_summaries(found, f) if f else found


def _corpora(records: DataFrame, schema: T.StructType, namespace: str | None) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = records.filter(kind_of(nsid_of("uri"), namespace) == "corpus.corpus").select("uri", read.alias("r"))
    return rows.filter("r is not null and r._bad is null").select("uri", *(F.col(f"r.{c.name}") for c in schema))


def discovered(records: DataFrame, schema: T.StructType, endpoint: str, now: Column, handles: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """A card for each corpus in crawled ``uri, value`` (JSON) rows, with where and when it was found; nothing is written.

    ``handles`` has ``did, handle``.  Works on streams as it does on tables.
    """
    cards = card(_corpora(records, schema, namespace)).withColumn("source_did", authority_of("uri")).withColumn("source_endpoint", F.lit(endpoint)).withColumn("discovered_via", F.lit("crawl"))
    if handles is not None:
        cards = cards.join(handles.select(F.col("did").alias("source_did"), F.nullif("handle", F.lit("")).alias("source_handle")), "source_did", "left")
    return cards.withColumn("first_seen_at", now).withColumn("last_updated_at", now)


def merge_cards(index: DataFrame, crawled: DataFrame, muted: DataFrame, fields: list[str], now) -> DataFrame:
    """The index after a crawl, with ``change``: inserted, updated, unchanged or kept.

    Muted datasets are not taken up.  A card is only written if its content differs;
    the time it was first seen stays.
    """
    fresh = keep_first(crawled.join(muted.select("uri").distinct(), "uri", "left_anti"), "uri", fields)
    old = index.select("uri", F.struct(*fields).alias("_old"), "first_seen_at", "last_updated_at")
    both = old.join(fresh.select("uri", F.struct(*fields).alias("_new")), "uri", "full_outer")
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    written = F.col("change").isin("inserted", "updated")
    return both.withColumn("change", change).select(
        "uri", *[F.coalesce(F.col("_new"), F.col("_old"))[f].alias(f) for f in fields],
        F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(written, now).otherwise(F.col("last_updated_at")).alias("last_updated_at"), "change",
    )


def new_cards(cards: DataFrame, index: DataFrame, muted: DataFrame) -> DataFrame:
    return cards.join(muted, "uri", "left_anti").join(index, "uri", "left_anti")


def merge_sources(built_in: DataFrame, own: DataFrame, fields: list[str]) -> DataFrame:
    """Built-in sources with the user's values over them by name, in order; new ones behind."""
    a = built_in.select("name", "ord", F.struct(*fields).alias("_a"))
    b = own.select("name", F.col("ord").alias("_own"), F.struct(*fields).alias("_b"))
    joined = a.join(b, "name", "full_outer")
    return joined.orderBy(F.col("ord").isNull(), F.coalesce("ord", "_own")).select("name", *[F.coalesce(F.col(f"_b.{f}"), F.col(f"_a.{f}")).alias(f) for f in fields])


def rank_in_group(df: DataFrame, group: str, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


class CardIndex:
    """Dataset cards, mutes, stream cursors and crawl states as records of a version store, by name of what they are about."""

    def __init__(self, store: VersionStore, fields: T.StructType):
        self.store, self.fields = store, fields

    def _uri(self, uri: Column | str, kind: str) -> Column:
        return card_uri(uri, f"index.{kind}")

    def _rows(self, kind: str, ref: str | None = None) -> DataFrame:
        return self.store.state(ref).filter(nsid_of("uri") == f"index.{kind}")

    def _write(self, df: DataFrame, kind: str, message: str, gone: bool = False) -> str:
        value = F.lit(None).cast("string") if gone else F.to_json(F.struct(*df.columns))
        rows = df.select(self._uri("uri", kind).alias("uri"), value.alias("value"), F.lit(gone).alias("is_tombstone"), F.lit(0).alias("ord"))
        return self.store.commit(rows, message)

    def cards(self, ref: str | None = None) -> DataFrame:
        """All cards, by their corpus's uri."""
        return self._rows("card", ref).select(F.from_json("value", self.fields).alias("c")).select("c.*").orderBy("uri")

    def put(self, cards: DataFrame) -> str:
        return self._write(cards.select(*self.fields.names), "card", "put cards")

    def get(self, uri: str) -> DataFrame:
        return self.cards().filter(F.col("uri") == uri)

    def remove(self, uri: str) -> bool:
        """Whether there was a card to remove."""
        found = self.get(uri)
        return not found.isEmpty() and bool(self._write(found.select("uri"), "card", f"remove {uri}", gone=True))

    def mute(self, cards: DataFrame, now: Column) -> None:
        """Take the cards out of the index and remember their datasets, which crawls then pass over."""
        known = cards.select("uri").join(self.cards().select("uri"), "uri", "left_semi")
        self._write(known, "card", "mute", gone=True)
        self._write(cards.select("uri", "name", now.alias("muted_at")), "muted", "mute")

    def unmute(self, uri: str) -> bool:
        """Whether it was muted."""
        found = self.muted().filter(F.col("uri") == uri)
        return not found.isEmpty() and bool(self._write(found.select("uri"), "muted", f"unmute {uri}", gone=True))

    def muted(self) -> DataFrame:
        return self._rows("muted").select(F.from_json("value", "uri string, name string, muted_at timestamp").alias("m")).select("m.*").orderBy("uri")

    def is_muted(self, uri: str) -> bool:
        return not self.muted().filter(F.col("uri") == uri).isEmpty()

    def note(self, kind: str, name: str, value: str) -> str:
        """Keep a stream's cursor or a crawl's state (JSON) under its endpoint or repository."""
        rows = self.store.spark.createDataFrame([(name, value)], "uri string, note string")
        return self._write(rows, kind, f"{kind} of {name}")

    def noted(self, kind: str, name: str) -> str | None:
        key = self.store.spark.range(1).select(self._uri(F.lit(name), kind).alias("uri"))
        found = self._rows(kind).join(key, "uri", "left_semi").select(F.get_json_object("value", "$.note").alias("note")).first()
        return found.note if found else None

    def diff_cards(self, base: str, head: str) -> DataFrame:
        """``uri, status`` of the corpora whose cards differ; a card that the index no longer has is told by its own uri."""
        found = diff(self._rows("card", base), self._rows("card", head)).select(F.col("uri").alias("_card"), "status")
        names = self.cards().select("uri", self._uri("uri", "card").alias("_card"))
        return found.join(names, "_card", "left").select(F.coalesce("uri", "_card").alias("uri"), "status")
