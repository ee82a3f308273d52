"""Queries of loading, changelog entries, discovery, anchors, record pages and the engine's own SQL spellings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import builders
from corpuslake.functions.anchors import ANCHOR, anchor_of, flatten_anchor
from corpuslake.operators import analytics, corpus, discovery, flatten, media, versions, views
from corpuslake.operators.dataset import Dataset
from corpuslake.plans.mapping import orders_json
from corpuslake.plans.queries_sql import both
from corpuslake.plans.queries_versions import _BOTH, _CHANGES
from corpuslake.plans.registry import query, table
from corpuslake.sources import records as record_source

# -- loading and views ------------------------------------------------------------------------------------------------


def _shop(spark, d):
    """Corpora of nations, whose memberships name customers' texts; orders name their customer."""
    uri = lambda who, kind, key: F.concat(F.lit(f"at://{who}/x.y.{kind}/"), F.col(key).cast("string"))
    row = lambda u, **fields: (u.alias("uri"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    host = F.concat(F.lit("at://n"), F.col("n_nationkey") % 5, F.lit("/x.y.corpus.corpus/"), "n_nationkey")
    corpora = n.select(*row(host, name=F.col("n_name")))
    owner = F.concat(F.lit("at://n"), F.col("c_nationkey") % 5)
    members = c.select(*row(F.concat(owner, F.lit("/x.y.corpus.membership/"), "c_custkey"), corpusRef=F.concat(owner, F.lit("/x.y.corpus.corpus/"), "c_nationkey"), expressionRef=uri("texts", "expression.expression", "c_custkey")))
    texts = c.filter("c_custkey % 3 != 0").select(*row(uri("texts", "expression.expression", "c_custkey"), text=F.col("c_name"), mediaRef=uri("media", "media.media", "c_nationkey")))
    others = o.select(*row(uri("orders", "segmentation.segmentation", "o_orderkey"), expression=uri("texts", "expression.expression", "o_custkey")))
    clips = n.select(*row(uri("media", "media.media", "n_nationkey"), kind=F.lit("audio"))).unionAll(n.select(*row(uri("n1", "shop.receipt", "n_nationkey"), kind=F.lit("no kind of record"))))
    return corpora.unionAll(members).unionAll(texts).unionAll(others).unionAll(clips)


_LOADED = """WITH m AS (SELECT * FROM customer WHERE c_nationkey % 5 = 1) SELECT 'at://n1/x.y.corpus.corpus/' || n_nationkey AS uri FROM nation WHERE n_nationkey % 5 = 1
UNION ALL SELECT 'at://n1/x.y.corpus.membership/' || c_custkey FROM m"""


@query("corpus_load", f"{_LOADED} UNION ALL SELECT 'at://texts/x.y.expression.expression/' || c_custkey FROM m WHERE c_custkey % 3 != 0 UNION ALL SELECT DISTINCT 'at://media/x.y.media.media/' || c_nationkey FROM m WHERE c_custkey % 3 != 0")
def corpus_load(spark, d):
    """A corpus's own authority and what it leads to, over two others."""
    return corpus.load(_shop(spark, d), "at://n1/x.y.corpus.corpus/1", namespace="x.y").select("uri")


@query("corpus_load_alone", _LOADED)
def corpus_load_alone(spark, d):
    return corpus.load(_shop(spark, d), "at://n1/x.y.corpus.corpus/1", follow=False, namespace="x.y").select("uri")


@query("record_groups", "SELECT 'x.y.corpus.membership' AS nsid, count(*) AS n, min('at://n' || c_nationkey % 5 || '/x.y.corpus.membership/' || c_custkey) AS first FROM customer")
def record_groups(spark, d):
    return corpus.by_nsid(_shop(spark, d)).filter("nsid = 'x.y.corpus.membership'").select("nsid", F.size("uris").cast("long").alias("n"), F.element_at("uris", 1).alias("first"))


@query("records_decoded", "SELECT 'u' || c_custkey AS uri, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'no name' WHEN c_custkey % 11 = 0 THEN 'not valid JSON of this type' END AS error FROM customer")
def records_decoded(spark, d):
    """Customers as sent records; some lack their name, some are cut off."""
    k = F.col("c_custkey")
    value = F.when(k % 7 == 0, F.lit('{"$type":"x"}')).when(k % 11 == 0, F.lit('{"name":')).otherwise(F.to_json(F.struct(F.col("c_name").alias("name"))))
    rows = table(spark, d, "customer").select(F.concat(F.lit("u"), k).alias("uri"), F.lit("c").alias("cid"), value.alias("value"), F.col("c_name").alias("own"))
    good, bad = record_source.decode(rows.drop("own"), T.StructType([T.StructField("name", T.StringType())]), ["name"])
    found = good.select("uri", F.lit(None).cast("string").alias("error")).unionAll(bad.select("uri", "error"))
    return found.join(rows.select("uri", F.col("own").alias("name")), "uri").select("uri", "name", "error")


@query("view_by_kind", "SELECT 'at://texts/x.y.expression.expression/' || c_custkey AS uri, c_name AS text FROM customer WHERE c_custkey % 3 != 0")
def view_by_kind(spark, d):
    nsid = "x.y.expression.expression"
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("languages", T.ArrayType(T.StringType()))])
    return flatten.views_by_kind(_shop(spark, d), [nsid], {nsid: schema})["x_y_expression_expression"].select("uri", "text")


@query("layer_exploded", """SELECT 'o' || l_orderkey AS layer_uri, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS BIGINT) AS annotation_index, 'span' AS layer_kind, l_returnflag AS label, 'textSpan' AS anchor_kind FROM lineitem""")
def layer_exploded(spark, d):
    i = table(spark, d, "lineitem")
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in ANCHOR.fields[1:]]
    at = F.col("l_linenumber").cast("long")
    span = F.struct(at.alias("byteStart"), (at + 1).alias("byteEnd"), at.alias("charStart"), at.alias("charEnd")).alias("textSpan")
    element = F.struct("l_linenumber", F.struct(F.struct(span, *null).alias("anchor"), F.col("l_returnflag").alias("label"), F.lit(None).cast("string").alias("value")).alias("a"))
    own = i.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(element)), lambda x: x["a"]).alias("annotations"))
    layers = own.select(F.concat(F.lit("o"), "l_orderkey").alias("uri"), F.lit("span").alias("kind"), F.lit(None).cast("string").alias("subkind"), "annotations")
    return flatten.explode_layer(layers).select("layer_uri", "annotation_index", "layer_kind", "label", "anchor_kind")


@query("anchors_from_json", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'span' WHEN 1 THEN 'tokenRef' WHEN 2 THEN 'page' END AS anchor_kind, CASE WHEN event_id % 4 = 0 THEN event_id // 2 END AS byte_start,
  CASE WHEN event_id % 4 = 1 THEN 't' || event_id END AS token_id, CASE WHEN event_id % 4 = 2 THEN event_id END AS page FROM events""")
def anchors_from_json(spark, d):
    """Anchors as they are sent: fractions are cut off, truth values are no numbers, ids come bare or wrapped."""
    e, k = table(spark, d, "events"), F.col("event_id")
    text = F.concat(F.lit('{"textSpan":{"byteStart":'), (k / 2).cast("decimal(20,1)"), F.lit(',"byteEnd":true}}'))
    token = F.concat(F.lit('{"tokenRef":{"tokenizationId":'), F.when(k % 8 == 1, F.concat(F.lit('"t'), k, F.lit('"'))).otherwise(F.concat(F.lit('{"value":"t'), k, F.lit('"}'))), F.lit(',"tokenIndex":3}}'))
    page = F.concat(F.lit('{"pageAnchor":{"page":'), k, F.lit("}}"))
    value = F.when(k % 4 == 0, text).when(k % 4 == 1, token).when(k % 4 == 2, page).otherwise(F.lit('"nothing"'))
    flat = e.select("event_id", anchor_of(value).alias("anchor")).select("event_id", *flatten_anchor())
    return flat.select("event_id", "anchor_kind", "byte_start", "token_id", "page")


# -- changelogs and publishing ----------------------------------------------------------------------------------------

_ENTRIES = f"""{_CHANGES}, s AS (SELECT uri, any_value(CASE WHEN c0 IS NULL THEN 'added' WHEN c1 IS NULL THEN 'removed' ELSE 'changed' END) AS record_change FROM x WHERE status != 'unchanged' GROUP BY uri)
, en AS (SELECT uri AS subject, record_change, CASE record_change WHEN 'removed' THEN 'major' WHEN 'added' THEN 'minor' ELSE 'patch' END AS level FROM s)"""


def _entries(spark, d):
    base, head = orders_json(spark, d), orders_json(spark, d, True)
    found = versions.diff(base, head)
    known = base.filter("uri like '%0'").select(F.col("uri").alias("subject"), F.lit("1.2.3").alias("version"))
    return versions.entries(found, versions.field_changes(found), known)


@query("changelog_entries", f"""{_ENTRIES} SELECT subject, record_change, level, CASE WHEN subject LIKE '%0' AND record_change != 'added' THEN CASE level WHEN 'major' THEN '2.0.0' ELSE '1.2.4' END
  ELSE CASE level WHEN 'major' THEN '1.0.0' WHEN 'minor' THEN '0.1.0' ELSE '0.0.1' END END AS version FROM en""")
def changelog_entries(spark, d):
    return _entries(spark, d).select("subject", "record_change", "level", "version")


@query("record_change_lists", f"{_CHANGES}, n AS (SELECT uri, count(*) AS n, string_agg(field_path, ',' ORDER BY field_path) AS fields FROM ch GROUP BY uri) SELECT x.uri, x.status AS record_change, coalesce(n, 0) AS n, coalesce(fields, '') AS fields FROM x LEFT JOIN n ON x.uri = n.uri")
def record_change_lists(spark, d):
    found = versions.record_changes(orders_json(spark, d), orders_json(spark, d, True), unchanged=True)
    return found.select("uri", "record_change", F.size("changes").cast("long").alias("n"), F.array_join(F.transform("changes", lambda c: c["field_path"]), ",").alias("fields"))


@query("span_overlay", """SELECT p_partkey AS sentence, CASE k WHEN 0 THEN 0 ELSE length(w[1]) + 1 END AS lo, CASE k WHEN 0 THEN length(p_name) ELSE length(p_name) END AS hi, CASE k WHEN 0 THEN 'whole' ELSE 'last' END AS label, CAST(CASE k WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS lane
FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w, unnest([0, 1]) AS k FROM part) WHERE len(w) = 2""")
def span_overlay(spark, d):
    """Names of two words: an annotation of both, and one of the second."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sentence"), F.col("p_name").alias("text"), F.split("p_name", " ").alias("w")).filter("size(w) = 2")
    first = F.length(F.col("w")[0])
    words = p.select("sentence", F.inline(F.array(F.struct(F.lit(0).alias("token_index"), F.lit(0).alias("byte_start"), first.alias("byte_end")), F.struct(F.lit(1).alias("token_index"), (first + 1).alias("byte_start"), F.length("text").alias("byte_end")))))
    rows = F.array(F.struct(F.lit(0).alias("annotation_index"), F.array(F.lit(0), F.lit(1)).alias("token_indexes"), F.lit("whole").alias("label")), F.struct(F.lit(1).alias("annotation_index"), F.array(F.lit(1)).alias("token_indexes"), F.lit("last").alias("label")))
    annotations = p.select("sentence", F.inline(rows), F.lit(None).cast("int").alias("byte_start"), F.lit(None).cast("int").alias("byte_end"))
    return analytics.span_overlay(annotations, words, p)


@query("changelog_subject", "SELECT 'at://shop/sales.order/35' AS subject, 'changed' AS record_change, 'patch' AS level, '3.1.1' AS version")
def changelog_subject(spark, d):
    return versions.generate_entry(orders_json(spark, d), orders_json(spark, d, True), "at://shop/sales.order/35", "3.1.0").select("subject", "record_change", "level", "version")


@query("changelog_own_rule", f"{_ENTRIES} SELECT subject, CASE record_change WHEN 'added' THEN 'patch' ELSE 'major' END AS level FROM en")
def changelog_own_rule(spark, d):
    found = versions.diff(orders_json(spark, d), orders_json(spark, d, True))
    rule = lambda told: F.when(F.col("status") == "added", "patch").otherwise("major")
    return versions.entries(found, versions.field_changes(found), rule=rule).select("subject", "level")


_OPS = f"""{_BOTH}, p AS (SELECT CASE status WHEN 'added' THEN 'create' WHEN 'removed' THEN 'delete' ELSE 'update' END AS action, uri, 3 AS tier FROM x WHERE status != 'unchanged'),
q AS (SELECT 'create', 'at://shop/x.changelog.entry/' || split_part(uri, '/', 5) || CASE status WHEN 'added' THEN '.0.1.0' WHEN 'removed' THEN '.1.0.0' ELSE '.0.0.1' END, 4 FROM x WHERE status != 'unchanged')"""


@query("publish_augmented", f"{_OPS}, u AS (SELECT * FROM p UNION ALL SELECT * FROM q) SELECT action, uri, tier, row_number() OVER (ORDER BY action != 'delete', CASE WHEN action = 'delete' THEN -tier ELSE tier END, uri) - 1 AS place FROM u")
def publish_augmented(spark, d):
    """A publish plan with an entry of the changelog for each of its records."""
    base, head = orders_json(spark, d), orders_json(spark, d, True)
    cid = lambda df: df.select("uri", F.sha2("value", 256).alias("cid"))
    none = spark.createDataFrame([], "subject string, version string")
    return versions.augment(versions.plan_publish(cid(head), cid(base)), base, head, none, "shop", "x.changelog.entry").select("action", "uri", "tier", "place")


@query("wire_values", "SELECT 'at://shop/sales.order/' || o_orderkey AS uri, '{\"$type\":\"sales.order\",\"cust\":' || o_custkey || ',\"status\":\"' || o_orderstatus || '\",\"price\":\"' || printf('%.2f', round(o_totalprice, 2)) || '\"}' AS value FROM orders WHERE o_orderkey % 11 != 4")
def wire_values(spark, d):
    return orders_json(spark, d).select("uri", versions.wire_value("value", F.lit("sales.order")).alias("value"))


@query("references_filled", "SELECT 'o' || o_orderkey AS uri, '{\"to\":\"at://shop/customer/' || o_custkey || '\",\"plain\":\"pending\"}' AS value FROM orders")
def references_filled(spark, d):
    """Orders that refer to customers by pending names."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uri"), F.concat(F.lit('{"to":"pending:c'), "o_custkey", F.lit('","plain":"pending"}')).alias("value"))
    known = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.concat(F.lit("at://shop/customer/"), "c_custkey").alias("uri"))
    return builders.with_references(o, known)


# -- discovery --------------------------------------------------------------------------------------------------------

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _WHOLE = T.StringType(), T.IntegerType()
CORPUS = _struct(
    name=_TEXT, description=_TEXT, domain=_TEXT, language=_TEXT, languages=T.ArrayType(_TEXT), licensing=_struct(expression=_TEXT, licenses=T.ArrayType(_struct(spdx=_TEXT))), expressionCount=T.LongType(),
    annotationDesign=_struct(rounds=_WHOLE, adjudication=_struct(method=_TEXT), redundancy=_struct(count=_WHOLE), qualityCriteria=T.ArrayType(_struct(metric=_TEXT))),
)


def _corpora(spark, d):
    """Customers as corpora of their nation; some are cut off."""
    k = F.col("c_custkey")
    value = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("domain"), F.array(F.when(k % 2 == 0, "en").otherwise("de"), F.lit("fr")).alias("languages"),
        F.struct(F.when(k % 3 == 0, "CC-BY-4.0").otherwise("").alias("expression"), F.array(F.struct(F.lit("MIT").alias("spdx"))).alias("licenses")).alias("licensing"), k.alias("expressionCount"),
        F.when(k % 5 == 0, F.struct(F.lit(2).alias("rounds"), F.struct(F.lit("vote").alias("method")).alias("adjudication"), F.array(F.struct(F.lit("kappa").alias("metric"))).alias("qualityCriteria"))).alias("annotationDesign"),
    )
    text = F.when(k % 13 == 0, F.lit('{"name":')).otherwise(F.to_json(value))
    return table(spark, d, "customer").select(F.concat(F.lit("at://n"), "c_nationkey", F.lit("/x.y.corpus.corpus/"), k).alias("uri"), text.alias("value"))


_SUMMARY = """SELECT 'at://n' || c_nationkey || '/x.y.corpus.corpus/' || c_custkey AS uri, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'de' END AS language,
  CASE WHEN c_custkey % 3 = 0 THEN 'CC-BY-4.0' ELSE 'MIT' END AS license, c_custkey % 5 = 0 AS has_adjudication"""


@query("actor_datasets", f"{_SUMMARY} FROM customer WHERE c_custkey % 13 != 0 AND c_nationkey = 3 AND c_custkey >= 20")
def actor_datasets(spark, d):
    found = discovery.list_datasets(_corpora(spark, d), "n3", CORPUS, discovery.Facets(language="fr", min_count=20), "x.y")
    return found.select("uri", "name", "language", "license", "has_adjudication")


@query("cards_discovered", f"{_SUMMARY}, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS annotation_rounds, CASE WHEN c_custkey % 5 = 0 THEN 'vote' END AS adjudication_method, 'n' || c_nationkey AS source_did, n_name AS source_handle FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 != 0")
def cards_discovered(spark, d):
    handles = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("did"), F.col("n_name").alias("handle"))
    found = discovery.discovered(_corpora(spark, d), CORPUS, "https://host", F.to_timestamp(F.lit("2024-01-01")), handles, "x.y")
    return found.select("uri", "name", "language", "license", "has_adjudication", "annotation_rounds", "adjudication_method", "source_did", "source_handle")


@query("search_accelerated", """SELECT 'at://n' || c_nationkey || '/x.y.corpus.corpus/' || c_custkey AS uri, 2.5 + CASE WHEN c_custkey % 5 = 0 THEN 1.0 ELSE 0.0 END AS score FROM customer
WHERE c_custkey % 13 != 0 AND contains(lower(c_name), '1_') = false AND contains(lower(c_name), '#00') AND c_mktsegment = 'BUILDING' AND c_custkey >= 10""")
def search_accelerated(spark, d):
    cards = discovery.discovered(_corpora(spark, d), CORPUS, "https://host", F.to_timestamp(F.lit("2024-01-01")), namespace="x.y")
    return discovery.search_accelerated(cards, discovery.Facets(text="#00", domain="BUILDING", min_count=10)).select("uri", F.col("score").cast("double").alias("score"))


@query("cards_by_ontology", "SELECT p_partkey AS uri FROM part WHERE p_size % 4 = 1")
def cards_by_ontology(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("uri"), F.array(F.lit("o"), F.concat(F.lit("o"), F.col("p_size") % 4)).alias("ontology_refs"))
    return discovery.using_ontology(p, "o1").select("uri")


@query("links_of_target", "SELECT o_orderkey AS uri FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def links_of_target(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uri"), F.col("o_custkey").alias("target"), F.col("o_orderstatus").alias("kind"))
    return discovery.linking(o, "target", 7, kind="O").select("uri")


# -- anchors and record pages -----------------------------------------------------------------------------------------


def _anchor(**variant):
    return F.struct(*(variant.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANCHOR))


@query("anchors_resolved", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'text_span' WHEN 1 THEN 'page' ELSE 'external' END AS kind, CASE p_partkey % 3 WHEN 0 THEN substring(p_name, 2, 3) WHEN 1 THEN p_name ELSE 'https://x/' || p_partkey END AS resolved FROM part")
def anchors_resolved(spark, d):
    k = F.col("p_partkey") % 3
    none = F.lit(None).cast("long")
    span = F.struct(F.lit(1).cast("long").alias("byteStart"), F.lit(4).cast("long").alias("byteEnd"), none.alias("charStart"), none.alias("charEnd"))
    page = F.struct(F.lit(0).cast("long").alias("page"), F.lit(None).cast(span_type()).alias("textSpan"), F.lit(None).cast("struct<x: long, y: long, width: long, height: long>").alias("boundingBox"))
    anchor = _anchor(textSpan=F.when(k == 0, span), pageAnchor=F.when(k == 1, page), externalTarget=F.when(k == 2, F.struct(F.concat(F.lit("https://x/"), "p_partkey").alias("source"))))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), anchor.alias("anchor"))
    return media.resolve_anchors(rows, "text").select("p_partkey", "kind", "resolved")


def span_type() -> T.DataType:
    return ANCHOR["textSpan"].dataType


@query("boxes_at_time", """WITH e AS (SELECT event_id, least(greatest(event_id % 3000, 500), 1500) AS t, CASE event_id % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'step' ELSE 'cubic' END AS way FROM events)
SELECT event_id, round(CASE way WHEN 'linear' THEN t / 20.0 WHEN 'step' THEN 0.0 ELSE 100 * (3 * pow(t / 2000.0, 2) - 2 * pow(t / 2000.0, 3)) END, 6) AS x FROM e""")
def boxes_at_time(spark, d):
    """Two keyframes at 0 and 2,000 ms, a span from 500 to 1,500, and the way told by name or by a uri's end."""
    k = F.col("event_id") % 3
    way = F.when(k == 0, F.lit("other")).when(k == 1, F.lit("step")).otherwise(F.lit("https://ways/x#cubic"))
    frame = lambda t, x: F.struct(F.lit(t).cast("long").alias("timeMs"), F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("x", x), ("y", 1), ("width", 2), ("height", 3)))).alias("bbox"))
    body = F.struct(F.struct(F.lit(500).cast("long").alias("start"), F.lit(1500).cast("long").alias("ending")).alias("temporalSpan"), F.array(frame(2000, 100), frame(0, 0)).alias("keyframes"), way.alias("interpolation"))
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 3000).alias("time"), _anchor(spatioTemporalAnchor=body).alias("anchor"))
    return media.resolve_anchors(rows, "frame").select("event_id", F.round("resolved.x", 6).alias("x"))


@query("media_pages", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE 'image' END AS heading, url AS external, CASE WHEN page_id % 3 = 0 THEN 'CC0' ELSE 'MIT, BSD' END AS licensing FROM pages")
def media_pages(spark, d):
    k = F.col("page_id")
    licenses = F.array(F.struct(F.lit("MIT").alias("spdx")), F.struct(F.lit("BSD").alias("spdx")))
    rows = table(spark, d, "pages").select(
        k.alias("uri"), F.when(k % 2 == 0, F.concat(F.lit("T"), k)).otherwise("").alias("title"), F.lit("image").alias("kind"), F.lit("image/png").alias("mimeType"), F.lit(5).alias("durationMs"),
        F.col("url").alias("externalUri"), F.struct(F.when(k % 3 == 0, "CC0").otherwise("").alias("expression"), licenses.alias("licenses")).alias("licensing"),
    )
    return views.media(rows).select(F.col("uri").alias("page_id"), "heading", "external", "licensing")


@query("persona_pages", "SELECT c_custkey, c_name AS heading, c_mktsegment AS domain, 'o1, o2' AS ontologies, 'Be brief…' AS guidelines FROM customer")
def persona_pages(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("uri"), F.col("c_name").alias("name"), F.lit("").alias("description"), F.col("c_mktsegment").alias("domain"), F.lit("rater").alias("kind"), F.array(F.lit("o1"), F.lit("o2")).alias("ontologyRefs"),
        F.struct(F.lit("").alias("expression"), F.array(F.struct(F.lit("MIT").alias("spdx"))).alias("licenses")).alias("licensing"), F.lit("Be brief and kind.").alias("guidelines"),
    )
    return views.persona(rows, 9).select(F.col("uri").alias("c_custkey"), "heading", "domain", "ontologies", "guidelines")


@query("eprint_pages", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN 'raw' ELSE 'id' || doc_id END AS heading, lang || ', Ada' AS creators FROM documents")
def eprint_pages(spark, d):
    k = F.col("doc_id")
    creator = lambda literal, family, given: F.struct(literal.alias("literal"), family.alias("family"), given.alias("given"))
    none = F.lit(None).cast("string")
    citation = F.struct(F.when(k % 3 == 0, F.concat(F.lit("Title "), k)).alias("title"), F.when(k % 3 == 1, "raw").otherwise("").alias("raw"), F.array(creator(F.col("lang"), F.lit("x"), none), creator(F.lit(""), none, F.lit("Ada"))).alias("creators"), none.alias("doi"), none.alias("containerTitle"))
    rows = table(spark, d, "documents").select(k.alias("uri"), F.concat(F.lit("id"), k).alias("eprintIdentifier"), F.lit("doi").alias("eprintIdentifierType"), F.lit("cites").alias("linkType"), citation.alias("citation"))
    return views.eprint(rows).select(F.col("uri").alias("doc_id"), "heading", "creators")


@query("judgment_responses", "SELECT l_orderkey * 10 + l_linenumber AS judgment, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS VARCHAR) WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE 'free' END AS response, p_name AS item_text FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 2 = 0")
def judgment_responses(spark, d):
    n = F.col("l_linenumber")
    i = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("judgment"), F.col("l_partkey").alias("item"), F.when(n % 3 == 0, n).alias("scalarValue"), F.when(n % 3 == 1, F.col("l_returnflag")).otherwise("").alias("categoricalValue"), F.lit("free").alias("freeText"))
    texts = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("text"))
    return views.judgment_set(i, texts).select("judgment", "response", "item_text")


@query("experiment_page", "SELECT 'set' AS part, count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'report', count(*) FROM customer WHERE c_custkey = 7")
def experiment_page(spark, d):
    found = views.experiment(table(spark, d, "orders").withColumnRenamed("o_custkey", "experimentRef"), table(spark, d, "customer").withColumnRenamed("c_custkey", "experimentRef"), 7)
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("set", found["sets"]).unionAll(count("report", found["reports"]))


@query("expression_edges", "SELECT o_orderkey AS edge FROM orders WHERE o_custkey = 7")
def expression_edges(spark, d):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.struct(F.array(entry("other", F.lit("7")), entry("uds_expression", F.col("o_custkey"))).alias("entries")).alias("properties"))
    none = table(spark, d, "part").select(F.col("p_name").alias("parentRef"), F.col("p_name").alias("expression"), F.col("p_name").alias("uri"), F.col("p_name").alias("kind"), F.col("p_name").alias("subkind"), F.array("p_name").alias("annotations"))
    return views.expression(none, none, edges, "7")["edges"].select("edge")


@query("span_texts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(substring(t, 3, 20), chr(10), ' ') WHEN doc_id % 3 = 1 THEN 'token 4' ELSE 'tokens 2..9' END AS shown FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)")
def span_texts(spark, d):
    k = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t"), F.when(k == 0, F.lit(2)).alias("a"), F.when(k == 0, F.lit(22)).alias("b"), F.when(k == 1, F.array(F.lit(4))).when(k == 2, F.array(F.lit(9), F.lit(2))).alias("i"))
    return rows.select("doc_id", analytics.span_text("t", "a", "b", "i").alias("shown"))


@query("characters_of_bytes", "SELECT doc_id, length(decode(array_slice(encode(substring(t, 1, 12)), 1, 5))) AS char_start, least(length(t), 12) AS char_end FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)")
def characters_of_bytes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.substring(F.regexp_replace("text", "[^ -~]", ""), 1, 12).alias("t"), F.lit(5).alias("byte_start"), F.lit(12).alias("byte_end"))
    return analytics.char_spans(rows, "t").select("doc_id", "char_start", "char_end")


@query("frames_cropped", "SELECT event_id AS frame_id, hex(list_reduce([chr(CAST((event_id + k) % 100 AS INTEGER)) FOR k IN [9, 10, 11, 12, 13, 14]], lambda a, b: a || b)) AS pixels FROM events")
def frames_cropped(spark, d):
    """Frames of three by two pixels, cut to the last row's first two."""
    frame = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.lpad(F.hex((F.col("event_id") + k) % 100), 2, "0")), ""))
    size = {"width": 3, "height": 2, "x": 0.0, "y": 1.0, "w": 2.0, "h": 1.0}
    rows = table(spark, d, "events").select(F.col("event_id").alias("frame_id"), frame.alias("pixels"), *(F.lit(v).alias(n) for n, v in size.items()))
    return media.crop_frames(rows).select("frame_id", F.hex("cropped").alias("pixels"))


# -- datasets and SQL spellings ---------------------------------------------------------------------------------------


@query("dataset_pipeline", "SELECT p_partkey * 2 AS twice, upper(p_brand) AS brand FROM part WHERE p_size > 25 AND p_partkey % 2 = 0")
def dataset_pipeline(spark, d):
    """A condition, a predicate on rows and a function on rows."""
    ds = Dataset(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").filter("p_size > 25").filter(lambda r: r["p_partkey"] % 2 == 0)
    return ds.map(lambda r: {"twice": r["p_partkey"] * 2, "brand": r["p_brand"].upper()}, "twice long, brand string").df


_QUALIFY = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus != 'P' QUALIFY place <= 2"
both("sql_qualify", _QUALIFY)
both("sql_replace", "SELECT * EXCLUDE (c_acctbal) REPLACE (upper(c_mktsegment) AS c_mktsegment, c_nationkey + 1 AS c_nationkey) FROM customer")
both("sql_qualify_nested", f"SELECT place, count(*) AS n FROM ({_QUALIFY}) t GROUP BY place")
