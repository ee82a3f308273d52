"""Queries of the record graph, search and list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.partitioning import spread
from corpuslake.operators import corpus, discovery
from corpuslake.plans import mapping, service
from corpuslake.plans.registry import query, table
from corpuslake.sources.knowledge import KnowledgeBase

E, M, L = mapping.EXPRESSIONS, mapping.MEMBERSHIPS, mapping.LAYERS


@query("scope_semi", f"WITH e AS ({E}), m AS ({M}) SELECT uri, lang FROM e WHERE uri IN (SELECT \"expressionRef\" FROM m WHERE \"corpusRef\" = 'at://docs/corpus/src3')")
def scope_semi(spark, d):
    return corpus.scoped(mapping.expressions(spark, d), mapping.memberships(spark, d), "at://docs/corpus/src3").select("uri", "lang")


@query("scope_fallback", f"SELECT uri, lang FROM ({E})")
def scope_fallback(spark, d):
    """A corpus without members holds every expression."""
    return corpus.scoped(mapping.expressions(spark, d), mapping.memberships(spark, d), "at://docs/corpus/none").select("uri", "lang")


@query("split_dev", f"WITH e AS ({E}), m AS ({M}) SELECT uri, lang FROM e WHERE uri IN (SELECT \"expressionRef\" FROM m WHERE split = 'dev')")
def split_dev(spark, d):
    return corpus.split(mapping.expressions(spark, d), mapping.memberships(spark, d), "dev").select("uri", "lang")


@query("splits_distinct", f"SELECT DISTINCT split FROM ({M}) ORDER BY split")
def splits_distinct(spark, d):
    return corpus.splits(mapping.memberships(spark, d))


@query("layers_by_subkind", f"SELECT uri, value FROM ({L}) WHERE kind = 'document-tag' AND subkind = 'toxic'")
def layers_by_subkind(spark, d):
    return corpus.annotation_layers(mapping.layers(spark, d), "document-tag", "toxic").select("uri", "value")


@query("with_annotations_counts", f"""WITH e AS ({E}), l AS ({L}) SELECT e.uri, count(l.uri) AS n_layers, coalesce(string_agg(l.subkind || '=' || l.value, ',' ORDER BY l.ord), '') AS tags
FROM e LEFT JOIN l ON l.expression = e.uri GROUP BY e.uri""")
def with_annotations_counts(spark, d):
    grouped = corpus.with_annotations(mapping.expressions(spark, d).select("uri"), mapping.layers(spark, d), ["subkind", "value"])
    tags = F.array_join(F.transform("layers", lambda x: F.concat(x["subkind"], F.lit("="), x["value"])), ",")
    return grouped.select("uri", F.size("layers").cast("long").alias("n_layers"), tags.alias("tags"))


@query("with_media_left", "SELECT 'o' || o_orderkey AS uri, c_name AS media_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 != 0")
def with_media_left(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uri"), F.concat(F.lit("c"), "o_custkey").alias("mediaRef"))
    media = table(spark, d, "customer").filter("c_custkey % 3 != 0").select(F.concat(F.lit("c"), "c_custkey").alias("uri"), F.col("c_name").alias("name"))
    return corpus.with_media(o, media, ["name"]).select("uri", "media_name")


def _item_records(spark, d):
    value = F.to_json(F.struct(F.concat(F.lit("at://shop/part/"), "l_partkey").alias("part"), F.struct(F.concat(F.lit("at://shop/supplier/"), "l_suppkey").alias("ref")).alias("by"), F.concat(F.lit("at://shop/part/"), "l_partkey").alias("again"), F.lit("plain").alias("note")))
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select(F.concat(F.lit("at://shop/item/"), "l_orderkey", F.lit("-"), "l_linenumber").alias("uri"), value.alias("value"))


@query("refs_of", """SELECT 'at://shop/item/' || l_orderkey || '-' || l_linenumber AS src, 'at://shop/part/' || l_partkey AS dst, CAST(0 AS BIGINT) AS ref_ord FROM lineitem
UNION ALL SELECT 'at://shop/item/' || l_orderkey || '-' || l_linenumber, 'at://shop/supplier/' || l_suppkey, CAST(1 AS BIGINT) FROM lineitem""")
def refs_of(spark, d):
    return corpus.references(_item_records(spark, d))


@query("backrefs", "SELECT DISTINCT 'at://shop/item/' || l_orderkey || '-' || l_linenumber AS src FROM lineitem WHERE l_partkey = 17")
def backrefs(spark, d):
    return corpus.backrefs(corpus.references(_item_records(spark, d)), "at://shop/part/17")


@query("closure_recursive", """WITH RECURSIVE edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
walk(uri) AS (SELECT 'o' || o_orderkey FROM orders UNION SELECT dst FROM walk JOIN edges ON src = uri) SELECT DISTINCT uri FROM walk""")
def closure_recursive(spark, d):
    """What all orders lead to."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    edges = o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst")).unionAll(c.select(name("c", "c_custkey"), name("n", "c_nationkey"))).unionAll(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    known = edges.select(F.col("src").alias("uri")).unionAll(edges.select("dst")).distinct()
    return corpus.closure(spark, edges, o.select(name("o", "o_orderkey").alias("uri")), known)


@query("type_counts", "SELECT event_type AS nsid, count(*) AS n FROM events GROUP BY event_type")
def type_counts(spark, d):
    return corpus.type_counts(table(spark, d, "events").select(F.col("event_type").alias("nsid")))


@query("inspect_rollup", "SELECT event_type AS nsid, count(*) AS n FROM events GROUP BY ROLLUP(event_type)")
def inspect_rollup(spark, d):
    return corpus.inspect_counts(table(spark, d, "events").select(F.col("event_type").alias("nsid")))


@query("related_records", "SELECT 'at://shop/order/' || o_orderkey AS uri FROM orders WHERE o_custkey = 7")
def related_records(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("at://shop/order/"), "o_orderkey").alias("uri"), F.lit("order").alias("nsid"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cust"))).alias("value"))
    return corpus.related(o, "order", "cust", "7").select("uri")


@query("latest_upsert", """SELECT user_id AS uri, min(event_id) AS ord, arg_max(event_type, event_id) AS action, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def latest_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("ord"), F.col("event_type").alias("action"), "value")
    return corpus.latest(e)


def _cards(spark, d):
    docs = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("expression_count"), F.min("doc_id").alias("first"))
    name = F.concat("source", F.lit(" "), "lang", F.lit(" corpus"))
    description = F.when(F.col("first") % 2 == 0, F.concat(F.lit("texts in "), "lang", F.lit(" from "), "source"))
    return docs.select(
        F.concat(F.lit("at://cards/"), "source", F.lit("/"), "lang").alias("uri"), name.alias("name"), description.alias("description"), F.lit(None).cast("string").alias("domain"),
        F.col("lang").alias("language"), F.array("lang").alias("languages"), "expression_count", F.when(F.col("first") % 3 == 0, F.lit(2)).alias("annotation_rounds"),
        F.when(F.col("first") % 5 == 0, F.array(F.lit("kappa"))).alias("quality_metrics"),
    )


_CARDS = """SELECT 'at://cards/' || source || '/' || lang AS uri, source || ' ' || lang || ' corpus' AS name, CASE WHEN min(doc_id) % 2 = 0 THEN 'texts in ' || lang || ' from ' || source END AS description,
  lang AS language, count(*) AS expression_count, CASE WHEN min(doc_id) % 3 = 0 THEN 2 END AS annotation_rounds, min(doc_id) % 5 = 0 AS has_metrics FROM documents GROUP BY source, lang"""


@query("search_rank", f"""WITH c AS ({_CARDS}) SELECT uri, name, CASE WHEN contains(lower(name), 'src1') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(description, '')), 'src1') THEN 1.0 ELSE 0.0 END
  + 0.5 + CASE WHEN has_metrics THEN 0.5 ELSE 0.0 END + CASE WHEN annotation_rounds IS NOT NULL THEN 0.5 ELSE 0.0 END AS score
FROM c WHERE language = 'en' AND expression_count >= 2 AND (contains(lower(name), 'src1') OR contains(lower(coalesce(description, '')), 'src1'))""")
def search_rank(spark, d):
    found = discovery.search(_cards(spark, d), discovery.Facets(text="SRC1", language="en", min_count=2))
    return found.select("uri", "name", F.col("score").cast("double").alias("score"))


@query("filter_summary", f"SELECT uri, name FROM ({_CARDS}) WHERE contains(lower(name || ' ' || coalesce(description, '')), 'corpus texts in') AND expression_count <= 40")
def filter_summary(spark, d):
    """The text is found across the seam of name and description."""
    return discovery.filter_summaries(_cards(spark, d), discovery.Facets(text="corpus texts in", max_count=40)).select("uri", "name")


@query("dedup_keep_first", "SELECT text_key, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM (SELECT md5(text) AS text_key, doc_id, source FROM documents) GROUP BY text_key")
def dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return discovery.keep_first(docs, "text_key", ["doc_id"]).select("text_key", "doc_id", "source")


@query("discover_union", "SELECT uri, min(actor) AS actor FROM (SELECT 'n' || s_nationkey AS uri, 'a' AS actor FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'b' FROM customer) GROUP BY uri")
def discover_union(spark, d):
    parts = [table(spark, d, t).select(F.concat(F.lit("n"), k).alias("uri"), F.lit(a).alias("actor")) for t, k, a in (("supplier", "s_nationkey", "a"), ("customer", "c_nationkey", "b"))]
    return discovery.discover(parts).select("uri", "actor")


@query("contents_table", "SELECT 'shop.' || event_type AS nsid, count(*) AS n, false AS dataset_like FROM events GROUP BY event_type UNION ALL SELECT 'x.corpus.corpus', count(*), true FROM region")
def contents_table(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("shop."), "event_type").alias("nsid")).unionAll(table(spark, d, "region").select(F.lit("x.corpus.corpus")))
    return discovery.contents(e)


@query("datalinks_of_host", "SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) = (SELECT min(regexp_extract(url, '^https?://([^/]+)', 1)) FROM pages)")
def datalinks_of_host(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return pages.join(pages.agg(F.min("host").alias("host")), "host", "left_semi").select("page_id", "url")


@query("index_merge", """WITH old AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 3 != 0),
new AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 5 != 0 AND c_custkey % 7 != 0)
SELECT 'c' || coalesce(new.k, old.k) AS uri, coalesce(new.name, old.name) AS name, coalesce(new.seg, old.seg) AS seg,
  CASE WHEN new.k IS NULL THEN 'kept' WHEN old.k IS NULL THEN 'inserted' WHEN old.name = new.name AND old.seg = new.seg THEN 'unchanged' ELSE 'updated' END AS change FROM old FULL JOIN new ON old.k = new.k""")
def index_merge(spark, d):
    c = table(spark, d, "customer")
    uri = F.concat(F.lit("c"), "c_custkey").alias("uri")
    seg = F.when(F.col("c_custkey") % 4 == 0, "old").otherwise(F.col("c_mktsegment")).alias("seg")
    when = F.to_timestamp(F.lit("2024-01-01"))
    index = c.filter("c_custkey % 3 != 0").select(uri, F.col("c_name").alias("name"), seg, when.alias("first_seen_at"), when.alias("last_updated_at"))
    crawled = c.filter("c_custkey % 5 != 0").select(uri, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    muted = c.filter("c_custkey % 7 = 0").select(uri)
    return discovery.merge_cards(index, crawled, muted, ["name", "seg"], F.to_timestamp(F.lit("2024-02-01"))).select("uri", "name", "seg", "change")


@query("new_cards_anti", "SELECT p_partkey AS uri FROM part WHERE p_partkey % 2 != 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def new_cards_anti(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("uri"))
    return discovery.new_cards(p, table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("uri")), p.filter("uri % 2 = 0"))


def _memberships_as_records(spark, d):
    m = mapping.memberships(spark, d)
    return m.select(F.concat(F.lit("at://docs/corpus.membership/"), "ordinal").alias("uri"), F.lit("docs").alias("repo"), F.lit("corpus.membership").alias("kind"), F.col("ordinal").alias("ord"), F.to_json(F.struct("corpusRef", "expressionRef", "split")).alias("value"))


@query("list_memberships_page", f"SELECT 'at://docs/corpus.membership/' || ordinal AS uri, ordinal AS ord FROM ({M}) WHERE \"corpusRef\" = 'at://docs/corpus/src3' AND split = 'train' AND ordinal > 40 ORDER BY ordinal LIMIT 50")
def list_memberships_page(spark, d):
    return service.list_records(_memberships_as_records(spark, d), "corpus.listMemberships", "at://docs/corpus/src3", 50, (40,), split="train").select("uri", "ord")


@query("list_expressions_page", f"SELECT uri, ord FROM ({E}) WHERE lang = 'de' ORDER BY ord LIMIT 20")
def list_expressions_page(spark, d):
    e = mapping.expressions(spark, d)
    records = e.select("uri", F.lit("docs").alias("repo"), F.lit("expression.expression").alias("kind"), "ord", F.to_json(F.struct("id", F.col("kind"), F.array("lang").alias("languages"))).alias("value"))
    return service.list_records(records, "expression.listExpressions", "docs", 20, languages="de").select("uri", "ord")


@query("list_entries_newest", "SELECT 'at://shop/changelog.entry/' || o_orderkey AS uri, o_orderdate AS created FROM orders WHERE o_custkey = 13 ORDER BY o_orderdate DESC, uri DESC LIMIT 50")
def list_entries_newest(spark, d):
    o = table(spark, d, "orders")
    records = o.select(F.concat(F.lit("at://shop/changelog.entry/"), "o_orderkey").alias("uri"), F.lit("shop").alias("repo"), F.lit("changelog.entry").alias("kind"), F.col("o_orderdate").alias("created"), F.to_json(F.struct(F.concat(F.lit("c"), "o_custkey").alias("subject"))).alias("value"))
    return service.list_records(records, "changelog.listEntries", "c13").select("uri", "created")


@query("kb_candidates", "SELECT p1.p_brand AS name, p2.p_partkey AS id, row_number() OVER (PARTITION BY p1.p_brand ORDER BY p2.p_partkey) - 1 AS rank FROM (SELECT DISTINCT p_brand FROM part) p1 JOIN part p2 ON lower(p1.p_brand) = lower(p2.p_brand) QUALIFY rank < 10")
def kb_candidates(spark, d):
    p = table(spark, d, "part")
    kb = KnowledgeBase(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label")), p.select(F.lit(1).alias("source"), F.lit("r").alias("relation"), F.lit(1).alias("target")))
    return kb.search_many(p.select(F.col("p_brand").alias("name"))).select("name", "id", "rank")


@query("kb_neighbors", """SELECT l_partkey AS source, 'supplied-by' AS relation, l_suppkey AS target, s_name AS target_label FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
LEFT JOIN supplier ON l_suppkey = s_suppkey QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) <= 100""")
def kb_neighbors(spark, d):
    """Up to a hundred neighbours, as many as the connector gives, of every part."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lit("supplied-by").alias("relation"), F.col("l_suppkey").alias("target")).distinct()
    return KnowledgeBase(s, edges).neighbors(table(spark, d, "part").select(F.col("p_partkey").alias("id"))).select("source", "relation", "target", "target_label")
