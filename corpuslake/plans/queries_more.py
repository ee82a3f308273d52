"""Further queries: tokens, segmentations, media, record pages, builders, UDFs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import builders
from corpuslake.functions.anchors import anchor_bytes, anchor_tokens, flatten_anchor
from corpuslake.operators import analytics, corpus, discovery, media, views
from corpuslake.operators.dataset import Dataset
from corpuslake.operators.versions import schema_diff
from corpuslake.plans import mapping
from corpuslake.plans.registry import query, table


def _segmentations(spark, d):
    """Each part's name cut into its words, by index and byte span; every third word has its own text."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("w"))
    start = lambda i: F.aggregate(F.slice("w", 1, i), F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    token = lambda x, i: F.struct(i.cast("long").alias("tokenIndex"), F.when(i % 3 == 2, F.upper(x)).alias("text"), F.struct(start(i).cast("long").alias("byteStart"), (start(i) + F.octet_length(x)).cast("long").alias("byteEnd")).alias("textSpan"))
    tokens = F.transform("w", token)
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("expression"), F.col("p_partkey").alias("ord"), F.array(F.struct(F.lit("t").alias("uuid"), tokens.alias("tokens"))).alias("tokenizations"))


@query("tokens_surface", """SELECT 'p' || p_partkey AS expression, CAST(k AS BIGINT) AS token_index, CASE WHEN k % 3 = 2 THEN upper(w[k + 1]) ELSE w[k + 1] END AS surface
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(len(string_split(p_name, ' ')))) AS k FROM part)""")
def tokens_surface(spark, d):
    e = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.col("p_name").alias("text"))
    return analytics.tokens(_segmentations(spark, d), e).select("expression", "token_index", "surface")


@query("with_segmentation", "SELECT 'p' || p_partkey AS uri, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM part")
def with_segmentation(spark, d):
    e = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("uri"))
    return corpus.with_segmentation(e, _segmentations(spark, d).filter("ord % 2 = 0"), ["tokenizations"]).select("uri", F.size("segmentations").alias("n"))


@query("pick_tokenization", """WITH v AS (SELECT l_orderkey AS e, 't' || l_linenumber AS t, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT 'o' || e AS expression, arg_max(t, n * 100000000.0 + q * 100000 - CAST(substr(t, 2) AS BIGINT)) AS tokenization_id FROM v GROUP BY e""")
def pick_tokenization(spark, d):
    i = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("expression"), F.concat(F.lit("t"), "l_linenumber").alias("tokenization_id"), "l_quantity", "l_linenumber")
    sizes = i.groupBy("expression", "tokenization_id").agg(F.max("l_quantity").alias("n_tokens"), F.max("l_linenumber").alias("ord"))
    return analytics.pick_tokenization(i.select("expression", "tokenization_id"), sizes)


@query("anchor_accessors", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber AS BIGINT) END AS first_byte, CASE WHEN l_orderkey % 2 = 1 THEN CAST(l_linenumber AS BIGINT) END AS token,
  CASE WHEN l_orderkey % 2 = 0 THEN 'span' ELSE 'tokenRef' END AS kind FROM lineitem""")
def anchor_accessors(spark, d):
    i = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    anchors = i.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, builders.span(n, n + 3)).otherwise(builders.token_ref(F.lit("t"), n)).alias("anchor"))
    return anchors.select("l_orderkey", "l_linenumber", anchor_bytes()["byteStart"].alias("first_byte"), F.get(anchor_tokens(), F.lit(0)).alias("token"), flatten_anchor()[0].alias("kind"))


@query("resolve_tokens", "SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part")
def resolve_tokens(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), builders.token_ref(F.lit("t"), F.lit(0)).alias("anchor"))
    return p.select("p_partkey", F.get(media.resolve_token("w"), F.lit(0)).alias("word"))


@query("resolve_media", "SELECT 'm' || page_id AS uri, CASE WHEN page_id % 2 = 0 THEN 'b' || page_id ELSE url END AS address, CASE WHEN page_id % 2 = 0 THEN 'blob' ELSE 'external' END AS place FROM pages")
def resolve_media(spark, d):
    blob = F.when(F.col("page_id") % 2 == 0, F.struct(F.concat(F.lit("b"), "page_id").alias("cid"), F.lit("text/html").alias("mimeType")))
    rows = table(spark, d, "pages").select(F.concat(F.lit("m"), "page_id").alias("uri"), blob.alias("blob"), F.col("url").alias("externalUri"), F.lit(None).cast("string").alias("mimeType"))
    return media.resolve_media(rows).select("uri", "address", "place")


@query("verified_blobs", "SELECT doc_id, doc_id % 3 != 0 AS ok FROM documents")
def verified_blobs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    stored = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    return media.verified(docs.withColumn("sha256", stored)).select("doc_id", "ok")


@query("distribution_dispatch", """SELECT o_orderpriority AS task, o_orderstatus AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'ordinal' WHEN '2-HIGH' THEN 'categorical' WHEN '3-MEDIUM' THEN 'free-text' ELSE CASE o_orderstatus WHEN 'F' THEN 'ordinal' WHEN 'O' THEN 'categorical' ELSE 'free-text' END END AS kind,
count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def distribution_dispatch(spark, d):
    o = table(spark, d, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    task = F.when(p == "1-URGENT", "ordinal-scale").when(p == "2-HIGH", "preference").when(p == "3-MEDIUM", "cloze")
    scalar = (s == "F") | (p == "1-URGENT")
    return o.select(p.alias("task"), s.alias("status"), analytics.distribution_kind(task, scalar, s == "O", F.lit(True)).alias("kind")).groupBy("task", "status", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("record_detail", """SELECT 'c' || c_custkey AS uri, 'name' AS field, c_name AS value FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'c' || c_custkey, 'nations', '[' || c_nationkey || ']' FROM customer""")
def record_detail(spark, d):
    c = table(spark, d, "customer")
    return views.detail(c.select(F.concat(F.lit("c"), "c_custkey").alias("uri"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("segment"), F.array("c_nationkey").alias("nations"), F.array().cast("array<string>").alias("none")))


@query("corpus_splits", f"SELECT split, count(*) AS n FROM ({mapping.MEMBERSHIPS}) WHERE \"corpusRef\" = 'at://docs/corpus/src2' GROUP BY split")
def corpus_splits(spark, d):
    return views.corpus(mapping.memberships(spark, d), "at://docs/corpus/src2")


@query("edge_cards", "SELECT 'o' || o_orderkey AS uri, 'c' || o_custkey AS source, 'local' AS target FROM orders")
def edge_cards(spark, d):
    null = F.lit(None).cast("string")
    end = lambda r, k: F.struct(r.alias("recordRef"), null.alias("knowledgeRef"), k.alias("localId"), null.alias("objectId"))
    sets = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uri"), F.lit("t").alias("edgeType"), F.array(F.struct(end(F.concat(F.lit("c"), "o_custkey"), F.lit("x")).alias("source"), end(F.lit(""), F.lit("local")).alias("target"))).alias("edges"))
    return views.edge_cards(sets).select("uri", "source", "target")


@query("layer_violations", "SELECT 'o' || l_orderkey AS uri, 'confidence out of range' AS problem FROM lineitem GROUP BY l_orderkey HAVING max(l_quantity) > 45")
def layer_violations(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") * 22.2).cast("long").alias("confidence"))).alias("annotations"))
    return builders.violations(i.select(F.concat(F.lit("o"), "l_orderkey").alias("uri"), F.lit("e").alias("expression"), "annotations"))


@query("merge_sources", "SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE 'built-in' END AS url FROM nation")
def merge_sources(spark, d):
    n = table(spark, d, "nation")
    built_in = n.filter("n_nationkey % 8 != 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.lit("built-in").alias("url"))
    own = n.filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.lit("own").alias("url"))
    return discovery.merge_sources(built_in, own, ["url"])


@query("dataset_map_batched", "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(source) AS BIGINT) AS width FROM documents")
def dataset_map_batched(spark, d):
    ds = Dataset(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ds.map_batched(lambda rows: [{"doc_id": r["doc_id"], "width": len(r["source"])} for r in rows], "doc_id long, width long", 100).df


@query("dataset_features", "SELECT 'doc_id' AS name, 'int64' AS dtype UNION ALL SELECT 'text', 'string' UNION ALL SELECT 'lang', 'string' UNION ALL SELECT 'source', 'string' UNION ALL SELECT 'n_chars', 'int64'")
def dataset_features(spark, d):
    return spark.createDataFrame([(n, t) for n, t, _ in Dataset(table(spark, d, "documents")).features()], "name string, dtype string")


@query("schema_changes", "SELECT 'lang' AS path, 'removed' AS change UNION ALL SELECT 'n_chars', 'changed' UNION ALL SELECT 'region', 'added'")
def schema_changes(spark, d):
    docs = table(spark, d, "documents")
    found = schema_diff(docs, docs.drop("lang").withColumn("n_chars", F.col("n_chars").cast("string")).withColumn("region", F.lit("x")))
    return spark.createDataFrame([(p, c) for p, c, *_ in found], "path string, change string")
