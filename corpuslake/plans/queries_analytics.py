"""Queries of the annotation analytics, media, codec and export operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslake.functions.anchors import byte_slice
from corpuslake.operators import analytics, media
from corpuslake.plans import mapping
from corpuslake.plans.registry import query, table
from corpuslake.sources import codecs, exporters

_WORDS = r"WITH s AS (" + mapping.WORDS + ")"


def _documents(spark, d):
    """All words of each document as a sentence."""
    return mapping.words(spark, d).withColumnRenamed("layer_uri", "sentence")


@query("syntax_grid_pivot", _WORDS + """ SELECT layer_uri AS sentence, token_index, value AS form, label AS "UPOS", CASE WHEN regexp_matches(value, '^[A-Za-z]{6}') THEN upper(substring(value, 1, 3)) ELSE '_' END AS "LEMMA",
  CAST(CASE WHEN token_index = 0 THEN 0 ELSE token_index END AS VARCHAR) AS "HEAD", 'dep' AS "DEPREL" FROM s""")
def syntax_grid_pivot(spark, d):
    """The word before is a word's head."""
    w, keys = _documents(spark, d), ["sentence", "token_index"]
    lemma = F.when(F.col("value").rlike("^[A-Za-z]{6}"), F.upper(F.substring("value", 1, 3)))
    rows = F.inline(F.filter(F.array(F.struct(F.lit("pos").alias("subkind"), F.col("label").alias("value")), F.struct(F.lit("lemma").alias("subkind"), lemma.alias("value"))), lambda x: x["value"].isNotNull()))
    tags = w.select(*keys, rows).select(*keys, analytics.tag_heading(F.col("subkind"), F.lit("token-tag")).alias("heading"), F.col("value").alias("tag"))
    relations = w.select(*keys, (F.col("token_index") - 1).alias("head"), F.lit("dep").alias("deprel"))
    return analytics.syntax_grid(w.select(*keys, F.col("value").alias("form")), tags, ["LEMMA", "UPOS"], relations)


@query("tag_values", _WORDS + " SELECT layer_uri AS sentence, token_index // 3 AS token_index, string_agg(label, '|' ORDER BY label) AS tag FROM s GROUP BY layer_uri, token_index // 3")
def tag_values(spark, d):
    """Three words' labels as the values of one token; an empty value gives way to the label."""
    w = _documents(spark, d)
    rows = w.select("sentence", F.floor(F.col("token_index") / 3).alias("token_index"), F.when(F.col("token_index") % 2 == 0, "").otherwise(F.col("label")).alias("value"), "label")
    return analytics.tag_values(rows, ["sentence", "token_index"])


@query("dependency_relations", _WORDS + " SELECT layer_uri, token_index // 2 AS token_index, arg_max(CASE WHEN token_index % 3 = 0 THEN -1 ELSE token_index END, token_index) AS head, arg_max(label, token_index) AS deprel FROM s GROUP BY layer_uri, token_index // 2")
def dependency_relations(spark, d):
    w = mapping.words(spark, d)
    rows = w.select("layer_uri", F.floor(F.col("token_index") / 2).alias("token_index"), F.when(F.col("token_index") % 3 != 0, F.col("token_index")).alias("head_index"), "label", F.col("token_index").alias("annotation_index"))
    return analytics.dependencies(rows)


@query("dependency_tree", _WORDS + """, r AS (SELECT layer_uri AS sentence, row_number() OVER (PARTITION BY layer_uri ORDER BY token_index) - 1 AS token_index FROM s),
t AS (SELECT sentence, token_index, CASE WHEN token_index = 0 THEN -1 ELSE (token_index - 1) // 2 END AS head FROM r)
SELECT sentence, token_index, CAST(floor(log2(token_index + 1)) AS INTEGER) AS depth FROM t""")
def dependency_tree(spark, d):
    """Words as the nodes of a binary heap."""
    order = Window.partitionBy("sentence").orderBy("token_index")
    w = _documents(spark, d).select("sentence", (F.row_number().over(order) - 1).cast("long").alias("token_index"))
    heads = F.when(F.col("token_index") == 0, -1).otherwise(F.floor((F.col("token_index") - 1) / 2))
    return analytics.dependency_tree(w.withColumn("head", heads)).select("sentence", "token_index", "depth")


@query("interlinear_strips", """SELECT o_orderkey AS expression, 0 AS strip, CAST(k AS BIGINT) AS token_index, CAST(r AS INTEGER) AS row, CASE r WHEN 0 THEN 'word' ELSE 'UPOS' END AS heading,
  CASE WHEN r = 0 AND k = 0 THEN o_orderstatus WHEN r = 0 THEN o_orderpriority WHEN k = 0 THEN 'STATUS' ELSE '' END AS cell FROM orders, (SELECT unnest([0, 1]) AS k), (SELECT unnest([0, 1]) AS r)""")
def interlinear_strips(spark, d):
    """An order's status and priority as two words, the first with a tag."""
    o = table(spark, d, "orders")
    each = F.posexplode(F.array("o_orderstatus", "o_orderpriority")).alias("token_index", "surface")
    words = o.select(F.col("o_orderkey").alias("expression"), each)
    tags = o.select(F.col("o_orderkey").alias("expression"), F.lit(0).alias("token_index"), F.lit("UPOS").alias("heading"), F.lit("STATUS").alias("tag"))
    return analytics.interlinear(words, tags, ["UPOS"]).select("expression", F.col("strip").cast("int").alias("strip"), "token_index", "row", "heading", "cell")


@query("segmentation_rows", "SELECT 'o' || l_orderkey AS uri, CAST(l_linenumber AS BIGINT) AS token_index, l_shipdate_text AS surface FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text FROM lineitem)")
def segmentation_rows(spark, d):
    """Line items as the tokens of their order."""
    token = F.struct(F.col("l_linenumber").cast("long").alias("tokenIndex"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("text"), F.struct(F.lit(0).cast("long").alias("byteStart"), F.lit(1).cast("long").alias("byteEnd")).alias("textSpan"))
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(token).alias("tokens"))
    segmentations = own.select(F.concat(F.lit("o"), "l_orderkey").alias("uri"), F.array(F.struct(F.lit("t").alias("uuid"), F.lit("custom").alias("kind"), "tokens")).alias("tokenizations"))
    return analytics.segmentation_table(segmentations).select("uri", "token_index", "surface")


@query("descendant_texts", "SELECT 'c' || conv_id AS uri, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS texts FROM conversations WHERE text != '' GROUP BY conv_id")
def descendant_texts(spark, d):
    """Turns below their conversation."""
    c = table(spark, d, "conversations")
    turns = c.select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("uri"), F.concat(F.lit("c"), "conv_id").alias("parentRef"), "text", F.col("turn").alias("ord"))
    roots = c.select("conv_id").distinct().select(F.concat(F.lit("c"), "conv_id").alias("uri"), F.lit(None).cast("string").alias("parentRef"), F.lit(None).cast("string").alias("text"), F.col("conv_id").alias("ord"))
    return analytics.descendant_texts(roots.unionByName(turns))


@query("byte_spans", "SELECT doc_id, decode(array_slice(encode(regexp_replace(text, '[^ -~]', '', 'g')), 11, 40)) AS piece FROM documents")
def byte_spans(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    return docs.select("doc_id", byte_slice("t", F.lit(10), F.lit(40)).alias("piece"))


@query("tier_timeline", "SELECT event_id, unnest(range(event_id % 7, event_id % 7 + event_id % 3 + 1)) AS \"column\" FROM events")
def tier_timeline(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 * 200).alias("t_start_ms"), ((F.col("event_id") % 7 + F.col("event_id") % 3) * 200 + 10).alias("t_end_ms"))
    return analytics.timeline(e).select("event_id", "column")


@query("document_tags", "SELECT doc_id, 'q' || quality || ' ' || quality * 90 || '%' AS tag FROM labels")
def document_tags(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("label"), F.lit(None).cast("string").alias("value"), (F.col("quality") * 900).alias("confidence"))
    return analytics.document_tags(rows).select("doc_id", "tag")


@query("span_overlaps", """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) * 100 AS lo, CAST(l_quantity AS BIGINT) * 100 + l_linenumber * 300 AS hi FROM lineitem)
SELECT a.k, a.lo AS a_lo, a.hi AS a_hi, CAST(a.n AS VARCHAR) AS a_label, b.lo AS b_lo, b.hi AS b_hi, CAST(b.n AS VARCHAR) AS b_label FROM x a JOIN x b ON a.k = b.k AND a.lo < b.hi AND b.lo < a.hi WHERE a.n % 2 = 0 AND b.n % 2 = 1""")
def span_overlaps(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("long") * 100).alias("lo"), (F.col("l_quantity").cast("long") * 100 + F.col("l_linenumber") * 300).alias("hi"), F.col("l_linenumber").cast("string").alias("label"))
    return analytics.overlaps(i.filter("n % 2 = 0"), i.filter("n % 2 = 1"), "k")


@query("lane_packing")
def lane_packing(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("lo"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 3).alias("hi"), F.col("l_linenumber").cast("string").alias("label"))
    return analytics.lanes(i, "k")


@query("token_byte_spans", """WITH i AS (SELECT l_orderkey AS s, CAST(l_linenumber AS BIGINT) AS n, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem), w AS (SELECT DISTINCT s, n FROM i WHERE n < m),
j AS (SELECT i.s, i.n, a.n AS x, b.n AS y FROM i LEFT JOIN w a ON a.s = i.s AND a.n = i.n LEFT JOIN w b ON b.s = i.s AND b.n = i.n + 1)
SELECT s AS sentence, n AS annotation_index, CAST(coalesce(x * 10, y * 10, 1) AS INTEGER) AS byte_start, CAST(coalesce(y * 10 + 5, x * 10 + 5, 2) AS INTEGER) AS byte_end FROM j""")
def token_byte_spans(spark, d):
    """An annotation names two words; the last word of each order is missing."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence"), F.col("l_linenumber").cast("long").alias("n"))
    spans = i.select("sentence", F.col("n").alias("annotation_index"), F.array("n", F.col("n") + 1).alias("token_indexes"), F.lit(1).cast("long").alias("byte_start"), F.lit(2).cast("long").alias("byte_end"))
    last = i.groupBy("sentence").agg(F.max("n").alias("n"))
    words = i.join(last, ["sentence", "n"], "left_anti").select("sentence", F.col("n").alias("token_index"), (F.col("n") * 10).alias("byte_start"), (F.col("n") * 10 + 5).alias("byte_end"))
    return analytics.token_spans(spans, words).select("sentence", "annotation_index", F.col("byte_start").cast("int").alias("byte_start"), F.col("byte_end").cast("int").alias("byte_end"))


@query("graph_edge_labels", """SELECT 'order/' || o_orderkey AS source_label, 'placed-by/' || o_orderpriority AS relation, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'customer/' || o_custkey) AS target_label FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def graph_edge_labels(spark, d):
    nodes = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("at://shop/customer/"), "c_custkey").alias("uri"), F.lit(None).cast("string").alias("label"), F.col("c_name").alias("name"))
    end = lambda kind, key: F.struct(F.concat(F.lit(f"at://shop/{kind}/"), key).alias("recordRef"), F.lit(None).cast("string").alias("localId"), F.lit(None).cast("string").alias("objectId"))
    edges = table(spark, d, "orders").select(end("order", "o_orderkey").alias("source"), end("customer", "o_custkey").alias("target"), F.lit("placed-by").alias("edgeType"), F.col("o_orderpriority").alias("label"))
    return analytics.graph_edges(nodes, edges)


@query("alignment_bitext", """SELECT o_orderkey AS alignment, 'w' || (o_orderkey % 5) || ' ?' AS source, '∅' AS target FROM orders""")
def alignment_bitext(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("alignment"))
    links = o.select("alignment", F.lit(0).alias("link_no"), F.lit("l").alias("label"), F.array(F.lit(0), F.lit(9)).alias("sourceIndices"), F.array().cast("array<int>").alias("targetIndices"))
    words = o.select("alignment", F.lit(0).alias("token_index"), F.concat(F.lit("w"), F.col("alignment") % 5).alias("surface"))
    return analytics.bitext(links, words, words).select("alignment", "source", "target")


@query("item_index", "SELECT l_partkey AS item, count(*) AS n, arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS experiment FROM lineitem GROUP BY l_partkey")
def item_index(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("experiment"), F.col("l_orderkey").alias("set_ord"), F.col("l_linenumber").alias("judgment_index"))
    return analytics.item_index(i)


@query("judgment_ordinal", """WITH v AS (SELECT l_returnflag AS g, l_linenumber AS v FROM lineitem), s AS (SELECT g, least(min(v), 1) AS lo, greatest(max(v), 9) AS hi, avg(v) AS mean, median(v) AS med FROM v GROUP BY g),
l AS (SELECT g, unnest(range(lo, hi + 1)) AS level, mean, med FROM s) SELECT l.g, CAST(l.level AS BIGINT) AS level, count(v.v) AS n, round(any_value(mean), 6) AS mean, CAST(any_value(med) AS DOUBLE) AS median FROM l LEFT JOIN v ON v.g = l.g AND v.v = l.level GROUP BY l.g, l.level""")
def judgment_ordinal(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("v"))
    return analytics.ordinal_histogram(v, "g", "v", 1, 9).withColumn("mean", F.round("mean", 6)).withColumn("median", F.col("median").cast("double"))


_MAGNITUDE = """SELECT g, count(*) AS n, round(coalesce(exp(avg(CASE WHEN v > 0 THEN ln(CASE WHEN v > 0 THEN v END) END)), avg(v)), 4) AS center, list_sort(list(v))[count(*) // 2 + 1] AS upper_median, min(v) AS low, max(v) AS high FROM v GROUP BY g"""
_BINS = """, e AS (SELECT g, v, min(v) OVER (PARTITION BY g) AS lo, max(v) OVER (PARTITION BY g) AS hi FROM v)
SELECT g, CAST(least(15, floor((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 15)) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1, 2"""
_PRICES = "WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders)"
#: Whole balances: negative ones, zeros, and a group whose values are all below one.
_BALANCES = "WITH v AS (SELECT c_mktsegment AS g, CAST(trunc(c_acctbal / 1000) AS DOUBLE) AS v FROM customer UNION ALL SELECT 'debt', CAST(-(c_custkey % 5) AS DOUBLE) FROM customer UNION ALL SELECT 'same', 3.0 FROM region)"


def _prices(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))


def _balances(spark, d):
    c = table(spark, d, "customer")
    whole = c.select(F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") / 1000).cast("long").cast("double").alias("v"))
    debt = c.select(F.lit("debt"), (-(F.col("c_custkey") % 5)).cast("double"))
    return whole.unionAll(debt).unionAll(table(spark, d, "region").select(F.lit("same"), F.lit(3.0)))


for _name, _sql, _values in (("judgment_magnitude", _PRICES, _prices), ("judgment_magnitude_signed", _BALANCES, _balances)):
    query(_name, f"{_sql} {_MAGNITUDE}")(lambda spark, d, values=_values: analytics.magnitude_summary(values(spark, d), "g", "v").withColumn("center", F.round("center", 4)))
for _name, _sql, _values in (("judgment_bins", _PRICES, _prices), ("judgment_bins_signed", _BALANCES, _balances)):
    query(_name, f"{_sql}{_BINS}")(lambda spark, d, values=_values: analytics.magnitude_bins(values(spark, d), "g", "v"))


@query("judgment_categorical", """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS v, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2)
SELECT g, v, n, CAST(round_even(100.0 * n / sum(n) OVER (PARTITION BY g), 0) AS BIGINT) AS percent, CAST(row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS INTEGER) AS place FROM c""")
def judgment_categorical(spark, d):
    v = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("v"), F.col("c_custkey").alias("o"))
    return analytics.categorical(v, "g", "v", "o")


@query("layers_roster", "SELECT 'o' || l_orderkey AS expression, CAST(count(*) AS INTEGER) AS n_annotations FROM lineitem GROUP BY l_orderkey")
def layers_roster(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("annotations"))
    return analytics.layers_roster(i.select(F.concat(F.lit("o"), "l_orderkey").alias("expression"), F.col("l_orderkey").alias("uri"), F.lit("k").alias("kind"), F.lit("s").alias("subkind"), "annotations")).select("expression", "n_annotations")


@query("type_hierarchy", "SELECT p_brand AS \"typeKind\", count(*) AS n_types, CAST(sum(p_size % 3) AS BIGINT) AS n_roles FROM part GROUP BY p_brand")
def type_hierarchy(spark, d):
    roles = F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("p_size") % 3)
    types = table(spark, d, "part").select(F.lit("o").alias("ontologyRef"), F.col("p_brand").alias("typeKind"), roles.alias("allowedRoles"))
    return analytics.type_hierarchy(types, "o").withColumn("n_roles", F.col("n_roles").cast("long"))


@query("collection_forms", "SELECT 'n' || s_nationkey AS \"collectionRef\", n_name AS form FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def collection_forms(spark, d):
    members = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("collectionRef"), F.concat(F.lit("e"), "s_nationkey").alias("entryRef"))
    entries = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("e"), "n_nationkey").alias("uri"), F.col("n_name").alias("form"), F.array(F.struct(F.col("n_name").alias("form"))).alias("components"))
    return analytics.collection_forms(members, entries).select("collectionRef", "form")


@query("keyframe_interpolate", """SELECT event_id, round(CASE WHEN t <= 0 THEN 10.0 WHEN t >= 1000 THEN 30.0 WHEN t < 400 THEN 10 + 30 * (t / 400.0) ELSE 40 - 10 * ((t - 400) / 600.0) END, 6) AS x FROM (SELECT event_id, event_id % 1200 - 100 AS t FROM events)""")
def keyframe_interpolate(spark, d):
    frames = F.array(*[F.struct(F.lit(t).cast("long").alias("timeMs"), F.struct(F.lit(x).alias("x")).alias("bbox")) for t, x in ((0, 10.0), (400, 40.0), (1000, 30.0))])
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 1200 - 100).alias("t"), frames.alias("k"))
    return e.select("event_id", F.round(media.interpolate(F.col("k"), F.col("t"), ["x"])["x"], 6).alias("x"))


@query("signal_windows", "SELECT o_orderkey, array_to_string(list_transform(range((o_orderkey % 4) * 2, (o_orderkey % 4) * 2 + 4), lambda x: CAST(x AS VARCHAR)), ',') AS samples FROM orders")
def signal_windows(spark, d):
    """Two channels at 1000 samples a second."""
    o = table(spark, d, "orders").select("o_orderkey", F.sequence(F.lit(0), F.lit(39)).alias("s"))
    cut = media.window_of(F.col("s"), F.col("o_orderkey") % 4, F.col("o_orderkey") % 4 + 2, F.lit(1000), F.lit(2))
    return o.select("o_orderkey", F.array_join(F.transform(cut, lambda x: x.cast("string")), ",").alias("samples"))


@query("events_in_windows", """SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity >= o.o_orderkey % 20 AND l.l_quantity < o.o_orderkey % 20 + 15""")
def events_in_windows(spark, d):
    w = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 20).alias("start"), (F.col("o_orderkey") % 20 + 15).alias("end"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("t"), "l_linenumber")
    return media.events_in_windows(w, e, "k", 8).select(F.col("k").alias("o_orderkey"), "l_linenumber")


@query("asof_join", """WITH e AS (SELECT user_id, event_id, ts FROM events), p AS (SELECT user_id, ts, max(event_id) AS pid FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts)
SELECT e.event_id, p.pid AS asof_pid FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    first = e.join(e.agg(F.min("event_type").alias("event_type")), "event_type", "left_semi").groupBy("user_id", "ts").agg(F.max("event_id").alias("pid"))
    return media.as_of(e.select("user_id", "event_id", "ts"), first, "user_id", "ts", ["pid"]).select("event_id", "asof_pid")


@query("conllu_roundtrip", """SELECT o_orderkey AS source, CAST(0 AS BIGINT) AS sentence, CAST(k AS BIGINT) AS token_index, CASE k WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS form,
  CAST(k - 1 AS BIGINT) AS head, CASE k WHEN 0 THEN 0 ELSE length(o_orderstatus) + 1 END AS byte_start FROM orders, (SELECT unnest([0, 1]) AS k)""")
def conllu_roundtrip(spark, d):
    """Two-word sentences are written, read, written and read again."""
    line = lambda n, form, head: F.concat_ws("\t", F.lit(str(n)), F.col(form), *[F.lit("_")] * 4, F.lit(str(head)), *[F.lit("_")] * 3)
    text = F.concat_ws("\n", line(1, "o_orderstatus", 0), line(2, "o_orderpriority", 1), F.lit("\n"))
    first = codecs.conllu_tokens(table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), text.alias("content")))
    again = codecs.conllu_tokens(codecs.conllu_text(first).select("source", "content"))
    return again.select("source", "sentence", "token_index", "form", "head", F.col("byte_start").cast("int").alias("byte_start"))


@query("brat_canonical", "SELECT o_orderkey AS source, 'T1' || chr(9) || 'Status 0 1' || chr(9) || o_orderstatus || chr(10) || 'A1' || chr(9) || 'Seen T1' AS content FROM orders")
def brat_canonical(spark, d):
    text = F.concat(F.col("o_orderstatus"), F.lit(codecs.BRAT_SEPARATOR), F.lit("T7\tStatus 0 1\t"), F.col("o_orderstatus"), F.lit("\nA9\tSeen T7\nA3\tLost T8\nR1\tNext Arg1:T7 Arg2:T9\nnoise"))
    return codecs.brat_text(codecs.brat_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), text.alias("content"))))


@query("export_tasks", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'token-classification' WHEN p_size % 3 = 1 THEN 'dependency-parsing' END AS task FROM part")
def export_tasks(spark, d):
    k = F.col("p_size") % 3
    layers = table(spark, d, "part").select("p_partkey", F.when(k == 0, "token-tag").when(k == 1, "tree").otherwise("other").alias("kind"), F.when(k == 0, "ner").alias("subkind"), F.lit(None).cast("string").alias("formalism"))
    return exporters.tasks(layers).select("p_partkey", "task")


@query("export_shards", "SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard, lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) % 100 AS VARCHAR), 8, '0') AS key, doc_id FROM documents")
def export_shards(spark, d):
    return exporters.shards(table(spark, d, "documents").select("doc_id"), "doc_id", 100).select("shard", "key", "doc_id")


@query("export_batches", "SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch, count(*) OVER (PARTITION BY 1) * 0 + vec_id AS vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id) <= count(*) OVER () // 32 * 32")
def export_batches(spark, d):
    return exporters.batches(table(spark, d, "embeddings").select("vec_id"), "vec_id", 32, drop_remainder=True).select("batch", "vec_id")
