"""Queries of the concordance, pattern and view operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions.anchors import ANCHOR, flatten_anchor
from corpuslake.functions.uri import authority_of, card_uri, nsid_of, rkey_of, short_uri, truncate
from corpuslake.operators import corpus, flatten
from corpuslake.plans import cql, kwic, mapping
from corpuslake.plans.engine import filter_rows
from corpuslake.plans.registry import query, table


def _kwic_sql(pattern: str, flags: str = "(?i)") -> str:
    p = flags + pattern
    return rf"""
WITH e AS ({mapping.EXPRESSIONS}), m AS (SELECT uri, text, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM e WHERE text IS NOT NULL),
x AS (SELECT uri, text, hits, gaps, unnest(range(len(hits))) AS k FROM m),
y AS (SELECT uri, text, k, hits[k + 1] AS hit, CAST(list_sum(list_transform(gaps[1:k + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k], lambda h: length(h))), 0) AS BIGINT) AS pos FROM x)
SELECT uri AS source, CAST(k AS BIGINT) AS match_no, regexp_replace(substring(text, greatest(pos - 48, 0) + 1, least(pos, 48)), '\s+', ' ', 'g') AS "left",
  regexp_replace(hit, '\s+', ' ', 'g') AS match, regexp_replace(substring(text, pos + length(hit) + 1, 48), '\s+', ' ', 'g') AS "right" FROM y"""


@query("kwic_the", _kwic_sql(r"\bthe\b"))
def kwic_the(spark, d):
    return kwic.kwic(mapping.expressions(spark, d), r"\bthe\b")


@query("kwic_case_sensitive", _kwic_sql(r"\bThe\b", ""))
def kwic_case_sensitive(spark, d):
    return kwic.kwic(mapping.expressions(spark, d), r"\bThe\b", ignore_case=False)


@query("kwic_native", _kwic_sql(r"\bthe\b"))
def kwic_native(spark, d):
    return kwic.kwic_native(mapping.expressions(spark, d), r"\bthe\b", "uri")


@query("cql_any", f"SELECT layer_uri, token_index, label AS tok0 FROM ({mapping.WORDS})")
def cql_any(spark, d):
    return cql.cql(mapping.words(spark, d), "[]")


#: Words with the two behind them; an index has one row in a layer.
_AHEAD = f"""WITH w AS ({mapping.WORDS}), x AS (SELECT layer_uri, token_index, label, lead(token_index) OVER o AS i1, lead(label) OVER o AS l1, lead(value) OVER o AS v1, lead(token_index, 2) OVER o AS i2, lead(label, 2) OVER o AS l2
FROM w WINDOW o AS (PARTITION BY layer_uri ORDER BY token_index))"""


@query("cql_two_token", f"{_AHEAD} SELECT layer_uri, token_index, label AS tok0, l1 AS tok1 FROM x WHERE label = 'CAP' AND l1 = 'LONG' AND i1 = token_index + 1")
def cql_two_token(spark, d):
    return cql.cql(mapping.words(spark, d), '[label="CAP"] [label="LONG"]')


_THREE = f"""{_AHEAD} SELECT layer_uri, token_index, label AS tok0, l1 AS tok1, l2 AS tok2 FROM x
WHERE label = 'SHORT' AND regexp_matches(v1, '^th') AND l2 != 'CAP' AND i1 = token_index + 1 AND i2 = token_index + 2"""


@query("cql_three_token_regex", _THREE)
def cql_three_token_regex(spark, d):
    return cql.cql(mapping.words(spark, d), '[label="SHORT"] [value~"^th"] [label!="CAP"]')


@query("cql_sorted_pass", _THREE)
def cql_sorted_pass(spark, d):
    return cql.cql_sorted(mapping.words(spark, d), '[label="SHORT"] [value~"^th"] [label!="CAP"]')


@query("cql_negation", f"SELECT layer_uri, token_index, label AS tok0 FROM ({mapping.WORDS}) WHERE label != 'MID' AND regexp_matches(value, 'ing')")
def cql_negation(spark, d):
    return cql.cql(mapping.words(spark, d), '[label!="MID" & value~"ing"]')


@query("filter_rows", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'brand#1')")
def filter_rows_query(spark, d):
    return filter_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "Brand#1", ["p_name", "p_brand"])


@query("expressions_view", f"SELECT uri, id, kind, text, lang FROM ({mapping.EXPRESSIONS})")
def expressions_view(spark, d):
    nested = mapping.expressions(spark, d).select("uri", "id", "kind", "text", "lang", F.array("lang").alias("languages"), F.struct("source").alias("features"))
    return flatten.expressions_view(nested)


def _anchored(spark, d):
    """Anchors of several kinds made of line items."""
    i = table(spark, d, "lineitem")
    k = F.col("l_orderkey") % 4
    a, b = F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long")
    null = {f.name: F.lit(None).cast(f.dataType) for f in ANCHOR.fields}
    span = F.struct(a.alias("byteStart"), b.alias("byteEnd"), F.lit(None).cast("long").alias("charStart"), F.lit(None).cast("long").alias("charEnd"))
    token = F.struct(F.struct(F.col("l_returnflag").alias("value")).alias("tokenizationId"), a.alias("tokenIndex"))
    time = F.struct((a * 100).alias("start"), (b * 100).alias("ending"))
    anchor = F.struct(*[{"textSpan": F.when(k == 0, span), "tokenRef": F.when(k == 1, token), "temporalSpan": F.when(k == 2, time)}.get(n, v).alias(n) for n, v in null.items()])
    return i.select("l_orderkey", "l_linenumber", anchor.alias("anchor"))


@query("flatten_anchor", """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN 'span' WHEN 1 THEN 'tokenRef' WHEN 2 THEN 'temporalSpan' END AS anchor_kind,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_linenumber AS BIGINT) END AS byte_start, CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_linenumber + l_quantity AS BIGINT) END AS byte_end,
  CASE WHEN l_orderkey % 4 = 1 THEN l_returnflag END AS token_id, CASE WHEN l_orderkey % 4 = 1 THEN CAST(l_linenumber AS BIGINT) END AS token_index,
  CASE WHEN l_orderkey % 4 = 2 THEN CAST(l_linenumber AS BIGINT) * 100 END AS t_start_ms, CASE WHEN l_orderkey % 4 = 2 THEN CAST(l_linenumber + l_quantity AS BIGINT) * 100 END AS t_end_ms FROM lineitem""")
def flatten_anchor_query(spark, d):
    flat = _anchored(spark, d).select("l_orderkey", "l_linenumber", *flatten_anchor("anchor"))
    return flat.select("l_orderkey", "l_linenumber", "anchor_kind", "byte_start", "byte_end", "token_id", "token_index", "t_start_ms", "t_end_ms")


@query("annotations_explode", """SELECT 'at://shop/order/' || l_orderkey AS layer_uri, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) - 1 AS BIGINT) AS annotation_index,
  l_returnflag AS label, l_linestatus AS value, CAST(l_linenumber AS BIGINT) AS token_index FROM lineitem""")
def annotations_explode(spark, d):
    i = table(spark, d, "lineitem")
    element = F.struct("l_linenumber", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ANCHOR.fields]).alias("anchor"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("value"), F.col("l_linenumber").cast("long").alias("tokenIndex"))
    # the line number leads the struct for the order, and is then left out
    layers = i.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(element)), lambda x: F.struct(x["anchor"].alias("anchor"), x["label"].alias("label"), x["value"].alias("value"), x["tokenIndex"].alias("tokenIndex"))).alias("annotations"))
    view = flatten.annotations_view(layers.select(F.concat(F.lit("at://shop/order/"), "l_orderkey").alias("uri"), "annotations"))
    return view.select("layer_uri", "annotation_index", "label", "value", "token_index")


@query("uri_parts", f"SELECT uri, 'docs' AS authority, 'expression' AS nsid, id AS rkey, 'expression/' || id AS short, 'at://did:local:index/index.card/' || substr(sha256(uri), 1, 24) AS card FROM ({mapping.EXPRESSIONS})")
def uri_parts(spark, d):
    e = mapping.expressions(spark, d)
    return e.select("uri", authority_of("uri").alias("authority"), nsid_of("uri").alias("nsid"), rkey_of("uri").alias("rkey"), short_uri("uri").alias("short"), card_uri("uri").alias("card"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 59) || '…' ELSE text END AS short FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate("text", 60).alias("short"))


@query("summarize_records", """SELECT 'at://shop/persona.persona/' || c_custkey AS uri, c_name || '|' || c_mktsegment || '|' || 'buyer' AS cells FROM customer""")
def summarize_records(spark, d):
    value = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("domain"), F.lit("buyer").alias("kind")))
    records = table(spark, d, "customer").select(F.concat(F.lit("at://shop/persona.persona/"), "c_custkey").alias("uri"), F.lit("x.persona.persona").alias("nsid"), value.alias("value"))
    return corpus.summarize(records).select("uri", F.array_join("cells", "|").alias("cells"))
