"""The driver tables seen as annotation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.partitioning import spread
from corpuslake.plans.tables import table


def expressions(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return docs.select(F.concat(F.lit("at://docs/expression/"), "doc_id").alias("uri"), F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("kind"), "text", "lang", "source", F.col("doc_id").alias("ord"))


EXPRESSIONS = "SELECT 'at://docs/expression/' || doc_id AS uri, CAST(doc_id AS VARCHAR) AS id, 'document' AS kind, text, lang, source, doc_id AS ord FROM documents"


def memberships(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    return docs.select(F.concat(F.lit("at://docs/corpus/"), "source").alias("corpusRef"), F.concat(F.lit("at://docs/expression/"), "doc_id").alias("expressionRef"), split.alias("split"), F.col("doc_id").alias("ordinal"))


MEMBERSHIPS = """SELECT 'at://docs/corpus/' || source AS "corpusRef", 'at://docs/expression/' || doc_id AS "expressionRef",
  CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, doc_id AS ordinal FROM documents"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """Token-aligned annotations: a word's label tells its form."""
    each = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("token_index", "value")).filter("value != ''")
    label = F.when(F.col("value").rlike("^[A-Z]"), "CAP").when(F.length("value") >= 9, "LONG").when(F.length("value") <= 3, "SHORT").otherwise("MID")
    return each.select(F.concat(F.lit("at://docs/layer/"), "doc_id").alias("layer_uri"), F.col("token_index").cast("long").alias("token_index"), "value", label.alias("label"))


WORDS = r"""SELECT 'at://docs/layer/' || doc_id AS layer_uri, token_index, value,
  CASE WHEN regexp_matches(value, '^[A-Z]') THEN 'CAP' WHEN length(value) >= 9 THEN 'LONG' WHEN length(value) <= 3 THEN 'SHORT' ELSE 'MID' END AS label
FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n]+')) AS value, unnest(range(len(string_split_regex(text, '[ \n]+')))) AS token_index FROM documents) WHERE value != ''"""


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Document-tag layers from the labels, each with the expression it is about."""
    labels = table(spark, d, "labels")
    parts = [labels.select("doc_id", F.lit(k).alias("subkind"), F.col(k).cast("string").alias("value"), F.lit(n).alias("n")) for n, k in enumerate(("quality", "toxic"))]
    both = parts[0].unionByName(parts[1]).filter("value is not null")
    return both.select(F.concat(F.lit("at://docs/layer/"), "subkind", F.lit("/"), "doc_id").alias("uri"), F.concat(F.lit("at://docs/expression/"), "doc_id").alias("expression"), F.lit("document-tag").alias("kind"), "subkind", "value", (F.col("doc_id") * 2 + F.col("n")).alias("ord"))


LAYERS = """SELECT 'at://docs/layer/' || subkind || '/' || doc_id AS uri, 'at://docs/expression/' || doc_id AS expression, 'document-tag' AS kind, subkind, value, doc_id * 2 + n AS ord
FROM (SELECT doc_id, 'quality' AS subkind, CAST(quality AS VARCHAR) AS value, 0 AS n FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), 1 FROM labels) WHERE value IS NOT NULL"""


def orders_json(spark: SparkSession, d: str, changed: bool = False) -> DataFrame:
    """Orders as records in JSON; the changed copy drops, adds and alters some."""
    o = table(spark, d, "orders")
    price = F.round(F.col("o_totalprice") + (F.when(F.col("o_orderkey") % 5 == 0, 1.0).otherwise(0.0) if changed else F.lit(0.0)), 2)
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")) if changed else F.col("o_orderstatus")
    rows = o.filter(F.col("o_orderkey") % 11 != (3 if changed else 4))
    value = F.to_json(F.struct(F.col("o_custkey").alias("cust"), status.alias("status"), F.format_string("%.2f", price).alias("price")))
    return rows.select(F.concat(F.lit("at://shop/sales.order/"), "o_orderkey").alias("uri"), value.alias("value"))


def orders_sql(changed: bool) -> str:
    price = "round(o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.0 END, 2)" if changed else "round(o_totalprice, 2)"
    status = "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END" if changed else "o_orderstatus"
    return f"""SELECT 'at://shop/sales.order/' || o_orderkey AS uri, o_custkey AS cust, {status} AS status, printf('%.2f', {price}) AS price,
      '{{"cust":' || o_custkey || ',"status":"' || {status} || '","price":"' || printf('%.2f', {price}) || '"}}' AS value
      FROM orders WHERE o_orderkey % 11 != {3 if changed else 4}"""
