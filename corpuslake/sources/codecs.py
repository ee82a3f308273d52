"""Annotation formats: CoNLL-U sentences and brat standoff, to rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns of a CoNLL-U token line.
CONLLU = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
# Fixed value: what stands between text and annotations of a brat source.
BRAT_SEPARATOR = "\n===ANN===\n"


def conllu_tokens(sources: DataFrame, key: str = "source", text: str = "content") -> DataFrame:
    """One row per token of each sentence, with byte spans over the forms joined by one space.

    ``sentence`` counts blocks between blank lines.  Ranges and empty nodes are left
    out.  ``head`` is -1 for a root, else the index of the head.  ``declared`` is the
    sentence's text comment; an underscore is a missing value.
    """
    blocks = sources.select(key, F.posexplode(F.split(F.col(text), r"\r?\n\s*\n")).alias("sentence", "block")).filter(F.trim("block") != "")
    lines = blocks.select(key, "sentence", F.regexp_extract("block", r"(?m)^#\s*text\s*=\s*(.*)$", 1).alias("declared"), F.posexplode(F.split("block", r"\r?\n")).alias("line_no", "line"))
    cells = lines.filter(F.col("line").rlike(r"^\d+\t")).withColumn("c", F.split("line", "\t"))
    named = cells.select(key, "sentence", "declared", "line_no", *[F.nullif(F.get("c", F.lit(k)), F.lit("_" if n != "form" else "\0")).alias(n) for k, n in enumerate(CONLLU)])
    order = Window.partitionBy(key, "sentence").orderBy("line_no")
    width = F.octet_length("form")
    placed = named.withColumn("token_index", F.row_number().over(order) - 1).withColumn("byte_end", (F.sum(width + 1).over(order) - 1).cast("long"))
    return placed.select(
        key, F.col("sentence").cast("long").alias("sentence"), F.col("token_index").cast("long").alias("token_index"), "form", "lemma", "upos", "xpos", "feats",
        (F.col("head").try_cast("long") - 1).alias("head"), "deprel", "deps", "misc", (F.col("byte_end") - width).alias("byte_start"), "byte_end", F.nullif("declared", F.lit("")).alias("declared"),
    )


def conllu_text(tokens: DataFrame, key: str = "source") -> DataFrame:
    """Sources as CoNLL-U text: sentences in order, a text comment first where one was declared."""
    blank = lambda c: F.coalesce(c, F.lit("_"))
    line = F.concat_ws("\t", (F.col("token_index") + 1).cast("string"), *[blank(F.col(c)) for c in ("form", "lemma", "upos", "xpos", "feats")], blank((F.col("head") + 1).cast("string")), *[blank(F.col(c)) for c in ("deprel", "deps", "misc")])
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_index", line.alias("l")))), lambda x: x["l"]), "\n")
    comment = F.coalesce(F.concat(F.lit("# text = "), F.first("declared"), F.lit("\n")), F.lit(""))
    sentences = tokens.groupBy(key, "sentence").agg(F.concat(comment, lines, F.lit("\n")).alias("s"))
    return sentences.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence", "s"))), lambda x: x["s"]), "\n").alias("content"))


def brat_rows(sources: DataFrame, key: str = "source", text: str = "content") -> dict[str, DataFrame]:
    """Entities, relations and attributes of brat sources; lines that do not fit are skipped.

    The parts of a discontinuous span become the span around them; an attribute
    without a value is a flag with an empty one.
    """
    lines = sources.select(key, F.posexplode(F.split(F.element_at(F.split(F.col(text), BRAT_SEPARATOR, 2), -1), "\n")).alias("line_no", "line"))
    take = lambda p, k: F.regexp_extract("line", p, k)
    t, r, a = r"^(T\S+)\t(\S+) ((?:\d+ \d+;?)+)\t(.*)$", r"^(R\S+)\t(\S+) (\S+?):(\S+) (\S+?):(\S+)\s*$", r"^([AM]\S+)\t(\S+) (\S+)(?: (.*))?$"
    numbers = F.transform(F.regexp_extract_all(take(t, 3), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return {
        "entities": lines.filter(F.col("line").rlike(t)).select(key, "line_no", take(t, 1).alias("local_id"), take(t, 2).alias("label"), F.array_min(numbers).alias("start"), F.array_max(numbers).alias("end"), take(t, 4).alias("text")),
        "relations": lines.filter(F.col("line").rlike(r)).select(key, "line_no", take(r, 1).alias("local_id"), take(r, 2).alias("label"), take(r, 3).alias("role1"), take(r, 4).alias("arg1"), take(r, 5).alias("role2"), take(r, 6).alias("arg2")),
        "attributes": lines.filter(F.col("line").rlike(a)).select(key, "line_no", take(a, 1).alias("local_id"), take(a, 2).alias("name"), take(a, 3).alias("target"), take(a, 4).alias("value")),
    }


def brat_text(rows: dict[str, DataFrame], key: str = "source") -> DataFrame:
    """Canonical standoff: T, R and A lines numbered anew, arguments renamed, attributes by entity.

    Relations and attributes whose ends are not entities are dropped.
    """
    entities = rows["entities"].withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    names = entities.select(key, F.col("local_id").alias("_old"), F.concat(F.lit("T"), F.col("n")).alias("_new"), F.col("n").alias("_n"))

    def renamed(df, column):
        return df.join(names.withColumnRenamed("_old", column).withColumnRenamed("_new", f"{column}_new").withColumnRenamed("_n", f"{column}_n"), [key, column])

    relations = renamed(renamed(rows["relations"], "arg1"), "arg2").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    attributes = renamed(rows["attributes"], "target").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("target_n", "line_no")))
    lines = (
        entities.select(key, F.lit(0).alias("part"), "n", F.format_string("T%d\t%s %d %d\t%s", "n", "label", "start", "end", "text").alias("line"))
        .unionByName(relations.select(key, F.lit(1).alias("part"), "n", F.format_string("R%d\t%s %s:%s %s:%s", "n", "label", "role1", "arg1_new", "role2", "arg2_new").alias("line")))
        .unionByName(attributes.select(key, F.lit(2).alias("part"), "n", F.rtrim(F.format_string("A%d\t%s %s %s", "n", "name", "target_new", "value")).alias("line")))
    )
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "n", "line"))), lambda x: x["line"]), "\n").alias("content"))


class ConlluCodec:
    """Ten-column token lines as an adapter."""

    decode, encode = staticmethod(conllu_tokens), staticmethod(conllu_text)


class BratCodec:
    """Standoff annotations as an adapter."""

    decode, encode = staticmethod(brat_rows), staticmethod(brat_text)
