"""The record graph of a corpus: scope, splits, group and lookup joins, references, closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.kinds import KINDS, display_rank, kind_of
from corpuslake.functions.uri import authority_of, nsid_of, short_uri, truncate
from corpuslake.operators.flatten import annotations_view, expressions_view, materialize


def latest(records: DataFrame, key: str = "uri", order: str = "ord") -> DataFrame:
    """The last row of each key, at the place of its first (an upsert keeps its position)."""
    rest = [c for c in records.columns if c not in (key, order)]
    return records.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("_r")).select(key, order, *[F.col(f"_r.{c}").alias(c) for c in rest])


def scoped(expressions: DataFrame, memberships: DataFrame, corpus: str | None = None) -> DataFrame:
    """Expressions that a corpus holds; all of them if it has no members.  One plan, without a count first."""
    own = memberships if corpus is None else memberships.filter(F.col("corpusRef") == corpus)
    members = own.select(F.col("expressionRef").alias("_m")).filter("_m is not null").distinct()
    marked = expressions.join(members, F.col("uri") == F.col("_m"), "left")
    return marked.filter(F.col("_m").isNotNull() | ~own.exists()).drop("_m")


def split(expressions: DataFrame, memberships: DataFrame, name: str, corpus: str | None = None) -> DataFrame:
    """Expressions with a membership of the split, each once."""
    own = memberships.filter(F.col("split") == name)
    own = own if corpus is None else own.filter(F.col("corpusRef") == corpus)
    return expressions.join(own, expressions.uri == own.expressionRef, "left_semi")


def splits(memberships: DataFrame, corpus: str | None = None) -> DataFrame:
    own = memberships if corpus is None else memberships.filter(F.col("corpusRef") == corpus)
    return own.select("split").filter("split is not null").distinct().orderBy("split")


def annotation_layers(layers: DataFrame, kind: str | None = None, subkind: str | None = None) -> DataFrame:
    """Layers by kind and subkind, whatever the corpus."""
    wanted = [F.col(c) == v for c, v in (("kind", kind), ("subkind", subkind)) if v is not None]
    return reduce(lambda df, c: df.filter(c), wanted, layers)


def with_group(expressions: DataFrame, others: DataFrame, on: str, name: str, fields: list[str], order: str = "ord") -> DataFrame:
    """Each expression with the list of the rows that point to it, in order; an empty list if none does."""
    lists = others.groupBy(F.col(on).alias("uri")).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return expressions.join(lists, "uri", "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))


def with_annotations(expressions: DataFrame, layers: DataFrame, fields: list[str]) -> DataFrame:
    return with_group(expressions, layers, "expression", "layers", fields)


def with_segmentation(expressions: DataFrame, segmentations: DataFrame, fields: list[str]) -> DataFrame:
    return with_group(expressions, segmentations, "expression", "segmentations", fields)


def with_media(expressions: DataFrame, media: DataFrame, fields: list[str]) -> DataFrame:
    """Each expression with its medium, nulls where it has none or it is not loaded."""
    found = media.select(F.col("uri").alias("mediaRef"), *[F.col(f).alias(f"media_{f}") for f in fields])
    return expressions.join(found, "mediaRef", "left")


def references(records: DataFrame, value: str = "value") -> DataFrame:
    """``src, dst, ref_ord``: record uris in string values anywhere in a record, first seen first, without its own."""
    quoted = r'"(at://(?:[^"\\]|\\.)*)"'
    keys_out = F.regexp_replace(F.col(value), quoted + r"\s*:", '"":')
    found = F.regexp_extract_all(keys_out, F.lit(quoted), F.lit(1))
    plain = F.transform(found, lambda x: F.when(F.contains(x, F.lit("\\")), F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0]).otherwise(x))
    return records.select(F.col("uri").alias("src"), F.posexplode(F.array_distinct(plain)).alias("ref_ord", "dst")).filter("src != dst").select("src", "dst", F.col("ref_ord").cast("long").alias("ref_ord"))


def backrefs(edges: DataFrame, target: str) -> DataFrame:
    return edges.filter(F.col("dst") == target).select("src").distinct()


def lineage_cut(spark):
    """``checkpoint()`` to the folder that the cluster shares, as set in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a folder of its machine and a cluster one
    beside its warehouse.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        local = context.master.split("[")[0] == "local"
        own = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return lambda df: df.checkpoint()


def closure(spark, edges: DataFrame, seeds: DataFrame, known: DataFrame, depth: int | None = None, work=None) -> DataFrame:
    """``uri``: what can be reached from ``seeds`` over ``edges(src, dst)`` within ``known(uri)``; each once.

    The frontier is joined and anti-joined level by level.  A frontier's lineage is
    cut by ``checkpoint()`` to the folder that the cluster shares, if one is set.
    Levels have no limit; with ``depth`` one that would be cut off is an error.
    """
    cut, level = lineage_cut(spark), 0
    reached = frontier = cut(seeds.select("uri").join(known, "uri", "left_semi").distinct())
    while True:
        step = edges.join(frontier, edges.src == frontier.uri, "left_semi").select(F.col("dst").alias("uri")).distinct()
        frontier = cut(step.join(known, "uri", "left_semi").join(reached, "uri", "left_anti"))
        if frontier.isEmpty():
            return reached
        if level == depth:
            raise ValueError(f"records more than {depth} references from where they start")
        reached, level = cut(reached.unionAll(frontier)), level + 1


def type_counts(records: DataFrame, nsid: str = "nsid", namespace: str | None = None) -> DataFrame:
    """Records by collection: known kinds in display order, then others by name."""
    return records.groupBy(nsid).agg(F.count(F.lit(1)).alias("n")).orderBy(display_rank(nsid, namespace), nsid)


def inspect_counts(records: DataFrame, nsid: str = "nsid") -> DataFrame:
    """Counts by collection and their total, whose collection is null."""
    return records.rollup(nsid).agg(F.count(F.lit(1)).alias("n"))


def related(records: DataFrame, nsid: str, field: str, target: str) -> DataFrame:
    """Records of a collection whose top-level field is ``target``."""
    return records.filter((F.col("nsid") == nsid) & (F.get_json_object("value", f"$.{field}") == target))


def by_nsid(records: DataFrame) -> DataFrame:
    """Uris of each collection, sorted."""
    return records.groupBy(nsid_of("uri").alias("nsid")).agg(F.sort_array(F.collect_list("uri")).alias("uris"))


def summarize(records: DataFrame, value: str = "value", namespace: str | None = None) -> DataFrame:
    """``uri, nsid, cells``: one to three cells told by the kind, else the name, id, title or short uri."""

    def get(field: str):
        return F.coalesce(F.get_json_object(F.col(value), f"$.{field}"), F.lit(""))

    def short(field: str):
        return short_uri(get(field))

    def count(field: str):
        return F.coalesce(F.json_array_length(F.get_json_object(F.col(value), f"$.{field}")), F.lit(0)).cast("string")

    by_kind = {
        "corpus.corpus": (get("name"), get("domain"), get("expressionCount")),
        "expression.expression": (get("id"), get("kind"), truncate(get("text"), 60)),
        "annotation.annotationLayer": (get("kind"), get("subkind"), short("expression")),
        "ontology.ontology": (get("name"), get("domain"), get("version")),
        "ontology.typeDef": (get("name"), get("typeKind"), short("ontologyRef")),
        "resource.collection": (get("name"), get("kind"), get("version")),
        "resource.entry": (get("form"), count("components")),
        "judgment.experimentDef": (get("name"), get("measureType"), get("taskType")),
        "judgment.judgmentSet": (short("experimentRef"), count("judgments")),
        "judgment.agreementReport": (get("metric"), get("value"), get("numAnnotators")),
        "graph.graphEdgeSet": (get("edgeType"), count("edges")),
        "media.media": (get("kind"), get("title")),
        "persona.persona": (get("name"), get("domain"), get("kind")),
        "eprint.eprint": (get("eprintIdentifier"), get("linkType")),
    }
    name = F.coalesce(*(F.nullif(get(f), F.lit("")) for f in ("name", "id", "title")), short_uri("uri"))
    cells = F.array(name)
    for kind, own in by_kind.items():
        cells = F.when(kind_of("nsid", namespace) == kind, F.array(*own)).otherwise(cells)
    return records.select("uri", "nsid", cells.alias("cells"))


def load(records: DataFrame, uri: str, follow: bool = True, namespace: str | None = None, decodable=None) -> DataFrame:
    """The records of a corpus: all of its authority's, and what they refer to, over authorities and any number of steps.

    ``records`` has ``uri, value`` (JSON), as ``read_dump`` gives them.  Only record
    kinds are taken, each uri once; a reference to nothing, and a record that cannot be
    read as a JSON object or that the condition ``decodable`` turns down, is passed over.
    """
    readable = F.coalesce(F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull(), F.lit(False))
    own = records.filter(kind_of(nsid_of("uri"), namespace).isin(*KINDS) & readable & (F.lit(True) if decodable is None else decodable))
    own = own.groupBy("uri").agg(F.max("value").alias("value"))
    seeds = own.filter(authority_of("uri") == F.lit(uri.removeprefix("at://").split("/")[0]))
    if not follow:
        return seeds
    return own.join(closure(records.sparkSession, references(own), seeds, own.select("uri")), "uri", "left_semi")


def numbered(df: DataFrame, *order, name: str = "row_no", partition: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 within a partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*order)).cast("long") - 1)


class Corpus:
    """Record tables by name, with a corpus uri that limits expressions to its members."""

    def __init__(self, tables: dict[str, DataFrame], uri: str | None = None):
        self.tables, self.uri = tables, uri

    def expressions(self) -> DataFrame:
        return scoped(self.tables["expressions"], self.tables["memberships"], self.uri)

    def expression_uris(self) -> DataFrame:
        return self.expressions().orderBy("ord").select("uri")

    def annotation_layers(self, kind: str | None = None, subkind: str | None = None) -> DataFrame:
        return annotation_layers(self.tables["layers"], kind, subkind)

    def split(self, name: str) -> DataFrame:
        return split(self.tables["expressions"], self.tables["memberships"], name, self.uri)

    def splits(self) -> DataFrame:
        return splits(self.tables["memberships"], self.uri)

    def with_annotations(self, fields: list[str]) -> DataFrame:
        return with_annotations(self.expressions(), self.tables["layers"], fields)

    def with_segmentation(self, fields: list[str]) -> DataFrame:
        return with_segmentation(self.expressions(), self.tables["segmentations"], fields)

    def with_media(self, fields: list[str]) -> DataFrame:
        return with_media(self.expressions(), self.tables["media"], fields)

    def segmentations(self) -> DataFrame:
        return self.tables["segmentations"]

    def media(self) -> DataFrame:
        return self.tables["media"]

    def memberships(self) -> DataFrame:
        """Memberships of this corpus; all of them where it has no uri."""
        rows = self.tables["memberships"]
        return rows if self.uri is None else rows.filter(F.col("corpusRef") == self.uri)

    def corpus_record(self) -> DataFrame:
        """The corpus's own record: by its uri, else the first there is."""
        rows = self.tables["corpora"]
        return rows.orderBy("uri").limit(1) if self.uri is None else rows.filter(F.col("uri") == self.uri)

    def record(self, table: str, uri: str) -> DataFrame:
        return self.tables[table].filter(F.col("uri") == uri)

    def materialize(self, folder: str) -> list[str]:
        """Write the views: member expressions, and the annotations of all layers, of whatever corpus."""
        return materialize({"expressions": expressions_view(self.expressions()), "annotations": annotations_view(self.tables["layers"])}, folder)

    def save(self, store, message: str = "materialize corpus snapshot") -> str:
        """Commit every record of the tables to a version store, in JSON under its uri; the name of the commit."""
        parts = []
        for name in sorted(self.tables):
            fields = [c for c in self.tables[name].columns if c not in ("uri", "ord")]
            parts.append(self.tables[name].filter("uri is not null").select("uri", F.to_json(F.struct(*fields)).alias("value")))
        rows = reduce(DataFrame.unionAll, parts).select("uri", "value", F.lit(False).alias("is_tombstone"), F.monotonically_increasing_id().alias("ord"))
        return store.commit(rows, message)
