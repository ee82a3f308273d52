"""Nested records to columnar views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.anchors import ANCHOR, FLAT, flatten_anchor, variant
from corpuslake.functions.uri import nsid_of

ANNOTATION = T.StructType([
    T.StructField("anchor", ANCHOR), T.StructField("confidence", T.LongType()), T.StructField("headIndex", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("targetIndex", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tokenIndex", T.LongType()), T.StructField("value", T.StringType()),
])
LAYER = T.StructType([
    T.StructField("annotations", T.ArrayType(ANNOTATION)), T.StructField("expression", T.StringType()), T.StructField("formalism", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("subkind", T.StringType()), T.StructField("tokenizationId", T.StringType()),
])


def scalars(schema: T.StructType) -> list[str]:
    """Fields that hold one value; nested ones are left out of views."""
    return [f.name for f in schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]


def records_view(df: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Scalar fields, then the flat anchor columns if records have an anchor."""
    anchored = anchor in df.columns
    return df.select(*[c for c in scalars(df.schema) if not anchored or c not in FLAT], *(flatten_anchor(anchor) if anchored else []))


def expressions_view(df: DataFrame) -> DataFrame:
    return records_view(df)


def annotations_view(layers: DataFrame, uri: str = "uri", full: bool = False) -> DataFrame:
    """One row for each annotation of each layer; layers without annotations give none.

    ``full`` adds the layer's expression, kind and subkind.
    """
    kept = [F.col(uri).alias("layer_uri")]
    if full:
        kept += [F.col("expression"), F.col("kind").alias("layer_kind"), F.col("subkind").alias("layer_subkind")]
    rows = layers.select(*kept, F.posexplode("annotations").alias("annotation_index", "a"))
    inner = layers.schema["annotations"].dataType.elementType
    own = "tokenIndex" in inner.names
    flat = [c for c, n in zip(flatten_anchor("a.anchor"), FLAT, strict=True) if not (own and n == "token_index")]
    # an annotation's own token index and that of its anchor are one column
    fields = [F.coalesce("a.tokenIndex", "a.anchor.tokenRef.tokenIndex").alias("token_index") if n == "tokenIndex" else F.col(f"a.{n}").alias(_snake(n)) for n in scalars(inner)]
    head = [c for c in rows.columns if c not in ("a", "annotation_index")]
    return rows.select(*head, F.col("annotation_index").cast("long").alias("annotation_index"), *fields, *flat)


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def explode_layer(layers: DataFrame, uri: str = "uri") -> DataFrame:
    """Annotations with their layer's kind and the property name of their anchor's variant; null elements are skipped, indexes kept."""
    rows = layers.select(F.col(uri).alias("layer_uri"), F.col("kind").alias("layer_kind"), F.col("subkind").alias("layer_subkind"), F.posexplode("annotations").alias("annotation_index", "a"))
    return rows.filter("a is not null").select("layer_uri", F.col("annotation_index").cast("long").alias("annotation_index"), "layer_kind", "layer_subkind", "a.label", "a.value", variant("a.anchor", default="none").alias("anchor_kind"))


def materialize(views: dict[str, DataFrame], folder: str, files: int | None = None) -> list[str]:
    """Write each view that has columns to ``folder/name.parquet``, by name; ``files`` bounds the files of each."""
    written = []
    for name in sorted(views):
        df = views[name]
        if df.columns:
            (df.coalesce(files) if files else df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            written.append(f"{folder}/{name}.parquet")
    return written


def views_by_kind(records: DataFrame, nsids: list[str], schemas: dict[str, T.StructType], uri: str = "uri", value: str = "value") -> dict[str, DataFrame]:
    """A view for each collection, from JSON values read with its schema; undecodable records are left out."""
    views = {}
    for nsid in nsids:
        rows = records.filter(nsid_of(uri) == nsid).select(uri, F.from_json(value, schemas[nsid], {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select(uri, "r.*")
        views[nsid.replace(".", "_")] = records_view(rows)
    return views


def materialize_records(records: DataFrame, folder: str, schemas: dict[str, T.StructType], expressions: str, layers: str) -> list[str]:
    """All views of a record table ``uri, value`` (JSON): expressions, exploded annotations, and one for each other collection.

    ``schemas`` are by collection name; ``expressions`` and ``layers`` name the two
    collections that have views of their own.  Records that cannot be read with their
    schema are left out, and views without rows are not written.
    """
    views = {}
    for nsid, schema in schemas.items():
        wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        read = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        rows = records.filter(nsid_of("uri") == nsid).select("uri", read.alias("r")).filter("r is not null and r._bad is null").select("uri", *(F.col(f"r.{f.name}") for f in schema))
        view = annotations_view(rows) if nsid == layers else expressions_view(rows) if nsid == expressions else records_view(rows)
        if not rows.isEmpty():
            views[{expressions: "expressions", layers: "annotations"}.get(nsid, nsid.replace(".", "_"))] = view
    return materialize(views, folder)


# Dtype names of scalar types.
DTYPES = {"string": "string", "bigint": "int64", "int": "int64", "boolean": "bool", "double": "float64", "float": "float64", "binary": "binary", "timestamp": "timestamp", "variant": "struct"}


def dtype_of(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"sequence<{dtype_of(kind.elementType)}>"
    return "struct" if isinstance(kind, (T.StructType, T.MapType)) else DTYPES.get(kind.simpleString(), "string")


def features_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, dtype and nullability of each field."""
    return [(f.name, dtype_of(f.dataType), f.nullable) for f in df.schema]
