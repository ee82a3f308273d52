"""Anchors: the places in text, tokens, time, space, pages or sources that annotations point to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("byteStart", "byteEnd", "charStart", "charEnd")])
UUID = T.StructType([T.StructField("value", T.StringType())])
TIME = T.StructType([T.StructField("start", T.LongType()), T.StructField("ending", T.LongType())])
BOX = T.StructType([T.StructField(n, T.LongType()) for n in ("x", "y", "width", "height")])
KEYFRAME = T.StructType([T.StructField("timeMs", T.LongType()), T.StructField("bbox", BOX)])
#: One optional field for each variant, in the order in which they are tried.
ANCHOR = T.StructType([
    T.StructField("textSpan", SPAN),
    T.StructField("tokenRefSequence", T.StructType([T.StructField("tokenizationId", UUID), T.StructField("tokenIndexes", T.ArrayType(T.LongType()))])),
    T.StructField("tokenRef", T.StructType([T.StructField("tokenizationId", UUID), T.StructField("tokenIndex", T.LongType())])),
    T.StructField("temporalSpan", TIME),
    T.StructField("spatioTemporalAnchor", T.StructType([T.StructField("temporalSpan", TIME), T.StructField("keyframes", T.ArrayType(KEYFRAME)), T.StructField("interpolation", T.StringType())])),
    T.StructField("pageAnchor", T.StructType([T.StructField("page", T.LongType()), T.StructField("textSpan", SPAN), T.StructField("boundingBox", BOX)])),
    T.StructField("externalTarget", T.StructType([T.StructField("source", T.StringType())])),
])

#: Kind names by variant in flattened views, in record views and in media resolution.
VIEW_KINDS = {"textSpan": "span", "tokenRefSequence": "tokenRefSequence", "tokenRef": "tokenRef", "temporalSpan": "temporalSpan", "spatioTemporalAnchor": "spatioTemporal", "pageAnchor": "page", "externalTarget": "external"}
MEDIA_KINDS = {"textSpan": "text_span", "tokenRefSequence": "token_ref_sequence", "tokenRef": "token_ref", "temporalSpan": "temporal_span", "spatioTemporalAnchor": "spatio_temporal", "pageAnchor": "page", "externalTarget": "external"}

FLAT = ("anchor_kind", "byte_start", "byte_end", "token_id", "token_index", "token_indexes", "t_start_ms", "t_end_ms", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "page", "ext_source")


def variant(anchor: str, kinds: dict[str, str] | None = None, default: str | None = None) -> Column:
    """The name of the first variant that is set."""
    names = kinds or {f.name: f.name for f in ANCHOR.fields}
    found = F.lit(default).cast("string")
    for field in reversed(ANCHOR.fields):
        found = F.when(F.col(f"{anchor}.{field.name}").isNotNull(), names[field.name]).otherwise(found)
    return found


def flatten_anchor(anchor: str = "anchor") -> list[Column]:
    """The fourteen flat columns of an ``ANCHOR`` struct; only the first variant that is set fills them."""
    which = variant(anchor)

    def take(kind_type: str, **paths: str) -> Column:
        found = F.lit(None).cast(kind_type)
        for name, path in paths.items():
            found = F.when(which == name, F.col(f"{anchor}.{name}.{path}")).otherwise(found)
        return found

    first_box = {"pageAnchor": "boundingBox"}
    values = [
        variant(anchor, VIEW_KINDS),
        take("long", textSpan="byteStart", pageAnchor="textSpan.byteStart"),
        take("long", textSpan="byteEnd", pageAnchor="textSpan.byteEnd"),
        take("string", tokenRef="tokenizationId.value", tokenRefSequence="tokenizationId.value"),
        take("long", tokenRef="tokenIndex"),
        take("array<long>", tokenRefSequence="tokenIndexes"),
        take("long", temporalSpan="start", spatioTemporalAnchor="temporalSpan.start"),
        take("long", temporalSpan="ending", spatioTemporalAnchor="temporalSpan.ending"),
        *[take("long", **{k: f"{p}.{side}" for k, p in first_box.items()}) for side in ("x", "y", "width", "height")],
        take("long", pageAnchor="page"),
        take("string", externalTarget="source"),
    ]
    return [v.alias(n) for v, n in zip(values, FLAT, strict=True)]


def int_at(value: Column, path: str) -> Column:
    """The integer at a path of a variant: fractions are cut off, truth values and texts are no number."""
    found = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(found)
    number = F.try_variant_get(value, path, "double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.when(kind == "BIGINT", F.try_variant_get(value, path, "bigint")).when(kind.isin("DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), whole.cast("long"))


def uuid_at(value: Column, path: str) -> Column:
    """An id at a path of a variant: a text, or the ``value`` of an object."""

    def text(p: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(value, p, "variant")) == "STRING", F.try_variant_get(value, p, "string"))

    return F.coalesce(text(path), text(f"{path}.value"))


def anchor_of(value: Column | str) -> Column:
    """An ``ANCHOR`` struct from its JSON text, as it is sent: an object with one field for each variant.

    Numbers are read as ``int_at`` reads them; what is not such an object is an anchor
    without a variant.
    """
    v = F.try_parse_json(F.col(value) if isinstance(value, str) else value)

    def there(path: str, kind: T.DataType, struct: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("OBJECT"))
        return F.when(F.coalesce(is_object, F.lit(False)), struct).cast(kind)

    def build(path: str, kind: T.DataType) -> Column:
        if kind == UUID:
            return F.when(uuid_at(v, path).isNotNull(), F.struct(uuid_at(v, path).alias("value"))).cast(UUID)
        if isinstance(kind, T.StructType):
            return there(path, kind, F.struct(*(build(f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.LongType):
            return int_at(v, path)
        if isinstance(kind, T.ArrayType):
            return F.try_variant_get(v, path, kind.simpleString())
        return F.try_variant_get(v, path, "string")

    return F.struct(*(build(f"$.{f.name}", f.dataType).alias(f.name) for f in ANCHOR))


def anchor_tokens(anchor: str = "anchor") -> Column:
    """Token indexes an anchor refers to, or null."""
    one = F.col(f"{anchor}.tokenRef.tokenIndex")
    return F.coalesce(F.col(f"{anchor}.tokenRefSequence.tokenIndexes"), F.when(one.isNotNull(), F.array(one)))


def anchor_bytes(anchor: str = "anchor") -> Column:
    """Byte span of text or page anchors as a struct, or null."""
    return F.coalesce(F.col(f"{anchor}.textSpan"), F.col(f"{anchor}.pageAnchor.textSpan"))


def anchor_time(anchor: str = "anchor") -> Column:
    return F.coalesce(F.col(f"{anchor}.temporalSpan"), F.col(f"{anchor}.spatioTemporalAnchor.temporalSpan"))


def byte_slice(text: Column | str, start: Column, end: Column) -> Column:
    """``text[start:end]`` in UTF-8 bytes with clamped bounds (null: 0); broken characters become U+FFFD."""
    raw = (F.col(text) if isinstance(text, str) else text).cast("binary")
    size = F.octet_length(raw)
    a = F.least(F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), size)
    b = F.least(F.greatest(F.coalesce(end, F.lit(0)), F.lit(0)), size)
    part = F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.make_valid_utf8(part.cast("string"))


def char_offset(text: Column | str, at: Column) -> Column:
    """The character that a byte offset falls on."""
    return F.length(byte_slice(text, F.lit(0), at))
