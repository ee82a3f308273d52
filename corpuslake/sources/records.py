"""Record sources and sinks: JSON-line dumps, decoding with failures apart, Parquet views, a registry of adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = "uri string, cid string, value string"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes ``uri, cid, value`` (JSON text) from a dump with one JSON object a line."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    get = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    return lines.filter("v is not null").select(get("uri", "string").alias("uri"), get("cid", "string").alias("cid"), F.to_json(F.try_variant_get("v", "$.value", "variant")).alias("value"))


def decode(envelopes: DataFrame, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed records, and failures as ``uri, cid, error``; one bad record does not fail the others.

    The wire's type marker is dropped; a record fails if it is not JSON of the schema
    or lacks a required field.
    """
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = envelopes.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.lit("not valid JSON of this type"))
    for name in required:
        error = F.coalesce(error, F.when(F.col(f"r.{name}").isNull(), F.lit(f"no {name}")))
    marked = read.withColumn("error", error)
    good = marked.filter("error is null").select("uri", "cid", *[F.col(f"r.{f.name}") for f in schema.fields])
    return good, marked.filter("error is not null").select("uri", "cid", "error")


def blob_ref(value: str) -> F.Column:
    """A blob in wire form (``ref.$link``, ``mimeType``, ``size``) as a struct."""
    get = lambda p: F.get_json_object(value, p)
    return F.struct(F.coalesce(get("$.ref['$link']"), get("$.cid")).alias("cid"), get("$.mimeType").alias("mime_type"), get("$.size").cast("long").alias("size"))


class Registry:
    """Named adapters; what was added last under a name holds.  With a ``port``, what an adapter makes must offer it."""

    def __init__(self, port: type | None = None):
        self.port = port
        self._found: dict[str, Callable] = {}

    def add(self, name: str, make: Callable) -> None:
        self._found[name] = make

    def make(self, name: str, *args, **options):
        made = self.get(name)(*args, **options)
        if self.port is not None and not isinstance(made, self.port):
            raise TypeError(f"{name} is no {self.port.__name__}")
        return made

    def get(self, name: str) -> Callable:
        if name not in self._found:
            raise KeyError(f"no adapter {name}; there are {', '.join(self.available())}")
        return self._found[name]

    def available(self) -> list[str]:
        return sorted(self._found)
