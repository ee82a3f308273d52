"""Exports for model training: task columns, tensors, batches and shards."""

from __future__ import annotations

import io
import json
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Training tasks by layer kind, subkind and formalism (null: any), with their columns.
TASKS = (
    ("token-classification", "token-tag", "pos", None, ("tokens", "labels", "token_index")),
    ("token-classification", "token-tag", "ner", None, ("tokens", "labels", "token_index")),
    ("token-classification", "token-tag", None, None, ("tokens", "labels", "token_index")),
    ("extractive-question-answering", "span", None, None, ("label", "byte_start", "byte_end")),
    ("dependency-parsing", "tree", None, "universal-dependencies", ("token_index", "label", "byte_start", "byte_end")),
    ("dependency-parsing", "tree", None, None, ("token_index", "label", "byte_start", "byte_end")),
    ("text-classification", "document-tag", None, None, ("label",)),
    ("automatic-speech-recognition", "tier", "forced-alignment", None, ("label", "t_start_ms", "t_end_ms")),
    ("object-detection", "span", "bounding-box", None, ("label", "bbox_x", "bbox_y", "bbox_w", "bbox_h")),
    ("object-tracking", "span", "spatio-temporal", None, ("label", "t_start_ms", "t_end_ms", "bbox_x", "bbox_y")),
)


def tasks(layers: DataFrame) -> DataFrame:
    """Layers with the most specific task that fits them, or null."""
    found = F.lit(None).cast("string")
    for task, kind, subkind, formalism, _ in sorted(TASKS, key=lambda t: (t[2] is not None) + (t[3] is not None)):
        fits = (F.col("kind") == kind) & (F.lit(True) if subkind is None else F.col("subkind") == subkind) & (F.lit(True) if formalism is None else F.col("formalism") == formalism)
        found = F.when(F.coalesce(fits, F.lit(False)), task).otherwise(found)
    return layers.withColumn("task", found)


def project(view: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in view.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}")
    return view.select(*columns)


def tensors(view: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns; a null in one of them is an error when rows are read."""
    columns = columns or [f.name for f in view.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return project(view, columns).select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c)).alias(c) for c in columns])


def batches(view: DataFrame, order: str, size: int, seed: int | None = None, drop_remainder: bool = False) -> DataFrame:
    """Rows with their batch number, in order or shuffled by a seeded hash of it."""
    from corpuslake.operators.versions import number_rows

    key = [F.col(order)] if seed is None else [F.xxhash64(F.lit(seed), F.col(order)), F.col(order)]
    placed = number_rows(view, key).withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    if not drop_remainder:
        return placed
    whole = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == size)
    return placed.join(whole.select("batch"), "batch", "left_semi")


def shards(view: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Rows with shard and zero-padded key within it."""
    from corpuslake.operators.versions import number_rows

    placed = number_rows(view, [F.col(order)])
    return placed.withColumn("shard", F.floor(F.col("place") / size).cast("long")).withColumn("key", F.lpad((F.col("place") % size).cast("string"), 8, "0"))


def write_shards(view: DataFrame, order: str, size: int = 1000, members: dict[str, str] | None = None) -> DataFrame:
    """``shard, n, tar``: tar files with a JSON member for each row, one task for each shard.

    ``members`` names binary columns by file ending: their contents become members of
    their own beside the JSON, which then lacks them; a null one is left out.
    """
    members = members or {}
    if missing := [c for c in members.values() if c not in view.columns]:
        raise KeyError(f"no column {', '.join(missing)}")

    def pack(key, rows):
        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for row in rows.sort_values("key").itertuples():
                files = {"json": row.value.encode()} | {ending: row.media[k] for k, ending in enumerate(members)}
                for ending, data in sorted(files.items()):
                    if data is not None:
                        info = tarfile.TarInfo(f"{row.key}.{ending}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "tar": [out.getvalue()]})

    value = F.to_json(F.struct(*(c for c in view.columns if c not in members.values())))
    media = F.array(*members.values()).cast("array<binary>") if members else F.array().cast("array<binary>")
    return shards(view, order, size).select("shard", "key", value.alias("value"), media.alias("media")).groupBy("shard").applyInPandas(pack, "shard long, n long, tar binary")


def provenance(name: str, revision: str, counts: dict[str, int]) -> str:
    """A card for a published set, as JSON."""
    return json.dumps({"dataset": name, "revision": revision, "views": counts}, sort_keys=True)


def log_revision(spark, folder: str, run: str, revision: str, counts: dict[str, int], **notes: str) -> None:
    """Append what a training run was fed with to a table: the revision, the views' rows and any notes."""
    row = [(run, revision, counts, {k: str(v) for k, v in notes.items()})]
    spark.createDataFrame(row, "run string, revision string, counts map<string, long>, notes map<string, string>").withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(folder)


def revisions_of(spark, folder: str, run: str) -> DataFrame:
    return spark.read.parquet(folder).filter(F.col("run") == run).orderBy("logged_at")
