"""Helpers shared by the training-data operators: shared storage, lineage cuts, hashing."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators of this subpackage agree on.
SPACE = r"[\x20\x09-\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as set in ``spark.checkpoint.dir``.

    Where the session names none, a local session gets ``/tmp/checkpoints``
    (one machine, so it is shared) and a cluster a folder beside its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return root.rstrip("/")


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices, so that few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


class _Cleanup:
    """Shuffle files are deleted when a write ends, for as long as some thread of the session is writing a table."""

    lock, writing = threading.Lock(), {}

    def __init__(self, spark: SparkSession):
        self.conf, self.key = spark.conf, id(spark._jsparkSession)

    def __enter__(self):
        with self.lock:
            count, before = self.writing.get(self.key, (0, self.conf.get(_CLEANUP, None)))
            self.writing[self.key] = (count + 1, before)
            self.conf.set(_CLEANUP, "true")

    def __exit__(self, *error):
        with self.lock:
            count, before = self.writing.pop(self.key)
            if count > 1:
                self.writing[self.key] = (count - 1, before)
            elif before is None:
                self.conf.unset(_CLEANUP)
            else:
                self.conf.set(_CLEANUP, before)


class Workspace:
    """A fresh folder under the shared root for the intermediate tables of one operator run.

    Results are read from it lazily, so it stays while the driver's process lives and
    is deleted when that ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._made: list[str] = []
        atexit.register(self._delete)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later steps neither recompute it nor hold its lineage.

        The write's shuffle files are deleted when it has ended, as nothing else reads
        them; otherwise they stay until the driver happens to collect its garbage.
        """
        path = self.folder(name)
        with _Cleanup(self.spark):
            df.write.mode("overwrite").parquet(path)
        self._made.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        """Delete intermediate tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def append_columns(df: DataFrame, text_col: str, fields: list, make, keep: list[str]) -> DataFrame:
    """``df``'s columns ``keep`` as they are, and new columns that ``make(texts)`` gives for each Arrow batch.

    ``fields`` are the new columns' StructFields, ``make`` returns one list or
    numpy array for each.  Other columns never leave Arrow, so ids keep their
    type and nulls.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        for batch in sliced(batches):
            made = make(batch.column(len(keep)).to_pylist())
            yield pa.record_batch([*(batch.column(k) for k in range(len(keep))), *(pa.array(v, type=t) for v, t in zip(made, kinds, strict=True))], names)

    own = "_text"
    while own.lower() in map(str.lower, keep):
        own += "_"
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(own))
    return rows.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *fields]))
