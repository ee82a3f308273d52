"""A dataset index kept current from a stream of commit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.sources.files import Folder

EVENT = "seq bigint, op_ord int, repo string, collection string, rkey string, action string, record string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of commit events from JSON-line files; an offset log makes it resume where it stopped."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def wanted(events: DataFrame, collections: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Events of the collections asked for; deletes carry no record."""
    if collections:
        return events.filter(F.col("collection").isin(*collections))
    return events.filter(F.startswith("collection", F.lit(prefix))) if prefix else events


def outcomes(events: DataFrame, index: DataFrame) -> DataFrame:
    """``uri, record, outcome`` of the last event of each uri: built, unchanged, removed or skipped.

    Within a batch the last event by ``(seq, op_ord)`` holds; the index has ``uri, record``.
    """
    uri = F.concat(F.lit("at://"), "repo", F.lit("/"), "collection", F.lit("/"), "rkey")
    last = events.withColumn("uri", uri).groupBy("uri").agg(F.max_by(F.struct("action", "record"), F.struct("seq", "op_ord")).alias("e"), F.max("seq").alias("seq"))
    joined = last.join(index.select("uri", F.col("record").alias("old")), "uri", "left")
    action, record, old = F.col("e.action"), F.col("e.record"), F.col("old")
    readable = F.try_parse_json(record).isNotNull()
    outcome = (
        F.when(action == "delete", F.when(old.isNull(), "skipped").otherwise("removed"))
        .when(~action.isin("create", "update") | ~readable, "skipped")
        .when(old.eqNullSafe(record), "unchanged")
        .otherwise("built")
    )
    return joined.select("uri", record.alias("record"), "seq", outcome.alias("outcome"))


def apply_outcomes(index: DataFrame, found: DataFrame) -> DataFrame:
    changed = found.filter(F.col("outcome").isin("built", "removed"))
    return index.select("uri", "record").join(changed, "uri", "left_anti").unionByName(changed.filter("outcome = 'built'").select("uri", "record"))


class IndexWriter:
    """``foreachBatch`` target: an index ``uri, record`` as a base and the changes of each batch since.

    A batch reads the base and the changes behind it, by the uris that it has events
    of, and writes its own changes and then a note that they are whole; readers take
    noted batches only, and a repeated batch writes its changes anew.  Every
    ``compact_every`` batches the changes are folded into a new base.  The old base
    and its changes stay until the base after it is noted, for readers that hold them.
    """

    ROWS = "uri string, record string, gone boolean"

    def __init__(self, folder: str, compact_every: int = 20):
        self.folder, self.compact_every = folder.rstrip("/"), compact_every

    def _notes(self, spark: SparkSession) -> Folder:
        return Folder(spark, f"{self.folder}/notes")

    def _known(self, spark: SparkSession, before: int | None) -> tuple[int | None, list[int]]:
        """The last base and the batches behind it."""
        found = {"base": [], "batch": []}
        for name in self._notes(spark).names():
            kind, _, number = name.removesuffix(".json").partition("-")
            if kind in found and number.isdigit() and (before is None or int(number) < before):
                found[kind].append(int(number))
        base = max(found["base"], default=None)
        return base, sorted(n for n in found["batch"] if base is None or n > base)

    def _changes(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Base and changes with the number of the batch that made them."""
        base, batches = self._known(spark, before)
        rows = spark.createDataFrame([], f"{self.ROWS}, batch long")
        folders = ([] if base is None else [(base, f"base-{base:012d}")]) + [(n, f"batch-{n:012d}") for n in batches]
        for n, name in folders:
            rows = rows.unionAll(spark.read.schema(self.ROWS).parquet(f"{self.folder}/{name}").withColumn("batch", F.lit(n).cast("long")))
        return rows

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("uri").agg(F.max_by(F.struct("record", "gone"), "batch").alias("l"))
        return last.filter("not l.gone").select("uri", "l.record")

    def latest(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The index as the noted batches leave it."""
        return self._last(self._changes(spark, before))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        uri = F.concat(F.lit("at://"), "repo", F.lit("/"), "collection", F.lit("/"), "rkey")
        known = self._changes(spark, number).join(batch.select(uri.alias("uri")).distinct(), "uri", "left_semi")
        changed = outcomes(batch, self._last(known)).filter(F.col("outcome").isin("built", "removed"))
        rows = changed.select("uri", "record", (F.col("outcome") == "removed").alias("gone"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch-{number:012d}")
        self._notes(spark).write(f"batch-{number:012d}.json", {"batch": number}, replace=True)
        base, batches = self._known(spark, None)
        if len(batches) >= self.compact_every:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Fold all noted changes into a new base, and delete what the base before it stood on."""
        base, batches = self._known(spark, None)
        if not batches:
            return
        new = batches[-1]
        self.latest(spark).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.folder}/base-{new:012d}")
        notes, rows = self._notes(spark), Folder(spark, self.folder)
        notes.write(f"base-{new:012d}.json", {"base": new}, replace=True)
        for name in notes.names():
            kind, _, number = name.removesuffix(".json").partition("-")
            old = number.isdigit() and base is not None and (int(number) < base or (kind == "batch" and int(number) == base))
            if old:
                notes.delete(name)
                rows.delete(name.removesuffix(".json"))


def update_index(events: DataFrame, folder: str, checkpoint: str):
    """Run all events there are through the index; the checkpoint folder keeps the cursor."""
    return events.writeStream.foreachBatch(IndexWriter(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, for streams or tables (an extension of this engine)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user, closed by a gap (an extension of this engine)."""
    rows = events.withWatermark(time, gap) if events.isStreaming else events
    return rows.groupBy(user, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
