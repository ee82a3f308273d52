"""Anchors resolved against text, tokens, signals and video."""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.anchors import MEDIA_KINDS, byte_slice, variant


def resolve_text(text: str, anchor: str = "anchor") -> Column:
    return byte_slice(text, F.col(f"{anchor}.textSpan.byteStart"), F.col(f"{anchor}.textSpan.byteEnd"))


def resolve_page(text: str, anchor: str = "anchor") -> Column:
    """The span on the page, or the whole page."""
    span = f"{anchor}.pageAnchor.textSpan"
    return F.when(F.col(span).isNotNull(), byte_slice(text, F.col(f"{span}.byteStart"), F.col(f"{span}.byteEnd"))).otherwise(F.col(text))


#: What the variants of an anchor select from.
TARGETS = {
    "text_span": "text", "page": "text", "token_ref": "tokens", "token_ref_sequence": "tokens", "temporal_span": "samples", "spatio_temporal": "frame",
    "external": "nothing",
}
#: Ways between keyframes, by name or by the end of their uri.
INTERPOLATIONS = ("linear", "step", "cubic")


def anchor_kind(anchor: str = "anchor") -> Column:
    """Which variant an anchor has; null for none."""
    return variant(anchor, MEDIA_KINDS)


def resolve_external(anchor: str = "anchor") -> Column:
    """The address of what lies outside; nothing is fetched."""
    source = F.col(f"{anchor}.externalTarget.source")
    return F.coalesce(source, F.raise_error(F.lit("an external anchor needs a source")).cast("string"))


def interpolation_of(anchor: str = "anchor") -> Column:
    """The way between keyframes: by name, else by the end of the uri where the anchor has one, else linear."""
    body = f"{anchor}.spatioTemporalAnchor"
    known = lambda c: F.when(c.isin(*INTERPOLATIONS), c)
    return F.coalesce(known(F.col(f"{body}.interpolation")), known(F.lower(F.regexp_extract(F.col(f"{body}.interpolation"), r"([^/#]+)/*$", 1))), F.lit("linear"))


def box_at(time: Column, anchor: str = "anchor") -> Column:
    """The box of a spatio-temporal anchor at a time, which is first brought inside the anchor's span."""
    body = f"{anchor}.spatioTemporalAnchor"
    start, end = F.col(f"{body}.temporalSpan.start"), F.col(f"{body}.temporalSpan.ending")
    inside = F.when(time < start, start).when(time > end, end).otherwise(time)
    frames = F.sort_array(F.filter(f"{body}.keyframes", lambda k: k.isNotNull()))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    full = F.transform(frames, lambda k: F.struct(zero(k["timeMs"]).cast("long").alias("timeMs"), F.struct(*(zero(k["bbox"][f]).alias(f) for f in BOX_FIELDS)).alias("bbox")))
    ways = {mode: interpolate(full, inside, list(BOX_FIELDS), mode) for mode in INTERPOLATIONS}
    way = interpolation_of(anchor)
    return F.when(way == "step", ways["step"]).when(way == "cubic", ways["cubic"]).otherwise(ways["linear"])


BOX_FIELDS = ("x", "y", "width", "height")


def resolve_anchors(rows: DataFrame, target: str, anchor: str = "anchor", **columns: str) -> DataFrame:
    """``rows`` with ``kind`` and ``resolved``: what each anchor selects from the row's own data.

    ``target`` says what data that is: ``text`` (column ``text``), ``tokens`` (an array
    column ``tokens``), ``samples`` (columns ``samples``, ``rate``, ``channels``) or
    ``frame`` (a column ``time`` in milliseconds; the box to cut out is resolved, and
    ``crop_frames`` cuts it).  An anchor that selects from other data, or that has no
    variant, is an error; an external one gives its source whatever the target.
    """
    if target not in ("text", "tokens", "samples", "frame"):
        raise ValueError(f"no target {target}")
    name = lambda c: columns.get(c, c)
    kind = anchor_kind(anchor)
    wrong = F.concat(F.coalesce(kind, F.lit("empty")), F.lit(f" anchors do not select from {target}"))
    if target == "text":
        made = F.when(kind == "text_span", resolve_text(name("text"), anchor)).when(kind == "page", resolve_page(name("text"), anchor)).when(kind == "external", resolve_external(anchor))
        made = made.otherwise(F.raise_error(wrong).cast("string"))
    elif target == "tokens":
        made = F.when(kind.isin("token_ref", "token_ref_sequence"), resolve_token(name("tokens"), anchor)).when(kind == "external", F.array(resolve_external(anchor)))
        made = made.otherwise(F.raise_error(wrong).cast("array<string>"))
    elif target == "samples":
        span = f"{anchor}.temporalSpan"
        edge = lambda c: F.coalesce(F.col(f"{span}.{c}"), F.lit(0))
        cut = window_of(F.col(name("samples")), edge("start"), edge("ending"), F.col(name("rate")), F.col(name("channels")))
        made = F.when(kind == "temporal_span", cut).otherwise(F.raise_error(wrong).cast(rows.schema[name("samples")].dataType))
    else:
        box = box_at(F.col(name("time")), anchor)
        made = F.when(kind == "spatio_temporal", box).otherwise(F.raise_error(wrong).cast("struct<x: double, y: double, width: double, height: double>"))
    return rows.withColumn("kind", kind).withColumn("resolved", made)


def resolve_token(tokens: str, anchor: str = "anchor") -> Column:
    """The token or tokens an anchor names, in its order."""
    one = F.col(f"{anchor}.tokenRef.tokenIndex")
    indexes = F.coalesce(F.col(f"{anchor}.tokenRefSequence.tokenIndexes"), F.when(one.isNotNull(), F.array(one)))
    return F.transform(indexes, lambda i: F.get(F.col(tokens), i.cast("int")))


def ms_to_sample(ms: Column, rate: Column) -> Column:
    return F.when((ms < 0) | (rate <= 0), F.raise_error(F.lit("negative time or rate"))).otherwise(F.floor(ms * rate / 1000).cast("long"))


def sample_to_ms(sample: Column, rate: Column) -> Column:
    return F.when((sample < 0) | (rate <= 0), F.raise_error(F.lit("negative sample or rate"))).otherwise(F.floor(sample * 1000 / rate).cast("long"))


def window_of(samples: Column, start_ms: Column, end_ms: Column, rate: Column, channels: Column) -> Column:
    """Interleaved samples of a time window, whole frames."""
    a, b = ms_to_sample(start_ms, rate), ms_to_sample(end_ms, rate)
    frames = F.floor(F.size(samples) / channels)
    a, b = F.least(a, frames), F.least(b, frames)
    return F.when(end_ms < start_ms, F.raise_error(F.lit("the window ends before it starts"))).otherwise(F.slice(samples, (a * channels + 1).cast("int"), ((b - a) * channels).cast("int")))


def select_channels(samples: str, channels: str, names: list[str]) -> Column:
    """Channels by name in the order asked for; an unknown one is an error."""
    place = lambda n: F.when(F.array_position(channels, n) == 0, F.raise_error(F.lit(f"no channel {n}"))).otherwise(F.array_position(channels, n))
    return F.array(*[F.element_at(samples, place(n).cast("int")) for n in names])


def events_in_windows(windows: DataFrame, events: DataFrame, key: str, width: int) -> DataFrame:
    """Events of a key inside half-open windows, by an equi-join on ``width``-wide stretches of time."""
    w = windows.withColumn("_s", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width))))
    e = events.withColumn("_s", F.floor(F.col("t") / width))
    return w.join(e, [key, "_s"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("_s")


def smooth(x: Column) -> Column:
    return x * x * (F.lit(3) - 2 * x)


def interpolate(keyframes: Column, t: Column, fields: list[str], mode: str = "linear") -> Column:
    """A box at a time between its keyframes (sorted by ``timeMs``): clamped at the ends, then linear, step or cubic."""
    before = F.filter(keyframes, lambda k: k["timeMs"] <= t)
    after = F.filter(keyframes, lambda k: k["timeMs"] > t)
    a = F.coalesce(F.try_element_at(before, F.lit(-1)), F.get(keyframes, F.lit(0)))
    b = F.coalesce(F.get(after, F.lit(0)), F.try_element_at(keyframes, F.lit(-1)))
    span = b["timeMs"] - a["timeMs"]
    share = F.when((span <= 0) | (t <= a["timeMs"]), F.lit(0.0)).otherwise(F.least((t - a["timeMs"]) / span, F.lit(1.0)))
    share = {"linear": share, "step": F.lit(0.0), "cubic": smooth(share)}[mode]
    return F.struct(*[(a["bbox"][f] + (b["bbox"][f] - a["bbox"][f]) * share).alias(f) for f in fields])


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time, by one sorted pass."""
    from pyspark.sql import Window

    l_ = left.select(key, time, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*fields).alias("x")).schema["x"].dataType).alias("_r"), F.lit(1).alias("_side"))
    r_ = right.select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l"), F.struct(*fields).alias("_r"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = l_.unionByName(r_).withColumn("_last", F.last("_r", ignorenulls=True).over(order)).filter("_side = 1")
    return seen.select("_l.*", *[F.col(f"_last.{f}").alias(f"asof_{f}") for f in fields])


def crop(frame: bytes, width: int, height: int, box: tuple[float, float, float, float]) -> bytes:
    """The pixels (3 bytes each) of a box inside a frame."""
    x, y, w, h = (int(v) for v in box)
    if x < 0 or y < 0 or w <= 0 or h <= 0 or x + w > width or y + h > height:
        raise ValueError("the box is not inside the frame")
    return np.frombuffer(frame, np.uint8).reshape(height, width, 3)[y : y + h, x : x + w].tobytes()


def crop_frames(frames: DataFrame) -> DataFrame:
    """``frame_id, cropped`` from frames with their size and box, in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            cut = [crop(r["pixels"], r["width"], r["height"], (r["x"], r["y"], r["w"], r["h"])) for r in rows]
            yield pa.record_batch([pa.array([r["frame_id"] for r in rows], pa.int64()), pa.array(cut, pa.binary())], ["frame_id", "cropped"])

    return frames.mapInArrow(run, "frame_id long, cropped binary")


def decode_wave(content: bytes) -> tuple[int, int, list[int]]:
    """Rate, channels and interleaved samples of uncompressed sound; ValueError for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as sound:
            rate, channels, width, raw = sound.getframerate(), sound.getnchannels(), sound.getsampwidth(), sound.readframes(sound.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from e
    if width == 1:  # unsigned
        return rate, channels, (np.frombuffer(raw, np.uint8).astype(np.int64) - 128).tolist()
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return rate, channels, (wide.view("<i4").ravel() >> 8).tolist()
    return rate, channels, np.frombuffer(raw, f"<i{width}").tolist()


def decode_sounds(files: DataFrame) -> DataFrame:
    """``key, rate, channels, samples, error`` of ``key, content`` rows; what is no uncompressed sound has an error instead."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for content in batch.column(1).to_pylist():
                try:
                    rows.append((*decode_wave(content or b""), None))
                except ValueError as e:
                    rows.append((None, None, None, str(e) or "no sound"))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["key", "rate", "channels", "samples", "error"])

    return files.select(F.col("key").cast("string"), "content").mapInArrow(run, "key string, rate int, channels int, samples array<long>, error string")


def resolve_media(media: DataFrame) -> DataFrame:
    """Where a medium's bytes are: its blob before an external address."""
    return media.select("uri", F.coalesce("blob.cid", "externalUri").alias("address"), F.when(F.col("blob.cid").isNotNull(), "blob").when(F.col("externalUri").isNotNull(), "external").otherwise("none").alias("place"), F.coalesce("mimeType", "blob.mimeType", F.lit("application/octet-stream")).alias("mime_type"))


def verified(blobs: DataFrame) -> DataFrame:
    """Blobs with ``ok``: whether their bytes have the digest they are stored under."""
    return blobs.withColumn("ok", F.sha2("content", 256) == F.col("sha256"))


class BlobCache:
    """Contents by key in a folder; a key that is a SHA-256 in hex is held against its content."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def _checked(keys: DataFrame) -> DataFrame:
        """A key is one part of a path, so that it cannot lead out of the folder."""
        bad = F.col("key").isNull() | F.col("key").isin("", ".", "..") | F.col("key").rlike(r"[/\\\\]")
        return keys.withColumn("key", F.when(bad, F.raise_error(F.lit("a key must be one part of a path"))).otherwise(F.col("key")))

    def put(self, blobs: DataFrame, verify: bool = True) -> None:
        """Store ``key, content``; one of a key's contents where it is given more than once.  A wrong digest is an error and stores nothing."""
        rows = self._checked(blobs.select("key", "content")).groupBy("key").agg(F.max("content").alias("content"))
        wrong = F.col("key").rlike("^[0-9a-f]{64}$") & (F.sha2("content", 256) != F.col("key"))
        if verify:
            rows = rows.withColumn("content", F.when(wrong, F.raise_error(F.concat(F.lit("the content is not that of "), "key")).cast("binary")).otherwise(F.col("content")))
        known = self._all()
        rows.join(known.select("key"), "key", "left_anti").write.mode("append").parquet(self.folder)

    def get(self, keys: DataFrame) -> DataFrame:
        """``key, content`` of ``keys(key)``; null where there is none."""
        found = self._all().groupBy("key").agg(F.max("content").alias("content"))
        return self._checked(keys.select("key")).distinct().join(found, "key", "left")

    def exists(self, keys: DataFrame) -> DataFrame:
        return self._checked(keys.select("key")).join(self._all().select("key", F.lit(True).alias("there")).distinct(), "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("there"))

    def _all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        schema = "key string, content binary"
        return self.spark.read.schema(schema).parquet(self.folder) if there else self.spark.createDataFrame([], schema)
