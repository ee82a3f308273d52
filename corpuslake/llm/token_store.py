"""Token-id files: patched frame-of-reference blocks with a block index.

A file holds the ids of consecutive documents.  Ids are cut into blocks of 256.
A block subtracts its minimum and packs the rest at the width that a percentile
of its values needs; values that do not fit are outliers, kept in an exception
list (place in the block, full difference) that patches the block when read.
``block_starts`` gives each block's place, so a block can be read alone.

Layout (little-endian): ``b"CLTF"``, u32 version, u32 part, u32 documents, u64 ids
of the part before this file, u64 ids, u64 blocks; then the document ids (i64),
null flags (u8), token counts (u64), block starts (u64), and the block bytes.
A block is u32 minimum, u8 width, u16 exceptions, packed bits, exception places
(u8), exception values (u32).
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import Workspace
from corpuslake.llm.tokens import END_ID, default_tokenizer, encoder

MAGIC, VERSION, BLOCK = b"CLTF", 1, 256
#: So many blocks are packed or unpacked at once.
_AT_ONCE = 512
_HEAD = struct.Struct("<4sIIIQQQ")
_BLOCK_HEAD = struct.Struct("<IBH")


def _word(width: int) -> np.dtype:
    """The smallest big-endian number that holds so many bits."""
    return np.dtype(">u1" if width <= 8 else ">u2" if width <= 16 else ">u4")


def pack_ids(ids: np.ndarray, percentile: float = 90.0) -> tuple[np.ndarray, bytes]:
    """Block starts and block bytes of unsigned 32-bit ids; a short last block is filled with its own last id."""
    parts = [_pack(ids[at : at + _AT_ONCE * BLOCK], percentile) for at in range(0, len(ids), _AT_ONCE * BLOCK)]
    before = np.cumsum([0, *(len(data) for _, data in parts)])
    return np.concatenate([np.zeros(0, "<u8"), *(starts + np.uint64(n) for (starts, _), n in zip(parts, before, strict=False))]), b"".join(data for _, data in parts)


def _pack(ids: np.ndarray, percentile: float) -> tuple[np.ndarray, bytes]:
    whole = -(-len(ids) // BLOCK)
    full = np.full(whole * BLOCK, ids[-1], "<u4")
    full[: len(ids)] = ids
    full = full.reshape(whole, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    cut = np.partition(rest, at, axis=1)[:, at]
    width = np.where(cut > 0, np.floor(np.log2(np.maximum(cut, 1))).astype(np.int64) + 1, 0)
    late = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    count = late.sum(axis=1)
    begin = _BLOCK_HEAD.size + width * BLOCK // 8  # of a block's exceptions, in the block
    size = begin + 5 * count
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(whole, np.dtype([("low", "<u4"), ("width", "u1"), ("late", "<u2")]))
    head["low"], head["width"], head["late"] = low, width, count
    out[starts[:, None] + np.arange(_BLOCK_HEAD.size)] = head.view(np.uint8).reshape(whole, -1)
    for w in np.unique(width[width > 0]).tolist():
        rows, word = np.flatnonzero(width == w), _word(w)
        values = np.where(late[rows], 0, rest[rows]).astype(word)
        if 8 * word.itemsize == w:
            packed = values.view(np.uint8).reshape(len(rows), -1)
        else:
            bits = np.unpackbits(values.view(np.uint8).reshape(len(rows), BLOCK, word.itemsize), axis=2)
            packed = np.packbits(bits[:, :, 8 * word.itemsize - w :].reshape(len(rows), BLOCK * w), axis=1)
        out[starts[rows][:, None] + _BLOCK_HEAD.size + np.arange(w * BLOCK // 8)] = packed
    row, place = np.nonzero(late)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    out[starts[row] + begin[row] + nth] = place
    values = np.ascontiguousarray(rest[row, place], "<u4").view(np.uint8).reshape(-1, 4)
    out[(starts[row] + begin[row] + count[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return starts.astype("<u8"), out.tobytes()


def unpack_ids(data: memoryview | bytes, starts: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of the blocks at ``starts``."""
    data = np.frombuffer(data, np.uint8)
    return np.concatenate([np.zeros(0, "<u4"), *(_unpack(data, starts[at : at + _AT_ONCE]) for at in range(0, len(starts), _AT_ONCE))])[:count]


def _unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    starts = starts.astype(np.int64)
    head = data[starts[:, None] + np.arange(_BLOCK_HEAD.size)]
    low = head[:, :4].copy().view("<u4").ravel()
    width, late = head[:, 4].astype(np.int64), head[:, 5:7].copy().view("<u2").ravel().astype(np.int64)
    out = np.zeros((len(starts), BLOCK), "<u4")
    for w in np.unique(width[width > 0]).tolist():
        rows, word = np.flatnonzero(width == w), _word(w)
        packed = data[starts[rows][:, None] + _BLOCK_HEAD.size + np.arange(w * BLOCK // 8)]
        if 8 * word.itemsize > w:
            bits = np.zeros((len(rows), BLOCK, 8 * word.itemsize), np.uint8)
            bits[:, :, 8 * word.itemsize - w :] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
            packed = np.packbits(bits, axis=2).reshape(len(rows), -1)
        out[rows] = packed.view(word).reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(len(starts)), late)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(late) - late, late)
    at = starts[row] + _BLOCK_HEAD.size + width[row] * BLOCK // 8
    out[row, data[at + nth]] = data[(at + late[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
    out += low[:, None]
    return out.ravel()


def file_bytes(part: int, before: int, doc_ids: list, raw: list[bytes]) -> bytes:
    """One token-id file."""
    return file_of(part, before, doc_ids, np.array([len(r) // 4 for r in raw], np.int64), np.frombuffer(b"".join(raw), "<u4"))


def file_of(part: int, before: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One token-id file, from the number of ids of each document and the ids of all."""
    starts, blocks = pack_ids(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return _HEAD.pack(MAGIC, VERSION, part, len(keys), before, len(ids), len(starts)) + keys.tobytes() + nulls.tobytes() + counts.astype("<u8").tobytes() + starts.tobytes() + blocks


def _by_size(batch: pa.RecordBatch, most: int = 1 << 22):
    """A batch of ``id, text`` in slices of about ``most`` bytes of text, one text at least."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def read_file(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """Part, ids of the part before the file, document ids, token counts and ids of a token-id file."""
    magic, version, part, docs, before, count, blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id file of this version")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs)
    ids = unpack_ids(memoryview(data)[at + 17 * docs + 8 * blocks :], starts, count)
    return part, before, [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], counts.astype(np.int64), ids


def write_tokens(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 20) -> DataFrame:
    """Encode texts and write token-id files to ``folder`` in ascending id order; return the manifest.

    ``folder`` must be reachable by every executor (any file system pyarrow opens)
    and have no token-id file in it (else ValueError).  Parts are ranges of ids; a part
    writes files of at least ``file_ids`` ids, so a task holds one file's ids and one
    document.  A file is written under the name of its task attempt and then renamed;
    a repeated attempt writes the same bytes and leaves the file that is there.  What
    a failed attempt leaves is deleted when the part's next attempt ends.  Ids are
    integers or null; null ids come first, rows with one id are ordered by text.
    """
    from pyarrow import fs

    def opened():
        disk, path = fs.FileSystem.from_uri(folder)
        disk.create_dir(path)
        return disk, path

    disk, path = opened()
    if any(f.base_name.endswith(".cltf") for f in disk.get_file_info(fs.FileSelector(path))):
        raise ValueError(f"there are token-id files in {folder}")

    def write(batches):
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        disk, path = opened()
        task = TaskContext.get()
        part, number, before = task.partitionId(), 0, 0
        keys, counts, ids, size = [], [], [], 0

        def save():
            nonlocal number, before, keys, counts, ids, size
            name = f"{path}/part-{part:06d}-{number:06d}.cltf"
            temp = f"{path}/.part-{part:06d}-{number:06d}-{task.taskAttemptId()}"
            with disk.open_output_stream(temp) as out:
                out.write(file_of(part, before, keys, np.concatenate(counts), np.concatenate(ids)))
            if disk.get_file_info(name).type == fs.FileType.NotFound:
                disk.move(temp, name)
            else:  # another attempt of this task has written the same bytes
                disk.delete_file(temp)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([os.path.basename(name)]), pa.array([len(keys)]), pa.array([size])], ["part", "number", "file", "n_docs", "n_ids"])
            number, before, keys, counts, ids, size = number + 1, before + size, [], [], [], 0
            return row

        for batch in batches:
            for some in _by_size(batch):
                own, (new, count) = some.column(0).to_pylist(), enc.all_raw(some.column(1), end)
                ends, at = np.cumsum(count), 0
                while at < len(own):  # a file ends with the document that fills it
                    done = int(ends[at - 1]) if at else 0
                    stop = min(int(np.searchsorted(ends, done + file_ids - size)) + 1, len(own))
                    keys += own[at:stop]
                    counts.append(count[at:stop])
                    ids.append(new[done : ends[stop - 1]])
                    size, at = size + int(ends[stop - 1]) - done, stop
                    if size >= file_ids:
                        yield save()
        if keys:
            yield save()
        if task.attemptNumber():
            for left in disk.get_file_info(fs.FileSelector(path)):
                if left.base_name.startswith(f".part-{part:06d}-"):
                    disk.delete_file(left.path)

    order = [F.col("id").asc_nulls_first(), "text"]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(order[0]).sortWithinPartitions(*order)
    return rows.mapInArrow(write, "part int, number int, file string, n_docs long, n_ids long")


def read_tokens(spark, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document of the manifest's token-id files: ``doc_id, start, n_tokens, ids_crc32, ids`` (binary; null if not asked for), from the files.

    The totals by part, one row for each range of ids, are summed up on the driver.
    Other files of the folder are not taken.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("files")).collect()
    files, bases, total = sum(r.files for r in parts), [], 0
    for part, n in sorted((r.part, r.n) for r in parts):
        bases.append((part, total))
        total += n

    def read(batches):
        from pyarrow import fs

        disk, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with disk.open_input_file(f"{path}/{name}") as file:
                    data = file.read()
                part, before, keys, counts, ids = read_file(data)
                ends = np.cumsum(counts)
                raw, view = memoryview(ids.tobytes()), before + ends - counts
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys, pa.int64()), pa.array(view), pa.array(counts), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary()) if with_ids else pa.nulls(len(cut), pa.binary())]
                yield pa.record_batch(columns, ["part", "doc_id", "place", "n_tokens", "ids_crc32", "ids"])

    docs = manifest.select("file").repartition(-(-files // 4), "file").mapInArrow(read, "part int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    base = spark.createDataFrame(bases, "part int, base long")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("place") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_store(df: DataFrame, folder: str | None = None, tokenizer: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Write the token-id files of ``df`` and read them back.

    A null or empty text is the end id alone; an empty table gives no file and an
    empty result.  Ids are integers or null; other columns are ignored, whatever
    their names.  ``folder`` (default: a new one) must hold no token-id file yet.
    """
    spark, schema = df.sparkSession, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    work = Workspace(spark, "tokens")
    folder = folder or work.folder("files")
    manifest = work.table(write_tokens(df, folder, tokenizer or default_tokenizer(), **options), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    return read_tokens(spark, folder, manifest, with_ids)


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_store(docs, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
