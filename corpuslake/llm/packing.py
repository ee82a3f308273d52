"""Best-fit packing of documents into token sequences, in hierarchical rounds.

Each task packs the pieces of its own documents by best fit, longest first.  Bins
that are nearly full leave as finished sequences.  The others stay open and become
the items of the next round, in which one task takes the open bins of ``fan_in``
tasks, until one task is left.  A task passes at most ``carry`` open bins up, those with
most room, so that no task's input grows with the corpus.

The open bins that were not passed up, and those of the last round, are the items of a
round over all of them.  To best fit bins of one fill are all alike, so that round works
on how many there are of each fill (at most ``size`` numbers): it takes and fills bins by
the thousand, and gives ranges of equal items to ranges of sequences.  Each open bin then
finds its sequence and its place there by its number among the bins of its fill; no bin
is moved, none is left out, and the number of bins does not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import Workspace, sliced
from corpuslake.llm.tokens import END_ID, default_tokenizer, encoder

#: A piece inside a bin.
PIECE = np.dtype([("doc", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
CLOSED, CARRIED, PARKED = range(3)
_BIN = "state int, level int, place long, number long, fill int, members binary"
_LOT = 200_000
#: Sequence numbers of the round over all parked bins start here.
_LAST = 1 << 62


def pieces_of(key, raw: bytes, size: int) -> list[tuple]:
    """Pieces of a document's ids (4 bytes each): ``size`` ids each, but the first takes what is left over."""
    n = len(raw) // 4
    first = n if n <= size else n % size or size
    cuts = [0, *range(first, n + 1, size)] if n > size else [0, n]
    null = key is None
    return [(0 if null else key, null, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def best_fit(fills: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each to the fullest bin that has room for it."""
    room_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    open_rooms = 0  # bit r is set if some bin has room r
    for item in np.argsort(-fills, kind="stable").tolist():
        need = int(fills[item])
        fitting = open_rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = room_bins[room].pop()
            if not room_bins[room]:
                open_rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = size, len(bins)
            bins.append([item])
        left = room - need
        if left:
            room_bins[left].append(b)
            open_rooms |= 1 << left
    return bins


def _round(fills: np.ndarray, members: list[bytes], level: int, place: int, last: bool, size: int, slack: int, carry: int) -> pd.DataFrame:
    """One task's bins after best fit: closed, carried to the next round, or parked for the round over all.

    Parked bins are numbered within their fill, others in the task.
    """
    bins = best_fit(fills, size)
    sums = np.array([int(fills[b].sum()) for b in bins], np.int64)
    state, number = np.where(sums >= size - slack, CLOSED, PARKED), np.arange(len(bins))
    if not last:
        by_room = np.argsort(sums, kind="stable")
        state[by_room[state[by_room] == PARKED][:carry]] = CARRIED
    parked = np.flatnonzero(state == PARKED)
    parked = parked[np.argsort(sums[parked], kind="stable")]
    number[parked] = np.arange(len(parked)) - np.searchsorted(sums[parked], sums[parked])
    joined = [b"".join(members[i] for i in b) for b in bins]
    return pd.DataFrame({"state": state.astype("int32"), "level": np.int32(level), "place": np.int64(place), "number": number, "fill": sums.astype("int32"), "members": joined})


def _merger(level: int, last: bool, size: int, slack: int, carry: int):
    def merge(key, bins):
        bins = bins.sort_values(["fill", "place", "number"])
        return _round(bins["fill"].to_numpy(), bins["members"].tolist(), level, int(key[0]), last, size, slack, carry)

    return merge


def best_fit_of_counts(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of many equal items: ``fill, first item, first bin, items a bin, room taken before`` of each range of items.

    Items of a fill are numbered from 0; a range ends where the fill's next one begins.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    found, bins = [], 0

    def put(fill, item, first, many, each, room):
        found.append((fill, item, first, each, size - room))
        if many and room > each * fill:
            rooms.setdefault(room - each * fill, []).append((first, many))

    for fill in sorted(counts, reverse=True):
        left, item = counts[fill], 0
        for room in sorted(r for r in rooms if r >= fill):
            each = room // fill
            while left and rooms[room]:
                first, many = rooms[room].pop()
                whole = min(many, left // each)
                if whole:
                    put(fill, item, first, whole, each, room)
                    item, left = item + whole * each, left - whole * each
                if whole < many and left:  # fewer items than one more bin of these takes
                    put(fill, item, first + whole, 1, left, room)
                    item, left, whole = item + left, 0, whole + 1
                if whole < many:
                    rooms[room].append((first + whole, many - whole))
        each = size // fill
        for many, each in ((left // each, each), (1, left % each)):
            if many and each:
                put(fill, item, bins, many, each, size)
                item, bins = item + many * each, bins + many
    return found


def _sequences(ranges: list[tuple[int, int, int, int, int]]):
    """For bins by fill and number: their sequences and offsets."""
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    at = table[:, 0] << 44 | table[:, 1]

    def find(fill: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, sequence, each, before = table[np.searchsorted(at, fill << 44 | number, side="right") - 1].T
        return sequence + (number - first) // each, before + (number - first) % each * fill

    return find


def pack(df: DataFrame, size: int = 1024, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", slack: int = 0, fan_in: int = 8, carry: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and the end id; a null or empty text is the end id
    alone.  Only documents longer than ``size`` are cut.  Ids are integers or null.
    Repeated rows are packed each.  An empty table gives an empty result; other
    columns are ignored, whatever their names.  ``slack`` is how much room a bin may
    have to be finished at once.
    """
    spark, tokenizer = df.sparkSession, tokenizer or default_tokenizer()
    work = Workspace(spark, "packing")

    def local(batches):
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        place, pieces, lots = TaskContext.get().partitionId(), [], 0

        def lot():
            table = np.array(pieces, PIECE)
            bins = _round(table["length"].astype(np.int64), [r.tobytes() for r in table], 0, place * 4096 + lots, False, size, slack, carry)
            return pa.RecordBatch.from_pandas(bins, preserve_index=False)

        for batch in sliced(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces += pieces_of(key, enc.raw(text) + end, size)
            if len(pieces) >= _LOT:  # a task's share is packed in bounded lots
                yield lot()
                pieces, lots = [], lots + 1
        if pieces:
            yield lot()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bins = [work.table(rows.mapInArrow(local, _BIN), "round0")]
    level, names = 0, bins[0].filter(F.col("state") == CARRIED).select("place").distinct().count()
    while names:
        level, names = level + 1, -(-names // fan_in)
        group = F.pmod(F.hash("place"), F.lit(names)).cast("int")
        merged = bins[-1].filter(F.col("state") == CARRIED).groupBy(group.alias("group")).applyInPandas(_merger(level, names == 1, size, slack, carry), _BIN)
        bins.append(work.table(merged, f"round{level}"))
        if names == 1:
            break
    made = bins[0]
    for more in bins[1:]:
        made = made.unionByName(more)

    parked = made.filter(F.col("state") == PARKED)
    places = work.table(parked.groupBy("level", "place", "fill").agg(F.count(F.lit(1)).alias("n")), "places")
    counts = {r.fill: r.n for r in places.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # at most a row for each fill below size
    find = _sequences(best_fit_of_counts(counts, size))
    before = Window.partitionBy("fill").orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    bases = places.select("level", "place", "fill", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    last = parked.join(bases, ["level", "place", "fill"]).withColumn("number", F.col("number") + F.col("base"))
    closed = made.filter(F.col("state") == CLOSED)

    def members(batches):
        for batch in batches:
            state, level, place, number, fill = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
            raw = batch.column(5).to_pylist()
            table = np.frombuffer(b"".join(raw), PIECE)
            counts = np.fromiter((len(m) // PIECE.itemsize for m in raw), np.int64, len(raw))
            sequence, offset = (level << 56) + (place << 24) + number, np.zeros(len(raw), np.int64)
            own = state == PARKED
            if own.any():
                sequence[own], offset[own] = find(fill[own], number[own])
                sequence[own] += _LAST
            length = table["length"].astype(np.int64)
            within, first = np.cumsum(length) - length, np.cumsum(counts) - counts
            columns = [pa.array(table["doc"], mask=table["null"].astype(bool)), table["piece"], table["start"], length, table["crc"].astype(np.int64), np.repeat(sequence, counts), within + np.repeat(offset - within[first], counts)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["state", "level", "place", "number", "fill", "members"]
    return closed.select(*columns).unionAll(last.select(*columns)).mapInArrow(members, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
