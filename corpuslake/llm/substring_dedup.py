"""Removal of repeated 100-byte strings by a prefix-free parse of the corpus.

Texts are parsed as UTF-8 bytes into overlapping phrases.  The trigger of a phrase
is a rolling hash of ``GRAM`` bytes that is least in its neighbourhood, so every
window of ``length`` bytes belongs to exactly one trigger, and equal windows belong to
equal triggers.  A phrase is all bytes of its trigger's windows: neighbours overlap,
and the windows of a phrase never leave it.  The distinct phrases are the dictionary,
their occurrences in corpus order the parse.

Corpus order of the corpus's suffixes, as far as ``length`` bytes tell them apart, is
then made of the two.  The parse is sorted by phrase and place: all but the first
occurrence of a phrase repeat an earlier text as a whole.  Phrases whose trigger no
other phrase has need no more.  The others' dictionary entries meet by trigger, and a
suffix array of each trigger's phrases, cut to ``length`` bytes, is sorted with ties in
the order of the parse: of equal suffixes all but the first repeat.  A suffix that ends
beyond its phrase never decides, so ranks of the parse's own suffixes are not needed.

Nothing grows with a popular passage: occurrences that a batch has seen already are
settled before they are exchanged, the others are dealt by phrase, not by trigger, and
streamed.  The phrases of a trigger that has more than ``crowded`` of them are not sorted
in one task.  Their windows have ``length - GRAM`` bytes beside the trigger, so half of
that on one side at least: a phrase is split into the windows with that much before the
trigger and those with that much behind it, and the bytes of that half join the trigger.
The parse of these finer phrases is sorted and settled as before, and split again where
it has to be; in the end a trigger is a whole window, which has one phrase.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import Workspace

GRAM = 32
_SEGMENT = 1 << 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
REPEAT, OPEN = 1, 2


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place, built by doubling."""
    h, width = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
    while width < GRAM:
        h = (h[:-width] ^ (h[:-width] >> np.uint64(31))) * _B + h[width:] * _A
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def parse(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hashes, trigger places, and first and last window starts of the phrases of one text."""
    found = []
    for at in range(0, max(len(data) - length + 1, 0), _SEGMENT):
        part = data[at : at + _SEGMENT + length - 1]
        h = gram_hashes(part)
        least, width, reach = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - GRAM + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        trigger = (least & _PLACE).astype(np.int64)
        last = np.append(np.flatnonzero(np.diff(trigger)), len(trigger) - 1)
        first = np.concatenate(([0], last[:-1] + 1))
        found.append((h[trigger[first]].view(np.int64), trigger[first] + at, first + at, last + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _later(order: list[np.ndarray], same: int) -> np.ndarray:
    """Marks rows that agree in the first ``same`` columns with one that sorts before them."""
    ranks = np.lexsort(order[::-1])
    equal = np.ones(max(len(ranks) - 1, 0), bool)
    for column in order[:same]:
        column = column[ranks]
        equal &= column[1:] == column[:-1]
    later = np.zeros(len(ranks), bool)
    later[ranks[1:][equal]] = True
    return later


#: A phrase's shape in one number: its windows, the trigger's place in it, and by how much the trigger has grown to the left and right.
_BITS = 15
_FIELDS = (1 << _BITS) - 1


def _shape(windows, place, left=0, right=0):
    return windows | place << _BITS | left << 2 * _BITS | right << 3 * _BITS


def _parsed(table: list[np.ndarray]) -> pa.RecordBatch:
    """Parse entries ``trigger, phrase, doc, start, shape, kind`` of a batch; kind REPEAT if the batch has a phrase earlier."""
    repeat = _later(table[:4], 2)
    # settled rows only travel on; they are spread by place
    table[0] = np.where(repeat, table[3] * 31 + table[2], table[0])
    table[1] = np.where(repeat, 0, table[1])
    return pa.record_batch([*map(pa.array, table), pa.array(np.where(repeat, REPEAT, OPEN).astype(np.int32))], ["trigger", "phrase", "doc", "start", "shape", "kind"])


def _entries(length: int):
    """Documents to parse entries."""
    from xxhash import xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                trigger, place, first, last = parse(np.frombuffer(raw, np.uint8), length)
                if len(trigger):
                    phrase = [xxh3_64_intdigest(raw[a : b + length], t - a) for a, b, t in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                    parts.append((trigger, np.array(phrase, np.uint64).view(np.int64), np.full(len(trigger), doc), first, _shape(last - first + 1, place - first)))
            if parts:
                yield _parsed([np.concatenate(x) for x in zip(*parts, strict=True)])

    return run


def _finer(length: int):
    """Dictionary rows of crowded triggers to the parse entries of their halves, with their bytes."""
    from xxhash import xxh3_64_intdigest

    def halves(raw, start, shape):
        windows, place, left, right = (shape >> k * _BITS & _FIELDS for k in range(4))
        slack = length - GRAM - left - right
        half = (slack + 1) // 2
        cut = min(max(place - left - half + 1, 0), windows)
        for first, n, a, b in ((0, cut, left + half, right), (cut, windows - cut, left, right + slack - half + 1)):
            if n:
                trigger, phrase = raw[place - a : place + GRAM + b], raw[first : first + n - 1 + length]
                yield xxh3_64_intdigest(trigger, a << _BITS | b), xxh3_64_intdigest(phrase, place - first), start + first, _shape(n, place - first, a, b), phrase

    def run(batches):
        for batch in batches:
            docs, rows = [], []
            for doc, start, shape, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = list(halves(raw, start, shape))
                rows += found
                docs += [doc] * len(found)
            if rows:
                codes = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in (0, 1)]
                entries = _parsed([*codes, np.array(docs, np.int64), *(np.array([r[k] for r in rows], np.int64) for k in (2, 3))])
                yield pa.record_batch([*entries.columns, pa.array([r[4] for r in rows], pa.binary())], [*entries.schema.names, "bytes"])

    return run


def _settle(batches):
    """Sorted parse entries to ``doc, start, shape, kind, trigger``, and their bytes if they have them: the first of a phrase is OPEN, the others REPEAT."""
    last = None
    for batch in batches:
        trigger, phrase, doc, start, shape, kind = (batch.column(k).to_numpy() for k in range(6))
        own = np.flatnonzero(kind != REPEAT)
        t, p = trigger[own], phrase[own]
        first = np.ones(len(own), bool)
        first[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
        if len(own):
            first[0] = (t[0], p[0]) != last
            last = (t[-1], p[-1])
        kind = np.full(len(kind), REPEAT, np.int32)
        kind[own[first]] = OPEN
        yield pa.record_batch([*map(pa.array, (doc, start, shape, kind)), pa.array(trigger, mask=kind == REPEAT), *batch.columns[6:]], ["doc", "start", "shape", "kind", "trigger", *batch.schema.names[6:]])


def _phrases(length: int):
    """Documents with the places of their open phrases to dictionary rows ``trigger, doc, start, shape, phrases, bytes``."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "replace")
                rows += [(p["trigger"], doc, p["start"], p["shape"], p["phrases"], raw[p["start"] : p["start"] + (p["shape"] & _FIELDS) + length - 1]) for p in places]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((*(pa.int64(),) * 5, pa.binary()))], ["trigger", "doc", "start", "shape", "phrases", "bytes"])

    return run


def suffix_array(phrases: list[bytes], length: int) -> tuple[list[bytes], list[int]]:
    """The suffixes of the phrases cut to ``length`` bytes, as they lie in the phrases, and their order; equal ones keep theirs."""
    windows = [p[a : a + length] for p in phrases for a in range(len(p) - length + 1)]
    return windows, sorted(range(len(windows)), key=windows.__getitem__)


def _suffix_arrays(length: int):
    """Dictionary rows, sorted by trigger and place, to runs ``doc, start, windows`` of suffixes that an earlier one equals."""

    def marks(phrases):
        windows, order = suffix_array(phrases, length)
        later, before = bytearray(len(windows)), None
        for k in order:
            if windows[k] == before:
                later[k] = 1
            before = windows[k]
        return bytes(later)

    def runs(rows, flags):
        doc, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        sizes = np.array([len(r[3]) - length + 1 for r in rows], np.int64)
        first = np.cumsum(sizes) - sizes
        later = np.frombuffer(b"".join(flags), np.uint8)
        opens = np.append(0, later[:-1]) < later
        opens[first] = later[first] > 0
        begin = np.flatnonzero(opens)
        row = np.repeat(np.arange(len(rows)), sizes)[begin]
        within = np.add.reduceat(later, begin, dtype=np.int64) if len(begin) else begin
        return pa.record_batch([pa.array(doc[row]), pa.array(start[row] + begin - first[row]), pa.array(within.astype(np.int32))], ["doc", "start", "windows"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            edges = [k for k in range(1, len(held)) if held[k][0] != held[k - 1][0]]
            if edges:
                flags = [marks([r[3] for r in held[a:b]]) for a, b in zip([0, *edges[:-1]], edges, strict=True)]
                yield runs(held[: edges[-1]], flags)
                held = held[edges[-1] :]
        if held:
            yield runs(held, [marks([r[3] for r in held])])

    return run


def _removal(length: int):
    """Documents with their repeated window starts to the removed runs and the bytes that stay."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, starts, windows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = text.encode("utf-8", "replace") if text else b""
                edge = np.zeros(len(raw) + 1, np.int32)
                if starts:
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.array(starts) + np.array(windows) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """``_key, _id, _text`` with a key that no two rows share and that sorts as the ids do.

    Where ids repeat or are null, rows are numbered in the order of id and text.
    """
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if rows.groupBy("_id").count().filter("count > 1 or _id is null").isEmpty():
        return rows.select(F.col("_id").alias("_key"), "_id", "_text")
    order = [F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()]
    return work.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_key"), "_id", "_text"), "keyed")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, crowded: int = 2048) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` (binary) for every row.

    A byte goes if a ``length``-byte string of its document covers it that also
    starts earlier: in a smaller id or before in the same document.  Null texts are
    empty; texts shorter than ``length`` lose nothing.  Null ids sort first, rows
    with one id by text, so of repeated rows the first stays whole.  An empty table
    gives an empty result; other columns are ignored.
    """
    if not GRAM <= length <= _FIELDS:
        raise ValueError(f"length must be from {GRAM} to {_FIELDS}")
    work = Workspace(df.sparkSession, "substrings")
    docs = _keyed(df, id_col, text_col, work)
    order, windows = ["trigger", "phrase", "doc", "start"], F.col("shape").bitwiseAND(F.lit(_FIELDS)).cast("int").alias("windows")
    entry, settled_row, entry_bytes = "trigger long, phrase long, doc long, start long, shape long, kind int", "doc long, start long, shape long, kind int, trigger long", ", bytes binary"
    repeats = []

    def by_doc(rows, *columns):
        return rows.groupBy(F.col("doc").alias("_key")).agg(*(F.collect_list(c).alias(f"{c}s") for c in columns))

    def settle(entries, level, more=""):
        """The first entries of phrases that share their trigger, with how many do; all others are settled."""
        parsed = entries.repartition("trigger", "phrase").sortWithinPartitions(*order)
        settled = work.table(parsed.mapInArrow(_settle, settled_row + more), f"settled{level}")
        repeats.append(settled.filter(F.col("kind") == REPEAT).select("doc", "start", windows))
        heads = settled.filter(F.col("kind") == OPEN).drop("kind")
        shared = heads.groupBy("trigger").agg(F.count(F.lit(1)).alias("phrases")).filter("phrases > 1")
        return work.table(heads.join(shared, "trigger"), f"opened{level}")

    def sort(dictionary, level):
        in_order = dictionary.select("trigger", "doc", "start", "bytes").repartition("trigger").sortWithinPartitions("trigger", "doc", "start")
        repeats.append(work.table(in_order.mapInArrow(_suffix_arrays(length), "doc long, start long, windows int"), f"suffixes{level}"))

    opened = settle(docs.select("_key", "_text").mapInArrow(_entries(length), entry), 0)
    places = by_doc(opened.select("doc", F.struct("trigger", "start", "shape", "phrases").alias("place")), "place")
    dictionary = docs.join(places.hint("shuffle_hash"), "_key").select("_key", "_text", "places").mapInArrow(_phrases(length), "trigger long, doc long, start long, shape long, phrases long, bytes binary")
    few, many = F.col("phrases") <= crowded, F.col("phrases") > crowded
    if opened.filter(many).isEmpty():
        sort(dictionary, 0)
    else:
        dictionary, level = work.table(dictionary, "dictionary"), 0
        sort(dictionary.filter(few), level)
        while not (left := dictionary.filter(many)).isEmpty():
            level += 1
            dictionary = settle(left.select("doc", "start", "shape", "bytes").mapInArrow(_finer(length), entry + entry_bytes), level, entry_bytes)
            sort(dictionary.filter(few), level)
    repeats = reduce(DataFrame.unionByName, repeats)
    marked = docs.join(by_doc(repeats, "start", "windows").hint("shuffle_hash"), "_key", "left")
    out = marked.select("_key", "_text", "starts", "windowss").mapInArrow(_removal(length), "_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if "keyed" in work._made:
        return out.join(docs.select("_key", F.col("_id").alias(id_col)), "_key").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out.withColumnRenamed("_key", id_col)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
