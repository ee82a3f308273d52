"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A 64-bit fingerprint is eight positional bytes.  Fingerprints at most ``bits`` apart
differ in at most ``bits`` bytes, so they share at least ``8 - bits`` positional
bytes: the guaranteed minimum of the count filter.  Lists of one positional byte hold
n/256 rows each, so a posting is joint: it names one position less than the guaranteed
minimum and the bytes there (three of eight for four bits, 24 bits a list).  Pairs that
share fewer bytes never meet.  Of pairs that meet in a list the shared positional bytes
are tallied, those that reach the minimum are retained, and the retained ones are
verified by their differing bits.

A list of up to four is compared side by side.  A longer one is walked breadth first: a
fingerprint takes all that it links to out of the list, so m fingerprints give at most
m - 1 links, a spanning forest of their links, and never all their pairs.  Equal fingerprints are one row throughout.  No list
that a task holds is longer than ``longest``: the fingerprints of longer lists are
indexed again by all positions of the guaranteed minimum, and those of lists that are
still longer by half of the 4-bit pieces of the bytes that remain, of which linked ones
share at least half.  Then at most 65,536 distinct fingerprints can be in a list (for
four bits), so a dense group of any size is split exactly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import Workspace, sliced
from corpuslake.llm.components import connected_components

_CHUNK = 1 << 16
#: Lists of so many fingerprints are compared side by side, longer ones are walked one by one.
_SHORT = 4


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text: lower-cased (A-Z) words between ASCII white space, XXH64 (seed 42) of each shingle.

    Fewer words than a shingle takes are one shingle; no word at all gives zero.
    """
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    pairs = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in pairs], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(values):
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id_col, fp``: fingerprints as signed 64-bit numbers."""

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(_signed([fingerprint(t, words) for t in texts]))], ["id", "fp"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return df.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of fingerprints link: their shared positional bytes are tallied, those with enough are verified."""
    differ = np.ascontiguousarray(a ^ b)
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    found = tally >= 8 - bits
    found[found] = np.bitwise_count(differ[found]) <= bits
    return found


def near_links(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of places."""
    left, queue, found = np.arange(len(values)), [], []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = linked(values[left], values[at], bits)
        if near.any():
            taken = left[near]
            found += [(at, t) for t in taken.tolist()]
            queue += taken.tolist()
            left = left[~near]
    return found


def postings(distinct: DataFrame, positions: int) -> DataFrame:
    """``key, fp``: a row for each choice of ``positions`` byte positions; the key names the choice and the bytes there."""

    def byte(k):
        return F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))

    def key(which, places):
        found = F.lit(which).cast("long")
        for k in places:
            found = F.shiftleft(found, 8).bitwiseOR(byte(k))
        return found

    return distinct.select(F.explode(F.array(*[key(n, p) for n, p in enumerate(combinations(range(8), positions))])).alias("key"), "fp")


def _pieces(bits: int):
    """Rows of lists of ``8 - bits`` joint bytes to rows keyed by ``bits`` of the 4-bit pieces of the other bytes as well."""
    choices = list(combinations(range(8), 8 - bits))

    def run(batches):
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            which = key >> (8 * (8 - bits))
            for n in np.unique(which).tolist():
                rows, own = fp[which == n], key[which == n].view(np.uint64)
                left = [k for k in range(8) if k not in choices[n]]
                halves = [(rows >> np.uint64(8 * k + h)) & np.uint64(15) for k in left for h in (0, 4)]
                for c, some in enumerate(combinations(range(2 * bits), bits)):
                    # keys of different lists may fall together: that only makes a list longer
                    finer = own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
                    for k in some:
                        finer = finer * np.uint64(0xD6E8FEB86659FD93) + halves[k]
                    yield pa.record_batch([pa.array(finer.view(np.int64)), pa.array(rows.view(np.int64))], ["key", "fp"])

    return run


def _walk(bits: int, longest: int | None):
    """Sorted ``key, fp`` to links ``a, b``; the rows of lists longer than ``longest`` come out as ``key, fp``."""
    none = np.zeros(0, np.int64)

    def rows(a=none, b=none, key=none, fp=none):
        short, long = len(a), len(key)
        return pa.record_batch(
            [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(long, pa.int64())]) for x in (a, b)] + [pa.concat_arrays([pa.nulls(short, pa.int64()), pa.array(x, pa.int64())]) for x in (key, fp)],
            ["a", "b", "key", "fp"],
        )

    def whole(key, fp):
        """Links of whole lists, and the rows of those that are too long."""
        if not len(key):
            return rows()
        new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))  # a fingerprint may be given twice
        key, fp = key[new], fp[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        size, value = np.repeat(sizes, sizes), fp.view(np.uint64)
        pairs = [[], []]
        for step in range(1, _SHORT):
            at = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= _SHORT))
            at = at[linked(value[at], value[at + step], bits)]
            pairs[0].append(at)
            pairs[1].append(at + step)
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if _SHORT < n <= (longest or n):
                some = np.array(near_links(value[s : s + n], bits), np.int64).reshape(-1, 2) + s
                pairs[0].append(some[:, 0])
                pairs[1].append(some[:, 1])
        long = size > (longest or len(key))
        return rows(*(fp[np.concatenate(p)] for p in pairs), key[long], fp[long])

    def run(batches):
        held, long_key = [none, none], None
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if long_key is not None:
                rest = int(np.searchsorted(key, long_key, side="right"))
                yield rows(key=key[:rest], fp=fp[:rest])
                key, fp = key[rest:], fp[rest:]
            if not len(key):
                continue
            long_key = None
            key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
            cut = int(np.searchsorted(key, key[-1]))
            yield whole(key[:cut], fp[:cut])
            held = [key[cut:], fp[cut:]]
            if longest and len(held[0]) > longest:
                long_key = key[-1]
                yield rows(key=held[0], fp=held[1])
                held = [none, none]
        yield whole(*held)

    return run


def index_links(distinct: DataFrame, work: Workspace, bits: int = 4, longest: int = 4096) -> DataFrame:
    """``a, b``: verified links that connect what is within ``bits`` (0 to 7), from distinct fingerprints ``fp``."""
    if bits == 0:
        return distinct.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    guaranteed = 8 - bits

    def walked(rows, longest, name):
        dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
        return work.table(dealt.mapInArrow(_walk(bits, longest), "a long, b long, key long, fp long"), name)

    found = [walked(postings(distinct, max(guaranteed - 1, 1)), longest, "met")]
    long = found[-1].filter("key is not null")
    if not long.isEmpty():
        found.append(walked(postings(long.select("fp").distinct(), guaranteed), longest, "met_again"))
        long = found[-1].filter("key is not null").select("key", "fp")
        if not long.isEmpty():
            found.append(walked(long.mapInArrow(_pieces(bits), "key long, fp long"), None, "met_in_pieces"))
    links = found[0].filter("a is not null").select("a", "b")
    for more in found[1:]:
        links = links.unionAll(more.filter("a is not null").select("a", "b"))
    return links


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """``id_col, fingerprint, component_id``: the smallest id reachable over fingerprints at most ``bits`` apart.

    Texts without words have fingerprint zero and link like any other.  Null ids
    keep their row and never become a component's id unless all its ids are null;
    repeated rows give repeated rows; an empty table an empty result.
    """
    work = Workspace(df.sparkSession, "simhash")
    prints = work.table(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = work.table(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    parts = connected_components(index_links(classes.select("fp"), work, bits), work)
    grouped = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = work.table(grouped.join(least, "component").select("fp", "component_id"), "class_ids")
    return prints.join(ids, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose id is its component's; rows with a null id stay, and ids with rows in several groups if one is kept."""
    found = simhash_components(df, id_col, **options)
    drop = found.groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("stays")).filter("not stays").select(id_col)
    return df.join(drop.hint("shuffle_hash"), id_col, "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
