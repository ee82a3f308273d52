"""SimHash near-dedup by similarity of word shingles: long fingerprints, positional bytes, count filtering, verification.

Texts with equal sets of shingles are one class throughout.  Sets of similarity s have a
cosine of 2s / (1 + s) at least, so a bit of their SimHash agrees with a probability that
follows from s (0.85 for 0.8).  That is too little for the byte filter of 64 bits, so
fingerprints are longer: 8,192 bits for up to four million classes, more beyond.  They are
the signs of two Hadamard transforms of the set's signed sums with random signs between,
which act as Gaussian hyperplanes at the cost of a few products for each bit.

Index: a posting names a position and the ``joint`` bytes there (three for up to four million
classes), so many that a pair at the least similarity shares none with probability ``miss``.
Count filter: of classes that meet in a list the shared positional bytes of the first 64 are
tallied, and pairs that reach the minimum are retained; of those the bits of these bytes
that differ are counted, and pairs beyond a bound are dropped.  A pair at the least similarity
fails either with a tenth of ``miss``.  Groups of a list are what remains connected.

The postings are indexed in passes, the first ones short.  Only connections count, so from
the second pass on a list or group whose classes are of one component already is dropped.
Texts a little less alike than ``similarity`` meet in hundreds of lists and never become one
component, so groups are not verified list by list: components that meet in any group of a
pass are a cluster, and all classes of a cluster are verified once a pass, by their shingles,
walked breadth first.  A class takes all unvisited ones that are similar enough out, with the
rest of their components, so m classes give at most m - 1 links, a spanning forest.

A cluster of more than ``longest`` classes is verified in chunks, each with the cluster's first
class.  Where its classes are one component after that, nothing is left to compare; the classes
of all its other components are then compared with the whole cluster, chunk by chunk.  As that
grows with the square of a cluster, the groups of one of more than ``CHUNKS`` chunks are verified
each for itself, equal groups once.  A list is streamed; one of more than ``longest`` classes is
not filtered but is a group, and is verified in chunks like a cluster.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import Workspace, sliced
from corpuslake.llm.components import connected_components

#: Bytes of a fingerprint that the count filter looks at; postings of one index task; documents transformed at once.
TALLIED, TASK, AT_ONCE = 64, 1 << 21, 64
#: Where the second and third pass begin, postings of a later one at most, and chunks of a cluster that is verified whole.
EARLY, PASS, CHUNKS = (2, 16), 256, 8
_SEGMENT = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased (A-Z) words between ASCII white space.

    Fewer words than a shingle takes are one shingle; no word at all gives none.
    """
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    found = np.full(n, k, np.uint64)
    for j in range(k):
        found = _mixed(found + each[j : j + n])
    return np.unique(found)


def _set_hash(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), 42)


def agreement(similarity: float) -> float:
    """The probability that a SimHash bit of two sets of this similarity agrees, at least."""
    return 1 - math.acos(min(2 * similarity / (1 + similarity), 1.0)) / math.pi


def index_plan(classes: int, similarity: float, miss: float) -> tuple[np.ndarray, int]:
    """The byte positions of each posting, and the bits of a fingerprint (a power of two), for so many classes."""
    joint = 3
    while classes > 256**joint / 4:
        joint += 1
    shared = agreement(similarity) ** (8 * joint)
    count = 1 if shared >= 1 else math.ceil(math.log(miss) / math.log1p(-shared))
    size = 1 << max(-(-count // 2) * joint - 1, TALLIED - 1).bit_length()
    wide = size // joint  # neighbours first, then bytes that are far apart
    near = np.arange(wide * joint).reshape(wide, joint)
    return np.concatenate([near, near.reshape(joint, wide).T])[:count], 8 * size


def _below(n: int, p: float, miss: float) -> int:
    """The most successes of ``n`` that fewer than are had with probability ``miss`` at most."""
    below = 0.0
    for m in range(n):
        below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > miss:
            return m
    return n


def least_tally(similarity: float, miss: float) -> int:
    """Shared bytes of ``TALLIED`` that a pair of this similarity has but for probability ``miss``."""
    return max(_below(TALLIED, agreement(similarity) ** 8, miss), 1)


def most_bits(similarity: float, miss: float) -> int:
    """Bits of the tallied bytes in which a pair of this similarity differs at most, but for probability ``miss``."""
    return 8 * TALLIED - _below(8 * TALLIED, agreement(similarity), miss)


@cache
def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


@cache
def _turns(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs between the transforms, and which transformed sum each bit is the sign of."""
    draw = np.random.default_rng(11)
    return np.where(draw.random(bits) < 0.5, np.float32(-1), np.float32(1)), draw.permutation(bits)


def simhashes(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits // 8`` bytes for each set of shingle hashes."""
    rows, inner = np.empty((len(sets), bits // 8), np.uint8), 1 << (bits.bit_length() // 2)
    signs, places = _turns(bits)

    def transformed(sums):
        cube = sums.reshape(len(sums), bits // inner, inner)
        return (np.matmul(_hadamard(bits // inner), cube) @ _hadamard(inner)).reshape(len(sums), bits)

    for at in range(0, len(sets), AT_ONCE):
        some = sets[at : at + AT_ONCE]
        sums = np.zeros((len(some), bits), np.float32)
        for row, found in zip(sums, some, strict=True):
            mixed = _mixed(found)
            row += np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), np.where(mixed >> np.uint64(63), -1.0, 1.0), bits).astype(np.float32)
        rows[at : at + AT_ONCE] = np.packbits(transformed(transformed(sums) * signs)[:, places] > 0, axis=1)
    return rows


def _postings(positions: np.ndarray, tasks: int):
    """Classes ``number, print`` to index rows ``task, base, codes, places``: a posting is a code and a class, as base and place."""
    count, joint = positions.shape
    span = -(-(count << (8 * joint)) // tasks)  # codes a task

    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(numbers), -1)
            edges = np.append(True, np.diff(numbers) != 1)
            edges[::_SEGMENT] = True
            cuts = np.flatnonzero(edges).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(numbers)], strict=True):
                code = np.repeat(np.arange(count, dtype=np.uint64)[None], b - a, axis=0)
                for k in range(joint):
                    code = code << np.uint64(8) | prints[a:b, positions[:, k]]
                code = code.ravel()
                order = np.argsort(code, kind="stable")
                code, place = code[order], (order // count).astype(np.uint16)
                task = (code // np.uint64(span)).astype(np.int64)
                edge = np.append(np.flatnonzero(np.append(True, np.diff(task) > 0)), len(task)).tolist()
                parts = list(zip(edge, edge[1:], strict=False))
                owner = task[edge[:-1]]
                codes = [(code[x:y] - np.uint64(t * span)).astype(np.uint32).tobytes() for (x, y), t in zip(parts, owner.tolist(), strict=True)]
                columns = [pa.array(owner.astype(np.int32)), pa.array(np.full(len(parts), numbers[a])), pa.array(codes, pa.binary()), pa.array([place[x:y].tobytes() for x, y in parts], pa.binary())]
                yield pa.record_batch(columns, ["task", "base", "codes", "places"])

    return run


def _lists(batches):
    """Index rows sorted by task to ``list, number`` of lists of two and more."""

    def lists(task, codes, numbers):
        code, number = np.concatenate(codes), np.concatenate(numbers)
        order = np.argsort(code, kind="stable")
        code, number = code[order], number[order]
        same = code[1:] == code[:-1]
        more = np.append(same, False) | np.append(False, same)
        return pa.record_batch([pa.array((np.int64(task) << 32) + code[more]), pa.array(number[more])], ["list", "number"])

    at, codes, numbers = None, [], []
    for batch in batches:
        for task, base, code, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if task != at and codes:
                yield lists(at, codes, numbers)
                codes, numbers = [], []
            at = task
            codes.append(np.frombuffer(code, np.uint32))
            numbers.append(base + np.frombuffer(place, np.uint16).astype(np.int64))
    if codes:
        yield lists(at, codes, numbers)


def retained(prints: np.ndarray, least: int, most: int) -> np.ndarray:
    """For each fingerprint (rows of eight bytes at a time) of a list the first one that it is connected to by pairs that pass the count filter."""
    root, left = np.arange(len(prints)), np.arange(len(prints))
    while len(left):
        head, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = passes(prints[left], prints[queue.pop()], least, most)
            root[left[near]] = head
            queue += left[near].tolist()
            left = left[~near]
    return root


def passes(a: np.ndarray, b: np.ndarray, least: int, most: int) -> np.ndarray:
    """Which pairs share ``least`` positional bytes and then differ in at most ``most`` bits."""
    differ = a ^ b
    found = (differ == 0).sum(axis=1) >= least
    found[found] = np.bitwise_count(differ[found]).sum(axis=1, dtype=np.int32) <= most
    return found


def _met(least: int, most: int, longest: int):
    """Sorted ``list, number, component, print`` to groups ``group, chunk, long, component, numbers`` of classes that are not of one component.

    A group's component is the least of its classes.  Rows of chunk -1 have no classes: ``group``
    and ``component`` are then components that meet, a spanning forest for all groups of a task.
    """
    names, kinds = ["group", "chunk", "long", "component", "numbers"], (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
    meeting, root = [], {}  # the components of each group found; links of the forest

    def top(c):
        while (up := root.setdefault(c, c)) != c:
            root[c] = c = root[up]
        return c

    def rows(found):
        for first, *others in meeting:
            for c in others:
                if (a := top(first)) != (b := top(c)):
                    root[b] = a
                    found.append((c, -1, False, first, None))
        meeting.clear()
        return pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

    def whole(key, number, component, prints):
        """Groups of whole lists."""
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        root = np.arange(len(key))
        two = start[size == 2]
        two = two[component[two] != component[two + 1]]
        near = passes(prints[two], prints[two + 1], least, most)
        root[two[near] + 1] = two[near]
        differ = np.maximum.reduceat(component, start) != np.minimum.reduceat(component, start)
        for s, n in zip(start[(size > 2) & differ].tolist(), size[(size > 2) & differ].tolist(), strict=True):
            root[s : s + n] = s + retained(prints[s : s + n], least, most)
        order = np.lexsort((number, root))
        root, number, component = root[order], number[order], component[order]
        start = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        size = np.diff(np.append(start, len(root)))
        several = np.maximum.reduceat(component, start) != np.minimum.reduceat(component, start)
        total = np.add.reduceat(_mixed(number.view(np.uint64)), start).view(np.int64)  # equal groups of different lists are one
        found = []
        for s, n, t in zip(start[several].tolist(), size[several].tolist(), total[several].tolist(), strict=True):
            meeting.append(np.unique(component[s : s + n]).tolist())
            found.append((t, 0, False, meeting[-1][0], number[s : s + n].tolist()))
        return found

    def long(key, numbers, components):
        """Chunks of a long list, each with its first class."""
        if min(components) == max(components):
            return []
        meeting.append(sorted(set(components)))
        step = longest - 1
        return [(hash(("long", key)), c, True, meeting[-1][0], [numbers[0], *numbers[1 + c * step : 1 + (c + 1) * step]]) for c in range(-(-(len(numbers) - 1) // step))]

    def run(batches):
        held, many = None, None  # rows of the last list so far; it, as key, numbers and components, when it is long
        for batch in batches:
            key, number, component = (batch.column(k).to_numpy() for k in range(3))
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), TALLIED)
            now = [key, number, component, prints]
            found = []
            if many is not None:
                n = int(np.searchsorted(now[0], many[0], side="right"))
                many[1].extend(now[1][:n].tolist())
                many[2].extend(now[2][:n].tolist())
                now = [x[n:] for x in now]
                if len(now[0]):
                    found += long(*many)
                    many = None
            if len(now[0]):
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                edges = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
                size = np.diff(np.append(edges, len(held[0])))
                for s, n in zip(edges[:-1][size[:-1] > longest].tolist(), size[:-1][size[:-1] > longest].tolist(), strict=True):
                    found += long(int(held[0][s]), held[1][s : s + n].tolist(), held[2][s : s + n].tolist())
                short = np.repeat(size <= longest, size)
                short[edges[-1] :] = False
                if short.any():
                    found += whole(*(x[short] for x in held))
                held = [x[edges[-1] :] for x in held]
                if len(held[0]) > longest:
                    many, held = (int(held[0][0]), held[1].tolist(), held[2].tolist()), None
            yield rows(found)
        if many is not None:
            yield rows(long(*many))
        elif held is not None:
            yield rows(whole(*held))

    return run


def similar_links(sets: list[np.ndarray], similarity: float, own: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among sets of shingles, as pairs of places, that connect what all links and the components ``own`` connect."""
    sizes, own = np.array([len(s) for s in sets]), np.arange(len(sets)) if own is None else np.array(own)
    which = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum(sizes)))
    inside = np.zeros(which.max() + 1, np.int64)
    left, queue, found = np.arange(len(sets)), [], []
    flat, starts = which, edges[:-1]
    while len(left):
        if not queue:
            take = own[left] == own[left[0]]
        else:
            at = queue.pop()
            mine = which[edges[at] : edges[at + 1]]
            inside[mine] = 1
            both = np.add.reduceat(inside[flat], starts)
            inside[mine] = 0
            near = both >= similarity * (sizes[left] + sizes[at] - both) - 1e-9
            found += [(at, t) for t in left[near].tolist()]
            take = np.isin(own[left], own[left[near]]) if near.any() else near
        queue += left[take].tolist()
        if take.any():
            flat, left = flat[np.repeat(~take, sizes[left])], left[~take]
            starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1])).astype(np.int64)
    return found


def _verified(similarity: float):
    """Sorted ``group, number, component, shingles`` to the links ``a, b`` of each group that join components."""

    def run(batches):
        at, numbers, sets, own, found = None, [], [], [], []

        def close():
            if len(sets) < 2:
                return
            root = {c: c for c in own}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for x, y in similar_links(sets, similarity, own):
                if (a := top(own[x])) != (b := top(own[y])):
                    root[b] = a
                    found.append((numbers[x], numbers[y]))

        def links():
            table = np.array(found, np.int64).reshape(-1, 2)
            found.clear()
            return pa.record_batch([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

        for batch in batches:
            for group, number, component, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if group != at:
                    close()
                    at, numbers, sets, own = group, [], [], []
                if not numbers or numbers[-1] != number:
                    numbers.append(number)
                    own.append(component)
                    sets.append(np.frombuffer(raw, np.uint64))
            yield links()
        close()
        yield links()

    return run


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, miss: float = 1e-4, longest: int = 512) -> DataFrame:
    """``id_col, component_id`` of rows with an id: the smallest id reachable over texts whose shingles have this Jaccard similarity.

    Texts without words equal each other and nothing else; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    work = Workspace(df.sparkSession, "near")
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    signed = lambda values: np.array(values, np.uint64).view(np.int64)
    positions, bits = index_plan(known.count(), similarity, miss)
    least, most = least_tally(similarity, miss / 10), most_bits(similarity, miss / 10)

    def sketch(batches):
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            prints = [p.tobytes() if len(found) else None for p, found in zip(simhashes(sets, bits), sets, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(signed([_set_hash(s) for s in sets])), pa.array(prints, pa.binary())], ["id", "fp", "print"])

    def members(batches):
        for batch in sliced(batches):
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(signed([_set_hash(s) for s in sets])), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType()), T.StructField("print", T.BinaryType())])
    rows = work.table(known.mapInArrow(sketch, schema), "rows")
    ids = work.table(rows.select("id", "fp"), "ids")
    found = rows.groupBy("fp").agg(F.min("id").alias("first"), F.first("print").alias("print"))
    classes = work.table(found.withColumn("number", F.monotonically_increasing_id()), "classes")
    work.drop("rows")
    named = classes.select("number", "fp", "first")
    prints = classes.filter("print is not null")
    count, parts, links = prints.count(), None, None

    def verify(faced: DataFrame, sets: DataFrame, *key: str) -> DataFrame:
        dealt = component(faced.select(F.xxhash64(*key).alias("group"), "number")).join(sets, "number").select("group", "number", "component", "shingles").repartition("group").sortWithinPartitions("group", "number")
        return dealt.mapInArrow(_verified(similarity), "a long, b long")

    def component(numbers: DataFrame) -> DataFrame:
        if parts is None:
            return numbers.withColumn("component", F.col("number"))
        return numbers.join(parts.withColumnRenamed("node", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))

    rest = positions[EARLY[-1] :]
    spans = [*np.split(positions[: EARLY[-1]], EARLY[:-1]), *np.array_split(rest, max(-(-len(rest) // PASS), 1))]
    for k, some in enumerate(x for x in spans if len(x)):
        tasks = max(-(-(len(some) << (8 * some.shape[1])) // (1 << 32)), -(-count * len(some) // TASK))
        index = prints.select("number", "print").mapInArrow(_postings(some, tasks), "task int, base long, codes binary, places binary")
        met = work.table(index.repartition("task").sortWithinPartitions("task").mapInArrow(_lists, "list long, number long"), f"met{k}")
        short = component(prints.select("number", F.substring("print", 1, TALLIED).alias("print")))
        met = met.join(short, "number").select("list", "number", "component", "print").repartition("list").sortWithinPartitions("list", "number")
        kept = met.mapInArrow(_met(least, most, longest), "group long, chunk int, long boolean, component long, numbers array<long>")
        groups = work.table(kept.groupBy("group", "chunk", "long", "component").agg(F.first("numbers").alias("numbers")), f"groups{k}")
        work.drop(f"met{k}")
        if groups.isEmpty():
            continue
        joined = groups.filter("chunk < 0").select(F.col("component").alias("a"), F.col("group").alias("b"))
        clusters = connected_components(joined, Workspace(df.sparkSession, "near")).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        inside = work.table(component(prints.select("number")).join(clusters, "component").select("cluster", "number"), f"members{k}")
        sized = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("head")).withColumn("chunks", F.ceil(F.col("n") / longest).cast("int"))
        chunk = F.pmod(F.xxhash64("number"), F.col("chunks")).cast("int")
        chunk = F.explode(F.when(F.col("number") == F.col("head"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk)))
        listed = inside.join(sized.filter(F.col("chunks") <= CHUNKS), "cluster").select(F.col("cluster").alias("group"), chunk.alias("chunk"), (F.col("chunks") > 1).alias("long"), "number")
        listed = work.table(listed, f"listed{k}")
        large = clusters.join(sized.filter(F.col("chunks") > CHUNKS), "cluster").select("component")
        if not large.isEmpty():
            alone = groups.filter("chunk >= 0").join(large, "component", "left_semi")
            listed = listed.unionAll(alone.select("group", "chunk", "long", F.explode("numbers").alias("number")))
        wanted = named.join(listed.select("number").distinct(), "number")
        texts = known.join(wanted.select(F.col("first").alias("id")).hint("shuffle_hash"), "id", "left_semi").select("text")
        sets = texts.mapInArrow(members, "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))
        sets = work.table(sets.join(wanted.select("fp", "number"), "fp").select("number", "shingles"), f"sets{k}")
        new = work.table(verify(listed, sets, "group", "chunk"), f"links{k}")
        links = new if links is None else links.unionAll(new)
        parts = connected_components(links, Workspace(df.sparkSession, "near"))
        long = listed.filter("long")
        if not long.isEmpty():
            placed = work.table(component(long.distinct()), f"placed{k}")
            main = placed.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
            others = work.table(placed.join(main, "group").filter("component != main").select("group", "number").distinct(), f"others{k}")
            if not others.isEmpty():
                blocks = others.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / longest).cast("int").alias("blocks"))
                chunks = long.groupBy("group").agg((F.max("chunk") + 1).alias("chunks"))
                whole = long.join(blocks, "group").select("group", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "number")
                rest = others.join(blocks, "group").join(chunks, "group").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
                rest = rest.select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "number")
                links = links.unionAll(work.table(verify(whole.unionAll(rest), sets, "group", "chunk", "block"), f"more_links{k}"))
                parts = connected_components(links, Workspace(df.sparkSession, "near"))
        work.drop(f"sets{k}", f"groups{k}", f"members{k}", f"listed{k}")
    grouped = component(named)
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    found = work.table(grouped.join(smallest, "component").select("fp", "component_id"), "class_ids")
    return ids.join(found, "fp").select(F.col("id").alias(id_col), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose id is its component's; rows with a null id stay, and ids with rows in several groups if one is kept."""
    found = near_components(df, id_col, **options)
    drop = found.groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("stays")).filter("not stays").select(id_col)
    return df.join(drop.hint("shuffle_hash"), id_col, "left_anti")
