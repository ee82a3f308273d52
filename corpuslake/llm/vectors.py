"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class throughout.  Hashes are of a class's unit
vector less the mean of its label, so that a direction that a label's vectors share
costs no bits.  How many passes a label needs follows from its number of classes and
how far they lie from the mean: so many that a pair at the threshold that nothing else
connects is found with probability ``recall``.

Each pass gives every class a code of concatenated random hyperplane hashes and orders
the classes of a label by it lexicographically; every vector is compared with its next
``window`` neighbours, across the ends of partitions too.  A task reduces its verified
pairs to a spanning forest, and all forests are united to components.  Links never
leave a component, so the links of a vector are then counted within its component; pairs
are counted and never listed.  Of a component of more than ``block`` classes, those
within half the threshold's angle of its centre all link with each other, which needs
no products; the others are compared with the whole component, in blocks of ``block``
classes dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import Workspace
from corpuslake.llm.components import connected_components


def _stack(column, kind: str) -> np.ndarray:
    raw = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is connected to by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _sums(kind: str):
    """Classes to partial sums by label and length: ``group, dim, n, total``."""

    def run(batches):
        for batch in batches:
            rows = batch.select(["group", "dim", "vector"]).to_pandas()
            found = [(g, d, len(own), _unit(_stack(own["vector"], kind)).sum(axis=0).tobytes()) for (g, d), own in rows.groupby(["group", "dim"])]
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (batch.schema.field("group").type, pa.int32(), pa.int64(), pa.binary()), strict=True)], ["group", "dim", "n", "total"])

    return run


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a component to its centre, not yet of unit length."""
    return pd.DataFrame({"component": rows["group"].iloc[:1], "centre": [sum(np.frombuffer(t, np.float64) for t in rows["total"]).tobytes()]})


def passes_for(n: int, shared: float, threshold: float, window: int, recall: float) -> int:
    """Passes that find an isolated pair at the threshold among ``n`` classes whose mean has length ``shared``.

    The two agree on a hash with probability 1 - angle / pi and must agree on about
    log2(n / window) of them to come within the window.
    """
    apart = max(1 - shared * shared, 1e-9)
    agree = 1 - np.arccos(np.clip(1 - (1 - threshold) / apart, -1, 1)) / np.pi
    met = max(agree, 1e-3) ** max(np.log2(max(n, 1) / window), 0)
    return int(min(np.ceil(np.log(1 - recall) / np.log1p(-met)), 1e6)) if met < recall else 1


def _plans(threshold: float, passes: int, window: int, recall: float):
    """Sums of a label to its mean and its passes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        mean = sum(np.frombuffer(t, np.float64) for t in rows["total"]) / n
        need = max(passes, passes_for(n, float(np.sqrt(mean @ mean)), threshold, window, recall))
        return pd.DataFrame({"group": rows["group"].iloc[:1], "dim": rows["dim"].iloc[:1], "n": [n], "mean": [mean.tobytes()], "passes": [need]})

    return run


def _codes(kind: str, bits: int, seed: int):
    """Classes with their label's mean and passes to one row for each pass: ``pass, group, dim, code, id, vector``."""

    def run(batches):
        for batch in batches:
            group, dims, ids, raw, means, needs = (batch.column(k) for k in range(6))
            sizes, needs = dims.to_numpy(), needs.to_numpy()
            for dim in np.unique(sizes).tolist():
                place = np.flatnonzero(sizes == dim)
                at = pa.array(place)
                rows = _unit(_stack(raw.take(at), kind)) - _stack(means.take(at), "<f8")
                for p in range(int(needs[place].max())):
                    own = needs[place] > p
                    at = pa.array(place[own])
                    planes = np.random.default_rng((seed, dim, p)).standard_normal((dim, bits))
                    code = (rows[own] @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(at), p, np.int32)), group.take(at), dims.take(at), pa.array(code), ids.take(at), raw.take(at)], ["pass", "group", "dim", "code", "id", "vector"])

    return run


def _forest(ids: np.ndarray, pairs: list):
    """A spanning forest of pairs of places, as ids."""
    root = _roots(len(ids), np.concatenate(pairs[0]), np.concatenate(pairs[1]))
    linked = np.flatnonzero(root != np.arange(len(ids)))
    return ids[linked], ids[root[linked]]


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the unit vectors of two blocks link; at the threshold as the windows see it."""
    product = a @ b.T
    near = product >= threshold
    i, j = np.nonzero(np.abs(product - threshold) < 1e-9)
    near[i, j] = _dots(a[i], b[j]) >= threshold
    return near


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _windows(kind: str, window: int, threshold: float, ends: bool = True):
    """Sorted rows to a spanning forest of the verified pairs of neighbours.

    With ``ends``, the partition's first and last ``window`` rows follow, each once:
    put together in order they are neighbours as before, across partitions.
    """

    def links(table):
        n, ids = len(table), table["id"].to_numpy()
        group = pd.factorize(pd.MultiIndex.from_frame(table.select(["pass", "group", "dim"]).to_pandas()))[0]
        pairs = [[], []]
        edge = np.flatnonzero(np.diff(table["dim"].to_numpy())) + 1
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
            rows = _unit(_stack(table["vector"].slice(s, e - s), kind))
            for step in range(1, min(window, e - s - 1) + 1):
                close = np.flatnonzero((group[s : e - step] == group[s + step : e]) & (_dots(rows[:-step], rows[step:]) >= threshold)) + s
                pairs[0].append(close)
                pairs[1].append(close + step)
        return _forest(ids, pairs) if pairs[0] else (ids[:0], ids[:0])

    def run(batches):
        kept, first, seen, schema = None, [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            schema = batch.schema
            if seen < window:
                first.append(batch.slice(0, window - seen))
            seen += len(batch)
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            kept = table.slice(max(len(table) - window, 0))
            a, b = links(table)
            blank = [pa.nulls(len(a), f.type) for f in schema]
            yield pa.record_batch([pa.array(a), pa.array(b), *(blank if ends else [])], ["a", "b", *(schema.names if ends else [])])
        if ends and seen:
            last = min(window, max(seen - window, 0))
            edge = pa.concat_tables([pa.Table.from_batches(first), kept.slice(len(kept) - last)]).combine_chunks().to_batches()[0]
            none = pa.nulls(len(edge), pa.int64())
            yield pa.record_batch([none, none, *edge.columns], ["a", "b", *schema.names])

    return run


def _count(kind: str, threshold: float):
    """Rows of a small component to the copies of other classes that each class links to."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = _unit(_stack(rows["vector"], kind))
        near = _close(vectors, vectors, threshold).astype(np.int64)
        np.fill_diagonal(near, 0)
        return pd.DataFrame({"id": rows["id"], "links": near @ rows["copies"].to_numpy()})

    return run


def _near_centre(kind: str, threshold: float):
    """Classes with the sum of their component's unit vectors to the same with ``core``: whether they are near its centre."""
    half = np.cos(np.arccos(threshold) / 2 - 1e-7)

    def run(batches):
        for batch in batches:
            vectors, centres = _unit(_stack(batch.column(3), kind)), _stack(batch.column(4), "<f8")
            size = np.sqrt((centres * centres).sum(axis=1))
            core = _dots(vectors, centres) >= half * np.where(size > 0, size, np.inf)
            yield pa.record_batch([*(batch.column(k) for k in range(4)), pa.array(core)], ["component", "id", "copies", "vector", "core"])

    return run


def _count_others(kind: str, threshold: float):
    """Rows of a block of a component and of a block of its classes far from the centre to the links between them, of both sides."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole, far = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(whole) or not len(far):
            return pd.DataFrame({"id": [], "links": []}).astype("int64")
        near = _close(_unit(_stack(whole["vector"], kind)), _unit(_stack(far["vector"], kind)), threshold).astype(np.int64)
        near[whole["id"].to_numpy()[:, None] == far["id"].to_numpy()] = 0
        of_far = near.T @ whole["copies"].to_numpy()
        of_core = (near @ far["copies"].to_numpy())[whole["core"].to_numpy(bool)]  # the others of the block are counted from the far side
        return pd.DataFrame({"id": [*whole["id"][whole["core"]], *far["id"]], "links": [*of_core, *of_far]})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, passes: int = 16, bits: int = 32, window: int = 32, block: int = 512, seed: int = 7, recall: float = 0.9999, edge_rows: int = 1 << 17) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Rows link when their labels are equal and not null and the cosine, in double
    precision, is at least ``threshold``.  Null or zero vectors, vectors with null
    or non-finite components, and rows with a null id link with nothing and are
    their own component.  Vectors of different length never link.  Repeated rows
    count as vectors of their own.  An empty table gives an empty result; other
    columns are ignored.
    """
    work = Workspace(df.sparkSession, "vectors")
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    element = "float" if kind == "<f4" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("group"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    big = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("id").isNotNull() & F.col("group").isNotNull() & F.coalesce(sound, F.lit(False)))
    classes = good.groupBy("group", "v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))

    def binary(batches):
        for batch in batches:
            vectors = [np.array(v, kind).tobytes() for v in batch.column(3).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(vectors, pa.binary())], ["group", "dim", "id", "copies", "vector"])

    group_type = df.schema[label_col].dataType.simpleString()
    packed = classes.select("group", F.size("v").alias("dim"), F.col("first").alias("id"), "v", "copies").mapInArrow(binary, f"group {group_type}, dim int, id long, copies long, vector binary")
    classed = work.table(packed, "classes")
    label = f"group {group_type}, dim int"
    sums = classed.select("group", "dim", "vector").mapInArrow(_sums(kind), f"{label}, n long, total binary")
    plans = work.table(sums.groupBy("group", "dim").applyInPandas(_plans(threshold, passes, window, recall), f"{label}, n long, mean binary, passes int"), "plans")
    planned = classed.select("group", "dim", "id", "vector").join(plans, ["group", "dim"])
    coded = planned.select("group", "dim", "id", "vector", "mean", "passes").mapInArrow(_codes(kind, bits, seed), f"pass int, {label}, code long, id long, vector binary")
    keys = ["pass", "group", "dim", "code", "id"]
    found = f"a long, b long, pass int, {label}, code long, id long, vector binary"
    swept = [work.table(coded.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_windows(kind, window, threshold), found), "swept0")]
    while True:  # the ends of partitions meet, themselves in partitions while they are many
        edges = swept[-1].filter("vector is not null").select(*keys, "vector")
        parts = edges.count() // max(edge_rows, 8 * window) + 1
        met = (edges.repartitionByRange(parts, *keys) if parts > 1 else edges.coalesce(1)).sortWithinPartitions(*keys)
        swept.append(work.table(met.mapInArrow(_windows(kind, window, threshold, ends=parts > 1), found if parts > 1 else "a long, b long"), f"swept{len(swept)}"))
        if parts == 1:
            break
    forest = swept[0].filter("a is not null").select("a", "b")
    for more in swept[1:]:
        forest = forest.unionAll(more.filter("a is not null").select("a", "b"))
    parts = connected_components(forest, work).withColumnRenamed("node", "id")
    members = work.table(classed.join(parts, "id"), "members")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = members.join(sizes, "component").select("component", "id", "copies", "vector", "blocks")
    per_class = "id long, links long"
    counted = sized.filter("blocks = 1").select("component", "id", "copies", "vector").groupBy("component").applyInPandas(_count(kind, threshold), per_class)
    large = sized.filter("blocks > 1")
    if not large.isEmpty():
        sums = large.select(F.col("component").alias("group"), F.octet_length("vector").alias("dim"), "vector").mapInArrow(_sums(kind), "group long, dim int, n long, total binary")
        centres = sums.groupBy("group").applyInPandas(_total, "component long, centre binary")
        placed = large.join(centres, "component").select("component", "id", "copies", "vector", "centre")
        placed = work.table(placed.mapInArrow(_near_centre(kind, threshold), "component long, id long, copies long, vector binary, core boolean"), "placed")
        cores = placed.filter("core").groupBy("component").agg(F.sum("copies").alias("all"))
        inside = placed.filter("core").join(cores, "component").select("id", (F.col("all") - F.col("copies")).alias("links"))
        counts = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("core")) / block).cast("int").alias("far"))
        dealt = placed.join(counts.filter("far > 0"), "component")
        deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        whole = dealt.select("component", deal("blocks").alias("low"), each("far").alias("high"), F.lit(0).alias("side"), "id", "copies", "vector", "core")
        far = dealt.filter("not core").select("component", each("blocks").alias("low"), deal("far").alias("high"), F.lit(1).alias("side"), "id", "copies", "vector", "core")
        between = whole.unionAll(far).groupBy("component", "low", "high").applyInPandas(_count_others(kind, threshold), per_class)
        counted = counted.unionAll(inside).unionAll(between)
    counted = counted.groupBy("id").agg(F.sum("links").alias("links"))
    about = members.select("id", "component").join(counted, "id")
    known = work.table(classed.select("id", "copies").join(about, "id", "left").filter("copies > 1 or component is not null"), "known")
    of_class = classes.select("group", "v", F.col("first")).join(known.withColumnRenamed("id", "first"), "first")
    linked = good.join(of_class, ["group", "v"]).select("id", (F.col("links") + F.col("copies") - 1).alias("with_others"), (F.col("copies") - 1).alias("with_copies"), F.coalesce("component", "first").alias("component"))
    found = linked.groupBy("id").agg(F.max(F.coalesce("with_others", "with_copies")).alias("n_links"), F.min("component").alias("component"))
    return (
        rows.select("id")
        .join(found, "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def op6_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON v.vec_id = m.a LEFT JOIN n ON v.vec_id = n.a
"""
