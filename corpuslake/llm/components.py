"""Connected components of a link table, by contraction in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import Workspace

#: Links a task of a round has at least, but for the last one.
ROWS = 10_000


def connected_components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    In each round every node points to the smallest of itself and its neighbours,
    pointers are followed once more, and links are redrawn between the nodes that
    are pointed to.  Inner links vanish, so the link table shrinks until it is
    empty.  Minima are pre-aggregated before they are exchanged, and the joins are
    plain sort-merge joins, whose hot nodes Spark splits at run time.  Each round's
    map is written to the shared folder; no link or node reaches the driver.  The
    maps are then composed from the last round back, over growing tables.  A round's
    tables have no more files than their links fill with ``ROWS`` each, so that late
    rounds are not many tasks of next to nothing.  Null ends and links of a node to
    itself are ignored.
    """

    def tidy(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = work.table(links.select(*tidy(F.col("a"), F.col("b"))).filter("a < b").distinct(), "links0")
    maps, step = [], 0
    while count := edges.count():
        files = count // ROWS + 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")).coalesce(files), f"points{step}")
        further = points.select(F.col("node").alias("to"), F.col("to").alias("root"))
        jump = work.table(points.join(further, "to").select("node", "root").coalesce(files), f"map{step}")
        maps.append(jump)
        ends = edges.join(jump.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(jump.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = work.table(ends.select(*tidy(F.col("ra"), F.col("rb"))).filter("a < b").distinct().coalesce(files), f"links{step + 1}")
        work.drop(f"points{step}", f"links{step}")
        step += 1
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[-1].select("node", F.col("root").alias("component"))
    for jump in reversed(maps[:-1]):
        known = found.select(F.col("node").alias("root"), "component")
        found = jump.join(known, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return work.table(found, "components")
