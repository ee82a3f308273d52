"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares are raised to an exponent and normalised.  The exponent is
bisected: the flattest weights whose repetition stays within ``max_repeats``, or
those whose entropy is ``entropy`` bits.  Rows are dealt to ``blocks`` blocks of
their source by a hash of their id.  A source gets its whole epochs and, for the
rest of its budget, the first blocks of a keyed permutation of its blocks, taken
while their tokens fit.  Only block totals (``blocks`` rows a source at most) are
sorted or exchanged; rows find their copies by arithmetic on source and block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import SPACE, Workspace

STEPS, NEAR = 60, 1e-9
#: Up to so many sources their totals are bisected on the driver and their cuts broadcast.
FEW_SOURCES = 10_000


def _hash16(column, at: int = 1):
    return F.conv(F.substring(F.md5(column), at, 4), 16, 10).cast("long")


def _bisect(flat_enough) -> float:
    """The least exponent in [0, 1] at which ``flat_enough`` holds; it holds at 1."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


def entropy_of(counts: list[int], power: float) -> float:
    """Entropy in bits of the normalised powers of token counts."""
    weights = [c**power for c in counts]
    total = sum(weights)
    return math.log2(total) - sum(w * math.log2(w) for w in weights) / total


def exponent(totals: DataFrame, max_repeats: float | None, entropy: float | None) -> float:
    """The exponent for ``totals(source, tokens)``."""
    if entropy is None:
        # repetition of a source against the largest one, which gets one epoch, depends on the extremes alone
        most, least = totals.filter("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
        return _bisect(lambda a: most is None or (most / least) ** (1 - a) <= max_repeats)
    shares = totals.filter("tokens > 0")
    few = shares.limit(FEW_SOURCES + 1).collect()
    if not few:
        return 1.0
    if len(few) <= FEW_SOURCES:
        counts = [r.tokens for r in few]
        return _bisect(lambda a: entropy_of(counts, a) <= entropy)
    return _bisect(lambda a: _spread_entropy(shares, a) <= entropy)


def _spread_entropy(shares: DataFrame, power: float) -> float:
    """``entropy_of`` for more sources than the driver takes."""
    w = F.pow(F.col("tokens").cast("double"), F.lit(power))
    total, inner = shares.agg(F.sum(w), F.sum(w * F.log2(w))).first()
    return math.log2(total) - inner / total


def mix(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_repeats: float = 2.0, entropy: float | None = None, budget: int | None = None, blocks: int = 1024) -> DataFrame:
    """Rows of ``df``, repeated as their source's weight asks, with ``epoch`` and ``position``.

    Tokens are words between ASCII white space.  Without a ``budget`` in tokens the
    largest source is read exactly once and no row is left out; with one, a source
    may get part of an epoch only.  ``position`` is the place of a row's block in
    the source's permutation, epoch after epoch.  ``blocks`` is a power of two up to
    65,536, so that the keyed affine map of block numbers is a permutation.  Null
    sources are one source; a source without a token is read once; a null text has no
    tokens; rows with a null id are one block; repeated rows are repeated alike.  An
    empty table gives an empty result.  ``epoch`` and ``position`` replace columns of
    those names; no other column's name matters.
    """
    if blocks & (blocks - 1) or not 0 < blocks <= 65536:
        raise ValueError("blocks must be a power of two up to 65,536")
    names, work = [c for c in df.columns if c not in ("epoch", "position")], Workspace(df.sparkSession, "mixing")
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source")
    block = F.coalesce(_hash16(F.col(id_col).cast("string")) % blocks, F.lit(0)).alias("block")
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE.replace("[", "[^", 1) + "+")).cast("long")
    totals = work.table(df.select(source, block, tokens.alias("tokens")).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    by_source = totals.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    power = exponent(by_source, max_repeats, entropy)
    whole = by_source.agg(F.max("tokens").alias("most"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power)))).alias("sum")).first()
    share = F.col("total").cast("double")
    if budget is None:
        epochs = F.pow(F.lit(float(whole.most or 1)) / share, F.lit(1 - power))
    else:
        epochs = F.lit(float(budget)) * F.pow(share, F.lit(power - 1)) / F.lit(whole.sum or 1.0)
    epochs = F.when(F.col("total") > 0, epochs).otherwise(F.lit(1.0))
    rank = ((_hash16("source").bitwiseOR(F.lit(1)) * F.col("block") + _hash16("source", 5)) % blocks).alias("rank")
    each, in_order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("rank")
    taken = F.when((F.col("part") > 0) & F.col("fits"), F.col("rank"))
    plan = (
        totals.select("*", rank)
        .withColumn("total", F.sum("tokens").over(each))
        .withColumn("epochs", epochs)
        .withColumn("whole", F.floor(F.col("epochs") + NEAR).cast("int"))
        .withColumn("part", F.greatest(F.col("epochs") - F.col("whole"), F.lit(0.0)) * F.col("total"))
        .withColumn("fits", F.sum("tokens").over(in_order) <= F.col("part"))
    )
    cuts = work.table(plan.groupBy("source").agg(F.first("whole").alias("whole"), F.max(taken).alias("cut")), "cuts")
    rows = df.select(row, source, block).select("*", rank)
    if cuts.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        found = rows.join(F.broadcast(cuts), "source")
    else:  # more sources than may be broadcast: meet by source and block, so that a large source is spread
        found = rows.join(totals.select("source", "block").join(cuts, "source"), ["source", "block"])
    copies = F.col("whole") + F.when(F.col("rank") <= F.coalesce("cut", F.lit(-1)), 1).otherwise(0)
    return (
        found.withColumn("copies", copies)
        .filter("copies > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("position", F.col("epoch").cast("long") * blocks + F.col("rank"))
        .select(*(F.col(f"row.`{c}`") for c in names), "epoch", "position")
    )


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "epoch", "position")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
         coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 1024, 0) AS block,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), b AS (
  SELECT s, block, CAST(sum(tokens) AS BIGINT) AS tokens,
         ((CAST('0x' || substr(md5(s), 1, 4) AS BIGINT) | 1) * block + CAST('0x' || substr(md5(s), 5, 4) AS BIGINT)) % 1024 AS rank
  FROM d GROUP BY s, block
), t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS total FROM b GROUP BY s),
m AS (SELECT CAST(max(total) AS DOUBLE) AS most, CAST(min(total) AS DOUBLE) AS least FROM t WHERE total > 0),
steps(k, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1,
         CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM steps, m WHERE k < 60
), e AS (
  SELECT s, total, CASE WHEN total > 0 THEN pow(most / total, 1 - high) ELSE 1.0 END AS epochs
  FROM t, m, steps WHERE k = 60
), p AS (
  SELECT b.s, block, rank, CAST(floor(epochs + 1e-9) AS INT) AS whole,
         sum(tokens) OVER (PARTITION BY b.s ORDER BY rank) AS so_far,
         greatest(epochs - floor(epochs + 1e-9), 0) * total AS part
  FROM b JOIN e ON b.s = e.s
), c AS (
  SELECT s, max(whole) AS whole, coalesce(max(CASE WHEN part > 0 AND so_far <= part THEN rank END), -1) AS cut FROM p GROUP BY s
), r AS (
  SELECT d.doc_id, d.source, p.rank, c.whole + CASE WHEN p.rank <= c.cut THEN 1 ELSE 0 END AS copies
  FROM d JOIN p ON d.s = p.s AND d.block = p.block JOIN c ON d.s = c.s
)
SELECT doc_id, source, CAST(epoch AS INT) AS epoch, CAST(epoch * 1024 + rank AS BIGINT) AS position
FROM (SELECT doc_id, source, rank, unnest(range(copies)) AS epoch FROM r)
"""
