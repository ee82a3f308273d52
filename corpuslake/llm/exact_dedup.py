"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each row's text is normalised (white space deleted) and digested.  Rows are dealt
to ``runs`` runs by a hash of their id.  A run is the sorted list of its digests, cut
into digest ranges, each digest with the smallest identifier seen; Spark pre-aggregates
a task's rows before the runs are made, so a digest that a third of all rows share
crosses the network at most once for each task and run.  Runs then meet in rounds, as
in a binomial tree of degree ``fan_in``: in round k those whose numbers agree after k
divisions go, range by range, to one partition, where they are merged in digest order
and of equal entries the smallest identifier is retained, verified by SHA-256.  A round
is one exchange; its merge neither exchanges nor sorts again, and no task receives
more of a digest than there are runs.  The last round leaves one run, still in ranges.

On the way back down the winners meet the entries of the first runs, and rows meet
their own run's entry only, so copies of one text are spread over ``runs`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import SPACE, Workspace

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
_ORDER = ("range", "run", "digest", "sha")


def merged_runs(runs: DataFrame, count: int, fan_in: int = 8) -> DataFrame:
    """The rounds: ``count`` sorted runs ``range, run, digest, sha, best, n`` to one."""
    while count > 1:
        met = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("range", "run").sortWithinPartitions(*_ORDER)
        runs = met.groupBy(*_ORDER).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        count = -(-count // fan_in)
    return runs


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 512, fan_in: int = 8, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``df``, its ``columns`` (default: all), and ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting white space; a null text counts
    as empty, so null, empty and blank texts are one group.  Of equal texts the row
    with the most code points stays, ties go to the smallest id, and a null id loses
    to any other.  Of rows repeated with one id and text exactly one is kept.  An
    empty table gives an empty result.  The four result names replace columns of
    the same name in ``df``; no other column's name matters.  Without the text among
    ``columns`` texts are read once, else twice.
    """
    work, names = Workspace(df.sparkSession, "exact"), [c for c in columns or df.columns if c not in RESULTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).alias("id"), F.length(text).alias("points"), F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("sha"))
        .withColumn("digest", F.xxhash64("sha"))
        .withColumn("range", F.floor(F.shiftrightunsigned("digest", 32) * ranges / 2**32).cast("int"))
        .withColumn("run", F.pmod(F.xxhash64(F.lit("run"), "id"), F.lit(runs)).cast("int"))
    )
    if text_col not in names:
        rows = work.table(rows, "rows")
    first = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))
    made = work.table(rows.groupBy(*_ORDER).agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n")), "runs")  # read on the way up and on the way down
    top = merged_runs(made, runs, fan_in).select("digest", "sha", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    entries = made.select("digest", "sha", "run").join(top, ["digest", "sha"])
    same_row = Window.partitionBy("digest", "sha", "run", "id").orderBy(F.col("points").desc())
    return (
        rows.join(entries, ["digest", "sha", "run"])
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same_row) == 1))
        .withColumn("text_sha256", F.lower(F.hex("sha")))
        .select(*(F.col(f"row.`{c}`") for c in names), *RESULTS)
    )


def kept_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that exact deduplication keeps, with the columns of ``df``."""
    return exact_dedup(df, **options).filter("kept").select(*df.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, columns=["doc_id"])


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS place
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM w
"""
