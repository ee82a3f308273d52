"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes all rows that its predecessor kept and returns their columns as they
are, but for the last, which returns pieces.  In every stage null texts count as empty,
a table without rows gives one without rows, and texts of any length are read whole;
what each does with null ids and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslake.llm import exact_dedup, mixing, near_copies, packing, quality
from corpuslake.llm.common import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its quality score is below this.
QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Rows with a null id are scored as others are; equal texts stay or go together;
    without labels of both kinds every text scores the smoothed share of good ones.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, threshold=QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as it is written, then the smallest id.

    Empty texts are one group; a null id loses to any other; of repeated rows one stays.
    """
    return exact_dedup.kept_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts that share 0.8 or more of their five-word shingles.

    Texts without words are one group; rows with a null id stay; rows that repeat an
    id and its text stay or go together.
    """
    return near_copies.representatives(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their source's weight asks; every document stays at least once.

    Null sources are one source; rows with a null id are one block of their source;
    repeated rows are repeated alike.
    """
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences; null ids stay null, and every row, also a repeated one, is packed."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Trained scores and token ids are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
