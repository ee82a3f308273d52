"""A local knowledge base: resolve, search and neighbours over entity and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH_LIMIT, NEIGHBOUR_LIMIT = 10, 100


class KnowledgeBase:
    """``entities(id, label, description)`` and ``edges(source, relation, target)``."""

    def __init__(self, entities: DataFrame, edges: DataFrame):
        self.entities, self.edges = entities, edges

    def resolve(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.entities, "id", "left")

    def search(self, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
        """Entities whose label holds the text: equal first, then at the start, then by label; scores fall from 1 with the rank."""
        label, needle = F.lower("label"), F.lit(text.lower())
        hits = self.entities.filter(F.contains(label, needle)).withColumn("_class", F.when(label == needle, 0).when(F.startswith(label, needle), 1).otherwise(2))
        top = hits.orderBy("_class", "label", "id").limit(limit)
        rank = F.row_number().over(Window.orderBy("_class", "label", "id")) - 1  # over at most ``limit`` rows
        return top.withColumn("rank", rank.cast("long")).withColumn("score", 1 - F.col("rank") / limit).drop("_class")

    def search_many(self, names: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
        """Candidates of each name that share its label in lower case, ranked within the name."""
        pairs = names.select("name", F.lower("name").alias("_k")).distinct().join(self.entities.withColumn("_k", F.lower("label")), "_k")
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("id")).cast("long") - 1).filter(F.col("rank") < limit)
        return best.select("name", "id", "label", "rank", (1 - F.col("rank") / limit).alias("score"))

    def neighbors(self, ids: DataFrame, relation: str | None = None, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
        """Up to ``limit`` one-hop edges of each entity with the target's label."""
        own = self.edges if relation is None else self.edges.filter(F.col("relation") == relation)
        out = own.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
        ranked = out.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("relation", "target"))).filter(F.col("_n") <= limit).drop("_n")
        return ranked.join(self.entities.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target", "left")
