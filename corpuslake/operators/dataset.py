"""Lazy, possibly streaming sequences of typed rows over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.operators.flatten import features_of


class Dataset:
    """Wraps a DataFrame; ``order`` names the column that gives rows their place."""

    def __init__(self, df: DataFrame, order: str | None = None, sized: bool = True):
        self.df, self.order, self.sized = df, order, sized and not df.isStreaming

    @classmethod
    def from_iterable(cls, spark, rows, schema: T.StructType | str, order: str = "place") -> Dataset:
        """Rows in memory, numbered in their order as ``order``."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        placed = [(k, *(r[f.name] if isinstance(r, dict) else r[i] for i, f in enumerate(kind))) for k, r in enumerate(rows)]
        return cls(spark.createDataFrame(placed, T.StructType([T.StructField(order, T.LongType()), *kind.fields])), order)

    @classmethod
    def streaming(cls, df: DataFrame) -> Dataset:
        """A sequence without a length: a stream, or a table that is not to be counted."""
        return cls(df, None, False)

    def filter(self, condition: Column | str | Callable) -> Dataset:
        """A column condition, which Catalyst sees through, or a Python predicate on rows in Arrow batches."""
        if not callable(condition) or isinstance(condition, Column):
            return Dataset(self.df.filter(condition), self.order, self.sized)

        def run(batches):
            for batch in batches:
                keep = [bool(condition(row)) for row in batch.to_pylist()]
                if any(keep):
                    import pyarrow as pa

                    yield batch.filter(pa.array(keep))

        return Dataset(self.df.mapInArrow(run, self.df.schema), self.order, self.sized)

    def map(self, fn: Callable[[dict], dict], schema: T.StructType | str) -> Dataset:
        """Row to row; the result has no length."""
        return self.map_batched(lambda rows: [fn(r) for r in rows], schema)

    def map_batched(self, fn: Callable[[list[dict]], list[dict]], schema: T.StructType | str, batch_size: int = 1000) -> Dataset:
        """Lists of at most ``batch_size`` rows to any number of rows; the result has no length."""
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, waiting = to_arrow_schema(kind), []

            def emit(rows):
                return pa.RecordBatch.from_pylist(list(fn(rows)), schema=arrow)

            for batch in batches:
                waiting += batch.to_pylist()
                while len(waiting) >= batch_size:
                    yield emit(waiting[:batch_size])
                    waiting = waiting[batch_size:]
            if waiting:
                yield emit(waiting)

        return Dataset(self.df.mapInArrow(run, kind), None, False)

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(self.order) if self.order else self.df

    def iter(self, batch_size: int = 1) -> Iterator[list]:
        """Lists of rows, one partition at a time on the driver; the last may be short."""
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        batch = []
        for row in self._ordered().toLocalIterator():
            batch.append(row)
            if len(batch) == batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    def take(self, count: int) -> list:
        return self._ordered().limit(count).collect()

    def __len__(self) -> int:
        if not self.sized:
            raise TypeError("a streaming dataset has no length")
        return self.df.count()

    def __getitem__(self, place: int):
        if not self.sized:
            raise TypeError("a streaming dataset has no places")
        if self.order is None:
            raise TypeError("a dataset without an order has no places")
        rows = self._ordered().offset(place).limit(1).collect() if place >= 0 else []
        if not rows:
            raise IndexError(place)
        return rows[0]

    def materialize(self) -> Dataset:
        """Kept in memory, spilling to disk."""
        return Dataset(self.df.cache(), self.order)

    def to_arrow(self):
        return self._ordered().toArrow()

    def to_pandas(self):
        return self._ordered().toPandas()

    def features(self) -> list[tuple[str, str, bool]]:
        return features_of(self.df)

    def numeric_columns(self) -> list[str]:
        return [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]

    def worker_share(self, worker: int, workers: int) -> DataFrame:
        """The rows that one of several loading processes reads: every ``workers``-th by order."""
        return self.df.filter(F.pmod(F.col(self.order), F.lit(workers)) == worker)
