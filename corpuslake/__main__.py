"""``python -m corpuslake FOLDER sql|concordance|cql QUERY [--limit N]``: ask a folder of views, and print rows with tabs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corpuslake.plans.engine import LIMIT, Engine
from corpuslake.plans.errors import QueryError


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 with the reason on stderr if the query is not answered."""
    reader = argparse.ArgumentParser(prog="corpuslake")
    reader.add_argument("folder")
    reader.add_argument("mode", choices=("sql", "concordance", "cql", "tables"))
    reader.add_argument("query", nargs="?", default="")
    reader.add_argument("--limit", type=int, default=LIMIT)
    asked = reader.parse_args(argv)
    try:
        engine = Engine.open(spark or SparkSession.builder.getOrCreate(), asked.folder)
        if asked.mode == "tables":
            for name, columns in engine.schema().items():
                print(name, *columns, sep="\t")
            return 0
        result = engine.query(asked.mode, asked.query, asked.limit)
    except QueryError as e:
        print(e, file=sys.stderr)
        return 2
    for row in (result.columns, *result.rows):
        print(*row, sep="\t")
    if result.truncated:
        print(f"more than {asked.limit} rows", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
