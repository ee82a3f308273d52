"""A token-pattern language: ``[attr op "value" & ...] [...]`` over token-aligned annotations.

A pattern is read into lists of constraints, one list for each token.  Tokens of a
match stand on consecutive indexes of one layer.  The pattern becomes an equi-join of
the annotation table with itself, or, where an index has one row at most, a look-ahead
in one sorted pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.regex import re2_to_java
from corpuslake.plans.errors import PatternError

Constraint = tuple[str, str, str]
OPERATORS = ("!=", "=", "~")


def _constraints(inner: str) -> list[Constraint]:
    """What stands between two brackets, read from left to right; ``&`` between constraints may be left out."""
    found, rest = [], inner.strip()
    while rest:
        rest = rest.removeprefix("&").lstrip()
        size = next((k for k, c in enumerate(rest) if not (c.isalnum() or c == "_")), len(rest))
        name, rest = rest[:size], rest[size:].lstrip()
        op = next((o for o in OPERATORS if rest.startswith(o)), None)
        value, quote, behind = rest[len(op or "") :].lstrip().removeprefix('"').partition('"')
        quoted = rest[len(op or "") :].lstrip().startswith('"') and quote
        if not name or name[0].isdigit() or op is None or not quoted:
            raise PatternError(f"malformed constraint: [{inner}]")
        found.append((name, op, value))
        rest = behind.lstrip()
    return found


def parse(pattern: str, columns: list[str]) -> list[list[Constraint]]:
    """Constraints by token; errors name what is wrong.  What stands outside brackets does not count."""
    if any(part.lstrip().startswith(("*", "+", "?", "{")) for part in pattern.split("]")[1:]):
        raise PatternError("quantifiers are not supported")
    found, rest = [], pattern
    while "[" in rest and "]" in rest[rest.index("[") :]:
        inner, _, rest = rest[rest.index("[") + 1 :].partition("]")
        found.append(_constraints(inner))
    if not found:
        raise PatternError("no [...] in the pattern")
    for name in (name for token in found for name, _, _ in token):
        if name not in columns:
            raise PatternError(f"no attribute {name}; there are {', '.join(columns)}")
    return found


def condition(constraint: Constraint, at=F.col) -> Column:
    """``=`` and ``!=`` drop nulls as SQL does; ``~`` finds the expression, in the RE2 dialect, anywhere."""
    name, op, value = constraint
    column = at(name).cast("string")
    if op == "~":
        try:
            return column.rlike(re2_to_java(value))
        except ValueError as e:
            raise PatternError(str(e)) from e
    return column == value if op == "=" else column != value


def _all(constraints: list[Constraint], at=F.col) -> Column:
    return reduce(lambda a, b: a & b, [condition(c, at) for c in constraints], F.lit(True))


def check(df: DataFrame) -> None:
    if not {"layer_uri", "token_index"} <= set(df.columns):
        raise PatternError("the table is not token-aligned: it needs layer_uri and token_index")


def cql(df: DataFrame, pattern: str) -> DataFrame:
    """``layer_uri, token_index`` of each match's first token, and ``tok0..n``, the labels, if the table has any.

    Rows that share a layer and index each match, as joins do.  A token's filters
    are below the joins, where Catalyst pushes them to the scan.
    """
    check(df)
    tokens = parse(pattern, df.columns)
    labels = ["label"] if "label" in df.columns else []

    def side(k):
        part = df.filter(F.col("layer_uri").isNotNull() & F.col("token_index").isNotNull()).filter(_all(tokens[k]))
        return part.select("layer_uri", (F.col("token_index") - k).alias("token_index"), *[F.col(c).cast("string").alias(f"tok{k}") for c in labels])

    return reduce(lambda a, b: a.join(b, ["layer_uri", "token_index"]), [side(k) for k in range(len(tokens))])


def cql_sorted(df: DataFrame, pattern: str) -> DataFrame:
    """The same matches by one exchange and sort; only for tables with one row for each layer and index."""
    check(df)
    tokens = parse(pattern, df.columns)
    order = Window.partitionBy("layer_uri").orderBy("token_index")
    used = sorted({name for t in tokens for name, _, _ in t} | ({"label"} & set(df.columns)) | {"token_index"})
    base = df.filter(F.col("layer_uri").isNotNull() & F.col("token_index").isNotNull())
    ahead = base.select("layer_uri", *used, *[F.lead(c, k).over(order).alias(f"_{c}{k}") for k in range(1, len(tokens)) for c in used])
    at = lambda k: (lambda c: F.col(c) if k == 0 else F.col(f"_{c}{k}"))
    ok = reduce(lambda a, b: a & b, [_all(t, at(k)) & (F.col("token_index") == at(k)("token_index") - k) for k, t in enumerate(tokens)])
    return ahead.filter(ok).select("layer_uri", "token_index", *[at(k)("label").cast("string").alias(f"tok{k}") for k in range(len(tokens)) if "label" in df.columns])
