"""Errors of the query layer."""


class QueryError(ValueError):
    """A query that cannot be answered."""


class PatternError(QueryError):
    """A token pattern that cannot be read."""
