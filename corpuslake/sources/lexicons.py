"""Record schemas from lexicon documents (JSON), as Spark types."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "cid-link": T.StringType(), "number": T.DoubleType()}
BLOB = T.StructType([T.StructField("cid", T.StringType()), T.StructField("mimeType", T.StringType()), T.StructField("size", T.LongType())])


def schema_of(lexicons: dict[str, dict], nsid: str, depth: int = 8) -> T.StructType:
    """The record type of ``nsid`` among ``lexicons`` (by id): its main definition's properties, by name.

    References are followed into other definitions and lexicons to ``depth`` nested
    objects; beyond that, and for unions and unknown values, a field is JSON text.
    """
    main = lexicons[nsid]["defs"]["main"]
    return _object(lexicons, nsid, main.get("record", main), depth)


def _object(lexicons: dict, nsid: str, body: dict, depth: int) -> T.StructType:
    needed, nullable = set(body.get("required", ())), set(body.get("nullable", ()))
    fields = sorted(body.get("properties", {}).items())
    return T.StructType([T.StructField(name, _type(lexicons, nsid, own, depth), name not in needed or name in nullable) for name, own in fields])


def _type(lexicons: dict, nsid: str, body: dict, depth: int) -> T.DataType:
    kind = body.get("type")
    if kind in _PLAIN:
        return _PLAIN[kind]
    if kind == "blob":
        return BLOB
    if kind == "array":
        return T.ArrayType(_type(lexicons, nsid, body["items"], depth))
    if kind in ("object", "record") and depth > 0:
        return _object(lexicons, nsid, body.get("record", body), depth - 1)
    if kind == "ref" and depth > 0:
        home, _, name = body["ref"].partition("#")
        home = home or nsid
        if home in lexicons:
            return _type(lexicons, home, lexicons[home]["defs"][name or "main"], depth - 1)
    return T.StringType()


def drift(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str]]:
    """Records whose schema differs between two sets of lexicons: ``(nsid, added, removed or changed)``."""
    records = lambda lexicons: {n for n, doc in lexicons.items() if doc.get("defs", {}).get("main", {}).get("type") == "record"}
    a, b = records(old), records(new)
    found = [(n, "removed") for n in a - b] + [(n, "added") for n in b - a]
    return sorted(found + [(n, "changed") for n in a & b if schema_of(old, n) != schema_of(new, n)])


def manifest(lexicons: dict[str, dict]) -> dict:
    """What a set of lexicons is: a digest of all of them, and how many definitions of each type they have."""
    text = json.dumps(lexicons, sort_keys=True, separators=(",", ":"))
    counts: dict[str, int] = {}
    for doc in lexicons.values():
        for body in doc.get("defs", {}).values():
            counts[body.get("type", "")] = counts.get(body.get("type", ""), 0) + 1
    return {"sha256": hashlib.sha256(text.encode()).hexdigest(), "lexicons": len(lexicons), "definitions": dict(sorted(counts.items()))}
