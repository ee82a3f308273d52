"""Spellings of SQL that Spark does not read, rewritten before it does."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Functions and name prefixes that read files by path.
READERS = {"read_parquet": "parquet", "parquet_scan": "parquet", "read_csv": "csv", "read_csv_auto": "csv", "read_json": "json", "read_json_auto": "json", "read_text": "text"}
_ENDS = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS"}
_PIECE = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\S""", re.S)


class Word(NamedTuple):
    """A word or sign outside comments: its place, itself in capitals (quoted text as it is), and how many parentheses are open."""

    start: int
    end: int
    text: str
    depth: int


def words(sql: str) -> list[Word]:
    found, depth = [], 0
    for m in _PIECE.finditer(sql):
        piece = m[0]
        if piece.startswith(("--", "/*")):
            continue
        if piece == ")":
            depth -= 1
        found.append(Word(m.start(), m.end(), piece if piece[0] in "'\"`" else piece.upper(), depth))
        if piece == "(":
            depth += 1
    return found


def _closing(found: list[Word], opening: int) -> int:
    """The word that closes the parenthesis at ``opening``."""
    return next(k for k in range(opening + 1, len(found)) if found[k].text == ")" and found[k].depth == found[opening].depth)


def qualified(sql: str) -> str:
    """``SELECT a FROM t QUALIFY c`` as a filter over a subquery that has the condition as a column."""
    while True:
        found = words(sql)
        at = next((k for k in reversed(range(len(found))) if found[k].text == "QUALIFY"), None)
        if at is None:
            return sql
        depth = found[at].depth
        start = next(k for k in reversed(range(at)) if found[k].text == "SELECT" and found[k].depth == depth)
        source = next(k for k in range(start, at) if found[k].text == "FROM" and found[k].depth == depth)
        stop = next((k for k in range(at + 1, len(found)) if found[k].depth < depth or (found[k].depth == depth and found[k].text in _ENDS)), None)
        end = len(sql) if stop is None else found[stop].start
        distinct = found[start + 1].text == "DISTINCT"
        items = sql[found[start + 1 if distinct else start].end : found[source].start].strip()
        inner = f"SELECT {items}, ({sql[found[at].end : end].strip()}) AS _qualified {sql[found[source].start : found[at].start].strip()}"
        sql = f"{sql[: found[start].start]}SELECT {'DISTINCT ' * distinct}* EXCEPT (_qualified) FROM ({inner}) WHERE _qualified {sql[end:]}"


def replaced(sql: str) -> str:
    """``* REPLACE (e AS c)`` as all other columns and then ``e AS c``; the replaced ones come last."""
    while True:
        found = words(sql)
        at = next((k for k in range(2, len(found)) if found[k].text == "REPLACE" and found[k - 1].text in ("*", ")") and k + 1 < len(found) and found[k + 1].text == "("), None)
        if at is None:
            return sql
        star, gone = at - 1, []
        if found[star].text == ")":
            opening = next(k for k in reversed(range(star)) if found[k].text == "(" and found[k].depth == found[star].depth)
            if found[opening - 1].text not in ("EXCEPT", "EXCLUDE"):
                return sql
            gone, star = [sql[found[opening].end : found[star].start].strip()], opening - 2
        last = _closing(found, at + 1)
        inside = found[at + 2 : last]
        depth = found[at + 1].depth + 1
        names = [sql[inside[k + 1].start : inside[k + 1].end] for k in range(len(inside) - 1) if inside[k].text == "AS" and inside[k].depth == depth]
        items = sql[found[at + 1].end : found[last].start].strip()
        sql = f"{sql[: found[star].end]} EXCEPT ({', '.join([*gone, *names])}), {items}{sql[found[last].end :]}"


def renamed(sql: str) -> str:
    """Functions and words that Spark has under another name."""
    out, at = [], 0
    found = words(sql)
    for k, w in enumerate(found):
        following = found[k + 1].text if k + 1 < len(found) else ""
        new = "regexp_like" if w.text == "REGEXP_MATCHES" and following == "(" else "EXCEPT" if w.text == "EXCLUDE" and following == "(" and k and found[k - 1].text == "*" else None
        if new:
            out += [sql[at : w.start], new]
            at = w.end
    return "".join([*out, sql[at:]])


def spark_sql(sql: str) -> str:
    return renamed(replaced(qualified(sql)))


def paths(sql: str) -> list[tuple[int, int, str, str]]:
    """Reads of files by path: place and end in the text, format and path."""
    found, reads = words(sql), []
    for k, w in enumerate(found):
        name = w.text.lower()
        if name in READERS and k + 2 < len(found) and found[k + 1].text == "(" and found[k + 2].text.startswith("'"):
            reads.append((w.start, found[_closing(found, k + 1)].end, READERS[name], found[k + 2].text[1:-1].replace("''", "'")))
        elif name in {*READERS.values(), "orc", "avro", "binaryfile"} and k + 2 < len(found) and found[k + 1].text == "." and found[k + 2].text.startswith("`"):
            reads.append((w.start, found[k + 2].end, name, found[k + 2].text[1:-1]))
        elif w.text.startswith("'") and k and found[k - 1].text in ("FROM", "JOIN"):
            reads.append((w.start, w.end, "parquet", w.text[1:-1]))
    return reads
