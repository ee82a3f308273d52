"""Repository archives: blocks of binary records, and the tree that names them, as ``uri, cid, value`` rows.

An archive (CAR, version 1) is a header and then blocks, each a content id and its
bytes (DAG-CBOR).  The header's root is a signed commit, whose ``data`` is the root of a
search tree; a node has entries that share a prefix with the key before, and the node
to the left of them all.  Keys are ``collection/key``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Link(str):
    """A content id, in its text form."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _cid_text(raw: bytes) -> str:
    return "b" + base64.b32encode(raw).decode().lower().rstrip("=")


def read_cbor(data: bytes, at: int = 0) -> tuple[object, int]:
    """A value of the subset that records use, and where it ends."""
    head = data[at]
    major, info, at = head >> 5, head & 31, at + 1
    if major == 7:
        if info in (20, 21, 22):
            return {20: False, 21: True, 22: None}[info], at
        if info == 27:
            return struct.unpack_from(">d", data, at)[0], at + 8
        raise ValueError("a value that records do not have")
    if info < 24:
        size = info
    elif info < 28:
        width = 1 << (info - 24)
        size, at = int.from_bytes(data[at : at + width], "big"), at + width
    else:
        raise ValueError("a value of unknown length")
    if major in (0, 1):
        return (size if major == 0 else -1 - size), at
    if major in (2, 3):
        raw = data[at : at + size]
        if len(raw) < size:
            raise ValueError("the data ends early")
        return (raw if major == 2 else raw.decode()), at + size
    if major == 6:
        value, at = read_cbor(data, at)
        return (Link(_cid_text(value[1:])) if size == 42 else value), at
    out: list = []
    for _ in range(size * (major - 3)):
        value, at = read_cbor(data, at)
        out.append(value)
    return (out if major == 4 else dict(zip(out[::2], out[1::2], strict=True))), at


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    size = next(k for k in range(4) if n < 1 << (8 << k))
    return bytes([major << 5 | 24 + size]) + n.to_bytes(1 << size, "big")


def write_cbor(value) -> bytes:
    """A JSON value in its one binary form: keys by length and then by bytes, numbers as short as they go, fractions in eight bytes.

    ``{"$link": id}`` and ``{"$bytes": text}`` are a link and bytes.
    """
    if value is None or isinstance(value, bool):
        return bytes([0xF6 if value is None else 0xF5 if value else 0xF4])
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        return _head(3, len(value.encode())) + value.encode()
    if isinstance(value, list):
        return _head(4, len(value)) + b"".join(map(write_cbor, value))
    if set(value) == {"$link"}:
        raw = b"\0" + _unpadded(value["$link"][1:].upper(), base64.b32decode, 8)
        return b"\xd8\x2a" + _head(2, len(raw)) + raw
    if set(value) == {"$bytes"}:
        return write_cbor(_unpadded(value["$bytes"], base64.b64decode, 4))
    keys = sorted(value, key=lambda k: (len(k.encode()), k.encode()))
    return _head(5, len(keys)) + b"".join(write_cbor(k) + write_cbor(value[k]) for k in keys)


def _unpadded(text: str, decode, block: int) -> bytes:
    return decode(text + "=" * (-len(text) % block))


def record_cid(value: str) -> str:
    """The content id of a record's JSON text: version 1, DAG-CBOR, SHA-256, in base 32."""
    return _cid_text(bytes([1, 0x71, 0x12, 32]) + hashlib.sha256(write_cbor(json.loads(value))).digest())


def with_cids(records: DataFrame, value: str = "value") -> DataFrame:
    """Records with ``cid``, the content id of their JSON text; null where that is none."""
    import pyarrow as pa

    def cid(text):
        try:
            return record_cid(text) if text is not None else None
        except ValueError:
            return None

    names = [c for c in records.columns if c != "cid"]
    at = names.index(value)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([cid(v) for v in batch.column(at).to_pylist()], pa.string())], [*names, "cid"])

    rows = records.select(*names)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cid", T.StringType())]))


def plain(value):
    """A value as JSON has it: bytes as ``$bytes``, links as ``$link``."""
    if isinstance(value, Link):
        return {"$link": str(value)}
    if isinstance(value, bytes):
        return {"$bytes": base64.b64encode(value).decode().rstrip("=")}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def _cid(data: bytes, at: int) -> tuple[str, int]:
    start = at
    if data[at] == 0x12:  # a bare digest, version 0
        return _cid_text(data[at : at + 34]), at + 34
    for _ in range(3):  # version, content, digest function
        _, at = _varint(data, at)
    size, at = _varint(data, at)
    return _cid_text(data[start : at + size]), at + size


def read_archive(data: bytes) -> tuple[list[str], dict[str, bytes]]:
    """Roots and blocks by content id."""
    size, at = _varint(data, 0)
    header, _ = read_cbor(data[at : at + size])
    at, blocks = at + size, {}
    while at < len(data):
        size, at = _varint(data, at)
        cid, body = _cid(data, at)
        blocks[cid] = data[body : at + size]
        at += size
    return [str(r) for r in header["roots"]], blocks


def _leaves(root: str, blocks: dict[str, bytes]) -> Iterator[tuple[str, str]]:
    """Keys and content ids of a tree, in order; nodes that the archive lacks are passed over."""
    stack: list = [("node", root)]
    while stack:
        kind, item = stack.pop()
        if kind == "leaf":
            yield item
            continue
        if item not in blocks:
            continue
        node, _ = read_cbor(blocks[item])
        steps: list = [("node", str(node["l"]))] if node.get("l") else []
        key = b""
        for entry in node["e"]:
            key = key[: entry["p"]] + entry["k"]
            steps.append(("leaf", (key.decode(), str(entry["v"]))))
            if entry.get("t"):
                steps.append(("node", str(entry["t"])))
        stack += reversed(steps)


def records_of(data: bytes) -> Iterator[tuple[str, str, str]]:
    """``uri, cid, value`` (JSON) of an archive's records; records that the archive lacks are passed over."""
    roots, blocks = read_archive(data)
    commit, _ = read_cbor(blocks[roots[0]])
    for key, cid in _leaves(str(commit["data"]), blocks):
        if cid in blocks:
            yield f"at://{commit['did']}/{key}", cid, json.dumps(plain(read_cbor(blocks[cid])[0]), ensure_ascii=False)


def read_archives(files: DataFrame) -> DataFrame:
    """``uri, cid, value`` of archives ``content`` (one row each, as ``binaryFile`` gives them); one that cannot be read gives none."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                try:
                    rows = list(records_of(data))
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["uri", "cid", "value"])

    return files.select("content").mapInArrow(run, "uri string, cid string, value string")
