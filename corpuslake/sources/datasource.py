"""Python data sources: record dumps as tables, and commit logs as a stream with ``seq`` as its offset."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpuslake.streaming.index import EVENT


def _files(path: str):
    """File system and files of a folder, by name; any file system that pyarrow opens."""
    from pyarrow import fs

    disk, root = fs.FileSystem.from_uri(path)
    return disk, sorted(f.path for f in disk.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".jsonl"))


def _lines(disk, path: str, start: int = 0, end: int | None = None):
    with disk.open_input_file(path) as file:
        file.seek(start)
        rest, left = b"", None if end is None else end - start
        while block := file.read(1 << 20 if left is None else min(left, 1 << 20)):
            left = None if left is None else left - len(block)
            *whole, rest = (rest + block).split(b"\n")
            yield from whole
        if rest:
            yield rest


def _objects(path: str, part: _File):
    disk, _ = _files(path)
    for line in _lines(disk, part.file, part.start, part.end):
        try:
            value = json.loads(line)
        except ValueError:
            continue  # a malformed line does not end the scan
        if isinstance(value, dict):
            yield value


class _File(InputPartition):
    """A file, from one byte to another (null: its end)."""

    def __init__(self, file: str, start: int = 0, end: int | None = None):
        self.file, self.start, self.end = file, start, end


class RecordDump(DataSource):
    """``spark.read.format("record_dump").option("path", folder)``: ``uri, cid, value`` of JSON-line files, one task a file.

    ``nsid`` keeps one collection only.
    """

    @classmethod
    def name(cls):
        return "record_dump"

    def schema(self):
        return "uri string, cid string, value string"

    def reader(self, schema):
        return _DumpReader(self.options)


class _DumpReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.nsid = options["path"], options.get("nsid")

    def partitions(self):
        return [_File(f) for f in _files(self.path)[1]]

    def read(self, partition):
        for row in _objects(self.path, partition):
            uri = row.get("uri") or ""
            if self.nsid is None or (uri.removeprefix("at://").split("/") + [""])[1] == self.nsid:
                yield uri, row.get("cid"), json.dumps(row.get("value"), ensure_ascii=False)


class CommitLog(DataSource):
    """``spark.readStream.format("commit_log")``: events of JSON-line files that are named in the order of their ``seq``.

    The offset is the last file and how much of it was there, so a batch reads what
    came since, the end of that file and the files behind it, and the driver reads
    nothing but the folder's list.  Lines are written whole.  ``cursor`` passes over
    events up to a ``seq``; events of one commit share theirs.  ``nsids`` (commas between
    them) or ``prefix`` keep some collections only.
    """

    @classmethod
    def name(cls):
        return "commit_log"

    def schema(self):
        return EVENT

    def streamReader(self, schema):  # noqa: N802
        return _LogReader(self.options)


class _LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.cursor = options["path"], int(options.get("cursor", -1))
        self.nsids, self.prefix = set(filter(None, options.get("nsids", "").split(","))), options.get("prefix", "")

    def initialOffset(self):  # noqa: N802
        return {"file": "", "bytes": 0}

    def latestOffset(self):  # noqa: N802
        disk, files = _files(self.path)
        return {"file": files[-1], "bytes": disk.get_file_info(files[-1]).size} if files else self.initialOffset()

    def partitions(self, start, end):
        _, files = _files(self.path)
        later = [f for f in files if start["file"] <= f <= end["file"]]
        parts = [_File(f, start["bytes"] if f == start["file"] else 0, end["bytes"] if f == end["file"] else None) for f in later]
        return [p for p in parts if p.end is None or p.end > p.start]

    def read(self, partition):
        places: dict[int, int] = {}
        for e in _objects(self.path, partition):
            seq, nsid = e.get("seq"), e.get("collection") or ""
            if not isinstance(seq, int) or seq <= self.cursor or (self.nsids and nsid not in self.nsids) or not nsid.startswith(self.prefix):
                continue
            places[seq] = places.get(seq, -1) + 1
            record = None if e.get("action") == "delete" else e.get("record")
            yield seq, int(e.get("op_ord", places[seq])), e.get("repo"), nsid, e.get("rkey"), e.get("action"), record if record is None or isinstance(record, str) else json.dumps(record)

    def commit(self, end):
        pass


def register(spark) -> None:
    spark.dataSource.register(RecordDump)
    spark.dataSource.register(CommitLog)
