"""Archives, lexicons, ports, exports and the command line."""

import hashlib
import io
import json
import tarfile

import pytest
from corpuslake.__main__ import main
from corpuslake.operators.dataset import Dataset
from corpuslake.operators import media
from corpuslake.operators.media import BlobCache
from corpuslake.sources import archives, codecs, exporters, knowledge, lexicons, ports, records
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(major, n):
    if n < 24:
        return bytes([major << 5 | n])
    width = next(w for w in (1, 2, 4, 8) if n < 256**w)
    return bytes([major << 5 | 23 + width.bit_length()]) + n.to_bytes(width, "big")


def cbor(v):
    if isinstance(v, archives.Link):
        raw = b"\0" + links[v]
        return b"\xd8\x2a" + number(2, len(raw)) + raw
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[v]
    if isinstance(v, int):
        return number(0, v) if v >= 0 else number(1, -1 - v)
    if isinstance(v, bytes):
        return number(2, len(v)) + v
    if isinstance(v, str):
        return number(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return number(4, len(v)) + b"".join(map(cbor, v))
    return number(5, len(v)) + b"".join(cbor(k) + cbor(x) for k, x in v.items())


links: dict = {}
blocks: list = []


def block(value) -> archives.Link:
    body = cbor(value)
    raw = bytes([1, 0x71, 0x12, 32]) + hashlib.sha256(body).digest()
    name = archives.Link(archives._cid_text(raw))
    links[name] = raw
    blocks.append((raw, body))
    return name


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def archive():
    links.clear(), blocks.clear()
    values = {f"x.y/{k}": {"text": "é" * k, "n": -k, "raw": b"\1\2", "deep": [True, None, {"big": 1 << 40}]} for k in (1, 30, 300)}
    first, second, third = (block(v) for v in values.values())
    lost = archives.Link("blost")
    links[lost] = bytes([1, 0x71, 0x12, 32]) + b"\0" * 32
    right = block({"l": None, "e": [{"p": 0, "k": b"x.y/300", "v": third, "t": None}, {"p": 4, "k": b"9", "v": lost, "t": None}]})
    tree = block({"l": block({"l": None, "e": [{"p": 0, "k": b"x.y/1", "v": first, "t": None}]}), "e": [{"p": 0, "k": b"x.y/30", "v": second, "t": right}]})
    root = block({"did": "did:own:1", "data": tree, "version": 3})
    header = cbor({"roots": [root], "version": 1})
    return varint(len(header)) + header + b"".join(varint(len(raw + body)) + raw + body for raw, body in blocks), values, first


def test_archives(spark):
    data, values, first = archive()
    files = spark.createDataFrame([(bytearray(data),), (bytearray(b"\5hello"),), (bytearray(data[:60]),)], "content binary")
    got = {r.uri: r for r in archives.read_archives(files).collect()}
    assert set(got) == {f"at://did:own:1/{k}" for k in values}
    assert json.loads(got["at://did:own:1/x.y/30"].value) == {"text": "é" * 30, "n": -30, "raw": {"$bytes": "AQI"}, "deep": [True, None, {"big": 1 << 40}]}
    assert got["at://did:own:1/x.y/1"].cid == str(first) and archives.plain({"a": [first]}) == {"a": [{"$link": str(first)}]}


def test_content_ids(spark):
    """Against the encoder above, for values whose keys are in order already."""
    value = {"a": [1, -300, 2.5, True, None], "bb": {"$bytes": "AQI"}, "ccc": {"deep": "é" * 300}, "dddd": 1 << 33}
    known = block({"a": [1, -300, "x", True, None], "bb": b"\1\2", "ccc": {"deep": "é" * 300}, "dddd": 1 << 33})
    assert archives.record_cid(json.dumps({**value, "a": [1, -300, "x", True, None]})) == str(known) and str(known).startswith("bafyrei")
    assert archives.read_cbor(archives.write_cbor({**value, "bb": {"$link": str(known)}}))[0] == {**value, "bb": known}
    assert archives.record_cid('{"zz":1,"b":2,"aa":3}') == archives.record_cid('{"b":2,"aa":3,"zz":1}')
    rows = archives.with_cids(spark.createDataFrame([("u", "old", '{"a":1}'), ("v", None, "{"), ("w", None, None)], "uri string, cid string, value string")).collect()
    assert [r.cid for r in rows] == [archives.record_cid('{"a": 1}'), None, None]


def test_lexicons():
    docs = {
        "x.thing": {"defs": {"main": {"type": "record", "record": {"type": "object", "required": ["name"], "properties": {
            "name": {"type": "string"}, "count": {"type": "integer"}, "parts": {"type": "array", "items": {"type": "ref", "ref": "#part"}}, "home": {"type": "ref", "ref": "x.place"},
            "clip": {"type": "blob"}, "any": {"type": "union", "refs": []}, "loop": {"type": "ref", "ref": "x.thing"}}}}, "part": {"type": "object", "properties": {"at": {"type": "boolean"}}}}},
        "x.place": {"defs": {"main": {"type": "object", "properties": {"lat": {"type": "string"}}}}},
    }
    found = lexicons.schema_of(docs, "x.thing", depth=2)
    assert [f.name for f in found] == ["any", "clip", "count", "home", "loop", "name", "parts"] and [f.nullable for f in found if f.name in ("name", "count")] == [True, False]
    assert found["parts"].dataType == T.ArrayType(T.StructType([T.StructField("at", T.BooleanType())])) and found["home"].dataType["lat"].dataType == T.StringType()
    assert found["clip"].dataType == lexicons.BLOB and found["any"].dataType == T.StringType() and isinstance(found["loop"].dataType, T.StructType)
    other = json.loads(json.dumps(docs).replace('"count": {"type": "integer"}', '"count": {"type": "string"}'))
    assert lexicons.manifest(docs)["definitions"] == {"object": 2, "record": 1} and lexicons.manifest(docs)["sha256"] != lexicons.manifest(other)["sha256"]
    assert lexicons.drift(docs, other) == [("x.thing", "changed")] and lexicons.drift({}, docs) == [("x.thing", "added")] and lexicons.drift(docs, docs) == []


def test_ports(spark, tmp_path):
    codec = records.Registry(ports.Codec)
    codec.add("conllu", codecs.ConlluCodec)
    codec.add("brat", codecs.BratCodec)
    codec.add("none", dict)
    assert codec.available() == ["brat", "conllu", "none"]
    rows = codec.make("conllu").decode(spark.createDataFrame([("f", "1\tA\t_\t_\t_\t_\t0\troot\t_\t_\n")], "source string, content string"))
    assert codec.make("conllu").encode(rows).first().content.startswith("1\tA")
    with pytest.raises(TypeError, match="no Codec"):
        codec.make("none")
    with pytest.raises(KeyError, match="brat"):
        codec.get("absent")
    empty = spark.createDataFrame([], "id string, label string")
    assert isinstance(BlobCache(spark, str(tmp_path)), ports.Store) and isinstance(knowledge.KnowledgeBase(empty, empty), ports.Knowledge)


def test_shards_with_media(spark):
    view = spark.range(5).select("id", F.when(F.col("id") != 3, F.col("id").cast("string").cast("binary")).alias("sound"), (F.col("id") * 2).alias("twice"))
    shards = exporters.write_shards(view, "id", 3, {"wav": "sound"}).orderBy("shard").collect()
    files = [{m.name: tar.extractfile(m).read() for m in tar.getmembers()} for tar in (tarfile.open(fileobj=io.BytesIO(bytes(s.tar))) for s in shards)]
    assert list(files[0]) == [f"{k:08d}.{e}" for k in range(3) for e in ("json", "wav")] and files[0]["00000001.wav"] == b"1"
    assert json.loads(files[0]["00000002.json"]) == {"id": 2, "twice": 4} and list(files[1]) == ["00000000.json", "00000001.json", "00000001.wav"]
    with pytest.raises(KeyError):
        exporters.write_shards(view, "id", members={"png": "picture"})


def test_tensors_and_revisions(spark, tmp_path):
    view = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "a int, b double, c string")
    assert exporters.tensors(view, ["a"]).columns == ["a"] and exporters.tensors(view.filter("b is not null")).first() == (1, 2.0)
    with pytest.raises(Exception, match="null in b"):
        exporters.tensors(view).collect()
    exporters.log_revision(spark, f"{tmp_path}/runs", "r1", "c7", {"tokens": 5}, lr=0.1)
    assert exporters.revisions_of(spark, f"{tmp_path}/runs", "r1").first().notes == {"lr": "0.1"} and exporters.revisions_of(spark, f"{tmp_path}/runs", "r2").count() == 0
    assert json.loads(exporters.provenance("n", "r", {"v": 1})) == {"dataset": "n", "revision": "r", "views": {"v": 1}}


def test_datasets_of_rows_and_of_streams(spark, tmp_path):
    ds = Dataset.from_iterable(spark, [{"a": 1}, {"a": 5}, (7,)], "a long")
    assert len(ds) == 3 and ds[2].a == 7 and ds.to_arrow().column("a").to_pylist() == [1, 5, 7] and list(ds.to_pandas()["a"]) == [1, 5, 7] and ds.numeric_columns() == ["place", "a"]
    assert len(ds.materialize()) == 3 and [r.a for r in ds.worker_share(1, 2).collect()] == [5]
    with pytest.raises(TypeError):
        len(Dataset.streaming(spark.range(3)))
    spark.range(3).write.json(f"{tmp_path}/in")
    stream = Dataset(spark.readStream.schema("id long").json(f"{tmp_path}/in"))
    with pytest.raises(TypeError):
        stream[0]


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("a", "one two two")], "id string, text string").write.parquet(f"{tmp_path}/expressions.parquet")
    assert main([str(tmp_path), "concordance", "two", "--limit", "1"], spark) == 0
    out = capsys.readouterr()
    assert out.out.splitlines() == ["source\tleft\tmatch\tright", "a\tone \ttwo\t two"] and "more than 1" in out.err
    assert main([str(tmp_path), "tables"], spark) == 0 and capsys.readouterr().out == "expressions\tid\ttext\n"
    assert main([str(tmp_path), "sql", "DROP VIEW expressions"], spark) == 2 and "only queries" in capsys.readouterr().err


def test_sounds(spark):
    import wave

    def sound(width, frames):
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(2)
            file.setsampwidth(width)
            file.setframerate(8000)
            file.writeframes(frames)
        return bytearray(out.getvalue())

    samples = {1: [-128, 0, 127, 1], 2: [-30000, 0, 30000, 1], 3: [-8_000_000, 0, 8_000_000, 1], 4: [-(2**31), 0, 2**31 - 1, 1]}
    frames = {w: b"".join((s + 128 * (w == 1)).to_bytes(w, "little", signed=w > 1) for s in own) for w, own in samples.items()}
    rows = media.decode_sounds(spark.createDataFrame([(str(w), sound(w, f)) for w, f in frames.items()] + [("bad", bytearray(b"RIFF")), ("none", None)], "key string, content binary")).collect()
    got = {r.key: r for r in rows}
    assert all((got[str(w)].rate, got[str(w)].channels, got[str(w)].samples) == (8000, 2, own) for w, own in samples.items())
    assert got["bad"].samples is None and got["bad"].error and got["none"].error
