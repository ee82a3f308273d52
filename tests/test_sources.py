import json

import pytest
from corpuslake.functions import builders
from corpuslake.functions.anchors import ANCHOR
from corpuslake.operators import corpus, discovery, flatten, media, versions, views
from corpuslake.plans import registry  # noqa: F401
from corpuslake.plans.queries_store import CORPUS
from corpuslake.sources import datasource
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_record_dump(spark, tmp_path):
    datasource.register(spark)
    rows = [{"uri": "at://a/x.y/1", "cid": "c", "value": {"t": "é"}}, {"uri": "at://a/x.z/2", "value": 3}]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    (tmp_path / "b.jsonl").write_text("")
    read = spark.read.format("record_dump").option("path", str(tmp_path))
    assert sorted(map(tuple, read.load().collect())) == [("at://a/x.y/1", "c", '{"t": "é"}'), ("at://a/x.z/2", None, "3")]
    assert [r.uri for r in read.option("nsid", "x.z").load().collect()] == ["at://a/x.z/2"]


def test_commit_log_resumes(spark, tmp_path):
    datasource.register(spark)
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def write(name, seqs):
        (log / name).write_text("\n".join(json.dumps({"seq": s, "repo": "r", "collection": "c", "rkey": str(s), "action": "create", "record": {"v": s}}) for s in seqs))

    def run():
        stream = spark.readStream.format("commit_log").option("path", str(log)).option("cursor", "0").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(out).collect())

    write("1.jsonl", [0, 1, 2])
    assert run() == [1, 2]
    write("2.jsonl", [3, 4])
    assert run() == [1, 2, 3, 4]
    with (log / "2.jsonl").open("a") as file:  # lines put behind what was read, and a new file
        file.write("\n" + json.dumps({"seq": 5, "repo": "r", "collection": "c", "rkey": "5", "action": "delete", "record": {}}) + "\nnot json\n")
    write("3.jsonl", [6, 6])
    assert run() == [1, 2, 3, 4, 5, 6, 6]
    (log / "1.jsonl").write_text("rubbish")  # files that were read are not read again
    write("4.jsonl", [7])
    assert run() == [1, 2, 3, 4, 5, 6, 6, 7]
    last = {r.rkey: r for r in spark.read.parquet(out).collect()}
    assert last["5"].record is None and sorted(r.op_ord for r in spark.read.parquet(out).filter("seq = 6").collect()) == [0, 1]


def test_commit_log_reads_positions_only(tmp_path):
    for name, seqs in (("a.jsonl", [1, 2]), ("b.jsonl", [3])):
        (tmp_path / name).write_text("".join(json.dumps({"seq": s, "collection": f"x.{s}"}) + "\n" for s in seqs))
    reader = datasource._LogReader({"path": str(tmp_path), "prefix": "x."})
    end = reader.latestOffset()
    (first, second) = reader.partitions(reader.initialOffset(), end)
    assert end["file"].endswith("b.jsonl") and (first.start, second.end) == (0, end["bytes"]) and reader.partitions(end, end) == []
    assert [e[0] for p in (first, second) for e in reader.read(p)] == [1, 2, 3]
    some = datasource._LogReader({"path": str(tmp_path), "nsids": "x.2,x.3", "cursor": "2"})
    assert [e[0] for p in some.partitions(some.initialOffset(), end) for e in some.read(p)] == [3]


def test_builders(spark):
    ok = spark.range(1).select(builders.span(F.lit(1), F.lit(2)).alias("a")).first().a
    assert ok.textSpan.byteEnd == 2 and ok.tokenRef is None
    for bad in (builders.span(F.lit(3), F.lit(2)), builders.token_ref(F.lit("t"), F.lit(-1)), builders.temporal(F.lit(-1), F.lit(2))):
        try:
            spark.range(1).select(bad.alias("a")).collect()
        except Exception:
            continue
        raise AssertionError("it was accepted")


def test_views_offered(spark):
    record = spark.createDataFrame([("u", "n", "", None)], "uri string, name string, empty string, list array<string>")
    offered = views.ViewRegistry()
    offered.add("k", "Full", lambda uri: record)
    offered.add("k", "Nothing", lambda uri: record.filter("false"))
    found = offered.views("k", "u", record)
    assert [n for n, _ in found] == ["Full", "Detail"] and [tuple(r) for r in found[-1][1].collect()] == [("u", "name", "n")]


def test_layer_builder(spark):
    made = builders.LayerBuilder("at://e", "token-tag", "pos", tokenization="t")
    first = made.add(label="N", token_index=0, confidence=900)
    made.add({"textSpan": {"byteStart": 1, "byteEnd": 2}}, "V", uuid="own")
    assert len(first["uuid"]) == 36
    view = flatten.annotations_view(builders.layers(spark, {"at://l": made.build()}), full=True).orderBy("annotation_index").collect()
    assert [(r.layer_uri, r.label, r.token_index, r.byte_start, r.layer_subkind) for r in view] == [("at://l", "N", 0, None, "pos"), ("at://l", "V", None, 1, "pos")]
    for bad in ({"token_index": -1}, {"confidence": 1001}):
        with pytest.raises(ValueError):
            made.add(**bad)
    for make in (lambda: builders.LayerBuilder("", "k"), lambda: builders.LayerBuilder("e", "k").build()):
        with pytest.raises(ValueError):
            make()


def test_references_to_records_that_are_not_published(spark):
    records = spark.createDataFrame([("u", '{"a":"pending:x","b":["pending:y","pending:xy"]}'), ("v", "{}")], "uri string, value string")
    known = spark.createDataFrame([("x", "at://1"), ("y", "at://2"), ("xy", "at://3")], "name string, uri string")
    assert dict(map(tuple, builders.with_references(records, known).collect())) == {"u": '{"a":"at://1","b":["at://2","at://3"]}', "v": "{}"}
    for some in (known.filter("name != 'y'"), known.withColumn("uri", F.when(F.col("name") != "y", F.col("uri")))):
        with pytest.raises(Exception, match="published as y"):
            builders.with_references(records, some).collect()


def test_blob_cache(spark, tmp_path):
    import hashlib

    cache = media.BlobCache(spark, f"{tmp_path}/blobs")
    digest = hashlib.sha256(b"one").hexdigest()
    blobs = lambda *rows: spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "key string, content binary")
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "key string")
    cache.put(blobs((digest, b"one"), ("https:opaque", b"two")))
    cache.put(blobs((digest, b"one")))
    assert {r.key: r.content and bytes(r.content) for r in cache.get(keys(digest, "none", "https:opaque")).collect()} == {digest: b"one", "none": None, "https:opaque": b"two"}
    assert {r.key: r.there for r in cache.exists(keys(digest, "none")).collect()} == {digest: True, "none": False}
    for key in ("..", "a/b", "", "a\\b"):
        with pytest.raises(Exception, match="one part of a path"):
            cache.get(keys(key)).collect()
    wrong = hashlib.sha256(b"three").hexdigest()
    with pytest.raises(Exception, match="not that of"):
        cache.put(blobs((wrong, b"else")))
    assert not cache.exists(keys(wrong)).first().there


def test_anchors_select_from_their_own_data(spark):
    kinds = {"text": ("textSpan", {"byteStart": 1, "byteEnd": 3}), "tokens": ("tokenRefSequence", {"tokenIndexes": [2, 0]}), "samples": ("temporalSpan", {"start": 1, "ending": 2}), "external": ("externalTarget", {"source": "u"})}
    rows = {name: spark.createDataFrame([({field: body}, "abcd", ["x", "y", "z"], [1, 2, 3, 4], 1000, 1, 5)], f"anchor {ANCHOR.simpleString()}, text string, tokens array<string>, samples array<int>, rate int, channels int, time long") for name, (field, body) in kinds.items()}
    for name, want in (("text", "bc"), ("tokens", ["z", "x"]), ("samples", [2])):
        assert media.resolve_anchors(rows[name], name).first().resolved == want
        for other in {"text", "tokens", "samples", "frame"} - {name}:
            with pytest.raises(Exception, match="do not select from"):
                media.resolve_anchors(rows[name], other).collect()
    assert media.resolve_anchors(rows["external"], "text").first().resolved == "u"
    empty = rows["text"].withColumn("anchor", F.lit(None).cast(ANCHOR))
    with pytest.raises(Exception, match="empty anchors"):
        media.resolve_anchors(empty, "text").collect()
    with pytest.raises(ValueError):
        media.resolve_anchors(empty, "smell")


def test_corpus_is_loaded_saved_and_materialized(spark, tmp_path):
    p = "x.y."
    value = lambda **fields: json.dumps(fields)
    records = [
        (f"at://a/{p}corpus.corpus/1", value(name="c")), (f"at://a/{p}corpus.membership/1", value(corpusRef=f"at://a/{p}corpus.corpus/1", expressionRef=f"at://b/{p}expression.expression/e1")),
        (f"at://b/{p}expression.expression/e1", value(text="one", quoted='say "hi"', next=f"at://c/{p}media.media/m")), (f"at://b/{p}expression.expression/e2", value(text="two")),
        (f"at://c/{p}media.media/m", value(kind="audio", other="at://none/x.y.media.media/zzz", odd="at://a/strange.kind/1")), ("at://a/strange.kind/1", value(x=1)), (f"at://a/{p}persona.persona/bad", "[1"),
        (f"at://a/{p}annotation.annotationLayer/l", value(expression=f"at://b/{p}expression.expression/e1", kind="span", annotations=[{"label": "N", "anchor": {"textSpan": {"byteStart": 0, "byteEnd": 1}}}])),
    ]
    rows = spark.createDataFrame(records, "uri string, value string")
    loaded = corpus.load(rows, f"at://a/{p}corpus.corpus/1", namespace="x.y")
    assert sorted(r.uri.split("/")[-2] + "/" + r.uri.split("/")[-1] for r in loaded.collect()) == sorted(f"{p}{x}" for x in ("corpus.corpus/1", "corpus.membership/1", "expression.expression/e1", "media.media/m", "annotation.annotationLayer/l"))
    schemas = {f"{p}expression.expression": T.StructType([T.StructField("text", T.StringType())]), f"{p}annotation.annotationLayer": flatten.LAYER, f"{p}media.media": T.StructType([T.StructField("kind", T.StringType())]), f"{p}eprint.eprint": T.StructType([T.StructField("kind", T.StringType())])}
    written = flatten.materialize_records(loaded, f"{tmp_path}/views", schemas, f"{p}expression.expression", f"{p}annotation.annotationLayer")
    assert [w.split("/")[-1] for w in written] == ["annotations.parquet", "expressions.parquet", "x_y_media_media.parquet"]
    assert spark.read.parquet(f"{tmp_path}/views/annotations.parquet").first().byte_end == 1
    tables = {
        "expressions": spark.createDataFrame([("e1", 0, "one"), ("e2", 1, "two")], "uri string, ord long, text string"), "layers": builders.layers(spark, {"l": {"expression": "e9", "kind": "span", "annotations": [{"label": "N"}]}}),
        "memberships": spark.createDataFrame([("m", "c", "e2", "dev")], "uri string, corpusRef string, expressionRef string, split string"), "corpora": spark.createDataFrame([("c", "name")], "uri string, name string"),
    }
    own = corpus.Corpus(tables, "c")
    assert own.corpus_record().first().name == "name" and own.memberships().count() == 1
    own.materialize(f"{tmp_path}/own")
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/own/expressions.parquet").collect()] == ["two"] and spark.read.parquet(f"{tmp_path}/own/annotations.parquet").first().label == "N"
    store = versions.VersionStore(spark, f"{tmp_path}/store")
    own.save(store)
    assert {r.uri for r in store.state().collect()} == {"e1", "e2", "l", "m", "c"} and json.loads(store.state().filter("uri = 'e2'").first().value) == {"text": "two"}


def test_references_with_escaped_signs(spark):
    rows = spark.createDataFrame([("at://s", json.dumps({"a": 'at://x/y/"z"', "b": ["at://x/\\n", "at://plain"], "at://key": 1}))], "uri string, value string")
    assert [r.dst for r in corpus.references(rows).orderBy("ref_ord").collect()] == ['at://x/y/"z"', "at://x/\\n", "at://plain"]


def test_card_index(spark, tmp_path):
    store = versions.VersionStore(spark, f"{tmp_path}/index")
    fields = T._parse_datatype_string("uri string, name string, expression_count long")
    cards = lambda *rows: spark.createDataFrame(rows, fields)
    index = discovery.CardIndex(store, fields)
    index.put(cards(("at://a", "A", 1), ("at://b", "B", 2)))
    first = store.head
    index.put(cards(("at://b", "B", 3), ("at://c", "C", 4)))
    assert [tuple(r) for r in index.cards().collect()] == [("at://a", "A", 1), ("at://b", "B", 3), ("at://c", "C", 4)] and index.get("at://b").first().expression_count == 3
    assert index.remove("at://a") and not index.remove("at://a")
    index.mute(cards(("at://c", "C", 4), ("at://d", "D", 5)), F.to_timestamp(F.lit("2024-01-01")))
    assert [r.uri for r in index.cards().collect()] == ["at://b"] and [r.name for r in index.muted().collect()] == ["C", "D"] and index.is_muted("at://c")
    found = {r.uri: r.status for r in index.diff_cards(first, store.head).collect()}
    assert found.pop("at://b") == "changed" and list(found.values()) == ["removed"] and next(iter(found)).startswith("at://did:local:index/index.card/")
    assert index.unmute("at://c") and not index.unmute("at://c") and not index.is_muted("at://c")
    index.note("cursor", "wss://relay", '{"seq":7}')
    assert index.noted("cursor", "wss://relay") == '{"seq":7}' and index.noted("cursor", "other") is None
    reopened = discovery.CardIndex(versions.VersionStore(spark, f"{tmp_path}/index"), fields)
    assert reopened.cards().count() == 1


def test_accelerated_search_has_the_same_hits(spark):
    names = ["50% off", "a_b", "ab", "A_B c", "back\\slash", "50 percent"]
    cards = spark.createDataFrame([(f"u{k}", n, n[::-1] if k % 2 else None, "en", ["en"], k, 1, ["m"]) for k, n in enumerate(names)], "uri string, name string, description string, language string, languages array<string>, expression_count long, annotation_rounds int, quality_metrics array<string>")
    for text in ("%", "_", "a_b", "b", "\\", "50%", ""):
        for facets in (discovery.Facets(text=text), discovery.Facets(text=text, min_count=2)):
            assert [tuple(r) for r in discovery.search_accelerated(cards, facets).select("uri", "score").collect()] == [tuple(r) for r in discovery.search(cards, facets).select("uri", "score").collect()]


def test_discovered_cards_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"uri": "at://n/x.y.corpus.corpus/1", "value": json.dumps({"name": "N", "languages": ["de"]})}) + "\n" + json.dumps({"uri": "at://n/other.corpus.corpus/2", "value": "{}"}))
    rows = spark.readStream.schema("uri string, value string").json(f"{tmp_path}/in")
    cards = discovery.discovered(rows, CORPUS, "https://host", F.current_timestamp(), namespace="x.y")
    cards.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [(r.name, r.language, r.source_did) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("N", "de", "n")]
