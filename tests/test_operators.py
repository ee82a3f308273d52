"""Operators on small tables with exact results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslake.functions.anchors import ANCHOR, FLAT, byte_slice, flatten_anchor
from corpuslake.functions.kinds import section_of, tier_of
from corpuslake.operators import analytics, corpus, media, versions
from corpuslake.operators.dataset import Dataset
from corpuslake.sources import codecs, exporters, records
from corpuslake.streaming import index


def test_anchor_kinds(spark):
    rows = [
        ({"textSpan": {"byteStart": 1, "byteEnd": 4}},), ({"tokenRef": {"tokenizationId": {"value": "t"}, "tokenIndex": 3}},), ({"tokenRefSequence": {"tokenIndexes": [1, 2]}},),
        ({"temporalSpan": {"start": 5, "ending": 9}},), ({"spatioTemporalAnchor": {"temporalSpan": {"start": 1, "ending": 2}}},),
        ({"pageAnchor": {"page": 2, "textSpan": {"byteStart": 7}, "boundingBox": {"x": 1, "width": 3}}},), ({"externalTarget": {"source": "u"}},), (None,),
    ]
    flat = [r.asDict() for r in spark.createDataFrame(rows, f"anchor {ANCHOR.simpleString()}").select(*flatten_anchor()).collect()]
    assert [r["anchor_kind"] for r in flat] == ["span", "tokenRef", "tokenRefSequence", "temporalSpan", "spatioTemporal", "page", "external", None]
    assert tuple(flat[0]) == FLAT
    assert flat[0]["byte_end"] == 4 and flat[1]["token_id"] == "t" and flat[2]["token_indexes"] == [1, 2] and flat[4]["t_start_ms"] == 1
    assert (flat[5]["page"], flat[5]["byte_start"], flat[5]["bbox_w"]) == (2, 7, 3)


def test_byte_slice_like_python(spark):
    text = "aé😀z"
    spans = [(a, b) for a in range(-1, 10) for b in range(-1, 10)]
    got = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a long, b long").select(byte_slice("t", F.col("a"), F.col("b")).alias("s")).collect()
    raw = text.encode()
    for (a, b), r in zip(spans, got, strict=True):
        want = raw[max(a, 0) : max(b, 0)]
        if want.decode(errors="ignore").encode() == want:
            assert r.s == want.decode(), (a, b)


def test_scope(spark):
    e = spark.createDataFrame([("e1", 0), ("e2", 1)], "uri string, ord long")
    m = spark.createDataFrame([("c1", "e1", "train"), ("c1", "e1", "test")], "corpusRef string, expressionRef string, split string")
    assert [r.uri for r in corpus.scoped(e, m, "c1").collect()] == ["e1"]
    assert corpus.scoped(e, m, "c2").count() == 2
    assert corpus.split(e, m, "test").count() == 1
    assert [r.split for r in corpus.splits(m).collect()] == ["test", "train"]


def test_references_and_closure(spark):
    r = spark.createDataFrame([("at://a", '{"x":"at://b","at://key":["at://c","at://a","at://b"]}'), ("at://b", '{"y":"at://d"}'), ("at://d", "{}")], "uri string, value string")
    edges = corpus.references(r)
    assert [tuple(x) for x in edges.orderBy("src", "ref_ord").select("src", "dst").collect()] == [("at://a", "at://b"), ("at://a", "at://c"), ("at://b", "at://d")]
    reached = corpus.closure(spark, edges, r.filter("uri = 'at://a'"), r.select("uri"))
    assert sorted(x.uri for x in reached.collect()) == ["at://a", "at://b", "at://d"]


def test_latest_keeps_place(spark):
    r = spark.createDataFrame([("a", 0, "old"), ("b", 1, "x"), ("a", 2, "new")], "uri string, ord long, value string")
    assert sorted(map(tuple, corpus.latest(r).collect())) == [("a", 0, "new"), ("b", 1, "x")]


def test_json_changes():
    old, new = '{"a":1,"b":{"c":[1,2]},"d":"x"}', '{"a":1,"b":{"c":[1,3,4]},"e":{"f":1}}'
    assert versions.json_changes(old, new) == [("b/c/1", "changed", "2", "3"), ("b/c/2", "added", None, "4"), ("d", "removed", "x", None), ("e", "added", None, '{"f": 1}')]
    assert versions.json_changes(old, old) == []


def test_versions(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        store.tag("none")
    assert store.state().count() == 0 and store.head is None
    rows = lambda x: spark.createDataFrame(x, "uri string, value string, is_tombstone boolean, ord long")
    store.commit(rows([("a", '{"id":1}', False, 0), ("b", "{}", False, 1)]), "one", "ada")
    store.tag("v1")
    store.save("a", '{"id":2}')
    store.forget("b")
    with pytest.raises(KeyError):
        store.forget("zzz")
    with pytest.raises(KeyError):
        store.resolve("nothing")
    again = versions.VersionStore(spark, str(tmp_path / "v"))  # who opens it sees all of it
    assert again.head == store.head and [(c["author"], c["message"]) for c in again.log] == [("ada", "one"), ("", "save a"), ("", "forget b")]
    assert [tuple(r) for r in again.state().collect()] == [("a", '{"id":2}')] and again.tags == {"v1": again.log[0]["id"]}
    assert sorted(map(tuple, versions.diff(again.state("v1"), again.state()).select("uri", "status").collect())) == [("a", "changed"), ("b", "removed")]
    branch = again.commit(rows([("b", "[]", False, 0)]), "beside", parents=[again.resolve("v1")])
    merged = again.commit(rows([("c", "1", False, 0)]), "merge", parents=[again.log[2]["id"], branch])
    assert sorted(map(tuple, again.state(merged).collect())) == [("a", '{"id":2}'), ("b", "[]"), ("c", "1")]
    again.tag("v1", merged)
    assert store.resolve("v1") == merged
    log = versions.generate_changelog(store.state(store.log[0]["id"]), store.state(store.log[2]["id"]), "1.2.3")
    assert (log.level, log.version) == ("major", "2.0.0")
    same = versions.generate_changelog(store.state(), store.state(), "1.2.3")
    assert (same.level, same.version) == ("none", "1.2.3")
    always = versions.generate_changelog(store.state(store.log[0]["id"]), store.state(), "1.2.3", lambda records, changes: records.agg(F.lit("patch").alias("level")))
    assert always.version == "1.2.4"


def test_commits_that_fail_or_come_second_change_nothing(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "v"))
    store.save("a", "1")
    with pytest.raises(Exception, match="broken"):
        store.commit(spark.range(1).select(F.lit("b").alias("uri"), F.raise_error(F.lit("broken")).cast("string").alias("value"), F.lit(False).alias("is_tombstone"), F.lit(0).alias("ord")), "fails")
    assert len(store.log) == 1 and store.state().count() == 1
    late = versions.VersionStore(spark, str(tmp_path / "v"))
    write = late._notes.write
    late._notes.write = lambda name, note: store.save("x", "2") and write(name, note)
    with pytest.raises(RuntimeError, match="first"):
        late.save("b", "3")
    assert sorted(r.uri for r in late.state().collect()) == ["a", "x"]


def test_entries_of_a_subject(spark):
    base, head = (spark.createDataFrame(rows, "uri string, value string") for rows in ([("at://a/x.y.corpus.corpus/1", '{"id":"p","n":1}'), ("at://a/z/2", "{}")], [("at://a/x.y.corpus.corpus/1", '{"id":"q","n":1,"more":[]}')]))
    entry = versions.generate_entry(base, head, "at://a/x.y.corpus.corpus/1", "0.3.9").first()
    assert (entry.record_change, entry.level, entry.version, entry.nsid) == ("changed", "major", "1.0.0", "x.y.corpus.corpus")
    assert '"category":"corpus"' in entry.sections and entry.sections.index('"id"') < entry.sections.index('"more"')
    same = versions.generate_entry(head, head, "at://a/x.y.corpus.corpus/1", "0.3.9").first()
    assert (same.level, same.version, same.sections) == ("none", "0.3.9", "[]")
    new = versions.generate_entry(None, head, "at://a/x.y.corpus.corpus/1").first()
    assert (new.record_change, new.version, new.previous_version) == ("added", "0.1.0", None)
    with pytest.raises(ValueError, match="neither"):
        versions.generate_entry(base, head, "at://a/none/1")


def test_ten_targets_of_a_group(spark):
    changes = spark.range(5000).select(F.format_string("u%05d", 5000 - F.col("id")).alias("uri"), F.lit("f").alias("field_path"), F.lit("added").alias("change_type"), F.lit("1").alias("new_value"), F.lit("x").alias("nsid"))
    row = versions.changelog_groups(changes.unionAll(changes)).first()
    assert (row.n, row.targets, row.new_value) == (10_000, ",".join(f"u{k:05d}" for k in range(1, 11)), None)


def test_tiers_and_sections(spark):
    row = spark.range(1).select(tier_of(F.lit("p.q.expression.expression")).alias("a"), tier_of(F.lit("x.y")).alias("b"), section_of(F.lit("p.q.persona.persona")).alias("c"), section_of(F.lit("x.y")).alias("d")).first()
    assert tuple(row) == (1, 3, "ontology", "other")
    foreign = spark.range(1).select(tier_of(F.lit("x.y.graph.graphEdge"), "p.q").alias("a"), tier_of(F.lit("p.q.graph.graphEdge"), "p.q").alias("b"), section_of(F.lit("p.qx.graph.graphEdge"), "p.q").alias("c"), tier_of(F.lit("p.q.r.graph.graphEdge"), "p.q").alias("d")).first()
    assert tuple(foreign) == (3, 4, "other", 3)


def test_judgments(spark):
    v = spark.createDataFrame([("g", x) for x in (7, 7, 6, 5, 7, 3, 7)], "g string, v long")
    h = analytics.ordinal_histogram(v, "g", "v", 1, 7).orderBy("level").collect()
    assert [r.n for r in h] == [0, 0, 1, 0, 1, 1, 4] and h[0].median == 7 and round(h[0]["mean"], 4) == 6
    m = analytics.magnitude_summary(spark.createDataFrame([("g", x) for x in (750, 820, 400, 900, 300)], "g string, v long"), "g", "v").first()
    assert m.upper_median == 750 and round(m.center) == 581
    signed = spark.createDataFrame([("g", x) for x in (-1, 0, 1, 4, 10, 15)] + [("low", x) for x in (-4, -2, 0)], "g string, v long")
    found = {r.g: r for r in analytics.magnitude_summary(signed, "g", "v").collect()}
    assert round(found["g"].center, 6) == round(600 ** 0.25, 6) and found["g"].upper_median == 4 and found["low"].center == -2 and found["low"].upper_median == -2
    assert sorted((r.bin, r.n) for r in analytics.magnitude_bins(signed.filter("g = 'g'"), "g", "v").collect()) == [(0, 2), (1, 1), (4, 1), (10, 1), (15, 1)]
    assert [(r.bin, r.n) for r in analytics.magnitude_bins(spark.createDataFrame([("g", 7), ("g", 7)], "g string, v long"), "g", "v").collect()] == [(0, 2)]
    even = analytics.ordinal_histogram(spark.createDataFrame([("g", x) for x in (1, 2, 4, 4)], "g string, v long"), "g", "v").first()
    assert even.median == 3 and even["mean"] == 2.75
    c = analytics.categorical(spark.createDataFrame([("g", x, k) for k, x in enumerate("AABA")], "g string, v string, o long"), "g", "v", "o").orderBy("place").collect()
    assert [(r.v, r.n, r.percent) for r in c] == [("A", 3, 75), ("B", 1, 25)]


def test_lanes(spark):
    s = spark.createDataFrame([("k", 0, 10, "long"), ("k", 2, 4, "a"), ("k", 4, 6, "b"), ("k", 3, 5, "c")], "k string, lo long, hi long, label string")
    assert {r.label: r.lane for r in analytics.lanes(s, "k").collect()} == {"a": 0, "c": 1, "b": 0, "long": 2}


def test_tree(spark):
    r = spark.createDataFrame([("s", 0, 1), ("s", 1, -1), ("s", 2, 1), ("s", 3, 2), ("s", 4, 9)], "sentence string, token_index long, head long")
    assert [(x.token_index, x.depth) for x in analytics.dependency_tree(r).orderBy("place").collect()] == [(1, 0), (0, 1), (2, 1), (3, 2), (4, 0)]


def walked(heads):
    """Nodes of a sentence with their depth, in the order of a recursive walk."""
    n, out = len(heads), []

    def below(k, depth):
        out.append((k, depth))
        for j in range(n):
            if heads[j] == k and j != k:
                below(j, depth + 1)

    for k, h in enumerate(heads):
        if h < 0 or h == k or h >= n:
            below(k, 0)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 9), min_size=1, max_size=9), min_size=1, max_size=5))
def test_tree_walk_is_the_recursive_one(sentences):
    import numpy as np

    where = np.concatenate([np.full(len(h), k) for k, h in enumerate(sentences)])
    token = np.concatenate([np.arange(len(h)) for h in sentences])
    depth, place = analytics.tree_walk(where, token, np.concatenate(sentences).astype(np.int64))
    for k, heads in enumerate(sentences):
        own = np.flatnonzero((where == k) & (depth >= 0))
        assert [(int(token[j]), int(depth[j])) for j in own[np.argsort(place[own])]] == walked(heads)


def test_trees_of_any_depth_and_number(spark):
    words = spark.range(1_100_000).select((F.col("id") % 550_000).alias("sentence"), F.floor(F.col("id") / 550_000).alias("token_index"))
    tree = analytics.dependency_tree(words.withColumn("head", F.col("token_index") - 1))
    assert tree.groupBy("depth").count().orderBy("depth").collect() == [(0, 550_000), (1, 550_000)]
    chain = analytics.dependency_tree(spark.range(5000).select(F.lit("s").alias("sentence"), F.col("id").alias("token_index"), (F.col("id") - 1).alias("head")))
    assert chain.filter("depth = place and depth = token_index").count() == 5000


def test_descendant_texts_of_any_depth(spark):
    rows = [("r0", None, None, 0), ("r1", None, "own", 1), ("c1", "r1", "not asked for", 0)] + [(f"d{k}", f"d{k - 1}" if k else "r0", "deep" if k == 119 else None, k) for k in range(120)] + [("e", "d5", "beside", 0)]
    e = spark.createDataFrame(rows, "uri string, parentRef string, text string, ord long")
    assert sorted(map(tuple, analytics.descendant_texts(e).collect())) == [("r0", "beside\n\ndeep"), ("r1", "own")]


def test_a_closure_is_never_cut_off(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(4)], "src string, dst string")
    known = spark.createDataFrame([(f"n{k}",) for k in range(5)], "uri string")
    start = known.filter("uri = 'n0'")
    with pytest.raises(ValueError, match="more than 2"):
        corpus.closure(spark, edges, start, known, depth=2)
    assert corpus.closure(spark, edges, start, known, depth=4).count() == corpus.closure(spark, edges, start, known).count() == 5


def test_interlinear_strips_fit_a_line(spark):
    words = spark.createDataFrame([("e", k, w) for k, w in enumerate(["ab", "c" * 30, "dd", "e" * 90, ""])] + [("f", 0, "x")], "expression string, token_index long, surface string")
    tags = spark.createDataFrame([("e", 0, "POS", "NOUN"), ("e", 4, "POS", "V")], "expression string, token_index long, heading string, tag string")
    strips = analytics.interlinear(words, tags, ["POS"], width=40)
    assert [(r.token_index, r.strip, r.cell, r.cell_width) for r in strips.filter("row = 0 and expression = 'e'").orderBy("token_index").collect()] == [(0, 0, "ab", 4), (1, 1, "c" * 30, 30), (2, 1, "dd", 2), (3, 2, "e" * 90, 90), (4, 3, "_", 1)]
    lines = analytics.interlinear_lines(analytics.interlinear(words, tags, ["POS"]))
    assert [r.line for r in lines.filter("expression = 'e' and strip = 0").orderBy("row").collect()] == ["word  ab    " + "c" * 30 + "  dd", "POS   NOUN"]


def test_interpolation(spark):
    frames = F.expr("array(named_struct('timeMs', 0L, 'bbox', named_struct('x', 0.0D)), named_struct('timeMs', 100L, 'bbox', named_struct('x', 10.0D)))")
    for mode, want in (("linear", [0, 0, 2.5, 10, 10]), ("step", [0, 0, 0, 10, 10]), ("cubic", [0, 0, 1.5625, 10, 10])):
        got = spark.createDataFrame([(t,) for t in (-5, 0, 25, 100, 400)], "t long").select(media.interpolate(frames, F.col("t"), ["x"], mode)["x"].alias("x")).collect()
        assert [r.x for r in got] == want, mode


def test_crop():
    frame = bytes(range(4 * 3 * 3))
    assert media.crop(frame, 4, 3, (1, 1, 2, 1)) == frame[15:21]
    with pytest.raises(ValueError):
        media.crop(frame, 4, 3, (3, 0, 2, 1))


CONLLU = "# text = Dogs run.\n1\tDogs\tdog\tNOUN\tNNS\tNumber=Plur\t2\tnsubj\t_\t_\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\trun\trun\tVERB\t_\t_\t0\troot\t_\t_\n3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n\n1\tHé\t_\t_\t_\t_\t0\troot\t_\t_\n"


def test_conllu(spark):
    t = codecs.conllu_tokens(spark.createDataFrame([("f", CONLLU)], "source string, content string"))
    rows = t.orderBy("sentence", "token_index").collect()
    assert [(r.form, r.head, r.byte_start, r.byte_end) for r in rows] == [("Dogs", 1, 0, 4), ("run", -1, 5, 8), (".", 1, 9, 10), ("Hé", -1, 0, 3)]
    again = codecs.conllu_tokens(codecs.conllu_text(t).select("source", "content"))
    assert sorted(map(str, again.drop("sentence").collect())) == sorted(map(str, t.drop("sentence").collect()))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", min_size=1, max_size=4), st.sampled_from(["Per", "Loc"])), min_size=1, max_size=4))
def test_brat_is_stable(spark, entities):
    text = " ".join(w for w, _ in entities)
    lines, at = [], 0
    for k, (w, label) in enumerate(entities):
        lines.append(f"T{k + 5}\t{label} {at} {at + len(w)}\t{w}")
        at += len(w) + 1
    source = spark.createDataFrame([("d", text + codecs.BRAT_SEPARATOR + "\n".join([*lines, "R1\tRel Arg1:T5 Arg2:T5", "A1\tNeg T5", "A2\tLost T99", "junk"]))], "source string, content string")
    once = codecs.brat_text(codecs.brat_rows(source)).first().content
    twice = codecs.brat_text(codecs.brat_rows(spark.createDataFrame([("d", text + codecs.BRAT_SEPARATOR + once)], "source string, content string"))).first().content
    assert once == twice and once.count("\n") == len(entities) + 1


def test_decode(spark):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("u1", "c", '{"name":"a","$type":"x"}'), ("u2", "c", "{"), ("u3", "c", '{"other":1}')], "uri string, cid string, value string")
    good, bad = records.decode(rows, T.StructType([T.StructField("name", T.StringType())]), ["name"])
    assert [r.uri for r in good.collect()] == ["u1"] and sorted(r.uri for r in bad.collect()) == ["u2", "u3"]


def test_exports(spark):
    rows = spark.range(25).withColumn("x", F.col("id") * 2)
    assert exporters.batches(rows, "id", 10).groupBy("batch").count().count() == 3
    assert exporters.batches(rows, "id", 10, drop_remainder=True).count() == 20
    shards = exporters.write_shards(rows, "id", 10).orderBy("shard").collect()
    assert [r.n for r in shards] == [10, 10, 5]
    with pytest.raises(KeyError):
        exporters.project(rows, ["zzz"])


def test_dataset(spark):
    ds = Dataset(spark.range(10), "id")
    assert len(ds.filter("id > 6")) == 3 and len(ds.filter(lambda r: r["id"] % 2 == 0)) == 5
    assert sum(r.n for r in ds.map_batched(lambda rows: [{"n": len(rows)}], "n long", 4).df.collect()) == 10
    assert [len(b) for b in ds.iter(4)] == [4, 4, 2] and ds[3].id == 3 and [r.id for r in ds.take(2)] == [0, 1]
    with pytest.raises(TypeError):
        len(ds.map(lambda r: r, "id long"))
    with pytest.raises(IndexError):
        ds[99]


def test_stream_index(spark, tmp_path):
    event = lambda seq, repo, action, record: {"seq": seq, "op_ord": 0, "repo": repo, "collection": "c.card", "rkey": "r", "action": action, "record": record}
    import json

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(event(*e)) for e in [(1, "a", "create", '{"v":1}'), (2, "b", "create", '{"v":1}'), (3, "d", "create", "{")]))
    run = lambda: index.update_index(index.read_events(spark, str(source)), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.json").write_text("\n".join(json.dumps(event(*e)) for e in [(4, "a", "update", '{"v":2}'), (5, "b", "delete", None), (6, "z", "delete", None)]))
    run()
    found = index.IndexWriter(str(tmp_path / "index")).latest(spark).collect()
    assert [tuple(r) for r in found] == [("at://a/c.card/r", '{"v":2}')]


def test_index_batches_are_repeated_and_folded(spark, tmp_path):
    writer = index.IndexWriter(str(tmp_path / "index"), compact_every=3)
    batch = lambda *events: spark.createDataFrame([(s, 0, repo, "c", "r", action, record) for s, repo, action, record in events], index.EVENT)
    want: dict = {}
    for n in range(11):
        events = [(10 * n, f"u{n % 4}", "update", f'{{"v":{n}}}'), (10 * n + 1, f"u{(n + 1) % 4}", "delete", None)]
        writer(batch(*events), n)
        if n % 3 == 0:
            writer(batch(*events), n)  # a repeated batch replaces itself
        want[f"at://u{n % 4}/c/r"] = f'{{"v":{n}}}'
        want.pop(f"at://u{(n + 1) % 4}/c/r", None)
        assert {r.uri: r.record for r in writer.latest(spark).collect()} == want
    writer.spare = spark.range(1).select(F.lit("at://torn/c/r").alias("uri"), F.lit("{}").alias("record"), F.lit(False).alias("gone")).write.parquet(f"{writer.folder}/batch-{99:012d}")
    assert {r.uri: r.record for r in writer.latest(spark).collect()} == want  # not noted, so not there
    base, batches = writer._known(spark, None)
    assert base is not None and len(batches) < 3
