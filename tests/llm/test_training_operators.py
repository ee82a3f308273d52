"""Training-data operators against brute force, on small tables with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import components, exact_dedup, language, mixing, packing, quality, simhash, substring_dedup, token_store, tokens, toxicity, vectors
from corpuslake.llm.common import Workspace

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def corpus_rows():
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k]) for k in range(4)]  # copies
    rows += [(200 + k, base[k].replace(" ", "  ")) for k in range(2)]  # copies but for white space
    rows += [(300 + k, base[5] + f" extra{k}") for k in range(6)]  # near copies
    rows += [(400 + k, prose(900 + k, 30) + base[7][:250] + prose(950 + k, 30)) for k in range(4)]  # a shared passage
    return [*rows, (500, None), (501, ""), (502, " \n"), (503, "one"), (504, "x" * 5000), (505, prose(77, 20_000)), (506, "日本語 テキスト é ñ"), (None, "no id here at all"), (0, base[0])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", 1, "clash", 0) for i, t in corpus_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score int").repartition(4)


def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs, runs=4, fan_in=2).collect()
    assert len(got) == len(corpus_rows()) and got[0].source is not None
    groups = {}
    for i, t in corpus_rows():
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        text = dict_text(r)
        own = sorted(groups[text])
        assert (r.keep_id, r.group_size, r.text_sha256) == (own[0][3], len(own), hashlib.sha256(text.encode()).hexdigest())
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0
    want = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)
    for runs, fan_in in ((1, 2), (7, 3), (512, 8)):
        assert sorted(str(tuple(r)) for r in exact_dedup.exact_dedup(docs, runs=runs, fan_in=fan_in, columns=["doc_id"]).collect()) == want


def test_no_column_name_is_taken(docs):
    names = ["row", "run", "range", "digest", "sha", "best", "n", "points", "_run", "_digest", "_sha", "_rank", "_whole", "_n", "_cut", "_source", "_block", "_copies", "tokens", "total"]
    clash = docs.select("doc_id", "text", "source", *(F.lit(f"own {k}").alias(k) for k in names))
    for found in (exact_dedup.exact_dedup(clash), mixing.mix(clash), quality.accepted(clash.withColumn("_text", F.lit("own")).withColumn("score", F.lit("own")), quality.AdditiveModel(3.0))):
        assert found.count() >= docs.count() - 5 and found.filter(" or ".join(f"`{k}` != 'own {k}'" for k in names)).isEmpty()
    assert set(clash.columns) <= set(exact_dedup.kept_rows(clash).columns)


def dict_text(r):
    return "".join(c for c in r.text or "" if c not in " \t\n\v\f\r")


def brute_fingerprint(text):
    from xxhash import xxh64

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    k = min(4, len(parts))
    hashes = [xxh64(b" ".join(parts[i : i + k]), seed=42).intdigest() for i in range(len(parts) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                parent[root(a)] = root(b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(root(k), []).append(k)
    return {k: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for k in g}


def test_simhash(docs):
    rows = corpus_rows()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = sorted(map(str, map(tuple, simhash.simhash_components(docs).collect())))
    assert got == sorted(str((i, f"{prints[k]:016x}", want[k])) for k, (i, _) in enumerate(rows))
    assert simhash.simhash_components(empty(docs)).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == [c for c in docs.columns] or set(kept.columns) == set(docs.columns)
    assert sorted({r.doc_id for r in kept.filter("doc_id is not null").collect()}) == sorted({i for k, (i, _) in enumerate(rows) if i is not None and i == want[k]})


def test_posting_lists_find_all_links(spark):
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, k, replace=False))) for f in fps for k in (1, 4, 5)]
    values = np.unique(np.concatenate([fps, np.array(near, np.uint64)]))
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.index_links(rows, Workspace(spark, "t")).distinct().collect()
    assert all((np.array([r.a, r.b]).view(np.uint64)[0] ^ np.array([r.a, r.b]).view(np.uint64)[1]).item().bit_count() <= 4 for r in links)
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    ids = values.view(np.int64).tolist()
    want = brute_components(ids, lambda a, b: int(values[a] ^ values[b]).bit_count() <= 4)
    assert all(found.get(ids[k], ids[k]) == c for k, c in want.items())


def test_long_lists_are_split_exactly(spark):
    draw = np.random.default_rng(3)
    center = int(draw.integers(0, 1 << 63))
    values = {center ^ sum(1 << int(b) for b in draw.choice(64, int(k), replace=False)) for k in draw.integers(0, 9, 400)} | {int(v) for v in draw.integers(0, 1 << 63, 50)}
    values = np.array(sorted(values), np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    ids = values.view(np.int64).tolist()
    want = brute_components(ids, lambda a, b: int(values[a] ^ values[b]).bit_count() <= 4)
    for longest in (1, 10, 4096):
        links = simhash.index_links(rows, Workspace(spark, "t"), longest=longest)
        assert all((a ^ b).bit_count() <= 4 for a, b in ((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()))
        found = {r.node: r.component for r in components.connected_components(links, Workspace(spark, "t")).collect()}
        assert all(found.get(ids[k], ids[k]) == c for k, c in want.items())


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(200, 400)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 200 for k in [*range(200, 400), 1000])


def library_ids(text):
    enc = tokens.encoder(tokens.default_tokenizer())
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_cached_ids_are_the_librarys():
    enc = tokens.Encoder(tokens.default_tokenizer(), limit=50)
    draw = random.Random(5)
    signs = [chr(c) for c in range(1, 0x260)] + list(" \n\t'.,as1\xa0\x85\x1c日") * 30
    for _ in range(4000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == library_ids(text)[:-1], repr(text)


def test_blocks_round_trip():
    draw = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.where(draw.random(n) < 0.05, draw.integers(0, 1 << 32, n), draw.integers(5, 900, n)).astype("<u4")
        starts, data = token_store.pack_ids(ids)
        assert (token_store.unpack_ids(data, starts, n) == ids).all()
    same = np.full(1000, 7, "<u4")
    assert len(token_store.pack_ids(same)[1]) < 64


def test_token_store(docs):
    got = token_store.token_store(docs, file_ids=300).collect()
    place = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(corpus_rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = np.array(library_ids(t), "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, place, len(ids) // 4, zlib.crc32(ids))
        place += r.n_tokens
    assert token_store.token_store(empty(docs)).count() == 0


def test_ids_beyond_double_precision_beside_a_null_id(spark, tmp_path):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "one two"), (None, "three"), (big + 2, "four")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(docs).collect()} == {r.doc_id for r in token_store.token_store(docs).collect()} == {big, None, big + 2}


def test_a_used_folder_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    first = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    assert token_store.token_store(first, folder=folder).count() == 20
    with pytest.raises(ValueError, match="token-id files"):
        token_store.token_store(first.limit(3), folder=folder)


def test_best_fit_of_counts_is_best_fit():
    draw = np.random.default_rng(4)
    for size, n in ((16, 40), (64, 300), (128, 2000)):
        fills = draw.integers(1, size, n)
        counts = {int(f): int(k) for f, k in zip(*np.unique(fills, return_counts=True), strict=True)}
        find = packing._sequences(packing.best_fit_of_counts(counts, size))
        numbers = np.zeros(n, np.int64)
        for f in counts:
            numbers[fills == f] = np.arange(counts[f])
        sequence, offset = find(fills.astype(np.int64), numbers)
        for b in np.unique(sequence):
            own = np.argsort(offset[sequence == b])
            sizes = fills[sequence == b][own]
            assert (offset[sequence == b][own] == np.cumsum(sizes) - sizes).all() and sizes.sum() <= size
        assert len(np.unique(sequence)) == len(packing.best_fit(fills, size))


@pytest.mark.parametrize("options", [{"slack": 2, "fan_in": 2}, {"carry": 1}, {"carry": 0}, {"carry": 3, "fan_in": 2}])
def test_packing(docs, monkeypatch, options):
    monkeypatch.setattr(packing, "_LOT", 40)
    got = packing.pack(docs, size=128, **options).collect()
    pieces = {}
    for i, t in corpus_rows():
        ids = np.array(library_ids(t), "<u4")
        first = len(ids) if len(ids) <= 128 else len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            key = (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    seen = {}
    for r in got:
        seen[tuple(r[:5])] = seen.get(tuple(r[:5]), 0) + 1
    assert seen == pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 128) * 1.05 + 1
    assert packing.pack(empty(docs)).count() == 0


def test_substring_dedup(spark, docs):
    rows = sorted({(i, t) for i, t in corpus_rows() if i is not None and i != 0}) + [(0, corpus_rows()[0][1])] + [(600, "ab" * 300), (601, prose(5, 40) + "ab" * 200)]
    rows.sort(key=lambda r: r[0])
    seen, want = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == want
    for most in (1, 3):
        crowded = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowded=most).collect()
        assert sorted(map(tuple, crowded)) == sorted(map(tuple, got))
    repeated = substring_dedup.remove_repeats(docs).collect()  # ids that are null or repeat
    assert len(repeated) == len(corpus_rows()) and sorted(r.n_removed for r in repeated if r.doc_id == 0) == [0, len(corpus_rows()[0][1])]
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_a_crowded_trigger_is_split(spark):
    """A line that stands in many different surroundings, some of which repeat around it."""
    draw, line = random.Random(6), "the very same line of forty letters here"
    rows = []
    for k in range(120):
        before, after = prose(draw.randrange(12), 12)[-60:], prose(100 + draw.randrange(12), 12)[:60]
        rows.append((k, f"{prose(3000 + k, 8)} {before}{line}{after} {prose(4000 + k, 8)}"))
    seen, want = set(), {}
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 99):
            if t[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(t[a : a + 100])
        want[i] = sum(gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sum(map(bool, want.values())) > 40
    for most in (1, 10, 1024):
        assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, crowded=most).collect()} == want


def test_suffix_arrays_are_in_byte_order():
    phrases = [b"abcabcabd" * 20, b"abcabcabd" * 14, bytes(range(256))]
    windows, order = substring_dedup.suffix_array(phrases, 100)
    assert [windows[k] for k in order] == sorted(windows) and all(a < b for a, b in zip(order, order[1:]) if windows[a] == windows[b])


def test_long_texts_are_parsed_in_segments(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 500)
    data = np.frombuffer(prose(3, 900).encode(), np.uint8)
    _, place, first, last = substring_dedup.parse(data, 100)
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place + substring_dedup.GRAM <= first + 100)).all()


def test_vectors(spark):
    draw = np.random.default_rng(2)
    centers = draw.standard_normal((8, 16))
    rows = [(k, (centers[k % 8] + draw.standard_normal(16) * (0.02 if k < 40 else 1.5)).tolist(), k % 8 % 3) for k in range(90)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(5)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [float("inf")] * 16, 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=8).collect()}
    ok = {i: np.array(v) for i, v, g in rows if v is not None and g is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: g for i, _, g in rows}
    near = lambda a, b: len(ok[a]) == len(ok[b]) and label[a] == label[b] and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.93
    ids = list(ok)
    comp = brute_components(ids, lambda a, b: near(ids[a], ids[b]))
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(near(i, j) for j in ids if j != i), comp[k], comp[k] == i), i
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, *_ in rows if i not in ok)


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_links_of_large_components(spark, block):
    """A tight group, a few beside it, a chain, and copies: all links are counted."""
    draw = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x)
    centre, side = np.eye(12)[0], np.eye(12)[1]
    tight = [unit(centre + 0.03 * draw.standard_normal(12)) for _ in range(30)]
    beside = [unit(np.cos(a) * centre + np.sin(a) * side) for a in np.linspace(0.2, 1.4, 20)]
    values = tight + beside + tight[:4]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(values)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    for k, v in enumerate(values):
        assert got[k].n_links == sum(v @ w >= 0.93 for j, w in enumerate(values) if j != k) and got[k].component_id == 0


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).groupBy("doc_id", "text").count().collect()
    rows = corpus_rows()
    assert len({(i, t) for i, t in rows}) == len(got)
    skew = spark.createDataFrame([(k, "w " * 10, "big" if k % 10 else "small") for k in range(2000)], "doc_id long, text string, source string")
    counts = {r["source"]: r["n"] for r in mixing.mix(skew, max_repeats=3.0).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["big"] == 1800 and 590 <= counts["small"] <= 600
    half = mixing.mix(skew, budget=10_000, max_repeats=1.0)
    assert 900 <= half.count() <= 1000 and half.groupBy("doc_id").count().filter("count > 1").isEmpty()
    wide = {r["source"]: r["n"] for r in mixing.mix(skew, entropy=0.9).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    p = wide["small"] / (wide["small"] + wide["big"])
    assert abs(-p * np.log2(p) - (1 - p) * np.log2(1 - p) - 0.9) < 0.01
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_of_many_sources(docs, monkeypatch):
    few = sorted(map(str, mixing.mix(docs).collect()))
    flat = mixing.mix(docs, entropy=1.5).count()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == few
    assert abs(mixing.mix(docs, entropy=1.5).count() - flat) <= 1


def labelled(spark, n, make, name):
    rows = [(k, *make(k)) for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    extra = spark.createDataFrame([(9000, None), (9001, ""), (None, "a text without an id")], "doc_id long, text string")
    return frame.select("doc_id", "text").unionByName(extra), frame.select("doc_id", F.col("y").alias(name)).unionByName(spark.createDataFrame([(9000, None)], f"doc_id long, {name} int")), {k: r[2] for k, r in enumerate(rows)}


def test_quality(spark):
    def make(k):
        text = prose(k, 80)
        return (text, 1) if k % 4 else (text.upper().replace(" ", "!! "), 0)

    docs, labels, truth = labelled(spark, 300, make, "quality")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 303 and held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    flat = quality.train(docs, labels.filter("quality = 1"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, flat).collect())
    assert quality.score(docs.limit(0), flat).count() == 0


def test_toxicity(spark):
    insults = ["blurgface", "snorkwit", "grumpfel"]

    def make(k):
        text, bad = prose(k, 60), k % 3 == 0
        return (text[:100] + " " + insults[k % 9 // 3] + " " + text[100:], 1) if bad else (text, 0)

    docs, labels, truth = labelled(spark, 400, make, "toxic")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert machine.probability("alpha beta s n o r k w i t gamma") > 0.5 > machine.probability("alpha beta gamma")
    assert machine.probability("alpha snorxkwit beta") > 0.5
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} <= {0, 1}


def test_collapsed_scores_are_kernel_sums():
    words = [toxicity.classes_of(w).tobytes() for w in ("stupid", "stup.id", "worthless")]
    row, which, value = toxicity._sparse(words)
    table = np.zeros((3, toxicity.ALPHABET**3))
    np.add.at(table, (row, which), value)
    machine = toxicity.Machine(table[0], 0.0, 1.0, 0.0)
    scores = machine.word_scores(toxicity.classes_of("stupid stup.id worthless"))[2]
    assert np.allclose(scores, table @ table[0])


def test_language(spark):
    kinds = {"en": "the of and with this that from have".split(), "de": "der die und mit nicht ein auf schön".split(), "fr": "le la et avec pas une sur été".split()}

    def text(k, lang):
        return " ".join(random.Random(k).choices(kinds[lang], k=30))

    rows = [(k, text(k, g), g) for k in range(300) for g in [list(kinds)[k % 3]]] + [(900, None, "en"), (901, "123 !", "de"), (902, "", None), (903, text(1, "de"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert held and all(zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in held) and np.mean([got[i].lang_pred == g for i, _, g in held]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    nothing = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
