"""The engine over a small folder of views: catalog, keyword in context, token patterns, SQL."""

import pytest
from corpuslake.functions.regex import re2_to_java
from corpuslake.plans import dialect
from corpuslake.plans.cql import condition, cql, cql_sorted, parse
from corpuslake.plans.engine import Engine, filter_rows, view_name
from corpuslake.plans.errors import PatternError, QueryError
from corpuslake.plans.kwic import kwic, kwic_native

TEXTS = {
    "lake-1": ("clause", "Seven grey herons stood in the shallow lake."),
    "lake-2": ("clause", "One heron waited; the other HERON flew off."),
    "lake-3": ("heading", "Herons, reeds and lakes"),
}
#: Words with their classes, by layer; the second layer lacks its third place.
LAYERS = {
    "birds": "Seven/NUM grey/ADJ herons/N stood/V in/P the/ART shallow/ADJ lake/N".split(),
    "flight": "One/NUM heron/N - waited/V the/ART other/ADJ heron/N flew/V".split(),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("views")
    spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id string, kind string, text string").write.parquet(f"{folder}/expressions.parquet")
    rows = [(layer, at, *reversed(word.split("/")), "class") for layer, words in LAYERS.items() for at, word in enumerate(words) if word != "-"]
    spark.createDataFrame(rows, "layer_uri string, token_index long, label string, value string, subkind string").write.parquet(f"{folder}/annotations.parquet")
    spark.range(2).write.parquet(f"{folder}/2nd-table.parquet")
    (folder / "broken.parquet").write_bytes(b"not a table")
    return Engine.open(spark, str(folder))


def test_catalog(engine, spark, tmp_path):
    assert engine.tables() == ("expressions", "annotations", "t_2nd_table")
    assert engine.columns("expressions") == ("id", "kind", "text") and engine.columns("nowhere") == ()
    assert [view_name(n) for n in ("north lake", "__reed__", "7th", "--", "é")] == ["north_lake", "reed", "t_7th", "t_", "t_"]
    for folder in (tmp_path, tmp_path / "absent"):
        with pytest.raises(QueryError):
            Engine.open(spark, str(folder))


def test_concordance_finds_every_match(engine):
    found = lambda p, **o: sorted(r[0] for r in engine.concordance(p, **o).rows)
    assert found(r"herons?") == ["lake-1", "lake-2", "lake-2", "lake-3"]
    assert found(r"\bheron\b") == ["lake-2", "lake-2"] and found(r"\bHERON\b", ignore_case=False) == ["lake-2"]
    assert found("pelican") == []
    (row,) = engine.concordance("stood").rows
    assert (row[1], row[2], row[3]) == ("Seven grey herons ", "stood", " in the shallow lake.")
    assert engine.concordance("heron", limit=2).truncated and not engine.concordance("heron", limit=4).truncated


def test_concordance_context(spark):
    rows = spark.createDataFrame([("a", "so\n\t far  MARK 🦆 MARK"), ("b", None), (None, "MARK" * 2)], "id string, text string")
    got = sorted(map(tuple, kwic(rows, "MARK").collect()))
    assert got[-2:] == [("a", 0, "so far ", "MARK", " 🦆 MARK"), ("a", 1, "so far MARK 🦆 ", "MARK", "")] and [g[0] for g in got[:2]] == ["", ""]
    assert sorted(map(tuple, kwic(rows, "MARK", window=3).collect()))[-1][2:] == (" 🦆 ", "MARK", "")
    known = rows.filter("id is not null")
    assert sorted(map(tuple, kwic(known, "MARK").collect())) == sorted(map(tuple, kwic_native(known, "MARK", "id").collect()))


@pytest.mark.parametrize("pattern", ["", "  \t", "he(ron"])
def test_concordance_refuses(engine, pattern):
    with pytest.raises(QueryError):
        engine.concordance(pattern)


@pytest.mark.parametrize(("pattern", "rows"), [
    ('[label="NUM"] [] [label="N"]', [("birds", "0", "NUM", "ADJ", "N")]),
    ('[label="ADJ"] [label="N"]', [("birds", "1", "ADJ", "N"), ("birds", "6", "ADJ", "N"), ("flight", "5", "ADJ", "N")]),
    ('[value="heron"] [label="V"]', [("flight", "6", "N", "V")]),
    ('[label="V"] [label="NUM"]', []),
    ('[label~"^A" & value!="grey"] or [value~"a"]', [("birds", "5", "ART", "ADJ"), ("birds", "6", "ADJ", "N")]),
])
def test_patterns(engine, pattern, rows):
    """Places that are missing from a layer break a match."""
    assert list(engine.find(pattern).rows) == rows
    table = engine.table("annotations")
    assert sorted(map(tuple, cql(table, pattern).collect())) == sorted(map(tuple, cql_sorted(table, pattern).collect()))


def test_patterns_count_rows_that_share_a_place(engine):
    assert engine.find("[]").row_count == 15
    twice = engine.table("annotations").unionAll(engine.table("annotations"))
    assert cql(twice, '[label="ADJ"] [label="N"]').count() == 4 * 3


def test_pattern_reading():
    columns = ["label", "value", "x_1"]
    assert parse(' outside [label = "a" value!="b&" & x_1 ~ "=c"] [] ', columns) == [[("label", "=", "a"), ("value", "!=", "b&"), ("x_1", "~", "=c")], []]
    for bad, told in (('[label="a"', "no ..."), ("nothing", "no ..."), ('[lemma="a"]', "label, value, x_1"), ('[label="a" &]', "malformed"), ("[label]", "malformed"), ('[label="a]', "malformed"), ('[1a="b"]', "malformed"), ('[label=="a"]', "malformed"), ('[] {2}', "quantifiers"), ("[]*", "quantifiers"), ('[label="a"]+', "quantifiers"), ("[] ?", "quantifiers")):
        with pytest.raises(PatternError, match=told.replace("...", r"\[\.\.\.\]")):
            parse(bad, columns)


def test_patterns_need_places(engine):
    with pytest.raises(PatternError, match="token-aligned"):
        engine.find("[]", table="expressions")
    with pytest.raises(QueryError, match="no table"):
        engine.find("[]", table="nowhere")


def test_expressions_of_patterns_are_re2(engine, spark):
    words = spark.createDataFrame([("l", k, w) for k, w in enumerate(["ab\n", "ab", "a[", "x\ry", "&&", "B1"])], "layer_uri string, token_index long, value string")
    found = lambda p: [r.token_index for r in words.filter(condition(("value", "~", p))).orderBy("token_index").collect()]
    assert found("b$") == [1] and found("[[]") == [2] and found("x.y") == [3] and found("[&&]{2}") == [4] and found("[[:upper:]](?P<n>[0-9])") == [5]
    for bad in ("(?=a)", r"(a)\1", "a*+", "(?>a)", "(?<!a)b"):
        with pytest.raises(PatternError):
            cql(words, f'[value~"{bad}"]')
    assert re2_to_java("(?m)a$") == "(?d)(?m)a$"


def test_sql(engine):
    assert engine.run_sql("SELECT * FROM annotations;", limit=3).truncated
    result = engine.run_sql("SELECT label, NULL AS nothing FROM annotations WHERE regexp_matches(label, '^AR')")
    assert not result.truncated and result.rows == (("ART", ""),) * 2 and result.row_count == 2 and result.elapsed_ms > 0
    for text in ("", " ; ", "SELEC 1", "DROP VIEW annotations", "CREATE TABLE t AS SELECT 1", "INSERT INTO annotations VALUES (1)", "SELECT * FROM nowhere", "SET a = 1"):
        with pytest.raises(QueryError):
            engine.run_sql(text)
    assert engine.query("sql", "SELECT * EXCLUDE (kind) FROM expressions").columns == ("id", "text")
    assert engine.query("concordance", "reeds").row_count == 1 and engine.query("cql", '[label="P"]').row_count == 1
    with pytest.raises(QueryError, match="no mode"):
        engine.query("regex", "x")


def test_sql_of_other_engines(engine):
    run = lambda text: engine.run_sql(text).rows
    assert run("SELECT value FROM annotations WHERE label = 'N' QUALIFY row_number() OVER (PARTITION BY layer_uri ORDER BY token_index DESC) = 1 ORDER BY value") == (("heron",), ("lake",))
    assert run("SELECT DISTINCT label FROM annotations QUALIFY count(*) OVER (PARTITION BY label) > 2 ORDER BY label LIMIT 9") == (("ADJ",), ("N",), ("V",))
    assert run("SELECT * REPLACE (upper(kind) AS kind) FROM (SELECT id, kind FROM expressions) WHERE id = 'lake-3'") == (("lake-3", "HEADING"),)
    assert dialect.spark_sql("SELECT 'x QUALIFY y' FROM t -- QUALIFY z") == "SELECT 'x QUALIFY y' FROM t -- QUALIFY z"


def test_files_by_path_are_refused_unless_allowed(engine, spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    queries = [f"SELECT count(*) FROM read_csv('{tmp_path}/t.csv') WHERE a > 1", f"SELECT count(*) FROM parquet.`{tmp_path}/t.parquet`", f"SELECT count(*) FROM '{tmp_path}/t.parquet'", f"SELECT count(*) FROM read_parquet('{tmp_path}/t.parquet') p JOIN expressions ON true"]
    for text in queries:
        with pytest.raises(QueryError, match="by path"):
            engine.run_sql(text)
    allowed = Engine(spark, engine.views, paths=True)
    assert [allowed.run_sql(text).rows[0][0] for text in queries] == ["1", "3", "3", "9"]


def test_filter_rows(engine):
    table = engine.table("expressions")
    assert filter_rows(table, "HEAD").count() == 1 and filter_rows(table, "").count() == 3 and filter_rows(table, "reed", ["id"]).count() == 0
