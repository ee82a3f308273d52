"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest
from corpuslake.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for file in sorted(os.listdir(DATA)):
        at = f"{DATA}/{file}"
        made.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return made


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    even = lambda v: round(v, 9) if isinstance(v, float) else v
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(map(even, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()), key=repr) == sorted((tuple(map(even, r)) for r in rows), key=repr)


def test_without_sql(spark):
    """Lanes do not overlap and none could be lower; counts and quantiles are near; a sample is of its size."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"lane_packing", "sql_approximate", "sql_sample"}
    by_key: dict = {}
    for r in QUERIES["lane_packing"](spark, DATA).collect():
        by_key.setdefault(r.k, []).append(r)
    for rows in by_key.values():
        taken: list = []
        for r in sorted(rows, key=lambda r: (r.hi - r.lo, r.lo, r.hi, r.label)):
            lane = next((k for k, own in enumerate(taken) if all(r.hi <= a or r.lo >= b for a, b in own)), len(taken))
            taken += [[]] * (lane == len(taken))
            taken[lane] = [*taken[lane], (r.lo, r.hi)]
            assert r.lane == lane
    exact = {r[0]: r[1:] for r in spark.sql(f"SELECT l_returnflag, count(DISTINCT l_partkey), median(l_quantity) FROM parquet.`{DATA}/lineitem.parquet` GROUP BY 1").collect()}
    for flag, parts, middle in QUERIES["sql_approximate"](spark, DATA).collect():
        assert abs(parts - exact[flag][0]) <= 0.15 * exact[flag][0] and abs(middle - exact[flag][1]) <= 1
    assert 400 < QUERIES["sql_sample"](spark, DATA).count() < 800
