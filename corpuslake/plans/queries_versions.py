"""Queries of the version, changelog, publish and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.operators import versions
from corpuslake.plans.mapping import orders_json, orders_sql
from corpuslake.plans.registry import query, table
from corpuslake.streaming import index

A, B = orders_sql(False), orders_sql(True)
_BOTH = f"WITH a AS ({A}), b AS ({B}), x AS (SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' WHEN a.value = b.value THEN 'unchanged' ELSE 'changed' END AS status, a.cust AS c0, b.cust AS c1, a.status AS s0, b.status AS s1, a.price AS p0, b.price AS p1 FROM a FULL JOIN b ON a.uri = b.uri)"
_CHANGES = _BOTH + """, ch AS (
  SELECT uri, 'cust' AS field_path, status AS change_type, CAST(c0 AS VARCHAR) AS old_value, CAST(c1 AS VARCHAR) AS new_value FROM x WHERE status IN ('added', 'removed')
  UNION ALL SELECT uri, 'status', status, s0, s1 FROM x WHERE status IN ('added', 'removed') OR (status = 'changed' AND s0 != s1)
  UNION ALL SELECT uri, 'price', status, p0, p1 FROM x WHERE status IN ('added', 'removed') OR (status = 'changed' AND p0 != p1))"""


def _states(spark, d):
    return orders_json(spark, d), orders_json(spark, d, True)


@query("record_diff", f"{_BOTH} SELECT uri, status FROM x WHERE status != 'unchanged'")
def record_diff(spark, d):
    return versions.diff(*_states(spark, d)).select("uri", "status")


@query("field_diff", f"{_CHANGES} SELECT uri, field_path, change_type, old_value, new_value FROM ch")
def field_diff(spark, d):
    return versions.field_changes(versions.diff(*_states(spark, d)))


@query("changelog_aggregate", f"""{_CHANGES} SELECT 'other' AS category, change_type, field_path, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT uri))[1:10], ',') AS targets, CASE WHEN count(*) = 1 THEN min(new_value) END AS new_value FROM ch GROUP BY change_type, field_path""")
def changelog_aggregate(spark, d):
    changes = versions.field_changes(versions.diff(*_states(spark, d)))
    return versions.changelog_groups(changes.withColumn("nsid", F.lit("sales.order")))


@query("changelog_bump", f"{_CHANGES} SELECT CASE WHEN bool_or(change_type = 'removed') THEN 'major' WHEN bool_or(change_type = 'added') THEN 'minor' ELSE 'patch' END AS level, CASE WHEN bool_or(change_type = 'removed') THEN '2.0.0' WHEN bool_or(change_type = 'added') THEN '1.5.0' ELSE '1.4.8' END AS version FROM ch")
def changelog_bump(spark, d):
    records = versions.diff(*_states(spark, d))
    level = versions.bump_level(records, versions.field_changes(records))
    return level.select("level", versions.bump_version(F.lit("1.4.7"), F.col("level")).alias("version"))


@query("publish_plan", f"""{_BOTH}, p AS (SELECT CASE status WHEN 'added' THEN 'create' WHEN 'removed' THEN 'delete' ELSE 'update' END AS action, uri, 'sales.order' AS nsid, 3 AS tier FROM x WHERE status != 'unchanged')
SELECT action, tier, uri, nsid, row_number() OVER (ORDER BY action != 'delete', CASE WHEN action = 'delete' THEN -tier ELSE tier END, uri) - 1 AS place FROM p""")
def publish_plan(spark, d):
    local, remote = _states(spark, d)[::-1]
    cid = lambda df: df.select("uri", F.sha2("value", 256).alias("cid"))
    return versions.plan_publish(cid(local), cid(remote))


@query("publish_chunks", f"""{_BOTH} SELECT CAST(floor(place / 200) AS BIGINT) AS chunk, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY status != 'removed', uri) - 1 AS place FROM x WHERE status != 'unchanged') GROUP BY 1""")
def publish_chunks(spark, d):
    return versions.chunks(publish_plan(spark, d)).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("latest_version", "SELECT o_custkey AS subject, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_version(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "subject")
    return versions.latest_by(o, "subject", "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("state_at_commit", """WITH w AS (SELECT l_partkey AS uri, l_orderkey AS v, l_linenumber AS c, l_returnflag = 'R' AS gone, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_linenumber IN (1, 2, 4)),
x AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY CASE c WHEN 1 THEN 0 WHEN 4 THEN 1 ELSE 2 END DESC, ord DESC) AS k FROM w) SELECT CAST(uri AS VARCHAR) AS uri, CAST(v AS VARCHAR) AS value FROM x WHERE k = 1 AND NOT gone""")
def state_at_commit(spark, d):
    """Commits 1 <- 4, 1 <- 2, and a merge of 4 and 2; commit 3 is on no path to it."""
    i = table(spark, d, "lineitem")
    data = i.select(F.col("l_linenumber").cast("string").alias("commit_id"), F.col("l_partkey").cast("string").alias("uri"), F.col("l_orderkey").cast("string").alias("value"), (F.col("l_returnflag") == "R").alias("is_tombstone"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return versions.state_at(spark, {"1": [], "2": ["1"], "3": ["1"], "4": ["1"], "m": ["4", "2"]}, data, "m")


_EVENTS = """WITH e AS (SELECT 'at://u' || user_id || '/c.card/r' AS uri, CASE event_id % 4 WHEN 0 THEN 'delete' WHEN 3 THEN 'noop' ELSE 'update' END AS action, '{"v":' || event_id % 3 || '}' AS record, event_id FROM events),
old AS (SELECT 'at://u' || user_id || '/c.card/r' AS uri, '{"v":1}' AS record FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0),
l AS (SELECT uri, arg_max(action, event_id) AS action, arg_max(record, event_id) AS record FROM e GROUP BY uri)
SELECT l.uri, CASE WHEN action = 'delete' THEN CASE WHEN old.uri IS NULL THEN 'skipped' ELSE 'removed' END WHEN action = 'noop' THEN 'skipped' WHEN old.record = l.record THEN 'unchanged' ELSE 'built' END AS outcome FROM l LEFT JOIN old ON l.uri = old.uri"""


def _events(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_id") % 4 == 0, "delete").when(F.col("event_id") % 4 == 3, "noop").otherwise("update")
    record = F.when(action != "delete", F.concat(F.lit('{"v":'), F.col("event_id") % 3, F.lit("}")))
    return e.select(F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("op_ord"), F.concat(F.lit("u"), "user_id").alias("repo"), F.lit("c.card").alias("collection"), F.lit("r").alias("rkey"), action.alias("action"), record.alias("record"))


@query("stream_outcomes", _EVENTS)
def stream_outcomes(spark, d):
    old = table(spark, d, "events").select("user_id").distinct().filter("user_id % 2 = 0")
    known = old.select(F.concat(F.lit("at://u"), "user_id", F.lit("/c.card/r")).alias("uri"), F.lit('{"v":1}').alias("record"))
    return index.outcomes(_events(spark, d), known).select("uri", "outcome")


@query("event_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return index.windowed_counts(table(spark, d, "events")).select(F.col("window.start").cast("timestamp").alias("window_start"), "event_type", "n")


@query("event_sessions", """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return index.sessions(table(spark, d, "events")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
