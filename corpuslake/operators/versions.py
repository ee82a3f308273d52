"""Versions of record sets: state, differences, changelogs and publish plans as set algebra."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions.kinds import IDENTITY_FIELDS, section_of, tier_of
from corpuslake.functions.uri import nsid_of, rkey_of
from corpuslake.operators.corpus import lineage_cut
from corpuslake.sources.files import Folder

VALUE_WIDTH, PATH_WIDTH, MOST_TARGETS = 1000, 200, 10


def ancestry(commits: dict[str, list[str]], head: str) -> list[str]:
    """Commits that lead to ``head``, parents before children, first parents first."""
    found, seen, stack = [], set(), [(head, False)]
    while stack:
        commit, done = stack.pop()
        if done:
            found.append(commit)
        elif commit not in seen:
            seen.add(commit)
            stack.append((commit, True))
            stack += [(p, False) for p in reversed(commits.get(commit, []))]
    return found


def state_at(spark, commits: dict[str, list[str]], data: DataFrame, head: str) -> DataFrame:
    """``uri, value`` at a commit: the last write of each uri along its ancestry, unless it is a tombstone."""
    order = spark.createDataFrame([(c, k) for k, c in enumerate(ancestry(commits, head))], "commit_id string, topo long")
    last = data.join(F.broadcast(order), "commit_id").groupBy("uri").agg(F.max_by(F.struct("value", "is_tombstone"), F.struct("topo", "ord")).alias("_l"))
    return last.filter(~F.col("_l.is_tombstone")).select("uri", F.col("_l.value").alias("value"))


class VersionStore:
    """Commits, tags and rows of writes in a folder; whoever opens it sees what was committed.

    A commit's rows are written under a name of their own, then its note is put in
    place by a rename: a write that fails leaves rows that no note names, and of two
    writers that commit at once one fails and may try again.
    """

    SCHEMA = "commit_id string, uri string, value string, is_tombstone boolean, ord long"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._notes, self._tags = Folder(spark, f"{self.folder}/commits"), Folder(spark, f"{self.folder}/tags")

    @property
    def log(self) -> list[dict]:
        """Notes of all commits, oldest first: ``id, parents, author, message``."""
        return [self._notes.read(n) for n in self._notes.names() if n.endswith(".json") and not n.startswith(".")]

    @property
    def commits(self) -> dict[str, list[str]]:
        return {c["id"]: c["parents"] for c in self.log}

    @property
    def tags(self) -> dict[str, str]:
        return {n.removesuffix(".json"): self._tags.read(n)["commit"] for n in self._tags.names() if not n.startswith(".")}

    @property
    def head(self) -> str | None:
        """The last commit."""
        log = self.log
        return log[-1]["id"] if log else None

    def commit(self, rows: DataFrame, message: str, author: str = "", parents: list[str] | None = None) -> str:
        """Append ``rows(uri, value, is_tombstone, ord)`` as a commit after the head."""
        log = self.log
        place, name = len(log), f"c{len(log):08d}-{uuid.uuid4().hex[:12]}"
        rows.select(F.lit(name).alias("commit_id"), "uri", "value", "is_tombstone", F.col("ord").cast("long").alias("ord")).write.mode("overwrite").parquet(f"{self.folder}/data/{name}")
        note = {"id": name, "parents": parents if parents is not None else [log[-1]["id"]] if log else [], "author": author, "message": message}
        if not self._notes.write(f"{place:08d}.json", note):
            raise RuntimeError("another commit came first")
        return name

    def tag(self, name: str, ref: str | None = None) -> None:
        commit = self.head if ref is None else self.resolve(ref)
        if commit is None:
            raise ValueError("there is no commit to tag")
        self._tags.write(f"{name}.json", {"commit": commit}, replace=True)

    def resolve(self, ref: str) -> str:
        found = self.tags.get(ref, ref)
        if found not in self.commits:
            raise KeyError(ref)
        return found

    def state(self, ref: str | None = None) -> DataFrame:
        """``uri, value`` at a commit or tag (default: the head), from the rows of its ancestry alone."""
        commits = self.commits
        if not commits:
            return self.spark.createDataFrame([], "uri string, value string")
        commit = self.head if ref is None else self.resolve(ref)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.folder}/data/{c}" for c in ancestry(commits, commit)))
        return state_at(self.spark, commits, rows, commit)

    def save(self, uri: str, value: str, message: str = "") -> str:
        """Commit one record."""
        return self.commit(self.spark.createDataFrame([(uri, value, False, 0)], "uri string, value string, is_tombstone boolean, ord long"), message or f"save {uri}")

    def forget(self, uri: str, message: str = "") -> str:
        if self.state().filter(F.col("uri") == uri).isEmpty():
            raise KeyError(uri)
        return self.commit(self.spark.createDataFrame([(uri, None, True, 0)], "uri string, value string, is_tombstone boolean, ord long"), message or f"forget {uri}")


def diff(base: DataFrame, head: DataFrame, key: str = "uri", value: str = "value", unchanged: bool = False) -> DataFrame:
    """``key, status, old, new``: added, removed and changed keys; values are compared null-safe."""
    b, h = base.select(key, F.col(value).alias("old"), F.lit(True).alias("_b")), head.select(key, F.col(value).alias("new"), F.lit(True).alias("_h"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    found = b.join(h, key, "full_outer").select(key, status.alias("status"), "old", "new")
    return found if unchanged else found.filter("status != 'unchanged'")


def _show(value) -> str | None:
    if value is None:
        return None
    return (value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False))[:VALUE_WIDTH]


def json_changes(old: str | None, new: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """Changed places of two JSON values as (path, change, old, new).

    Objects are walked by sorted key and arrays by index; a place that one side
    lacks is one change, whatever is below it.
    """
    out: list[tuple[str, str, str | None, str | None]] = []
    stack = [("", json.loads(old) if old else {}, json.loads(new) if new else {})]
    while stack:
        path, a, b = stack.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            steps = [(k, k in a, k in b, a.get(k), b.get(k)) for k in sorted({*a, *b})]
        elif isinstance(a, list) and isinstance(b, list):
            steps = [(str(k), k < len(a), k < len(b), a[k] if k < len(a) else None, b[k] if k < len(b) else None) for k in range(max(len(a), len(b)))]
        else:
            if type(a) is not type(b) or a != b:
                out.append((path[-PATH_WIDTH:], "changed", _show(a), _show(b)))
            continue
        below = []
        for name, in_a, in_b, x, y in steps:
            place = f"{path}/{name}" if path else name
            if in_a and in_b:
                below.append((place, x, y))
            else:
                out.append((place[-PATH_WIDTH:], "removed" if in_a else "added", _show(x), _show(y)))
        stack += reversed(below)
    return sorted(out, key=lambda c: c[0])


def field_changes(pairs: DataFrame, key: str = "uri") -> DataFrame:
    """``key, field_path, change_type, old_value, new_value`` of rows with JSON ``old`` and ``new``, in Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, *c) for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for c in json_changes(a, b)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], [key, "field_path", "change_type", "old_value", "new_value"])

    return pairs.select(F.col(key).cast("string").alias(key), "old", "new").mapInArrow(run, f"{key} string, field_path string, change_type string, old_value string, new_value string")


def record_changes(base: DataFrame, head: DataFrame, unchanged: bool = False) -> DataFrame:
    """``uri, record_change, changes``: what became of each record, with its changed fields by path."""
    records = diff(base, head, unchanged=unchanged)
    item = F.struct("field_path", "change_type", "old_value", "new_value")
    per = field_changes(records).groupBy("uri").agg(F.sort_array(F.collect_list(item)).alias("changes"))
    kind = per.schema["changes"].dataType
    return records.select("uri", F.col("status").alias("record_change")).join(per, "uri", "left").withColumn("changes", F.coalesce("changes", F.array().cast(kind)))


def bump_level(records: DataFrame, changes: DataFrame) -> DataFrame:
    """One row ``level``: major if a record or field is gone or an identity changed, minor if one came, else patch, none if equal."""
    leaf = F.element_at(F.split("field_path", "/"), -1)
    r = records.select((F.col("status") == "removed").alias("major"), (F.col("status") == "added").alias("minor"))
    c = changes.select(((F.col("change_type") == "removed") | ((F.col("change_type") == "changed") & leaf.isin(*IDENTITY_FIELDS))).alias("major"), (F.col("change_type") == "added").alias("minor"))
    return r.unionAll(c).agg(F.when(F.count(F.lit(1)) == 0, "none").when(F.bool_or("major"), "major").when(F.bool_or("minor"), "minor").otherwise("patch").alias("level"))


def bump_version(version: Column, level: Column) -> Column:
    """The next version; a missing one counts as 0.0.0, and level none keeps it."""
    v = F.transform(F.split(F.coalesce(version, F.lit("0.0.0")), r"\."), lambda x: x.cast("int"))
    a, b, c = (F.get(v, F.lit(k)) for k in range(3))
    parts = F.when(level == "major", F.array(a + 1, F.lit(0), F.lit(0))).when(level == "minor", F.array(a, b + 1, F.lit(0))).when(level == "patch", F.array(a, b, c + 1)).otherwise(v)
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), ".")


def changelog_groups(changes: DataFrame, nsid: str = "nsid", key: str = "uri", namespace: str | None = None) -> DataFrame:
    """Changes by section, type and path: their count, the first ten targets, and the value of single ones.

    Spark keeps ten targets a group in each task before it exchanges them, so a group
    that all records share is never gathered.
    """
    path = ["category", "change_type", "field_path"]
    rows = changes.withColumn("category", section_of(nsid, namespace))
    counted = rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.min("new_value").alias("_value"))
    ranked = rows.select(*path, F.col(key).alias("_key")).withColumn("_rank", F.dense_rank().over(Window.partitionBy(*path).orderBy("_key")))
    first = ranked.filter(F.col("_rank") <= MOST_TARGETS).groupBy(*path).agg(F.array_join(F.sort_array(F.collect_set("_key")), ",").alias("targets"))
    return counted.join(first, path).select(*path, "n", "targets", F.when(F.col("n") == 1, F.col("_value")).alias("new_value"))


def plan_publish(local: DataFrame, remote: DataFrame, namespace: str | None = None) -> DataFrame:
    """``action, tier, uri, nsid, place`` from local and remote ``uri, cid``.

    Deletes come first, from the highest tier down; then creates and updates from
    the lowest tier up; within a tier by uri.
    """
    found = diff(remote, local, value="cid")
    action = F.create_map(*[F.lit(x) for x in ("added", "create", "removed", "delete", "changed", "update")])[F.col("status")]
    ops = found.select(action.alias("action"), "uri", nsid_of("uri").alias("nsid")).withColumn("tier", tier_of("nsid", namespace))
    return number_rows(ops, publish_order()).select("action", "tier", "uri", "nsid", "place")


def publish_order() -> list[Column]:
    """Deletes first, from the highest tier down, then the others from the lowest tier up; then by uri."""
    upsert = F.col("action") != "delete"
    return [upsert, F.when(upsert, F.col("tier")).otherwise(-F.col("tier")), F.col("uri")]


def number_rows(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them to one task.

    Rows are sorted over range partitions; a row's number in its partition comes with
    the sort, and the sizes of the partitions, one number each, give every partition its
    offset.  The sorted rows are kept, as ranges that are drawn twice need not be the same.
    """
    keyed = df.withColumn("_o", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]))
    ranged = lineage_cut(df.sparkSession)(keyed.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_id", F.monotonically_increasing_id()))
    low = F.lit((1 << 33) - 1)
    local = ranged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_n", F.col("_id").bitwiseAND(low))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_o", "_id", "_p", "_n", "_before")


def chunks(df: DataFrame, place: str = "place", size: int = 200) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(place) / size).cast("long"))


def latest_by(df: DataFrame, key: str, newest: str, order: str, fields: list[str]) -> DataFrame:
    """For each key the row with the greatest ``newest``, the first in ``order`` of equal ones, by aggregation alone."""
    best = F.max_by(F.struct(*fields), F.struct(F.col(newest), -F.col(order)))
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[F.col(f"_b.{f}").alias(f) for f in fields])


def schema_diff(old: DataFrame, new: DataFrame) -> list[tuple[str, str, str | None, str | None]]:
    """Differences of two schemas by path: (path, change, old type, new type)."""
    from pyspark.sql import types as T

    def paths(kind, at=""):
        if isinstance(kind, T.StructType):
            return {k: v for f in kind for k, v in paths(f.dataType, f"{at}/{f.name}".strip("/")).items()}
        if isinstance(kind, T.ArrayType):
            return paths(kind.elementType, f"{at}[]")
        return {at: kind.simpleString()}

    a, b = paths(old.schema), paths(new.schema)
    return [(p, "added" if p not in a else "removed" if p not in b else "changed", a.get(p), b.get(p)) for p in sorted({*a, *b}) if a.get(p) != b.get(p)]


#: A bump rule: from record and field differences to one row ``level``.
BumpRule = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Changelog:
    """An aggregate entry: version, level and grouped changes."""

    version: str
    level: str
    groups: DataFrame


def generate_changelog(base: DataFrame, head: DataFrame, previous: str | None, rule: BumpRule = bump_level) -> Changelog:
    """The changelog from one state to another; no change keeps the version.  ``rule`` may be one of the caller's."""
    records = diff(base, head)
    changes = field_changes(records).withColumn("nsid", nsid_of("uri"))
    level = rule(records, changes)
    row = level.select("level", bump_version(F.lit(previous), F.col("level")).alias("version")).first()
    return Changelog(row.version, row.level, changelog_groups(changes))


def entries(records: DataFrame, changes: DataFrame, previous: DataFrame | None = None, rule: Callable[[DataFrame], Column] | None = None, namespace: str | None = None) -> DataFrame:
    """``subject, nsid, record_change, level, previous_version, version, sections``: an entry for each record that differs.

    ``records`` is a ``diff`` and ``changes`` its ``field_changes``; ``previous`` has
    ``subject, version``.  A subject's sections are its changes in JSON, by path.
    ``rule`` gives the level from the aggregates ``status, lost, broken, came`` of a
    subject; a record that is unchanged keeps its version and has no section.
    """
    leaf = F.element_at(F.split("field_path", "/"), -1)
    kind = F.col("change_type")
    item = F.struct("field_path", "change_type", "old_value", "new_value")
    per = changes.groupBy("uri").agg(
        F.bool_or(kind == "removed").alias("lost"), F.bool_or((kind == "changed") & leaf.isin(*IDENTITY_FIELDS)).alias("broken"), F.bool_or(kind == "added").alias("came"),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    told = records.select("uri", "status").join(per, "uri", "left")
    told = told.select("uri", "status", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("lost", "broken", "came")), "items")
    default = F.when((F.col("status") == "removed") | F.col("lost") | F.col("broken"), "major").when((F.col("status") == "added") | F.col("came"), "minor").otherwise("patch")
    same = (F.col("status") == "unchanged") & F.col("items").isNull()
    level = F.when(same, F.lit("none")).otherwise(default if rule is None else rule(told))
    if previous is not None:
        told = told.join(previous.select(F.col("subject").alias("uri"), F.col("version").alias("previous_version")), "uri", "left")
    else:
        told = told.withColumn("previous_version", F.lit(None).cast("string"))
    told = told.withColumn("nsid", nsid_of("uri")).withColumn("level", level)
    version = F.when(F.col("level") == "none", F.col("previous_version")).otherwise(bump_version(F.col("previous_version"), F.col("level")))
    sections = F.when(F.col("level") == "none", F.lit("[]")).otherwise(F.to_json(F.array(F.struct(section_of("nsid", namespace).alias("category"), F.coalesce("items", F.array().cast(told.schema["items"].dataType)).alias("items")))))
    return told.select(F.col("uri").alias("subject"), "nsid", F.col("status").alias("record_change"), "level", "previous_version", version.alias("version"), sections.alias("sections"))


def generate_entry(base: DataFrame | None, head: DataFrame, subject: str, previous: str | None = None, **options) -> DataFrame:
    """The entry of one record from one state (null: an empty one) to another; ValueError if neither has it."""
    base = head.limit(0) if base is None else base
    records = diff(*(df.filter(F.col("uri") == subject) for df in (base, head)), unchanged=True)
    if records.isEmpty():
        raise ValueError(f"neither state has {subject}")
    known = head.sparkSession.createDataFrame([(subject, previous)], "subject string, version string")
    return entries(records, field_changes(records.filter("status != 'unchanged'")), known, **options)


def augment(plan: DataFrame, base: DataFrame, head: DataFrame, previous: DataFrame, to: str, nsid: str, **options) -> DataFrame:
    """A publish plan with the changelog entries of its records as further creates, in their place.

    ``plan`` is ``plan_publish``'s; ``previous`` has ``subject, version``; entries are
    named after their record and version, under ``to`` and the collection ``nsid``.
    Records of that collection get no entry, nor do records that do not differ between
    the states.
    """
    subjects = plan.filter(F.col("nsid") != nsid).select("uri").distinct()
    records = diff(base, head).join(subjects, "uri", "left_semi")
    made = entries(records, field_changes(records), previous, **options).filter("version is not null")
    rows = made.select(F.lit("create").alias("action"), F.concat(F.lit(f"at://{to}/{nsid}/"), rkey_of("subject"), F.lit("."), "version").alias("uri"), F.lit(nsid).alias("nsid"))
    both = plan.select("action", "uri", "nsid").unionByName(rows).withColumn("tier", tier_of("nsid", options.get("namespace")))
    return number_rows(both, publish_order()).select("action", "tier", "uri", "nsid", "place")


def merge_plans(plans: list[DataFrame]) -> DataFrame:
    """Several plans as one, in publish order; of writes to one uri the last plan's holds."""
    each = [p.select("action", "uri", "nsid", "tier").withColumn("_plan", F.lit(k)) for k, p in enumerate(plans)]
    last = reduce(DataFrame.unionAll, each).groupBy("uri").agg(F.max_by(F.struct("action", "nsid", "tier"), "_plan").alias("w")).select("w.action", "uri", "w.nsid", "w.tier")
    return number_rows(last, publish_order()).select("action", "tier", "uri", "nsid", "place")


def wire_value(value: Column | str, nsid: Column | str) -> Column:
    """A record's JSON text as it is sent: its collection as ``$type``, before its own fields."""
    value, nsid = (F.col(c) if isinstance(c, str) else c for c in (value, nsid))
    body = F.substring(F.trim(value), 2, 1 << 30)
    marker = F.concat(F.lit('{"$type":"'), nsid, F.lit('"'))
    return F.when(F.regexp_like(value, F.lit(r"^\s*\{\s*\}\s*$")), F.concat(marker, F.lit("}"))).otherwise(F.concat(marker, F.lit(","), body))
