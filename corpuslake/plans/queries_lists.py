"""The list queries and point lookups of the service, on orders seen as records of every kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.kinds import KINDS
from corpuslake.plans import service
from corpuslake.plans.registry import query, table

#: Orders by required field, and by the optional field at each place.
GROUPS, OWN = 40, (2, 3, 5)


def _records(spark, d, name: str) -> DataFrame:
    """Each order as a record of the list's kind: its required field tells it from 40 groups, its optional ones from a few."""
    kind, needed, allowed = service.LISTS[name]
    key = F.col("o_orderkey")
    required = F.concat(F.lit("r"), key % GROUPS)
    values = {f: F.concat(F.lit("v"), F.floor(key / GROUPS).cast("long") % n) for f, n in zip(allowed, OWN, strict=False)}
    fields = [(F.array(c) if f == "languages" else c).alias(f) for f, c in values.items()]
    if needed not in ("repo", "nsid"):
        fields.append(required.alias(needed))
    nsid = F.concat(values["nsidPrefix"], F.lit(".x")) if "nsidPrefix" in values else required
    return table(spark, d, "orders").select(
        F.concat(F.lit("at://lists/"), key).alias("uri"), required.alias("repo"), F.lit(kind).alias("kind"), key.alias("ord"), F.col("o_orderdate").alias("created"),
        (required if needed == "nsid" and not allowed else nsid).alias("nsid"), values.get("did", F.lit(None).cast("string")).alias("did"),
        F.to_json(F.struct(*fields)) .alias("value") if fields else F.lit("{}").alias("value"),
    )


def _list(name: str, limit: int = 20) -> None:
    _, needed, allowed = service.LISTS[name]
    own = list(zip(allowed, OWN, strict=False))
    newest = name in service.NEWEST_FIRST
    where = [f"o_orderkey % {GROUPS} = 7"] + [f"o_orderkey // {GROUPS} % {n} = 1" for _, n in own]
    order = "o_orderdate DESC, uri DESC" if newest else "o_orderkey"
    sql = f"SELECT 'at://lists/' || o_orderkey AS uri, o_orderkey AS ord FROM orders WHERE {' AND '.join(where)} ORDER BY {order} LIMIT {limit}"

    def run(spark, d):
        return service.list_records(_records(spark, d, name), name, "r7", limit, **{f: "v1" for f, _ in own}).select("uri", "ord")

    query("list_" + name.split(".list")[0] + "_" + name.split(".list")[1].lower(), sql)(run)


for _name in service.LISTS:
    if _name != "integration.listExternal":
        _list(_name)


@query("list_integration_external", f"SELECT 'at://lists/' || o_orderkey AS uri, o_orderkey AS ord FROM orders WHERE o_orderkey // {GROUPS} % 2 = 1 AND o_orderkey // {GROUPS} % 3 = 1 ORDER BY o_orderkey LIMIT 20")
def list_external(spark, d):
    return service.list_records(_records(spark, d, "integration.listExternal"), "integration.listExternal", "v1.x", 20, nsidPrefix="v1", did="v1").select("uri", "ord")


@query("get_records", "SELECT 'at://get/' || p_partkey AS uri, p_name AS value FROM part WHERE p_partkey < 26")
def get_records(spark, d):
    """A lookup in each kind's records by uri: parts, dealt to the kinds by their key."""
    p = table(spark, d, "part").select(F.concat(F.lit("at://get/"), "p_partkey").alias("uri"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int")).alias("kind"), F.col("p_name").alias("value"))
    return reduce(DataFrame.unionAll, [service.get_record(p.filter(F.col("kind") == kind), f"at://get/{k}") for k, kind in enumerate(KINDS)]).select("uri", "value")
