"""List queries over records: required and optional filters, pages by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE, MOST = 50, 100
# List queries by kind, with the field they require and those they allow.
LISTS = {
    "alignment.listAlignments": ("alignment.alignment", "expression", ("kind",)),
    "annotation.listAnnotationLayers": ("annotation.annotationLayer", "expression", ("kind", "subkind")),
    "annotation.listClusterSets": ("annotation.clusterSet", "expression", ("kind",)),
    "changelog.listByCollection": ("changelog.entry", "collection", ()),
    "changelog.listEntries": ("changelog.entry", "subject", ()),
    "corpus.listCorpora": ("corpus.corpus", "repo", ("domain", "languages")),
    "corpus.listMemberships": ("corpus.membership", "corpusRef", ("split",)),
    "eprint.listDataLinks": ("eprint.dataLink", "eprintUri", ("dataKind",)),
    "eprint.listEprints": ("eprint.eprint", "repo", ("linkType", "eprintIdentifierType")),
    "expression.listExpressions": ("expression.expression", "repo", ("kind", "parentRef", "languages")),
    "graph.listGraphEdgeSets": ("graph.graphEdgeSet", "repo", ("edgeType", "expression")),
    "graph.listGraphEdges": ("graph.graphEdge", "repo", ("edgeType", "source", "target")),
    "graph.listGraphNodes": ("graph.graphNode", "repo", ("nodeType",)),
    "integration.listExternal": (None, "nsid", ("nsidPrefix", "did")),
    "judgment.listAgreementReports": ("judgment.agreementReport", "experimentRef", ("metric",)),
    "judgment.listExperimentDefs": ("judgment.experimentDef", "repo", ("measureType", "taskType")),
    "judgment.listJudgmentSets": ("judgment.judgmentSet", "experimentRef", ()),
    "media.listMedia": ("media.media", "repo", ("kind",)),
    "ontology.listOntologies": ("ontology.ontology", "repo", ("domain",)),
    "ontology.listTypeDefs": ("ontology.typeDef", "ontologyRef", ("typeKind",)),
    "persona.listPersonas": ("persona.persona", "repo", ("domain", "kind")),
    "resource.listCollections": ("resource.collection", "repo", ("kind", "languages")),
    "resource.listEntries": ("resource.entry", "repo", ("languages",)),
    "resource.listTemplates": ("resource.template", "repo", ("languages",)),
    "resource.listCollectionMemberships": ("resource.collectionMembership", "collectionRef", ()),
    "resource.listFillings": ("resource.filling", "templateRef", ("strategy",)),
    "resource.listTemplateCompositions": ("resource.templateComposition", "repo", ("compositionType",)),
    "segmentation.listSegmentations": ("segmentation.segmentation", "expression", ()),
}
NEWEST_FIRST = ("changelog.listByCollection", "changelog.listEntries")


def page(rows: DataFrame, order: list[str], limit: int = PAGE, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """A page of rows behind a key (the last row's ``order`` values of the page before).

    The key is a filter, which reaches the scan, and the page a top-k, which no
    shuffle precedes.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    if after is not None:
        here, there = F.struct(*order), F.struct(*[F.lit(v).cast(rows.schema[o].dataType).alias(o) for o, v in zip(order, after, strict=True)])
        rows = rows.filter(here < there if descending else here > there)
    return rows.orderBy(*[F.desc(o) if descending else F.asc(o) for o in order]).limit(limit)


def list_records(records: DataFrame, query: str, required: str, limit: int = PAGE, after: tuple | None = None, **optional: str) -> DataFrame:
    """A page of a list query; ``records`` has ``uri, repo, kind, ord, value`` (JSON) and, for newest-first lists, ``created``."""
    kind, needed, allowed = LISTS[query]
    if unknown := set(optional) - set(allowed):
        raise ValueError(f"{query} has no filter {', '.join(sorted(unknown))}")

    def has(field, value):
        if field in ("repo", "nsid", "did") and field in records.columns:
            return F.col(field) == value
        if field == "nsidPrefix":
            return F.startswith("nsid", F.lit(value))
        text = F.get_json_object("value", f"$.{field}")
        if field == "languages":
            return F.array_contains(F.from_json(text, "array<string>"), value)
        return text == value

    rows = records if kind is None else records.filter(F.col("kind") == kind)
    rows = rows.filter(has(needed, required))
    for field, value in optional.items():
        rows = rows.filter(has(field, value))
    newest = query in NEWEST_FIRST
    return page(rows, ["created", "uri"] if newest else ["ord"], limit, after, newest)


def get_record(records: DataFrame, uri: str) -> DataFrame:
    return records.filter(F.col("uri") == uri)
