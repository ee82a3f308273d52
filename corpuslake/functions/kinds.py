"""Record kinds: fixed tables by the last two segments of a collection name.

Without a namespace those two segments decide, whatever stands before them; with one
(the authority part that all record kinds share) collections of other namespaces have no kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The record kinds, in display order.
KINDS = (
    "corpus.corpus", "corpus.membership", "expression.expression", "segmentation.segmentation", "annotation.annotationLayer", "annotation.clusterSet",
    "alignment.alignment", "ontology.ontology", "ontology.typeDef", "resource.collection", "resource.collectionMembership", "resource.entry",
    "resource.template", "resource.templateComposition", "resource.filling", "judgment.experimentDef", "judgment.judgmentSet", "judgment.agreementReport",
    "graph.graphNode", "graph.graphEdge", "graph.graphEdgeSet", "media.media", "persona.persona", "eprint.eprint", "eprint.dataLink", "changelog.entry",
)
# Write order of kinds that is not 3; a kind refers to kinds of lower tiers.
TIERS = {
    0: ("ontology.ontology", "ontology.typeDef", "persona.persona", "eprint.eprint", "eprint.dataLink", "media.media"),
    1: ("expression.expression",),
    2: ("segmentation.segmentation",),
    4: (
        "annotation.clusterSet", "graph.graphEdge", "corpus.membership", "resource.entry", "resource.filling", "resource.collectionMembership",
        "resource.templateComposition", "judgment.experimentDef", "judgment.judgmentSet", "changelog.entry",
    ),
    5: ("graph.graphEdgeSet", "judgment.agreementReport"),
}
# Changelog section by namespace; others are "other".
SECTIONS = {
    "annotation": "annotations", "segmentation": "segmentation", "expression": "text", "ontology": "ontology", "persona": "ontology", "corpus": "corpus",
    "alignment": "alignment", "graph": "graph", "judgment": "experiment", "resource": "resource", "media": "media", "eprint": "provenance",
}
# Kinds that make a repository look like a dataset.
DATASET_KINDS = (
    "corpus.corpus", "corpus.membership", "expression.expression", "annotation.annotationLayer", "segmentation.segmentation", "media.media", "eprint.eprint",
    "eprint.dataLink", "ontology.ontology",
)
# Names of fields whose change breaks a record's identity.
IDENTITY_FIELDS = ("id", "localId", "local_id", "rkey", "uuid", "tokenizationId")


def kind_of(nsid: Column | str, namespace: str | None = None) -> Column:
    """The last two segments of a collection name; with a ``namespace``, null for names of other ones."""
    name = F.col(nsid) if isinstance(nsid, str) else nsid
    if namespace is not None:
        own = F.when(F.startswith(name, F.lit(f"{namespace}.")), F.substring(name, len(namespace) + 2, 1 << 20))
        return F.when(F.size(F.split(own, r"\.")) == 2, own)
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def _lookup(key: Column, table: dict, default) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def tier_of(nsid: Column | str, namespace: str | None = None) -> Column:
    return _lookup(kind_of(nsid, namespace), {k: t for t, kinds in TIERS.items() for k in kinds}, 3)


def section_of(nsid: Column | str, namespace: str | None = None) -> Column:
    return _lookup(F.split(kind_of(nsid, namespace), r"\.")[0], SECTIONS, "other")


def display_rank(nsid: Column | str, namespace: str | None = None) -> Column:
    return _lookup(kind_of(nsid, namespace), {k: n for n, k in enumerate(KINDS)}, len(KINDS))
