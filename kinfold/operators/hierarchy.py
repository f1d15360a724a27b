"""Ownership hierarchies over a relationship table: one hop, reachability, and a bounded tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .relational import cut_lineage

# Labels of relationship types seen from below and from above, and of reporting exceptions.
LABELS = {
    "IS_DIRECTLY_CONSOLIDATED_BY": ("Direct parent", "Subsidiaries (direct)"),
    "IS_ULTIMATELY_CONSOLIDATED_BY": ("Ultimate parent", "Subsidiaries (ultimate)"),
    "IS_FUND-MANAGED_BY": ("Managed by", "Funds managed"),
    "IS_SUBFUND_OF": ("Umbrella / parent fund", "Sub-funds"),
    "IS_FEEDER_TO": ("Feeds into (master fund)", "Feeder funds"),
    "IS_INTERNATIONAL_BRANCH_OF": ("Head office", "Branches"),
}
EXCEPTION_LABELS = {"DIRECT_ACCOUNTING_CONSOLIDATION_PARENT": "Direct parent", "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT": "Ultimate parent"}
EXCEPTION_REASONS = {
    "NATURAL_PERSONS": "parent is a natural person, not a legal entity",
    "NON_CONSOLIDATING": "entity does not prepare consolidated accounts",
    "NO_KNOWN_PERSON": "no known parent",
    "NO_LEI": "parent has no LEI",
    "NON_PUBLIC": "parent information is non-public",
}
#: The relationship type whose active presence makes an exception of a category moot.
COVERED_BY = {"DIRECT_ACCOUNTING_CONSOLIDATION_PARENT": "IS_DIRECTLY_CONSOLIDATED_BY", "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT": "IS_ULTIMATELY_CONSOLIDATED_BY"}


def _mapped(column: str, values: dict[str, str]):
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))


def neighbours(relationships: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(lei, direction, other, relationship_type, relationship_status, label, other_name), once from each end; inactive ones left out."""
    live = relationships.where("relationship_status IS DISTINCT FROM 'INACTIVE'")
    columns = ["relationship_type", "relationship_status"]
    up = live.select(F.col("start_node_id").alias("lei"), F.lit("up").alias("direction"), F.col("end_node_id").alias("other"), *columns, _mapped("relationship_type", {k: v[0] for k, v in LABELS.items()}).alias("label"))
    down = live.where("start_node_id <> end_node_id").select(F.col("end_node_id").alias("lei"), F.lit("down").alias("direction"), F.col("start_node_id").alias("other"), *columns, _mapped("relationship_type", {k: v[1] for k, v in LABELS.items()}).alias("label"))
    both = up.unionByName(down)
    if entities is None:
        return both
    return both.join(entities.select(F.col("entity_id").alias("other"), F.col("canonical_name").alias("other_name")), "other", "left")


def open_exceptions(exceptions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Reporting exceptions that no active parent relationship answers, with label and reason_text."""
    given = exceptions.withColumn("_covering", F.coalesce(*[F.when(F.col("exception_category") == c, F.lit(t)) for c, t in COVERED_BY.items()]))
    live = relationships.where("relationship_status IS DISTINCT FROM 'INACTIVE'").select(F.col("start_node_id").alias("lei"), F.col("relationship_type").alias("_covering")).distinct()
    left = given.join(live, ["lei", "_covering"], "left_anti").drop("_covering")
    return left.withColumns({"label": _mapped("exception_category", EXCEPTION_LABELS), "reason_text": _mapped("exception_reason", EXCEPTION_REASONS)})


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, hops): nodes within depth hops along edges (a to b), at their least distance; cycles end.

    Each hop is one join and one aggregation; what was reached before is not followed again. Fronts are written, so a
    hop does not repeat those before it.
    """
    steps = edges.select("a", "b").distinct()
    front = roots.select(F.col("node").alias("root"), F.col("node"), F.lit(0).alias("hops"))
    seen = front
    for hop in range(1, depth + 1):
        front = front.join(steps, F.col("node") == F.col("a")).select("root", F.col("b").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = cut_lineage(front.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "hops"))
        seen = seen.unionByName(front)
    return seen


@dataclass
class Node:
    lei: str
    name: str | None = None
    relationship_type: str | None = None
    label: str | None = None
    status: str | None = None
    expanded: bool = False
    exceptions: list[dict[str, str | None]] = field(default_factory=list)
    up: list[Node] = field(default_factory=list)
    down: list[Node] = field(default_factory=list)


def hierarchy_tree(
    relationships: DataFrame, entities: DataFrame, lei: str, depth: int = 1, direction: str = "all", extra_parent_depth: int = 0, max_nodes: int = 200, exceptions: DataFrame | None = None
) -> Node:
    """The tree around one entity, depth first, parents before children; each entity is expanded once, max_nodes at most.

    A step up uses up a level of parents and leaves the levels of children as they are, and the other way round, so a
    parent's other children are listed too. Expanded nodes carry their open reporting exceptions, if the table is
    given. Spark looks up what the walk comes to, an entity together with those that may follow it, so all lookups
    together take max_nodes entities at most.
    """
    if direction not in ("parents", "children", "all"):
        raise ValueError(f"direction is parents, children or all, not {direction}")
    links = neighbours(relationships, entities)
    named = entities.where(F.col("entity_id") == lei).select("canonical_name").first()
    silent = open_exceptions(exceptions, relationships) if exceptions is not None else None
    around: dict[str, list[Row]] = {}
    reported: dict[str, list[dict[str, str | None]]] = {}

    def fetch(wanted: Sequence[str]) -> None:
        fresh = [w for w in dict.fromkeys(wanted) if w not in around]
        if not fresh:
            return
        around.update({w: [] for w in fresh})
        for r in links.where(F.col("lei").isin(fresh)).orderBy("lei", "relationship_type", "other").collect():
            around[r["lei"]].append(r)
        if silent is not None:
            for r in silent.where(F.col("lei").isin(fresh)).orderBy("lei", "exception_category", "exception_reason").collect():
                reported.setdefault(r["lei"], []).append({"label": r["label"], "reason": r["reason_text"]})

    visited: set[str] = set()

    def expand(node: Node, up: int, down: int) -> None:
        visited.add(node.lei)
        fetch([node.lei])
        node.expanded, node.exceptions = True, reported.get(node.lei, [])
        steps = [(node.up, r, up - 1, down, up > 1) for r in around[node.lei] if r["direction"] == "up" and direction != "children"]
        steps += [(node.down, r, up, down - 1, down > 1) for r in around[node.lei] if r["direction"] == "down" and direction != "parents"]
        # looked up together: those that will be expanded, as far as the budget goes whatever lies below them
        fetch([r["other"] for _, r, _, _, more in steps if more and r["other"] not in visited][: max(0, max_nodes - len(around))])
        for side, r, above, below, more in steps:
            child = Node(r["other"], r["other_name"], r["relationship_type"], r["label"], r["relationship_status"])
            side.append(child)
            if more and len(visited) < max_nodes and child.lei not in visited:
                expand(child, above, below)

    root = Node(lei, named["canonical_name"] if named else None)
    expand(root, depth + extra_parent_depth, depth)
    return root
