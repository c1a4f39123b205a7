"""The lineage graph: edges from ledger rows, induced subgraphs, and reachability in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.shared import cut

#: Array column of a ledger row -> type of the edges from its members to the row.
LINKS = {"derived_from": "DERIVED_FROM", "caused_by_retrieval": "CONTEXTUALIZED", "returned": "RETRIEVED", "context_retrievals": "CONTRIBUTED_TO", "affected": "ROLLED_BACK_BY"}
#: No row makes INFLUENCED edges; they are added explicitly.
EDGE_TYPES = (*LINKS.values(), "INFLUENCED")


class UnknownNode(ValueError):
    """An edge names a record that the ledger doesn't have."""


def claimed_edges(ledger: DataFrame) -> DataFrame:
    """(src, dst, edge_type, dst_seq) as rows claim them, whether or not both ends exist. One scan: the arrays of a row are exploded together."""
    def typed(column: str, kind: str) -> Column:
        ids = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(ids, lambda x: F.struct(x.alias("src"), F.lit(kind).alias("edge_type")))

    pairs = F.flatten(F.array(*[typed(c, t) for c, t in LINKS.items() if c in ledger.columns]))
    return ledger.select(F.col("record_id").alias("dst"), F.col("seq").alias("dst_seq"), F.explode(pairs).alias("e")).select("e.src", "dst", "e.edge_type", "dst_seq")


def derive_edges(ledger: DataFrame) -> DataFrame:
    """Edges (src, dst, edge_type) whose source was in the ledger before the row that names it; others are skipped."""
    known = ledger.select(F.col("record_id").alias("src"), F.col("seq").alias("src_seq"))
    return claimed_edges(ledger).join(known, "src").where("src_seq < dst_seq").select("src", "dst", "edge_type").distinct()


def dangling_edges(ledger: DataFrame) -> DataFrame:
    """Claimed edges with a source that the ledger doesn't have."""
    return claimed_edges(ledger).join(ledger.select(F.col("record_id").alias("src")), "src", "left_anti").select("src", "dst", "edge_type")


def add_edges(edges: DataFrame, new: DataFrame, ledger: DataFrame) -> DataFrame:
    """Edges with ``new`` ones: both ends must be in the ledger (else UnknownNode); an edge that is there already stays as it is."""
    nodes = ledger.select(F.col("record_id").alias("node"))
    ends = new.select(F.explode(F.array("src", "dst")).alias("node"))
    stray = ends.join(nodes, "node", "left_anti").first()
    if stray is not None:
        raise UnknownNode(stray["node"])
    return edges.unionByName(new.dropDuplicates(["src", "dst", "edge_type"]).join(edges, ["src", "dst", "edge_type"], "left_anti").select(*edges.columns))


def neighbours(edges: DataFrame, nodes: DataFrame, *, out: bool = True, types: Sequence[str] | None = None) -> DataFrame:
    """Edges out of (or into) ``nodes`` (node), of the given types."""
    e = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    return e.join(nodes.select(F.col("node").alias("src" if out else "dst")), "src" if out else "dst", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def reach(edges: DataFrame, seeds: DataFrame, *, forward: bool = True, include_seeds: bool | None = None, types: Sequence[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Nodes that can be reached from ``seeds``: (node), or (root, node) if seeds have both, all roots at once.

    Forward closures hold their seeds, backward ones don't (not even in a cycle). Each round joins only the newest
    nodes with the edges and drops those seen before, so cycles end and every edge is followed once a root. The
    rounds' results are kept in the shared folder, which cuts the lineage and survives lost executors.
    """
    include_seeds = forward if include_seeds is None else include_seeds
    keys = [c for c in ("root", "node") if c in seeds.columns]
    here, there = ("src", "dst") if forward else ("dst", "src")
    e = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    steps = cut(e.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct())
    start = cut(seeds.select(*keys).distinct())
    seen = newest = start
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        stepped = newest.join(steps, "node").select(*keys[:-1], F.col("next").alias("node")).distinct()
        newest = cut(stepped.join(seen, keys, "left_anti"))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen if include_seeds else seen.join(start, keys, "left_anti")
