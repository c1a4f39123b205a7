"""Forensic queries: trace, blast radius, timeline, rollback, effective state, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.graph import reach

#: Most suspect first.
RANK = {level: i for i, level in enumerate("quarantined untrusted semi_trusted trusted system".split())}


def selects(selector: str) -> Column:
    """A write that a selector names: by record, source, source type or locator."""
    hit = F.lit(False)
    for c in ("record_id", "source_id", "source_type", "locator"):
        hit = hit | F.coalesce(F.col(c) == selector, F.lit(False))
    return (F.col("kind") == "write") & hit


def seeds(ledger: DataFrame, selector: str) -> DataFrame:
    return ledger.where(selects(selector)).select(F.col("record_id").alias("node"))


def blast_radius(ledger: DataFrame, edges: DataFrame, selector: str) -> DataFrame:
    """(node): everything that descends from the writes that ``selector`` names, and these; empty if it names none."""
    return reach(edges, seeds(ledger, selector))


def recency() -> Column:
    """Newest first when sorted upwards; times that can't be read count as the oldest."""
    return F.coalesce(-F.unix_micros(F.expr("try_to_timestamp(created_at)")), F.lit(0).cast("long"))


def suspicion() -> Column:
    rank = F.lit(1)
    for level, r in RANK.items():
        rank = F.when(F.col("trust_level") == level, r).otherwise(rank)
    return rank


def ancestors(edges: DataFrame, node: DataFrame) -> DataFrame:
    return reach(edges, node, forward=False)


def trace(ledger: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ranked root candidates of ``start`` (node): its ancestor writes by suspicion, recency and centrality, then by id.

    Centrality is the number of a write's descendants; all of them are counted in one closure with (root, node) pairs.
    """
    up = ancestors(edges, start)
    writes = ledger.where("kind = 'write'").join(up.select(F.col("node").alias("record_id")), "record_id", "left_semi")
    down = reach(edges, writes.select(F.col("record_id").alias("root"), F.col("record_id").alias("node")))
    central = down.groupBy(F.col("root").alias("record_id")).agg((F.count("*") - 1).alias("centrality"))
    rows = writes.select("record_id", "source_id", "source_type", F.coalesce("trust_level", F.lit("untrusted")).alias("trust_level"), "created_at", F.col("seq")).join(central, "record_id")
    order = Window.orderBy(suspicion(), recency(), F.desc("centrality"), "record_id")  # one action's ancestors only
    return rows.select("record_id", "source_id", "source_type", "trust_level", "created_at", "centrality", F.row_number().over(order).alias("rank"))


def first_text() -> Column:
    """The first of content, query, summary, reason that isn't empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("content", "query", "summary", "reason")], F.lit(""))


def timeline(ledger: DataFrame, topic: str) -> DataFrame:
    """(timestamp, seq, kind, record_id, text) of rows whose text has the topic, without regard to case; sort by timestamp, seq."""
    return ledger.withColumn("text", first_text()).where(F.contains(F.lower("text"), F.lit(topic.lower()))).select(F.coalesce("created_at", F.lit("")).alias("timestamp"), "seq", "kind", "record_id", "text")


def rollback_plan(ledger: DataFrame, edges: DataFrame, to: str, scope: str | None = None) -> DataFrame:
    """(node) that rolling back ``to`` affects: writes that it selects, or the record with that id, and all descendants, within the namespace ``scope``."""
    start = seeds(ledger, to).unionByName(ledger.where(F.col("record_id") == to).select(F.col("record_id").alias("node"))).distinct()
    hit = reach(edges, start)
    if scope is None:
        return hit
    return hit.join(ledger.where(F.col("namespace") == scope).select(F.col("record_id").alias("node")), "node", "left_semi")


def rolled_back_ids(ledger: DataFrame) -> DataFrame:
    return ledger.where("kind = 'rollback'").select(F.explode("affected").alias("node")).distinct()


def effective_state(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, state) of each of ``ids`` (node): rolled_back, expired where unknown, else the state on record or active."""
    known = ledger.select(F.col("record_id").alias("node"), (F.col("state") if "state" in ledger.columns else F.lit(None).cast("string")).alias("own"), F.lit(True).alias("known"))
    back = rolled_back_ids(ledger).withColumn("back", F.lit(True))
    state = F.when(F.col("back"), "rolled_back").when(F.col("known").isNull(), "expired").otherwise(F.coalesce("own", F.lit("active")))
    return ids.join(known, "node", "left").join(back, "node", "left").select("node", state.alias("state"))


def known_memory_ids(ledger: DataFrame) -> DataFrame:
    return ledger.where("kind = 'write' and memory_id <> ''").select("memory_id").distinct()


def reconcile(ledger: DataFrame, backend: DataFrame) -> DataFrame:
    """Rows of ``backend`` (line, memory_id) that no write accounts for: duplicates stay, ``line`` has their order."""
    return backend.join(known_memory_ids(ledger), "memory_id", "left_anti").select("line", "memory_id")
