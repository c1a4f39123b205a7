"""Questions by likeness: drift from a trusted consensus, and retrieval of like writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators.detectors import SUSPECT, TRUSTED
from palimpsest.plans.forensics import rolled_back_ids


def likeness(rows: DataFrame, topic: str, embedder: tx.Embedder = tx.DEFAULT) -> DataFrame:
    """``rows`` with cells and cosine with ``topic``, of those that have a bucket in common with it.

    The topic's vector, one number a bucket, is a constant of the plan, and each row's dot product is worked out within
    the row: nothing is joined or shuffled. Counts are summed as integers; the division comes last.
    """
    want = embedder.cells_of(topic)
    rows = rows.withColumn("cells", tx.cells(F.col("content"), embedder))
    if not want:
        return rows.withColumn("cosine", F.lit(0.0)).where(F.lit(False))
    weights = F.array(*[F.lit(want.get(i, 0)).cast(embedder.kind) for i in range(embedder.dim)])
    dot = F.aggregate("cells", F.lit(0).cast(embedder.kind), lambda a, x: a + x["n"] * F.get(weights, x["bucket"].cast("int")))
    size = sum(n * n for n in want.values()) ** 0.5
    return rows.withColumn("dot", dot).where("dot > 0").withColumn("cosine", F.col("dot") / (tx.norm(F.col("cells"), embedder) * F.lit(size))).drop("dot")


def drift_events(ledger: DataFrame, topic: str, near: float = 0.5, contradiction: float = 0.8, embedder: tx.Embedder = tx.DEFAULT) -> DataFrame:
    """(timestamp, seq, record_id, source_id, trust_level, similarity): suspect writes on the topic that depart from the centroid of the trusted ones.

    Without trusted writes on the topic there is no consensus and no event. The centroid is a sum by bucket over the
    trusted members, one row a bucket; as one row it is broadcast, and each suspect is judged within its row.
    """
    w = ledger.where("kind = 'write'").select("seq", "record_id", "source_id", "content", "created_at", F.coalesce("trust_level", F.lit("untrusted")).alias("trust_level"))
    cluster = likeness(w, topic, embedder).where(F.col("cosine") >= near).withColumn("size", tx.norm(F.col("cells"), embedder))
    members = cluster.where(F.col("trust_level").isin(*TRUSTED)).select("size", F.explode("cells").alias("c")).select("c.bucket", (F.col("c.n") / F.col("size")).alias("x"))
    mean = members.groupBy("bucket").agg(F.sum("x").alias("x"))
    centre = mean.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("centre"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("span"))
    own = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(F.try_element_at("centre", x["bucket"]), F.lit(0.0)))
    suspects = cluster.where(F.col("trust_level").isin(*SUSPECT)).crossJoin(F.broadcast(centre)).where("span > 0")  # one row
    got = suspects.withColumn("similarity", own / (F.col("size") * F.col("span"))).where(F.col("similarity") < contradiction)
    return got.select(F.coalesce("created_at", F.lit("")).alias("timestamp"), "seq", "record_id", "source_id", "trust_level", tx.rounded(F.col("similarity"), 4).alias("similarity"))


def retrieve(ledger: DataFrame, query: str, least: float = 0.3, respect_rollback: bool = False, embedder: tx.Embedder = tx.DEFAULT) -> DataFrame:
    """(seq, record_id, cosine) of writes like ``query``; sort by seq. Writes that were rolled back can be left out."""
    w = ledger.where("kind = 'write'")
    got = likeness(w.select("seq", "record_id", "content"), query, embedder).where(F.col("cosine") >= least).select("seq", "record_id", "cosine")
    if respect_rollback:
        got = got.join(rolled_back_ids(ledger).select(F.col("node").alias("record_id")), "record_id", "left_anti")
    return got
