"""Live detectors and ledger commits in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions import text as tx
from palimpsest.functions.records import parse_payloads
from palimpsest.operators import detectors as det
from palimpsest.store import Ledger

STATELESS = ("provenance_missing", "injection_scan", "unicode_smuggling", "secrets_pii")


def stateless_findings(writes: DataFrame) -> DataFrame:
    """Findings of the detectors that look at one write only; the batch functions run on a stream as they are."""
    out = None
    for name in STATELESS:
        found = det.REGISTRY[name](writes)
        out = found if out is None else out.unionByName(found)
    return out


def write_rate(writes: DataFrame, seconds: int = 60, most: int = 5, late: str = "10 minutes") -> DataFrame:
    """Bursts of a source in a namespace over a stream (namespace, source_id, record_id, seq, ts).

    State holds the arrivals of the last ``seconds`` before the newest, and goes when the watermark has passed them,
    so it doesn't grow with the stream. Rows later than the watermark are dropped, which batch replay doesn't do.
    """

    def step(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for record, ts in zip(rows["record_id"], rows["ts"]):
            at = ts.value // 1000
            times = [t for t in times if at - t <= seconds * 1_000_000] + [at]
            if len(times) > most:
                out.append((key[0], key[1], record, len(times)))
        state.update((times,))
        state.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["namespace", "source_id", "record_id", "writes_in_window"])

    return writes.withWatermark("ts", late).groupBy("namespace", "source_id").applyInPandasWithState(step, "namespace string, source_id string, record_id string, writes_in_window long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def trust(writes: DataFrame, penalty: float = 0.25, recovery: float = 0.1) -> DataFrame:
    """Anomalous writes of a stream with the prior and posterior of their source; state is one number a source."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        first = rows["trust_score"].iloc[0]
        p = state.get[0] if state.exists else 0.5 if pd.isna(first) else float(first)
        out = []
        for r in rows.itertuples():
            before = p
            bad = r.trust_level in ("untrusted", "quarantined") or r.locator is None
            p = p * (1 - penalty) if bad else min(1.0, p + (1 - p) * recovery)
            if bad:
                out.append((key[0], r.record_id, before, p))
        state.update((p,))
        yield pd.DataFrame(out, columns=["source_id", "record_id", "prior", "posterior"])

    return writes.groupBy("source_id").applyInPandasWithState(step, "source_id string, record_id string, prior double, posterior double", "p double", "append", GroupStateTimeout.NoTimeout)


def drift(writes: DataFrame, near: float = 0.5, contradiction: float = 0.8, embedder: tx.Embedder = tx.DEFAULT) -> DataFrame:
    """Suspect writes of a stream that depart from earlier trusted ones of their namespace.

    State holds the trusted unit vectors of a namespace, 2 kB each; it needs a store that spills, and a namespace that grows without bound should be replayed in batch.
    """
    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = np.frombuffer(state.get[0]).reshape(-1, embedder.dim) if state.exists else np.zeros((0, embedder.dim))
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            v = embedder.unit(r.content)
            if v is None:
                continue
            if r.trust_level in det.SUSPECT and len(seen):
                close = seen[seen @ v >= near]
                if len(close):
                    c = close.sum(axis=0)
                    s = float(v @ c / np.sqrt(c @ c))
                    if s < contradiction:
                        out.append((key[0], r.record_id, s))
            if r.trust_level in det.TRUSTED:
                seen = np.concatenate([seen, v[None]])
        state.update((seen.tobytes(),))
        yield pd.DataFrame(out, columns=["namespace", "record_id", "similarity"])

    return writes.groupBy("namespace").applyInPandasWithState(step, "namespace string, record_id string, similarity double", "vectors binary", "append", GroupStateTimeout.NoTimeout)


def commit(raw: DataFrame, folder: str, checkpoint: str, seed: bytes, digest: str = "blake3", *, every: int = 1, check_ids: bool | None = None, detectors: Sequence[str] = STATELESS) -> StreamingQuery:
    """Append a stream (order, record_id, kind, namespace, payload_json, created_at) to the ledger in ``folder``, micro-batch by micro-batch.

    One query commits at a time, for a chain has one end. A batch costs by its own size: the ledger's head has the last
    hash, the Merkle tree and the number of the last batch of each ``checkpoint`` folder. A batch that comes again after a
    failure is known by its number or, if its rows were written and its number wasn't, by its record ids. Ids are
    compared with the whole ledger (one column) where ``check_ids``; by default that is where a stream, with a new checkpoint folder,
    meets a ledger that has rows already and so may bring them again. A batch that passes a multiple of ``every`` rows signs a root.
    Findings of ``detectors`` (of those that look at one write only; the others have streams of their own) go to ``folder``/findings.
    """
    spark = raw.sparkSession
    ledger = Ledger(spark, folder, seed, every=every, digest=digest)
    head = ledger.head
    check = (checkpoint not in head["streams"] and head["seq"] > 0) or bool(head["streams"].get(f"{checkpoint}#ids")) if check_ids is None else check_ids

    def one(batch: DataFrame, number: int) -> None:
        last = ledger.head["streams"].get(checkpoint)
        if last is not None and number <= last:
            return
        known = ledger.rows().select("seq", "record_id")
        if check:
            ledger.head["streams"][f"{checkpoint}#ids"] = 1
        else:  # rows that a crash left without a number
            known = known.where(F.col("seq") > ledger.numbered)
        batch = batch.join(known.select("record_id"), "record_id", "left_anti").persist()
        try:
            if detectors:
                w = parse_payloads(batch).where("kind = 'write'")
                pack = None
                for name in detectors:
                    found = det.REGISTRY[name](w)
                    pack = found if pack is None else pack.unionByName(found)
                pack.write.mode("append").parquet(f"{folder}/findings")
            ledger.append_table(batch, (checkpoint, number))
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
