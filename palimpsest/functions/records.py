"""Records: canonical bytes, ids that sort by time, schemas and invariants."""

from __future__ import annotations

import datetime
import json
import os
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.digest import digest_udf, labelled

#: Set by the ledger, so not part of what is hashed.
LEDGER_SET = frozenset("entry_hash merkle_leaf prev_hash signature signer_kid".split())
ENUMS = {
    "source_type": ("user_input", "tool_output", "document_ingest", "rag_retrieval", "web_fetch", "file_read", "agent_self", "inter_agent", "system_seed"),
    "trust_level": ("system", "trusted", "semi_trusted", "untrusted", "quarantined"),
    "memory_type": ("working", "episodic", "semantic", "procedural", "identity"),
    "state": ("active", "quarantined", "redacted", "rolled_back", "expired"),
    "kind": ("write", "retrieval", "action", "rollback"),
    "severity": ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"),
}
LEDGER = ("seq long, record_id string, kind string, namespace string, payload_json string, entry_hash string, prev_hash string, signature string, signer_kid string, created_at string")
CHECKPOINT = ("id long, leaf_count long, root string, signature string, signer_kid string, created_at string")
FINDING = ("detector_name string, severity string, record_id string, message string, evidence map<string,string>")
SOURCE = "struct<source_id string, source_type string, locator string, trust_level string, trust_score double, first_seen string, metadata map<string,string>>"
PAYLOAD = (
    f"kind string, namespace string, record_id string, memory_id string, content string, content_hash string, memory_type string, source {SOURCE}, derived_from array<string>, caused_by_retrieval array<string>, state string, created_at string,"
    " retrieval_id string, query string, query_hash string, returned array<string>, scores array<double>, session_id string, turn_id string,"
    " action_id string, action_kind string, summary string, context_retrievals array<string>, rollback_id string, reason string, `to` string, scope string, affected array<string>, applied_at string"
)
ID_FIELD = {k: ("record" if k == "write" else k) + "_id" for k in ENUMS["kind"]}
MAX_CONTENT = 5 << 20


def _without(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _without(v) for k, v in x.items() if k not in LEDGER_SET}
    return [_without(v) for v in x] if isinstance(x, list) else x


def canonical(record: dict[str, Any]) -> str:
    """One spelling for a record: sorted keys, no spaces, no ledger-set keys at any depth, UTF-8."""
    return json.dumps(_without(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stamp() -> str:
    """Now, as rows and checkpoints have it."""
    return datetime.datetime.now(datetime.UTC).isoformat()


_lock, _last = threading.Lock(), 0


def uuid7(now_ms: int | None = None) -> str:
    """A version 7 UUID; within a process later ids are greater even if the clock stands still or goes back."""
    global _last
    with _lock:
        ms = int(time.time() * 1000) if now_ms is None else now_ms
        _last = ms if ms > _last else _last + 1
        ms = _last
    rand = int.from_bytes(os.urandom(10), "big")
    v = (ms & ((1 << 48) - 1)) << 80 | 7 << 76 | (rand >> 62 & 0xFFF) << 64 | 2 << 62 | rand & ((1 << 62) - 1)
    h = f"{v:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def write_record(content: str, source: dict[str, Any], *, namespace: str = "default", created_at: str, hashed: Callable[[bytes], bytes] | None = None, **more: Any) -> dict[str, Any]:
    """A memory write with its defaults; raises ValueError where an invariant doesn't hold. ``hashed``: BLAKE3, if the caller has a faster one."""
    if len(content.encode()) > more.pop("max_content", MAX_CONTENT):
        raise ValueError("content is larger than the limit")
    src = {"source_id": uuid7(), "locator": None, "trust_level": "untrusted", "trust_score": 0.5, "first_seen": created_at, "metadata": {}} | source
    if not 0 <= src["trust_score"] <= 1:
        raise ValueError("trust_score must lie between 0 and 1")
    for k in ("source_type", "trust_level"):
        if src[k] not in ENUMS[k]:
            raise ValueError(f"{src[k]} is no {k}")
    r = {"kind": "write", "record_id": uuid7(), "namespace": namespace, "memory_id": None, "content": content, "content_hash": "", "memory_type": "semantic", "source": src, "derived_from": [], "caused_by_retrieval": [], "state": "active", "created_at": created_at}
    if stray := set(more) - set(r):
        raise ValueError(f"unknown fields: {sorted(stray)}")
    r |= more
    mine = f"blake3:{hashed(content.encode()).hex()}" if hashed else labelled("blake3", [content.encode()])[0]
    if r["content_hash"] not in ("", mine):
        raise ValueError("content_hash does not match content")
    return r | {"content_hash": mine}


def parse(rows: DataFrame) -> DataFrame:
    """Ledger rows with the fields of their payload as columns; a payload that can't be read raises."""
    return parse_payloads(rows, ("seq", "record_id", "kind", "namespace", "created_at", "entry_hash"))


def parse_payloads(rows: DataFrame, own: tuple[str, ...] = ("record_id", "kind", "namespace", "created_at")) -> DataFrame:
    """The columns ``own`` of rows with a payload, and the payload's."""
    p = F.from_json("payload_json", PAYLOAD, {"mode": "FAILFAST"})
    s = F.col("p.source")
    return rows.withColumn("p", p).select(
        *own, s["source_id"].alias("source_id"), s["source_type"].alias("source_type"), s["locator"].alias("locator"), s["trust_level"].alias("trust_level"), s["trust_score"].alias("trust_score"),
        *[F.col(f"p.{c}").alias(c) for c in ("memory_id", "content", "content_hash", "state", "derived_from", "caused_by_retrieval", "query", "returned", "scores", "summary", "context_retrievals", "reason", "scope", "affected")], F.col("p.to").alias("to_selector"),
    )


def violations(records: DataFrame, max_content: int = MAX_CONTENT, digest: str = "blake3") -> DataFrame:
    """(record_id, rule) of writes that break an invariant: scores out of range, values outside an enum, content too large or not as hashed, ids that occur twice."""
    w = records.where("kind = 'write'")
    rules: dict[str, Column] = {
        "trust_score": ~F.coalesce(F.col("trust_score").between(0, 1), F.lit(True)),
        "source_type": ~F.coalesce(F.col("source_type").isin(*ENUMS["source_type"]), F.lit(True)),
        "trust_level": ~F.coalesce(F.col("trust_level").isin(*ENUMS["trust_level"]), F.lit(True)),
        "content_size": F.octet_length("content") > max_content,
    }
    if "content_hash" in records.columns:
        rules["content_hash"] = F.col("content_hash") != digest_udf(digest)(F.col("content"))
    broken = w.select("record_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    twice = records.groupBy("record_id").count().where("count > 1").select("record_id", F.lit("record_id").alias("rule"))
    return broken.unionByName(twice)
