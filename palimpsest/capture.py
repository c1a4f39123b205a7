"""From calls to a ledger: mapped calls become records of one table, which is linked and signed as one batch; and front ends that log live calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.digest import labelled
from palimpsest.functions.records import MAX_CONTENT, canonical, stamp, uuid7, write_record
from palimpsest.profile import Profile, now
from palimpsest.sources import calls

#: Columns of a mapped table that say more of a write than the source given for all.
_OF_SOURCE = ("source_id", "source_type", "locator", "trust_level", "trust_score")
_BATCH = "order long, record_id string, kind string, namespace string, payload_json string, created_at string"


def payloads(mapped: DataFrame, source: dict[str, Any], *, namespace: str = "default", order: str = "call_id", max_content: int = MAX_CONTENT) -> DataFrame:
    """Ledger rows to be (as ``Profile.append_table`` takes them) of mapped calls or files, in order of ``order``.

    Writes take their source from ``source`` and from columns of those names, where a row has a value. Rows without a
    record_id get one. A row that breaks an invariant raises, as it would if it were captured alone.
    """
    given, created, columns = {"source_type": "agent_self"} | source, now(), mapped.columns
    at = stamp()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                own = {"record_id": r.get("record_id") or uuid7()}
                if r["kind"] == "write":
                    more = {k: r[k] for k in ("memory_id", "memory_type") if r.get(k) is not None}
                    record = write_record(r["content"] or "", given | {k: r[k] for k in _OF_SOURCE if r.get(k) is not None}, namespace=namespace, created_at=created, max_content=max_content, **more, **own)
                else:
                    query = r["query"] or ""
                    record = {"kind": "retrieval", "retrieval_id": own["record_id"], "namespace": namespace, "query": query, "query_hash": labelled("blake3", [query.encode()])[0], "returned": r["returned"] or [], "scores": r["scores"] or [], "session_id": None, "turn_id": None, "created_at": created}
                out.append((r[order], own["record_id"], r["kind"], namespace, canonical(record), at))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["order", "record_id", "kind", "namespace", "payload_json", "created_at"])

    keep = [c for c in (order, "record_id", "kind", "content", "memory_id", "memory_type", "query", "returned", "scores", *_OF_SOURCE) if c in columns]
    return mapped.select(F.col(order).cast("long").alias(order), *[F.col(c) for c in keep if c != order]).mapInArrow(run, _BATCH)


def files_changed(profile: Profile, root: str, snapshot: DataFrame | None = None, namespace: str = "default") -> tuple[int, DataFrame]:
    """Append a write for each watched file under ``root`` that is new or changed; (how many, new snapshot)."""
    records, snap = calls.scan_files(profile.spark, root, snapshot, profile.max_content)
    rows = records.withColumn("call_id", F.xxhash64("locator")).withColumn("source_id", F.col("locator")).withColumn("memory_id", F.col("locator"))
    return profile.append_table(payloads(rows, {"source_type": "file_read"}, namespace=namespace, max_content=profile.max_content)), snap


class Recorder:
    """Logs live calls and appends them ``batch`` at a time. Calls go through first: one that raises leaves no record, results
    are handed on as they are, and methods that the adapter doesn't map are left alone."""

    def __init__(self, profile: Profile, adapter: calls.Adapter, source: dict[str, Any], *, namespace: str = "default", batch: int = 1000):
        self.profile, self.adapter, self.source, self.namespace, self.batch = profile, adapter, source, namespace, batch
        self._log: list[tuple] = []
        self._count = 0

    def log(self, method: str, args: tuple, kwargs: dict[str, Any], result: Any) -> None:
        if method in self.adapter.writes or method in self.adapter.reads:
            text = lambda x: json.dumps(x, default=str, ensure_ascii=False)
            self._log.append((self._count, method, text(list(args)), text(kwargs), text(result), False))
            self._count += 1
            if len(self._log) >= self.batch:
                self.flush()

    def call(self, method: str, forward: Callable[..., Any], *args: Any, **kwargs: Any) -> Any:
        result = forward(*args, **kwargs)
        self.log(method, args, kwargs, result)
        return result

    def call_tool(self, forward: Callable[[str, dict[str, Any]], Any], tool: str, arguments: dict[str, Any]) -> Any:
        """A tool call of a gateway: the tool's name is the method."""
        result = forward(tool, arguments)
        self.log(tool, (), arguments, result)
        return result

    def wrap(self, client: Any) -> Any:
        """The client, with its mapped methods logged."""
        recorder = self

        class Wrapped:
            def __getattr__(self, name: str) -> Any:
                found = getattr(client, name)
                if name not in recorder.adapter.writes and name not in recorder.adapter.reads:
                    return found
                return lambda *args, **kwargs: recorder.call(name, found, *args, **kwargs)

        return Wrapped()

    def flush(self) -> int:
        """Append what was logged; returns the number of records."""
        waiting, self._log = self._log, []
        if not waiting:
            return 0
        log = self.profile.spark.createDataFrame(waiting, "call_id long, method string, args string, kwargs string, result string, failed boolean")
        return self.profile.append_table(payloads(calls.mapped(log, self.adapter), self.source, namespace=self.namespace, max_content=self.profile.max_content))


class Sidecar:
    """Stands before a vector store: an upsert is recorded before it is forwarded, with the record's id added to its payload, a query after."""

    def __init__(self, profile: Profile, forward: Callable[[str, dict[str, Any]], Any], source: dict[str, Any], *, content: Callable[[dict[str, Any]], str], query: Callable[[dict[str, Any]], str], returned: Callable[[Any], list[str]], namespace: str = "default"):
        self.profile, self.forward, self.source, self.content, self.query, self.returned, self.namespace = profile, forward, source, content, query, returned, namespace

    def handle(self, op: str, payload: dict[str, Any]) -> Any:
        if op == "upsert":
            record = self.profile.write(self.content(payload), self.source, namespace=self.namespace)
            return self.forward(op, {**payload, calls.TAG: record})
        result = self.forward(op, payload)
        if op == "query":
            self.profile.retrieval(self.query(payload), self.returned(result), namespace=self.namespace)
        return result
