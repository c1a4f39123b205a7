"""A ledger in a folder, with its key, and what agents and investigators do with it."""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions import ed25519, keys
from palimpsest.functions.digest import labelled, one_by_one
from palimpsest.functions.records import ID_FIELD, MAX_CONTENT, canonical, parse, stamp, uuid7, write_record
from palimpsest.operators import chain, graph
from palimpsest.operators.detectors import DEFAULT_PACK, run_pack
from palimpsest.operators.monitor import Finding, Inspector, Monitor
from palimpsest.plans import forensics as fx
from palimpsest.shared import ship
from palimpsest.store import Anchor, Files, Ledger, durable

#: Names the environment variable with the folder of the profile to use where none is given.
ENV_HOME = "PALIMPSEST_HOME"


def home(folder: str | None = None) -> str:
    """The folder given, else the environment's, else the default."""
    return folder or os.environ.get(ENV_HOME) or ".palimpsest"


def now() -> str:
    return f"{datetime.datetime.now(datetime.UTC).replace(tzinfo=None).isoformat()}Z"


class Profile:
    """Ledger and checkpoints under ``folder``, on any file system that Spark can write to; edges are derived from the ledger, so they can't disagree with it.

    Rows are appended by one committer at a time; a chain has one end. A checkpoint is signed after each multiple of
    ``every`` rows. ``synchronous`` OFF or NORMAL lets rows wait in memory until many are written at once, FULL and EXTRA
    write each append (see ``store.DURABLE``). ``detectors`` names those that look at every write before it is appended, ``own``
    adds some; what they find is kept in ``captured``, also if the append then fails.
    """

    def __init__(self, spark: SparkSession, folder: str, *, every: int = 1, digest: str = "blake3", max_content: int = MAX_CONTENT, synchronous: str = "FULL", detectors: Iterable[str] = DEFAULT_PACK, own: dict[str, Inspector] | None = None, key: bytes | None = None, anchor: Anchor | None = None):
        ship(spark)
        durable(synchronous)
        self.spark, self.folder, self.digest, self.max_content = spark, str(folder), digest, max_content
        self._files, self._key, self._ledger = Files(spark, self.folder), key, None
        self._options = {"every": every, "digest": digest, "synchronous": synchronous, "anchor": anchor}
        self._blake3 = one_by_one(spark)
        self.monitor, self.captured = Monitor(detectors, own), []  # type: Monitor, list[Finding]

    @classmethod
    def create(cls, spark: SparkSession, folder: str, **options: Any) -> Profile:
        """A profile in a folder that only its owner can read, with a new key unless there is one or ``key`` brings one."""
        p = cls(spark, folder, **options)
        p._files.make()
        if p._key is None and not p.exists:
            p._files.write("signing.key", keys.dump(keys.generate()))
        return p

    @property
    def exists(self) -> bool:
        return self._files.exists("signing.key") or self._files.exists("ledger")

    @property
    def _seed(self) -> bytes:
        if self._key is None:
            self._key = keys.load(self._files.read("signing.key")) if self._files.exists("signing.key") else keys.from_env()
        return self._key

    @property
    def ledger(self) -> Ledger:
        if self._ledger is None:
            self._ledger = Ledger(self.spark, self.folder, self._seed, **self._options)
        return self._ledger

    @property
    def public_key(self) -> bytes:
        return ed25519.public_key(self._seed)

    def rows(self) -> DataFrame:
        return self.ledger.rows()

    def checkpoints(self) -> DataFrame:
        return self.ledger.checkpoints()

    def flush(self) -> None:
        self.ledger.flush()

    def records(self) -> DataFrame:
        return parse(self.rows())

    def edges(self) -> DataFrame:
        return graph.derive_edges(self.records())

    def append(self, records: Iterable[dict[str, Any]], *, minted: bool = False) -> list[str]:
        """Inspect, link, sign and store records in their order; returns their ids. Ids that weren't ``minted`` just now are looked up in the ledger first."""
        records = list(records)
        if not records:
            return []
        ids = [r[ID_FIELD[r["kind"]]] for r in records]
        if len(set(ids)) < len(ids) or (not minted and self.ledger.taken(ids)):
            raise ValueError("a record with this id is in the ledger already")
        at, seconds = stamp(), time.time()
        for r in records:
            if r["kind"] == "write":
                self.captured += self.monitor.inspect(r, seconds)
        self.ledger.append([{"record_id": i, "kind": r["kind"], "namespace": r["namespace"], "payload_json": canonical(r), "created_at": at} for i, r in zip(ids, records)])
        return ids

    def append_table(self, batch: DataFrame) -> int:
        """A bounded table (order, record_id, kind, namespace, payload_json, created_at) with new ids, linked and signed in tasks; ``findings`` covers it. Returns the number of rows."""
        return self.ledger.append_table(batch)

    def checkpoint(self) -> str:
        return self.ledger.checkpoint()

    def write(self, content: str, source: dict[str, Any], **more: Any) -> str:
        minted = "record_id" not in more
        return self.append([write_record(content, source, created_at=more.pop("created_at", now()), max_content=self.max_content, hashed=self._blake3, **more)], minted=minted)[0]

    def retrieval(self, query: str, returned: list[str], scores: list[float] | None = None, *, namespace: str = "default", session_id: str | None = None, turn_id: str | None = None) -> str:
        return self.append([{"kind": "retrieval", "retrieval_id": uuid7(), "namespace": namespace, "query": query, "query_hash": labelled("blake3", [query.encode()])[0], "returned": list(returned), "scores": list(scores or []), "session_id": session_id, "turn_id": turn_id, "created_at": now()}], minted=True)[0]

    def action(self, kind: str, summary: str, context_retrievals: list[str], *, namespace: str = "default", session_id: str | None = None, turn_id: str | None = None) -> str:
        return self.append([{"kind": "action", "action_id": uuid7(), "namespace": namespace, "action_kind": kind, "summary": summary, "context_retrievals": list(context_retrievals), "session_id": session_id, "turn_id": turn_id, "created_at": now()}], minted=True)[0]

    def rollback(self, to: str, *, scope: str | None = None, dry_run: bool = True, reason: str = "") -> tuple[list[str], str | None]:
        """(affected ids in order, rollback id). Applying appends an event, also for no records; nothing is deleted."""
        r = self.records()
        affected = sorted(x["node"] for x in fx.rollback_plan(r, graph.derive_edges(r), to, scope).collect())
        if dry_run:
            return affected, None
        event = {"kind": "rollback", "rollback_id": uuid7(), "namespace": scope or "default", "reason": reason, "to": to, "scope": scope, "affected": affected, "applied_at": now()}
        return affected, self.append([event], minted=True)[0]

    def verify(self, public_key: bytes | None = None) -> DataFrame:
        return chain.verify(self.rows(), self.checkpoints(), public_key or self.public_key, self.digest)

    def findings(self, names: Iterable[str] = DEFAULT_PACK) -> DataFrame:
        """Recomputed from the ledger, so a new session finds what the old one did."""
        return run_pack(self.records(), names)
