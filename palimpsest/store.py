"""Where a ledger lives: a folder on any Hadoop file system, its head, and appends whose cost doesn't grow with it."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Callable, Iterable
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ed25519
from palimpsest.functions.digest import DIGESTS, one_by_one
from palimpsest.functions.records import CHECKPOINT, LEDGER, stamp
from palimpsest.operators import chain
from palimpsest.shared import cut

#: How soon rows are on disk, as the names go elsewhere. FULL and EXTRA: before append returns. NORMAL and OFF: once ``flush_rows`` wait, at flush() and before anything is read.
DURABLE = {"OFF": False, "NORMAL": False, "FULL": True, "EXTRA": True}


def durable(mode: str) -> bool:
    if mode.upper() not in DURABLE:
        raise ValueError(f"{mode!r} is none of {', '.join(DURABLE)}")
    return DURABLE[mode.upper()]


class Anchor(Protocol):
    """Takes signed roots to a log outside; returns a receipt or None."""

    def publish(self, root: str, leaf_count: int) -> str | None: ...


class Files:
    """Small files under a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, str(folder).rstrip("/")
        root = self._path("")
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self._fs.getScheme() == "file" and root.toUri().getPath()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def uri(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        """A folder that only its owner may read."""
        self._fs.mkdirs(self._path(name))
        self._fs.setPermission(self._path(name), self._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """A new file, readable by its owner only from the start."""
        if self.local:
            path = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(path), mode=0o700, exist_ok=True)
            with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(data)
            return
        stream = self._jvm.org.apache.hadoop.fs.FileSystem.create(self._fs, self._path(name), self._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        """A file, or a folder with all that is in it."""
        self._fs.delete(self._path(name), True)


def parquet(rows: Iterable[tuple], schema: str) -> bytes:
    """One small Parquet file."""
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    out = io.BytesIO()
    pq.write_table(pa.table({name: pa.array(c, pa.int64() if kind == "long" else pa.string()) for (name, kind), c in zip(fields, cols)}), out, compression="snappy")
    return out.getvalue()


class Ledger:
    """Rows in ``ledger``, signed roots in ``checkpoints``, and in ``head`` what the next append needs: seq, last entry hash, the
    Merkle tree as its at most log2(rows) full subtrees, the number of checkpoints, and the last batch of each stream.

    An append reads the head and nothing else. A head is written after its rows; when a ledger is opened, rows beyond
    the head (left by a crash) are looked for once and taken in. One committer at a time, for a chain has one end.
    """

    def __init__(self, spark: SparkSession, folder: str, seed: bytes, *, every: int = 1, digest: str = "blake3", synchronous: str = "FULL", flush_rows: int = 4096, anchor: Anchor | None = None):
        self.spark, self.files, self.seed, self.every, self.digest, self.anchor = spark, Files(spark, folder), seed, every, digest, anchor
        self.flush_rows = 1 if durable(synchronous) else flush_rows
        self.receipts: list[str] = []
        self._hash: Callable[[bytes], bytes] = one_by_one(spark, digest)
        self._waiting: list[tuple] = []
        self._signed: list[tuple] = []
        self._leaves: list[str] = []
        self._head: dict[str, Any] | None = None
        self._head_file = ""
        #: Rows up to here were written together with the number of their batch.
        self.numbered = 0

    # head

    @property
    def head(self) -> dict[str, Any]:
        if self._head is None:
            self._head = self._load()
        return self._head

    def _load(self) -> dict[str, Any]:
        head: dict[str, Any] = {"seq": 0, "entry_hash": None, "peaks": [], "checkpoints": 0, "streams": {}}
        for name in reversed(self.files.names("head")):
            try:
                head = json.loads(self.files.read(f"head/{name}"))
            except ValueError:  # a crash while it was written; the one before it is still there
                continue
            self._head_file = name
            break
        self.numbered = head["seq"]
        if self.files.exists("ledger"):
            beyond = self._table("ledger", LEDGER).where(F.col("seq") > head["seq"])
            last = beyond.agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("r")).first()["r"]
            if last:
                for size, node in chain.new_nodes(beyond, self.digest):
                    self._push(head, size, node)
                head |= {"seq": last["seq"], "entry_hash": last["entry_hash"]}
                head["checkpoints"] = self._table("checkpoints", CHECKPOINT).count()
        return head

    def _push(self, head: dict[str, Any], size: int, node: bytes) -> None:
        peaks = [(n, bytes.fromhex(x)) for n, x in head["peaks"]]
        chain.push(peaks, size, node, self._hash)
        head["peaks"] = [[n, x.hex()] for n, x in peaks]

    def _save(self) -> None:
        self._settle()
        name = f"{self.head['seq']:020d}-{uuid.uuid4().hex}.json"
        self.files.write(f"head/{name}", json.dumps(self.head).encode())
        if self._head_file:
            self.files.remove(f"head/{self._head_file}")
        self._head_file = name

    def _settle(self) -> None:
        """Put the leaves that wait into the tree, all hashed at once."""
        if self._leaves:
            few = len(self._leaves) < 4
            leaves, self._leaves = [chain.leaf(x.encode()) for x in self._leaves], []
            for node in map(self._hash, leaves) if few else DIGESTS[self.digest](leaves):
                self._push(self.head, 1, node)

    # tables

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.files.uri(name)) if self.files.exists(name) else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        self.flush()
        return self._table("ledger", LEDGER)

    def checkpoints(self) -> DataFrame:
        self.flush()
        return self._table("checkpoints", CHECKPOINT)

    # appends

    def append(self, rows: list[dict[str, Any]]) -> None:
        """Link and sign rows (record_id, kind, namespace, payload_json, created_at) in their order, on the driver; a checkpoint falls after each multiple of ``every`` rows."""
        self._settle_if(len(rows))
        at = self.head["seq"], self.head["entry_hash"]
        if len(rows) < 8:
            done = chain.linked(rows, self.seed, at, self.digest, self._hash)
        else:
            done = chain.linked(rows, self.seed, at, self.digest)
        for r in done:
            self.head["seq"], self.head["entry_hash"] = r[0], r[5]
            self._waiting.append(r)
            self._leaves.append(r[5])
            if self.every > 0 and r[0] % self.every == 0:
                self.checkpoint(flush=False)
        if len(self._waiting) >= self.flush_rows:
            self.flush()

    def _settle_if(self, more: int) -> None:
        if len(self._leaves) + more > 100_000:
            self._settle()

    def append_table(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """The same for a bounded table (with ``order``), in tasks; one checkpoint at its end if one is due. Returns the number of rows."""
        self.flush()
        before = self.head["seq"]
        done = cut(chain.append(batch, self.seed, after=(before, self.head["entry_hash"]) if before else None, digest=self.digest))
        last = done.agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("r")).first()["r"]
        if last:
            done.write.mode("append").parquet(self.files.uri("ledger"))
            for size, node in chain.new_nodes(done, self.digest):
                self._push(self.head, size, node)
            self.head["seq"], self.head["entry_hash"] = last["seq"], last["entry_hash"]
            if chain.due(before, last["seq"], self.every):
                self.checkpoint(flush=False)
        if stream:
            self.head["streams"][stream[0]] = stream[1]
        self.flush()
        if last or stream:
            self._save()
            self.numbered = self.head["seq"]
        return self.head["seq"] - before

    def checkpoint(self, flush: bool = True) -> str:
        """Sign the root over all rows so far; it costs as many hashes as the tree has levels."""
        self._settle()
        root = chain.peaks_root([(n, bytes.fromhex(x)) for n, x in self.head["peaks"]], self._hash)
        self.head["checkpoints"] += 1
        name = f"{self.digest}:{root.hex()}"
        self._signed.append((self.head["checkpoints"], self.head["seq"], name, ed25519.sign(self.seed, root), chain.key_id(ed25519.public_key(self.seed)), stamp()))
        if self.anchor is not None and (receipt := self.anchor.publish(name, self.head["seq"])):
            self.receipts.append(receipt)
        if flush:
            self.flush()
        return name

    def flush(self) -> None:
        """Put on disk what waits: rows, then roots, then the head."""
        if not (self._waiting or self._signed):
            return
        if self._waiting:
            self.files.write(f"ledger/part-{self._waiting[0][0]:020d}-{uuid.uuid4().hex}.parquet", parquet(self._waiting, LEDGER))
            self._waiting = []
        if self._signed:
            self.files.write(f"checkpoints/part-{self._signed[0][0]:020d}-{uuid.uuid4().hex}.parquet", parquet(self._signed, CHECKPOINT))
            self._signed = []
        self._save()

    def taken(self, ids: list[str]) -> bool:
        """Whether one of the ids is in the ledger: one column is read, and the ids are joined with it."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "record_id string")
        return not self.rows().select("record_id").join(asked, "record_id", "left_semi").isEmpty()
