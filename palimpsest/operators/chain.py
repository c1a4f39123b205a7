"""The hash chain and its Merkle checkpoints: appending, and verification that runs in parallel."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import ed25519
from palimpsest.functions.digest import DIGESTS, blake3_finish, blake3_heads, blake3_resume, blake3_states
from palimpsest.functions.keys import key_id
from palimpsest.functions.records import CHECKPOINT, LEDGER
from palimpsest.shared import cut, ensure_checkpoint_dir, spread

BLOCK = 4096
_REPORT = "ok boolean, rows_checked long, seq long, record_id string, kind string, detail string"
_DETAIL = {
    "edit": "recomputed entry_hash does not match stored entry_hash",
    "gap": "prev_hash is not the entry_hash of the row before it: a row was removed or moved",
    "forgery": "signature does not verify against the trusted key",
}


def link_text(payload: str, prev_hash: str | None) -> bytes:
    """What a row's entry hash covers: its payload and the entry hash before it."""
    return (payload + (prev_hash or "")).encode()


def linked(rows: list[dict[str, Any]], seed: bytes, after: tuple[int, str | None], digest: str = "blake3", hashed: Callable[[bytes], bytes] | None = None) -> list[tuple]:
    """Ledger rows (as in LEDGER) for ``rows``, linked after (seq, entry_hash) in their order; ``hashed``, the digest of one message, is quicker for few rows."""
    kid, (seq, prev) = key_id(ed25519.public_key(seed)), after
    payloads = [r["payload_json"].encode() for r in rows]
    # What of a hash doesn't depend on the row before is worked out for all rows at once.
    heads = blake3_heads(payloads) if digest == "blake3" and hashed is None else []
    out = []
    for i, r in enumerate(rows):
        if hashed is not None:
            raw = hashed(link_text(r["payload_json"], prev))
        elif heads and prev:
            raw = blake3_finish(heads[i], payloads[i][1024 * len(heads[i]) :] + prev.encode())
        else:
            raw = DIGESTS[digest]([link_text(r["payload_json"], prev)])[0]
        seq += 1
        entry = f"{digest}:{raw.hex()}"
        out.append((seq, r["record_id"], r["kind"], r["namespace"], r["payload_json"], entry, prev, ed25519.sign(seed, raw), kid, r["created_at"]))
        prev = entry
    return out


#: Payload bytes that one task links before the next goes on.
PIECE = 64 << 20
_TO_LINK = "order", "record_id", "kind", "namespace", "payload_json", "created_at"
_LINKED = "seq long, record_id string, kind string, namespace string, payload_json string, entry_hash string, prev_hash string, created_at string"


def _with_states(rows: DataFrame, digest: str) -> DataFrame:
    """``rows`` (_TO_LINK) with what of each hash doesn't depend on the row before; None for a digest that can't go on from a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                states = blake3_states(part.column("payload_json").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(states, pa.binary())], [*part.schema.names, "state"])

    rows = rows.select(*_TO_LINK)
    if digest != "blake3":
        return rows.withColumn("state", F.lit(None).cast("binary"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("state", T.BinaryType())]))


def _link(rows: DataFrame, after: tuple[int, str] | None, digest: str) -> DataFrame:
    """Rows with states, linked after (seq, entry_hash) by one task in ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, prev = after or (0, None)
        for b in batches:
            first, entries, before = seq, [], []
            for payload, state in zip(b.column("payload_json").cast(pa.binary()).to_pylist(), b.column("state").to_pylist()):
                if state is not None and prev:
                    raw = blake3_resume(state, len(payload), payload[len(payload) // 64 * 64 :] + prev.encode())
                else:
                    raw = DIGESTS[digest]([payload + (prev or "").encode()])[0]
                before.append(prev)
                prev = f"{digest}:{raw.hex()}"
                entries.append(prev)
                seq += 1
            kept = {c: b.column(c) for c in ("record_id", "kind", "namespace", "payload_json", "created_at")}
            kept |= {"seq": pa.array(range(first + 1, seq + 1), pa.int64()), "entry_hash": pa.array(entries, pa.string()), "prev_hash": pa.array(before, pa.string())}
            names = [c.split()[0] for c in _LINKED.split(", ")]
            yield pa.RecordBatch.from_arrays([kept[c] for c in names], names)

    return rows.coalesce(1).sortWithinPartitions("order").select(*_TO_LINK[1:], "state").mapInArrow(run, _LINKED)


def _signed(rows: DataFrame, seed: bytes) -> DataFrame:
    """Linked rows as in LEDGER; signatures don't depend on each other, so fewer pieces than cores are spread, in short runs of rows."""
    kid, cores = key_id(ed25519.public_key(seed)), rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, F.expr("(seq - 1) div 64"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = [ed25519.sign(seed, bytes.fromhex(x.partition(":")[2])) for x in b.column("entry_hash").to_pylist()]
            have = dict(zip(b.schema.names, b.columns)) | {"signature": pa.array(signed, pa.string()), "signer_kid": pa.array([kid] * len(signed), pa.string())}
            names = [c.split()[0] for c in LEDGER.split(", ")]
            yield pa.RecordBatch.from_arrays([have[c] for c in names], names)

    return rows.mapInArrow(run, LEDGER)


def append(batch: DataFrame, seed: bytes, *, after: tuple[int, str] | None = None, digest: str = "blake3", piece: int = PIECE) -> DataFrame:
    """Ledger rows for ``batch`` (order, record_id, kind, namespace, payload_json, created_at), linked after row (seq, entry_hash).

    A chain is serial by nature: a row's hash needs the one before. What doesn't need it is done in parallel: the
    payloads' whole blocks are hashed before, for BLAKE3, and signatures follow. A batch of more than some ``piece`` payload bytes
    is ranged by ``order`` into pieces of about that size in the shared folder, and each is linked by a task of its own
    after the one before, so no task reads more than a piece. The linked pieces stay there, as the result reads them.
    """
    spark = batch.sparkSession
    size = batch.agg(F.sum(F.octet_length("payload_json")).alias("n")).first()["n"] or 0
    if size <= piece:
        return _signed(_link(_with_states(spread(batch), digest).repartition(1), after, digest), seed)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/chain-{uuid.uuid4().hex}"
    ranged = batch.select(*_TO_LINK).repartitionByRange(-(-size // piece), "order")
    _with_states(ranged, digest).withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(f"{folder}/ranged")
    whole = spark.read.parquet(f"{folder}/ranged")
    kinds = whole.drop("piece").schema
    for k in sorted(r["piece"] for r in whole.select("piece").distinct().collect()):
        to = f"{folder}/linked/piece={k}"
        _link(spark.read.schema(kinds).parquet(f"{folder}/ranged/piece={k}"), after, digest).write.parquet(to)
        last = spark.read.schema(_LINKED).parquet(to).agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("r")).first()["r"]
        after = last["seq"], last["entry_hash"]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ranged")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return _signed(spark.read.schema(_LINKED).parquet(f"{folder}/linked"), seed)


#: A run of rows with consecutive seqs: its first row, what is wrong with that one alone, its last row, its length, and its first other failure.
_RUN = "seq long, record_id string, prev string, edit boolean, forged boolean, end long, last string, n long, bad_at long, bad_seq long, bad_id string, bad_kind string"
_RUN_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in _RUN.split(", ")])


def _join(one: dict[str, Any] | None, two: dict[str, Any]) -> dict[str, Any]:
    """A run and the one after it as one run."""
    if one is None:
        return dict(two)
    if one["bad_kind"] is None:
        kind = "edit" if two["edit"] else "gap" if two["prev"] != one["last"] else "forgery" if two["forged"] else None
        if kind:
            one |= {"bad_at": one["n"], "bad_seq": two["seq"], "bad_id": two["record_id"], "bad_kind": kind}
        elif two["bad_kind"]:
            one |= {k: two[k] for k in ("bad_seq", "bad_id", "bad_kind")} | {"bad_at": one["n"] + two["bad_at"]}
    return one | {"end": two["end"], "last": two["last"], "n": one["n"] + two["n"]}


def verify_chain(ledger: DataFrame, public: bytes | None, digest: str = "blake3") -> DataFrame:
    """One row (ok, rows_checked, seq, record_id, kind, detail): the first divergence, if there is one.

    Hashes are recomputed from the stored links and signatures checked in the scan, where the payloads are; they are
    never shuffled. Each batch is reported as its runs of consecutive seqs, one row a run: a ledger that is stored in
    order, as it is written, gives one a task, and one in any order at most some 200 bytes a row. Runs are ranged by
    seq and joined in parallel, and the driver joins what the tasks report. In a row an edit comes before a gap and
    that before a forgery. Without a key, signatures aren't checked. Inputs of fewer partitions than cores are spread
    over the cores first, since hashing and signatures cost far more than moving so few bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Any] | None = None
        for b in batches:
            t = b.to_pydict()
            order = sorted(range(len(t["seq"])), key=t["seq"].__getitem__)
            raws = DIGESTS[digest]([link_text(p, h) for p, h in zip(t["payload_json"], t["prev_hash"])])
            done, wrong = [], False
            for i in order:
                seq, raw = t["seq"][i], raws[i]
                edit = f"{digest}:{raw.hex()}" != t["entry_hash"][i]
                # Signatures are the dearest check, and don't matter once an earlier row of the batch has failed.
                forged = not wrong and not edit and public is not None and not ed25519.verify(public, raw, t["signature"][i])
                row = {"seq": seq, "record_id": t["record_id"][i], "prev": t["prev_hash"][i], "edit": edit, "forged": forged, "end": seq, "last": t["entry_hash"][i], "n": 1, "bad_at": None, "bad_seq": None, "bad_id": None, "bad_kind": None}
                if held is not None and seq != held["end"] + 1:
                    done.append(held)
                    held = None
                held = _join(held, row)
                wrong = wrong or edit or forged
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_RUN_SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=_RUN_SCHEMA)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[str, Any] | None = None
        for b in batches:
            for run in b.to_pylist():
                whole = _join(whole, run)
        if whole is not None:
            yield pa.RecordBatch.from_pylist([whole], schema=_RUN_SCHEMA)

    spark = ledger.sparkSession
    runs = spread(ledger.select("seq", "record_id", "payload_json", "entry_hash", "prev_hash", "signature")).mapInArrow(scan, _RUN)
    parts = runs.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(stitch, _RUN).collect()  # a row a task
    whole: dict[str, Any] = {"seq": 0, "record_id": None, "prev": None, "edit": False, "forged": False, "end": 0, "last": None, "n": 0, "bad_at": None, "bad_seq": None, "bad_id": None, "bad_kind": None}
    for r in sorted(parts, key=lambda r: r["seq"]):
        whole = _join(whole, r.asDict())
    if whole["bad_kind"]:
        return spark.createDataFrame([(False, whole["bad_at"], whole["bad_seq"], whole["bad_id"], whole["bad_kind"], _DETAIL[whole["bad_kind"]])], _REPORT)
    return spark.createDataFrame([(True, whole["n"], None, None, None, None)], _REPORT)


def leaf(data: bytes) -> bytes:
    return b"\x00" + data


def leaves(ledger: DataFrame, digest: str = "blake3") -> DataFrame:
    """(seq, leaf): the leaf hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(DIGESTS[digest]([leaf(x.encode()) for x in b.column(1).to_pylist()]), pa.binary())], ["seq", "leaf"])

    return ledger.select("seq", "entry_hash").mapInArrow(run, "seq long, leaf binary")


def _reduce(nodes: list[bytes], digest: str) -> bytes:
    """Pairs are hashed level by level; one left over moves up unchanged."""
    if not nodes:
        return DIGESTS[digest]([b""])[0]
    while len(nodes) > 1:
        joined = DIGESTS[digest]([b"\x01" + nodes[i] + nodes[i + 1] for i in range(0, len(nodes) - 1, 2)])
        nodes = joined + nodes[len(nodes) - len(nodes) % 2 :]
    return nodes[0]


def compute_root(leaves: list[bytes], digest: str = "blake3") -> bytes:
    return _reduce(DIGESTS[digest]([leaf(x) for x in leaves]), digest)


Peaks = list[tuple[int, bytes]]


def push(peaks: Peaks, size: int, node: bytes, hashed: Callable[[bytes], bytes]) -> None:
    """Add a full subtree of ``size`` leaves (a power of two that divides the leaves so far) behind the full subtrees that stand for a tree."""
    peaks.append((size, node))
    while len(peaks) > 1 and peaks[-2][0] == peaks[-1][0]:
        (n, left), (_, right) = peaks[-2:]
        peaks[-2:] = [(2 * n, hashed(b"\x01" + left + right))]


def peaks_root(peaks: Peaks, hashed: Callable[[bytes], bytes]) -> bytes:
    """The root of the tree: what is left over at each level moves up, so the subtrees are joined from the right."""
    if not peaks:
        return hashed(b"")
    node = peaks[-1][1]
    for _, left in reversed(peaks[:-1]):
        node = hashed(b"\x01" + left + node)
    return node


def new_nodes(rows: DataFrame, digest: str = "blake3", block: int = BLOCK) -> list[tuple[int, bytes]]:
    """(size, node) of the full subtrees, in order, for ledger rows of consecutive seqs that begin anywhere.

    Aligned blocks are reduced in parallel to one node; of the two blocks that ``rows`` may hold in part come the leaves.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        nodes = DIGESTS[digest]([leaf(x.encode()) for x in t.column("entry_hash").to_pylist()])
        first = t.column("seq")[0].as_py()
        if len(nodes) == block:
            return pa.table({"seq": pa.array([first], pa.int64()), "size": pa.array([block], pa.int64()), "node": pa.array([_reduce(nodes, digest)], pa.binary())})
        return pa.table({"seq": pa.array(range(first, first + len(nodes)), pa.int64()), "size": pa.array([1] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.binary())})

    found = rows.select("seq", "entry_hash").groupBy(F.expr(f"(seq - 1) div {block}").alias("b")).applyInArrow(lambda t: run(t), "seq long, size long, node binary").collect()
    return [(r["size"], bytes(r["node"])) for r in sorted(found, key=lambda r: r["seq"])]


def inclusion_proof(leaves: list[bytes], index: int, digest: str = "blake3") -> list[tuple[bytes, bool]]:
    """(sibling, whether it is on the left) from the leaf up."""
    if index < 0 or index >= len(leaves):
        raise IndexError(index)
    level, out = DIGESTS[digest]([leaf(x) for x in leaves]), []
    while len(level) > 1:
        other = index ^ 1
        if other < len(level):
            out.append((level[other], other < index))
        joined = DIGESTS[digest]([b"\x01" + level[i] + level[i + 1] for i in range(0, len(level) - 1, 2)])
        level, index = joined + level[len(level) - len(level) % 2 :], index // 2
    return out


def verify_proof(data: bytes, proof: list[tuple[bytes, bool]], root: bytes, digest: str = "blake3") -> bool:
    node = DIGESTS[digest]([leaf(data)])[0]
    for sibling, left in proof:
        node = DIGESTS[digest]([b"\x01" + (sibling + node if left else node + sibling)])[0]
    return node == root


def merkle_root(ledger: DataFrame, leaf_count: int | None = None, digest: str = "blake3", block: int = BLOCK) -> tuple[bytes, int]:
    """(root over the first ``leaf_count`` entry hashes in order of seq, rows in the ledger).

    Leaves get their places from the sizes of ranged partitions, aligned blocks of 2**k leaves are reduced in
    parallel, and the driver reduces the block roots (32 bytes for every 4096 rows). A short last block moves up
    as a leaf left over would, so the root is that of one tree.
    """

    ranged = cut(ledger.select("seq", "entry_hash").repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()))
    # Partitions of a checkpoint keep their order, so sizes by number give each its offset.
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    wanted = total if leaf_count is None else min(leaf_count, total)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            part = b.column(2).to_numpy()
            i = np.empty(len(part), np.int64)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                start = at.get(int(p), offsets[int(p)])
                i[rows] = start + np.arange(len(rows))
                at[int(p)] = start + len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(i), b.column(1)], ["i", "entry_hash"])

    def reduce_block(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        nodes = DIGESTS[digest]([leaf(x.encode()) for x in t.column("entry_hash").to_pylist()])
        return pa.table({"block": pa.array([t.column("i")[0].as_py() // block], pa.int64()), "root": pa.array([_reduce(nodes, digest)], pa.binary())})

    roots = ranged.mapInArrow(placed, "i long, entry_hash string").where(F.col("i") < wanted).groupBy(F.expr(f"i div {block}").alias("b")).applyInArrow(lambda t: reduce_block(t), "block long, root binary").collect()
    return _reduce([bytes(r["root"]) for r in sorted(roots, key=lambda r: r["block"])], digest), total


def checkpoint(ledger: DataFrame, seed: bytes, number: int, created_at: str, digest: str = "blake3") -> DataFrame:
    """A signed row over all present leaves."""
    root, n = merkle_root(ledger, digest=digest)
    return ledger.sparkSession.createDataFrame([(number, n, f"{digest}:{root.hex()}", ed25519.sign(seed, root), key_id(ed25519.public_key(seed)), created_at)], CHECKPOINT)


def due(before: int, after: int, every: int) -> bool:
    """Whether a checkpoint falls between two row counts; 0 turns them off."""
    return every > 0 and after // every > before // every


def verify_merkle(ledger: DataFrame, checkpoints: DataFrame, public: bytes) -> DataFrame:
    """One row (ok, leaf_count, detail) for the latest checkpoint: signature, truncation, root, in this order."""
    spark: SparkSession = ledger.sparkSession
    schema = "ok boolean, leaf_count long, detail string"
    last = checkpoints.orderBy(F.desc("id")).first()
    if last is None:
        n = ledger.count()
        return spark.createDataFrame([(n == 0, n, "empty ledger, no checkpoint required" if n == 0 else "no signed checkpoint exists for a non-empty ledger")], schema)
    digest, _, hexed = last["root"].partition(":")
    k = last["leaf_count"]
    if not ed25519.verify(public, bytes.fromhex(hexed), last["signature"]):
        return spark.createDataFrame([(False, k, "checkpoint signature does not verify")], schema)
    root, n = merkle_root(ledger, k, digest)
    if n < k:
        return spark.createDataFrame([(False, k, f"ledger has {n} rows but checkpoint committed {k}")], schema)
    if root.hex() != hexed:
        return spark.createDataFrame([(False, k, "recomputed root does not match signed checkpoint")], schema)
    return spark.createDataFrame([(True, k, "ok")], schema)


def verify(ledger: DataFrame, checkpoints: DataFrame, public: bytes, digest: str = "blake3") -> DataFrame:
    """One row (ok, chain_ok, merkle_ok, rows_checked, summary); a divergence of the chain comes first in the summary."""
    c, m = verify_chain(ledger, public, digest).first(), verify_merkle(ledger, checkpoints, public).first()
    summary = f"chain diverges at seq {c['seq']} ({c['kind']}): {c['detail']}" if not c["ok"] else m["detail"] if not m["ok"] else f"{c['rows_checked']} rows verified"
    return ledger.sparkSession.createDataFrame([(c["ok"] and m["ok"], c["ok"], m["ok"], c["rows_checked"], summary)], "ok boolean, chain_ok boolean, merkle_ok boolean, rows_checked long, summary string")

