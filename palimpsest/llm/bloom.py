"""A Bloom filter of the hashes that may occur more than once, built in two passes over bounded segments.

The hash space is cut into segments by its upper bits. Pass one sends only the 8-byte hashes, by segment; a task
streams them through one filter per segment and notes those that the filter has already seen. Each segment then gets
a second, small filter of the noted hashes alone. A segment belongs to one task, so filters are never merged. The
second filters grow with the number of repeats, so these are counted first, and the bits for each and the number of
probes are chosen as the best that the limit on what is broadcast allows: 16 bits and 4 probes up to 10**8 repeats at
256 MB (one other row in 400 gets through), 3 bits and 2 probes at 5 * 10**8 (one in 4), one bit and one probe at
2 * 10**9 (two in 3). A smaller filter lets more rows through to the exact step and never loses a repeat, so results are
the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import mix
from palimpsest.shared import cut

PROBES = 4


def _positions(h: np.ndarray, mask: np.ndarray | np.uint64, probes: int = PROBES) -> Iterator[np.ndarray]:
    a = mix(h)
    b = mix(a) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) & mask


def _seen(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in _positions(h, np.uint64(8 * len(bits) - 1)):
        hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return hit


def _add(bits: np.ndarray, h: np.ndarray, probes: int = PROBES) -> None:
    for p in _positions(h, np.uint64(8 * len(bits) - 1), probes):
        np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def _size(n: int, bits: float) -> int:
    """Bytes of a filter for n hashes: a power of two, the nearest to so many bits for each."""
    return max(8, 1 << round(np.log2(max(1.0, n * bits / 8))))


def _pass_one(segment_rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        repeated: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            seg = np.asarray(batch.column(0))
            h = np.asarray(batch.column(1)).view(np.uint64)
            order = np.argsort(seg, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(seg[order])) + 1) if len(order) else []:
                s = int(seg[part[0]])
                if s not in seen:
                    seen[s] = np.zeros(max(64, 1 << (16 * segment_rows // 8 - 1).bit_length()), np.uint8)
                    repeated[s] = []
                u, n = np.unique(h[part], return_counts=True)
                again = _seen(seen[s], u) | (n > 1)
                _add(seen[s], u)
                if again.any():
                    repeated[s].append(u[again])
        for s, found in repeated.items():
            if found:
                u = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "hashes": pa.array([u.tobytes()], pa.binary()), "n": pa.array([len(u)], pa.int64())})

    return scan


class RepeatFilter:
    """``hit(h)``: true for every hash that occurs more than once among those given, and for few others."""

    def __init__(self, hashes: DataFrame, rows: int, *, segment_rows: int = 1 << 18, bits_per_repeat: int = 16, max_bytes: int = 256 << 20):
        spark = hashes.sparkSession
        self.log2 = max(0, (max(1, rows) - 1).bit_length() - (segment_rows.bit_length() - 1))
        (name,) = hashes.columns
        h = F.col(name)
        seg = F.shiftrightunsigned(h, 64 - self.log2) if self.log2 else F.lit(0).cast("long")
        noted = cut(hashes.where(h.isNotNull()).select(seg.alias("segment"), h.alias("h")).repartition("segment").mapInArrow(_pass_one(segment_rows), "segment long, hashes binary, n long"))
        counts = [r["n"] for r in noted.select("n").toLocalIterator()]  # one number a segment
        bits = float(bits_per_repeat)
        while bits > 2**-10 and sum(_size(n, bits) for n in counts) > max_bytes:
            bits *= 0.75
        each = 8 * sum(_size(n, bits) for n in counts) / max(1, sum(counts))
        self.probes = PROBES if each >= 6 else max(1, round(0.7 * each))
        probes = self.probes

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for x in b.column(1).to_pylist():
                    u = np.frombuffer(x, np.uint64)
                    a = np.zeros(_size(len(u), bits), np.uint8)
                    _add(a, u, probes)
                    out.append(a.tobytes())
                yield pa.RecordBatch.from_pydict({"segment": b.column(0), "bits": pa.array(out, pa.binary())})

        base = np.zeros(1 << self.log2, np.int64)
        mask = np.full(1 << self.log2, 63, np.uint64)
        flat, at = [np.zeros(8, np.uint8)], 8
        for r in noted.select("segment", "hashes").mapInArrow(build, "segment long, bits binary").toLocalIterator():
            a = np.frombuffer(bytes(r["bits"]), np.uint8)
            base[r["segment"]], mask[r["segment"]] = at, 8 * len(a) - 1
            flat.append(a)
            at += len(a)
        self.bytes = at
        self._shared = spark.sparkContext.broadcast((self.log2, base, mask, np.concatenate(flat)))

    def hit(self, h: Column) -> Column:
        shared, probes = self._shared, self.probes

        @F.arrow_udf("boolean")
        def probe(h: pa.Array) -> pa.Array:  # not by pandas, which turns longs beside nulls into floats
            log2, base, mask, flat = shared.value
            null = np.asarray(h.is_null())
            x = h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seg = (x >> np.uint64(64 - log2)).astype(np.int64) if log2 else np.zeros(len(x), np.int64)
            hit = ~null
            for p in _positions(x, mask[seg], probes):
                hit &= (flat[base[seg] + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            return pa.array(hit)

        return probe(h)
