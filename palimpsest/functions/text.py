"""Tokens, sparse embeddings and the phrases, code points and values that detectors look for."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import repeat
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.digest import DIGESTS

DIM = 256
SLICE = 1 << 20
KNOWN = 1 << 18
STOP = frozenset("a an and are in is it its of on or the to was".split())
_STOPS = frozenset(t.encode() for t in STOP)
#: White space as \s means it in Python for ASCII, spelled out since engines differ.
_S = r"[ \t\n\r\f\x0B\x1C-\x1F]"
_PRIOR, _SECRET = "(?:previous|prior|above)", "(?:password|secret|credential)s?"
INJECTION = tuple(
    p.replace("~", _S)
    for p in (
        rf"\bignore~+(?:all~+)?{_PRIOR}~+instructions?\b",
        r"\bdisregard~+(?:the~+)?(?:above|previous|prior|earlier)\b",
        r"\byou~+are~+now~+(?:an?|the)\b",
        r"\b(?:reveal|print|show|leak)~+(?:your~+)?(?:system~+)?prompt\b",
        r"\b(?:system|developer)~*(?:prompt|message)~*:",
        r"\boverride~+(?:all~+)?(?:safety|security|previous)\b",
        r"\bdo~+anything~+now\b",
        rf"\bsend~+(?:all~+)?(?:the~+)?{_SECRET}\b",
        r"</?(?:system|instructions?)>",
    )
)
#: Zero-width signs, direction controls and the tag block.
SMUGGLED = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"
#: Kinds pinned by the behaviour to match are aws_access_key and email; the others are ours.
SECRETS = {"aws_access_key": r"\bAKIA[0-9A-Z]{16}\b", "github_token": r"\bgh[opsu]_[0-9A-Za-z]{36}\b", "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}
PII = {"email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "us_ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text, start, end) of the runs of a-z and 0-9 in the lower-cased texts, all at once on Arrow buffers; nulls have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\u0130", "i\u0307")  # the one capital whose small form is two code points
    low = pc.utf8_lower(texts).cast(pa.large_string())
    if not len(low):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none
    off = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    first, last = inside[1:-1].copy(), inside[1:-1].copy()
    first &= ~inside[:-2]
    last &= ~inside[2:]
    edge = off[(off > 0) & (off < len(raw))]  # a text begins: what goes before isn't part of its first token
    first[edge] = inside[1:-1][edge]
    last[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return raw, np.searchsorted(off, start, "right") - 1, start, end


def _keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each token: eight bytes at a time are mixed in, for as many tokens as are that long."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    size = end - start
    key, on, at = size.astype(np.uint64), np.arange(len(start)), start
    while len(on):
        word, left = np.ascontiguousarray(view[at]).view("<u8").ravel(), end[on] - at
        short = left < 8
        word[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        key[on] = _mix(key[on] * np.uint64(0xD1342543DE82EF95) + word)
        more = left > 8
        on, at = on[more], at[more] + 8
    return key


class Embedder(Protocol):
    """Texts as sparse vectors. ``kind`` is the SQL type of the weights, ``dim`` the number of buckets."""

    kind: str
    dim: int

    def cells(self, texts: pa.Array) -> pa.Array:
        """For each text its (bucket, n), in order of bucket."""
        ...


class _Units:
    def cells_of(self, text: str | None) -> dict[int, float]:
        """Bucket -> weight of one text."""
        return {x["bucket"]: x["n"] for x in self.cells(pa.array([text], pa.string()))[0].as_py()}

    def unit(self, text: str | None) -> np.ndarray | None:
        """The vector of one text, of length 1; None if it has none."""
        v = np.zeros(self.dim)
        for at, n in self.cells_of(text).items():
            v[at] = n
        size = np.sqrt(v @ v)
        return v / size if size else None


def _listed(text: np.ndarray, bucket: np.ndarray, n: pa.Array, texts: int) -> pa.Array:
    pair = pa.StructArray.from_arrays([pa.array(bucket.astype(np.int64)), n], ["bucket", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=texts)))), pa.int32()), pair)


@dataclass(frozen=True)
class HashEmbedder(_Units):
    """Token counts by bucket: the first four bytes of a token's digest, modulo ``dim``. Only distinct tokens are hashed.

    SHA-256 can be held against SQL; ``digest="blake3"`` gives the vectors of systems that bucket by BLAKE3.
    """

    digest: str = "sha256"
    dim: int = DIM
    kind = "bigint"

    def buckets(self, tokens: list[bytes]) -> np.ndarray:
        return np.array([int.from_bytes(d[:4], "big") % self.dim for d in DIGESTS[self.digest](tokens)], np.int64)

    def known(self, tokens: list[bytes]) -> np.ndarray:
        """Their buckets, -1 for those that don't count. A process remembers ``KNOWN`` tokens that aren't long, as most come again in the next texts."""
        seen = _seen(self)
        at = np.fromiter(map(seen.get, tokens, repeat(-2)), np.int64, len(tokens))
        new = np.flatnonzero(at == -2)
        if len(new):
            fresh = [tokens[i] for i in new]
            at[new] = np.where([t in _STOPS for t in fresh], -1, self.buckets(fresh))
            if len(seen) > KNOWN:
                seen.clear()
            seen.update((t, b) for t, b in zip(fresh, at[new].tolist()) if len(t) <= 32)
        return at

    def cells_of(self, text: str | None) -> dict[int, float]:
        """For one text plain Python is quicker than arrays."""
        out: dict[int, float] = {}
        for t in re.findall("[a-z0-9]+", (text or "").lower()):
            if t not in STOP:
                at = _bucket(self, t)
                out[at] = out.get(at, 0) + 1
        return out

    def cells(self, texts: pa.Array) -> pa.Array:
        """Some ``SLICE`` bytes of text at a time, as what is held of each token is several times its size."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self._cells(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    def _cells(self, texts: pa.Array) -> pa.Array:
        raw, text, start, end = token_spans(texts)
        if not len(text):
            return _listed(text, text, pa.array([], pa.int64()), len(texts))
        which, keys = pd.factorize(_keys(raw, start, end))
        first = np.zeros(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        flat = raw.tobytes()
        at = self.known([flat[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])[which]
        ids = text[at >= 0] * self.dim + at[at >= 0]
        if len(texts) * self.dim <= 8 * len(ids) + SLICE:
            count = np.bincount(ids)
            cell = np.flatnonzero(count)
            n = count[cell]
        else:
            cell, n = np.unique(ids, return_counts=True)
        return _listed(cell // self.dim, cell % self.dim, pa.array(n.astype(np.int64)), len(texts))


@cache
def _seen(embedder: HashEmbedder) -> dict[bytes, int]:
    return {}


@lru_cache(1 << 16)
def _bucket(embedder: HashEmbedder, token: str) -> int:
    return int(embedder.buckets([token.encode()])[0])


@dataclass(frozen=True)
class ModelEmbedder(_Units):
    """Vectors of a model of one's own: ``model`` takes texts, many at a time, and returns a row of ``dim`` numbers for each."""

    model: Callable[[list[str]], np.ndarray]
    dim: int
    kind = "double"

    def cells(self, texts: pa.Array) -> pa.Array:
        x = np.asarray(self.model([t or "" for t in texts.to_pylist()]), float).reshape(len(texts), self.dim) if len(texts) else np.zeros((0, self.dim))
        text, bucket = np.nonzero(x)
        return _listed(text, bucket, pa.array(x[text, bucket]), len(texts))


DEFAULT = HashEmbedder()


@cache
def _cells_udf(embedder: Embedder):
    @F.arrow_udf(f"array<struct<bucket:bigint,n:{embedder.kind}>>")
    def run(texts: pa.Array) -> pa.Array:
        return embedder.cells(texts)

    # Else a filter on the result is pushed below it and the text is gone through twice.
    return run.asNondeterministic()


def cells(text: Column, embedder: Embedder = DEFAULT) -> Column:
    """Array of (bucket, n) in order of bucket: the sparse vector of a text. It is worked out within its row, so nothing is shuffled."""
    return _cells_udf(embedder)(text)


def norm(cells: Column, embedder: Embedder = DEFAULT) -> Column:
    return F.sqrt(F.aggregate(cells, F.lit(0).cast(embedder.kind), lambda a, x: a + x["n"] * x["n"]).cast("double"))


def sparse(rows: DataFrame, keys: list[str], text: str, embedder: Embedder = DEFAULT) -> DataFrame:
    """(keys, bucket, n): how many tokens of each row fall in each bucket. Rows without tokens have none."""
    return rows.select(*keys, F.explode(cells(F.col(text), embedder)).alias("c")).select(*keys, "c.bucket", "c.n")


def rounded(x: Column, digits: int) -> Column:
    """To ``digits`` places as Python rounds: by the exact binary value, which decimal rounding of its digits misses at ties. For few rows, as those of findings."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) for v in x.to_pylist()], pa.float64())

    return run(x)


def may_match(text: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """False only where none of the patterns matches. One automaton looks for all of them at once, without their word boundaries, so that the
    patterns themselves, which take some thirty times as long, are tried on few texts."""
    either = "|".join(f"(?:{p})" for p in patterns).replace(r"\b", "")

    @F.arrow_udf("boolean")
    def run(x: pa.Array) -> pa.Array:
        return pc.match_substring_regex(x, either, ignore_case=ignore_case)

    # Else a filter by the patterns is joined with this one and goes first.
    return run.asNondeterministic()(text)


def injection_matches(text: Column) -> Column:
    """The first match of each pattern that has one, in the order of patterns."""
    hits = [F.regexp_extract(text, "(?i)" + p, 0) for p in INJECTION]
    return F.filter(F.array(*hits), lambda x: x != "")


def smuggled(text: Column) -> Column:
    """The distinct hidden code points, as U+XXXX, in the order of these strings."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({SMUGGLED})"), F.lit(1)), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(c)))), F.lit("0"))))))


def counts(text: Column, kinds: dict[str, str]) -> Column:
    """Map of kind -> number of values, without kinds that don't occur. Values themselves are never kept."""
    pairs = [F.struct(F.lit(k).alias("key"), F.regexp_count(text, F.lit(p)).alias("value")) for k, p in kinds.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"] > 0))
