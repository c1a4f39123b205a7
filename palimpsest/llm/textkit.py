"""Vectorised text work on Arrow buffers: no Python string is made and no loop runs over words.

A text is taken as UTF-8 bytes. Normalising lower-cases ASCII and Latin-1 letters and turns every ASCII byte
that is neither a letter nor a digit into a separator; all other bytes belong to words. Substring hashes come from
one prefix sum of ``byte * P**position`` modulo 2**64, so every word or n-gram costs a subtraction and a product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_PINV = pow(_P, -1, 1 << 64)
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WORD_TABLE = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b < 58 or 97 <= _b < 123 or _b >= 128:
        WORD_TABLE[_b] = _b
    elif 65 <= _b < 91:
        WORD_TABLE[_b] = _b + 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, kept between calls."""
    if len(_pows[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for k, p in enumerate((_P, _PINV)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # doubling: out[done:2*done] = out[:done] * p**done
                out[done : 2 * done] = out[:done] * np.uint64(pow(p, done, 1 << 64))
                done *= 2
            _pows[k] = out
    return _pows[0], _pows[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), null
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], null


def pieces(offsets: np.ndarray, most_bytes: int = 1 << 18, most_docs: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents that are worked on together: bounded in bytes unless one document alone is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), n, i + most_docs)
        yield i, j
        i = j


def normalise(raw: np.ndarray) -> np.ndarray:
    """Lower-cased word bytes; 0 where no word is."""
    out = WORD_TABLE[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        nxt = raw[lead + 1]
        out[lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1] += 0x20
    return out


def words(norm: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each word. Words never cross from one document into the next."""
    n = len(norm)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = norm != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix(norm)
    h = mix((sums[e] - sums[s]) * powers(n + 1)[1][s])
    return h, np.searchsorted(offsets, s, "right") - 1, s, e


def prefix(norm: np.ndarray) -> np.ndarray:
    out = np.zeros(len(norm) + 1, np.uint64)
    np.cumsum(norm * powers(len(norm) + 1)[0][: len(norm)], out=out[1:])
    return out


def counted(doc: np.ndarray, h: np.ndarray, doc_bits: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with their counts, in order of document; hashes keep their lower 52 bits."""
    low = np.uint64((1 << (64 - doc_bits)) - 1)
    key = (doc.astype(np.uint64) << np.uint64(64 - doc_bits)) | (h & low)
    key.sort()
    if not len(key):
        return doc[:0], h[:0], np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(64 - doc_bits)).astype(np.int64), key & low, count


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\x0b")] = True


def count_tokens(texts: pa.Array) -> np.ndarray:
    """How many runs of bytes other than ASCII white space each text has; a null has none."""
    raw, off, _ = text_buffers(texts)
    out = np.zeros(len(texts), np.int64)
    for i, j in pieces(off, 1 << 22, 1 << 20):
        part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if not len(part):
            continue
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = at[at < len(part)]
        first[edge] = word[edge]
        out[i:j] = np.diff(np.searchsorted(np.flatnonzero(first), at))
    return out
