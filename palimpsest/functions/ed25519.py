"""Ed25519 signatures from RFC 8032 in plain Python, for tables of a size that one signs: keys stay out of DataFrames."""

from __future__ import annotations

import hashlib
from functools import cache

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)
PREFIX = "ed25519:"

Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % _P, (a[1] + a[0]) * (b[1] + b[0]) % _P
    w, z = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = v - u, z - w, z + w, v + u
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _x(y: int, odd: int) -> int | None:
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * _ROOT % _P
    if (x * x - xx) % _P or (x == 0 and odd):
        return None
    return _P - x if x % 2 != odd else x


_ZERO: Point = (0, 1, 1, 0)
_BY = 4 * pow(5, -1, _P) % _P
_BX = _x(_BY, 0)
_BASE: Point = (_BX, _BY, 1, _BX * _BY % _P)


#: A point as (y + x, y - x, 2dxy) with z = 1, which makes adding it cheaper.
Ready = tuple[int, int, int]


def _rows(p: Point) -> list[list[Ready]]:
    """Multiples of a point for each place of eight bits, so that a product takes 32 additions and no doubling."""
    points = []
    for _ in range(32):
        last = p
        for _ in range(255):
            points.append(last)
            last = _add(last, p)
        p = last  # 256 times the point
    # One inversion for all: running products there and back.
    before, run = [], 1
    for q in points:
        before.append(run)
        run = run * q[2] % _P
    back, ready = pow(run, -1, _P), [(1, 1, 0)] * len(points)
    for i in range(len(points) - 1, -1, -1):
        x, y, z, _ = points[i]
        inverse, back = back * before[i] % _P, back * z % _P
        x, y = x * inverse % _P, y * inverse % _P
        ready[i] = (y + x) % _P, (y - x) % _P, 2 * _D * x * y % _P
    return [[(1, 1, 0), *ready[i : i + 255]] for i in range(0, len(ready), 255)]


def _times(k: int, rows: list[list[Ready]], start: Point = _ZERO) -> Point:
    """k times the point that ``rows`` are of, plus ``start``."""
    x, y, z, t = start
    for digit, row in zip(k.to_bytes(32, "little"), rows):
        if digit:
            plus, minus, both = row[digit]
            a, b, c, d = (y - x) * minus % _P, (y + x) * plus % _P, t * both % _P, 2 * z
            e, f, g, h = b - a, d - c, d + c, b + a
            x, y, z, t = e * f % _P, g * h % _P, f * g % _P, e * h % _P
    return x, y, z, t


_BASES: list[list[Ready]] = []
_OWN: dict[bytes, tuple[int, bytes, bytes]] = {}
#: A ledger has few keys, so their multiples are kept as well.
_KEYS: dict[bytes, list[list[Ready]] | None] = {}


def _base_times(k: int) -> Point:
    if not _BASES:
        _BASES.extend(_rows(_BASE))
    return _times(k, _BASES)


def _pack(p: Point) -> bytes:
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y, odd = n & ((1 << 255) - 1), n >> 255
    if y >= _P:
        return None
    x = _x(y, odd)
    return None if x is None else (x, y, 1, x * y % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def _expand(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return a, h[32:]


@cache
def public_key(seed: bytes) -> bytes:
    return _pack(_base_times(_expand(seed)[0]))


def sign(seed: bytes, message: bytes) -> str:
    if seed not in _OWN:
        a, nonce = _expand(seed)
        _OWN[seed] = a, nonce, _pack(_base_times(a))
    a, nonce, key = _OWN[seed]
    r = _hash(nonce, message)
    point = _pack(_base_times(r))
    s = (r + _hash(point, key, message) * a) % _L
    return PREFIX + (point + s.to_bytes(32, "little")).hex()


def verify(key: bytes, message: bytes, signature: str | None) -> bool:
    """False for every malformed signature; never an error."""
    if not signature or not signature.startswith(PREFIX):
        return False
    try:
        raw = bytes.fromhex(signature.removeprefix(PREFIX))
    except ValueError:
        return False
    if len(raw) != 64 or len(key) != 32:
        return False
    s = int.from_bytes(raw[32:], "little")
    if key not in _KEYS:
        p = _unpack(key)
        _KEYS[key] = None if p is None else _rows((_P - p[0], p[1], p[2], _P - p[3]))
    minus = _KEYS[key]
    if s >= _L or minus is None:
        return False
    return _pack(_times(_hash(raw[:32], key, message), minus, _base_times(s))) == raw[:32]
