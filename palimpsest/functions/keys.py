"""Signing keys: made, kept in files that only their owner can read, or handed over in the environment."""

from __future__ import annotations

import json
import os
from functools import cache

from palimpsest.functions import ed25519
from palimpsest.functions.digest import DIGESTS

#: Names the environment variable with a hexadecimal private key.
ENV_KEY = "PALIMPSEST_SIGNING_KEY"


@cache
def key_id(public: bytes) -> str:
    """The first 16 hexadecimal signs of the public key's digest."""
    return DIGESTS["blake3"]([public])[0].hex()[:16]


def generate() -> bytes:
    return os.urandom(32)


def dump(seed: bytes) -> bytes:
    """What a key file holds."""
    return json.dumps({"version": 1, "kid": key_id(ed25519.public_key(seed)), "private_key": seed.hex()}).encode()


def load(data: bytes) -> bytes:
    """The private key of a key file (or of its bare hexadecimal form)."""
    text = data.decode().strip()
    return bytes.fromhex(json.loads(text)["private_key"] if text.startswith("{") else text)


def from_env(name: str = ENV_KEY) -> bytes:
    """KeyError if the variable isn't set."""
    if not os.environ.get(name):
        raise KeyError(f"environment variable {name} is not set")
    return bytes.fromhex(os.environ[name])
