"""Stable pseudonyms of sensitive values: keyed hashes from built-in SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key, as HMAC defines them."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_hex(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text, in hex; the key's pads are literals, so nothing leaves the JVM."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256))), 256)


def token(c: Column, kind: str, key: bytes) -> Column:
    """<kind>-<first ten hex digits>; null stays null, and equal values in any case have one token."""
    return F.concat(F.lit(f"{kind}-"), F.substring(hmac_hex(F.lower(F.trim(c)), key), 1, 10))
