"""Hashes, canonical JSON, hash chains and keyed randomness.

A draw is a function of its coordinates alone, so it needs no generator state and is the same on any
partitioning. Columns stay in the JVM; the plain functions give the same values in Python.
"""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "GENESIS"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; non-ASCII text stays as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def object_hash(value) -> str:
    return sha256(canonical(value))


def link(previous: str | None, value) -> str:
    """The hash of a chain's next record; no previous hash means its start."""
    return sha256(f"{previous or GENESIS}|{canonical(value)}")


def link_column(previous, payload) -> Column:
    """link() where payload is canonical JSON already."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit(GENESIS)), F.lit("|"), payload), 256)


def key_hex(*coordinates) -> Column:
    """The first 64 bits of the coordinates' hash, as 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws("|", *(c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in coordinates)), 256), 1, 16)


def unsigned(hex16) -> Column:
    """16 hex digits as an unsigned number."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def uniform_column(key, counter) -> Column:
    """The counter-th draw in [0, 1) of a key given as 16 hex digits."""
    word = F.substring(F.sha2(F.unhex(F.concat(key, F.lpad(F.hex(counter.cast("bigint")), 16, "0"))), 256), 1, 16)
    return unsigned(word).cast("double") / F.lit(float(2**64))


def key(*coordinates) -> int:
    return int(sha256("|".join(map(str, coordinates)))[:16], 16)


def uniform(k: int, counter: int) -> float:
    return int.from_bytes(hashlib.sha256(struct.pack(">QQ", k, counter)).digest()[:8], "big") / 2**64


def batch_hash_column(ids) -> Column:
    """The hash of a batch's sequence ids in any order (ids without characters that JSON escapes)."""
    quoted = F.transform(F.array_sort(ids), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.sha2(F.concat(F.lit('{"seq_ids":['), F.array_join(quoted, ","), F.lit("]}")), 256)
