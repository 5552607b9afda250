"""Deterministic, engine-portable randomness.

Every random choice (sampling, shuffling, template choice, splits) is an
md5 of a seed and a key, so a run is reproducible, independent of
partitioning, and has a plain-SQL twin (md5 digits agree across engines).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_key(seed, *keys) -> Column:
    """md5 hex of ``seed|k1|k2...``; string order = a seeded random order."""
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def md5_digit(salt: str, key) -> Column:
    """First hex digit of md5(salt || key) (fixture coin flips)."""
    return F.substring(F.md5(F.concat(F.lit(salt), _c(key).cast("string"))), 1, 1)


def hash_int(x: Column) -> Column:
    """Non-negative 32-bit integer from the first 8 hex digits of md5(x)."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_long(x: Column) -> Column:
    """Non-negative 60-bit integer from the first 15 hex digits of md5(x): positions in tables of any size."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("bigint")


def coprime_strides(n: int, seed, tries: int = 256, most: int = 64) -> list[int]:
    """Seeded step widths that share no factor with n: start + j * step (mod n) meets n different positions."""
    import hashlib
    import math
    found = [1 + int(hashlib.md5(f"{seed}|stride|{i}".encode()).hexdigest()[:15], 16) % n for i in range(tries)]
    return list(dict.fromkeys(c for c in found if math.gcd(c, n) == 1))[:most] or [1]


def hash_bucket(x: Column, n) -> Column:
    """Bucket in [0, n) from md5; n may be a Column."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.pmod(hash_int(x), n)


def seeded_bucket(seed, n, *keys) -> Column:
    return hash_bucket(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]), n)


def hash_id(*keys) -> Column:
    """Stable 60-bit integer id from md5 of the keys (first 15 hex digits)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_c(k).cast("string") for k in keys])), 1, 15),
                  16, 10).cast("bigint")
