"""Repeatable randomness.

Every random choice is a function of (seed, salt, row id), so it is the same for any partitioning,
any cluster size and any retry of a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
# 4 hex digits: 65,536 buckets per group, about 150,000 rows in a bucket of 10 billion rows.
BUCKET_DIGITS = 4


def hash_key(id_col: Column | str, salt: str, seed: int = SEED) -> Column:
    """Random sort key of a row, 32 hex digits."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), id_col.cast("string")))


def draw(id_col: Column | str, salt: str, seed: int = SEED) -> Column:
    """Random integer in [0, 2^60)."""
    return F.conv(F.substring(hash_key(id_col, salt, seed), 1, 15), 16, 10).cast("bigint")


def bucket_of(key: Column | str) -> Column:
    """Bucket number of a hash key; buckets sort like the keys."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(key, 1, BUCKET_DIGITS), 16, 10).cast("int")
