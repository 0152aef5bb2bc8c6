"""Repeatable pseudo-random keys: md5 of id and seed instead of a random generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 12


def hash_key(id_col: Column | str, *salts) -> Column:
    """32 hex digits, uniform over distinct ids; text order is the random order."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    parts = [salt if isinstance(salt, Column) else F.lit(str(salt)) for salt in salts]
    return F.md5(F.concat_ws(":", col.cast("string"), *[p.cast("string") for p in parts]))


def unit(key: Column) -> Column:
    """A number strictly between 0 and 1 from the first 48 bits of a hash key."""
    digits = F.conv(F.substring(key, 1, UNIT_DIGITS), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**UNIT_DIGITS))
