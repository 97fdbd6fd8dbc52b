"""Seeded hashing of row keys.

Sampling and splitting decide by a hash of the row key, so the outcome depends
on neither partitioning nor row order, and survives the loss of an executor.
"""

from pyspark.sql import Column, functions as F

from labelsieve.functions.columns import col, token

HEX_DIGITS = 12


def hash_hex(key, seed) -> Column:
    """md5 of ``seed:key`` as 32 hex digits; ``key`` is a name or several.

    Each part of a composite key is written with its length, so that no two keys are spelt alike.
    """
    names = [key] if isinstance(key, str) else list(key)
    parts = [token(col(name)) for name in names]
    if len(parts) > 1:
        parts = [F.concat(F.length(part), F.lit(":"), part) for part in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hash_unit(key, seed) -> Column:
    """A uniform number in [0, 1) from the leading digits of the hash."""
    leading = F.substring(hash_hex(key, seed), 1, HEX_DIGITS)
    return F.conv(leading, 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def fingerprint(columns) -> Column:
    """SHA-256 over several columns; equal exactly when all values are equal.

    Each value is written with its length, so no two different rows spell the
    same text. Nulls equal nulls, and 0.0 equals -0.0.
    """
    return F.sha2(F.concat(*[_framed(name, kind) for name, kind in columns]), 256)


def _framed(name: str, kind: str) -> Column:
    value = col(name)
    if kind in ("float", "double"):
        value = value + F.lit(0.0).cast(kind)
    elif kind.startswith(("array", "struct", "map")):
        value = F.to_json(value)
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))
