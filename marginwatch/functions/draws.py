"""Repeatable pseudo-random draws.

A draw is a function of the row's own key and a tag, never of its partition, so a
recomputed task or another cluster size gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Park-Miller generator with the revised multiplier.
MODULUS = 2147483647
MULTIPLIER = 48271


def digest(tag: str, *keys: Column) -> Column:
    """Hex digest of the tag and keys; ordering by it is a random order."""
    return F.md5(F.concat_ws(":", F.lit(tag), *[k.cast("string") for k in keys]))


def draw(digest_hex: Column) -> Column:
    """Integer in [0, 2**28) from a digest."""
    return F.conv(F.substring(digest_hex, 1, 7), 16, 10).cast("long")

