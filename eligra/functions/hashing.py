"""Seeded draws that depend on ids only, never on partitioning or task retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *ids: Column) -> Column:
    """Order key for a seeded shuffle; md5 text, so any SQL engine gives the same order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def uniform(seed: int, *ids: Column) -> Column:
    """Number in [0, 1) from the first 52 bits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))
