"""Expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins to each power of 2.
STEPS = 16


def size_bin(number: Column) -> Column:
    """An integer that never falls as a number grows: its sign, then its size in ``STEPS`` bins to a power
    of 2. Null has bin 0."""
    size = lambda c: F.floor(F.log2(c) * STEPS)
    return F.when(number > 0, size(number) + (1 << 20)).when(number < 0, -size(-number) - (1 << 20)).otherwise(0)
