"""Seeded draws: a portable 32-bit hash instead of a random generator.

The value depends on the arguments alone, so a draw survives task retries and
repartitioning, and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_BITS = 32


def draw(*parts) -> Column:
    """Uniform integer in [0, 2**32) from literals (str/int) and columns."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def fine_draw(*parts) -> Column:
    """The same with 60 bits, for the least of many draws: equal ones do not occur."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
