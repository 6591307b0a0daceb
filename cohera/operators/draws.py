"""Seeded numbers that any engine with MD5 gives alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts: Column | str | int, seed: int = 0) -> Column:
    """A whole number from 0 to 2^32 - 1 out of the parts; any engine with MD5 gives the same."""
    cols = [F.lit(str(seed)), *[(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")
