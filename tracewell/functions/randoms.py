"""Random numbers that depend on a key alone, never on how rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(digest: Column, place: int) -> Column:
    number = F.conv(F.substring(digest, 1 + 8 * place, 8), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(2**32))


def hash_uniform(*key: Column) -> Column:
    """A number in (0, 1) from the MD5 of the key's parts, joined by ``|``."""
    return _word(F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary")), 0)


def hash_normal(*key: Column) -> Column:
    """A standard normal number by the Box-Muller transform of two such numbers."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))
    return F.sqrt(F.lit(-2.0) * F.log(_word(digest, 0))) * F.cos(F.lit(2 * math.pi) * _word(digest, 1))
