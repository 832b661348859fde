"""Two numbers as one that is ordered as they are, so that a greatest pair is found by a hash aggregate.

Structs and strings are aggregated by sorting, since their buffers have no fixed width; a decimal has one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"
_STEP = 2**64
_SHIFT = 2**63


def _number(value: int) -> Column:
    return F.lit(str(value)).cast(_WIDE)


def joined_key(high: Column, low: Column) -> Column:
    """``high`` of at most 2**62 in size before ``low``, any bigint."""
    return (high.cast(_WIDE) * _number(_STEP) + (low.cast(_WIDE) + _number(_SHIFT))).cast(_WIDE)


def low_part(key: Column) -> Column:
    return (F.pmod(key, _number(_STEP)) - _number(_SHIFT)).cast("bigint")


def high_part(key: Column) -> Column:
    return ((key - F.pmod(key, _number(_STEP))) / _number(_STEP)).cast("bigint")
