"""Join helper for keys that may hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that spreads every key of ``large`` over ``SALTS`` tasks.

    ``small`` must be unique on ``key``; its rows are repeated once per salt, so it should
    be narrow. The salt is a hash of ``spread``, so a recomputed task gives the same rows.
    Needed where the result is grouped by the join key again: there Spark's own skew
    handling does not split the join.
    """
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
