"""Equi-joins whose hot keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``table``, which is unique on ``keys``; ``how`` is ``"inner"`` or ``"left"``.

    The rows of a key are dealt by ``spread`` into salts.  A first join, on the distinct pairs of key and salt, of which a
    key has ``salts`` at most, brings each pair its row of ``table``; the second, on key and salt, brings it to the rows.
    So no task gets more than about one in ``salts`` of a key's rows, whichever keys are hot, and nothing is broadcast.
    Null keys have no partner.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(17), spread), F.lit(salts)).cast("int"))
    named = dealt.select(*keys, "__salt").distinct().join(table, keys)
    return dealt.join(named, [*keys, "__salt"], how).drop("__salt")
