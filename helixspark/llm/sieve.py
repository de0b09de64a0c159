"""A semi-join's coarse first step: a bitmap of key hashes, small whatever the number of keys.

A shuffle join moves both sides whole, also where few rows of the large side have a partner.  The bitmap has ``2**bits``
bits in ``2**bits / 64`` rows at most, so broadcasting it is safe at any size of the input; rows whose bit is not set
have no partner and stay behind.  The join proper follows, so bits that keys share by accident cost time only; with
very many keys the bitmap is full and lets everything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused

BITS = 22


def bitmap(keys: DataFrame, *columns: str, bits: int = BITS) -> DataFrame:
    """``word, bits``: the set bits of the keys' hashes, 64 to a row."""
    h = _hash(columns, bits)
    one = keys.select(F.shiftright(h, 6).cast("int").alias("word"), h.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    return one.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))


def sift(rows: DataFrame, found: DataFrame, *columns: str, bits: int = BITS) -> DataFrame:
    """The rows whose key may be among those of the bitmap ``found``; null keys stay behind."""
    marked, hit = _marked(rows.where(~_any_null(columns)), found, columns, bits, "inner")
    return marked.where(hit).select(*_quoted(rows))


def part(rows: DataFrame, found: DataFrame, *columns: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a partner, rows that have none): the second need not be shuffled.  Null keys have none."""
    marked, hit = _marked(rows, found, columns, bits, "left")
    hit = ~_any_null(columns) & F.coalesce(hit, F.lit(False))
    return marked.where(hit).select(*_quoted(rows)), marked.where(~hit).select(*_quoted(rows))


def _marked(rows: DataFrame, found: DataFrame, columns: tuple[str, ...], bits: int, how: str) -> tuple[DataFrame, Column]:
    """The rows with the bitmap's word for their key, and whether their bit is set, under names the rows do not use."""
    word, at, held = unused(rows, "word", "at", "bits")
    h = _hash(columns, bits)
    marked = rows.withColumns({word: F.shiftright(h, 6).cast("int"), at: h.bitwiseAND(F.lit(63)).cast("int")})
    joined = marked.join(F.broadcast(found.toDF(word, held)), word, how)
    return joined, F.expr(f"shiftrightunsigned(`{held}`, `{at}`) & 1 = 1")


def _quoted(rows: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in rows.columns]


def _hash(columns: tuple[str, ...], bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(91), *columns), F.lit(1 << bits))


def _any_null(columns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out
