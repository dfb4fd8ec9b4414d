"""Bloom filters of DataFrame functions: 64-bit words in one stored row, read at the scan as a scalar subquery."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkqa.llm.shared import stored


def shape(keys: int, share: float) -> tuple[int, int]:
    """(bits, hashes) of a filter over so many keys that passes about ``share`` of the other keys."""
    bits = max(64, math.ceil(max(keys, 1) * math.log2(1 / share) / math.log(2)))
    return bits, min(12, max(1, round(bits / max(keys, 1) * math.log(2))))


def positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, column: str, seed: int, bits: int, hashes: int) -> DataFrame:
    """One stored row with the filter's words in order. Size: ``bits``, which the caller bounds."""
    spark, n = keys.sparkSession, (bits + 63) // 64
    at = keys.select(F.explode(F.array(*positions(F.col(column), seed, bits, hashes))).alias("p"))
    masks = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("mask"))
    words = masks.unionByName(spark.range(n).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")))
    words = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return stored(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")), "bloom")


def words_of(filled: DataFrame) -> Column:
    """The words of a stored filter, as a scalar subquery."""
    return filled.select("words").scalar()


def passes(key: Column, words: Column, seed: int, bits: int, hashes: int) -> Column:
    bit = lambda p: F.getbit(F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int"))
    return reduce(Column.__and__, [bit(p) == 1 for p in positions(key, seed, bits, hashes)])
