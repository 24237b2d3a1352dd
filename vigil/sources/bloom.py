"""Bloom filter over a key column, built by an aggregate, tested as a join condition (I4 at scale).

For a sensor dimension above the broadcast limit, a filter of a few bits per
sensor goes to all tasks instead, and readings of unknown sensors are dropped,
but for a small share of false positives, before anything is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import stored

#: The largest filter that is broadcast, in bits (16 MB); more keys make it less selective, never wrong.
MOST_BITS = 1 << 27


def bits_for(keys: int, false_positives: float) -> tuple[int, int]:
    """(bits, hashes) for so many keys: bits a power of two of 64 at least, hashes to suit."""
    wanted = -keys * math.log(false_positives) / math.log(2) ** 2
    bits = min(MOST_BITS, max(64, 1 << max(0, math.ceil(math.log2(max(1.0, wanted))))))
    return bits, max(1, min(16, round(bits / max(1, keys) * math.log(2))))


def positions(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key: two 64-bit hashes combined."""
    a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(a, 7) + F.shiftright(b, 7) * F.lit(i), F.lit(bits)) for i in range(hashes)]


def build(keys: DataFrame, key: str, false_positives: float = 0.01) -> tuple[DataFrame, int, int]:
    """(one-row DataFrame with the filter's 64-bit words, bits, hashes) of a column's distinct values."""
    keys = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    bits, hashes = bits_for(keys.count(), false_positives)
    at = keys.select(F.explode(F.array(*positions(F.col(key), bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    # bounded by MOST_BITS / 64 words, those without a bit left out until here
    packed = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64 - 1).cast("long")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    if bits // 64 > 1024:  # a map is searched from its begin; order the words instead
        every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
        packed = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("words"))
        return stored(packed, "bloom"), bits, hashes
    return stored(packed.select(array.alias("words")), "bloom"), bits, hashes


def may_hold(key: Column, words: Column, bits: int, hashes: int) -> Column:
    """False for keys that are surely not in the filter; NULL keys are not."""
    out = key.isNotNull()
    for p in positions(key, bits, hashes):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        out = out & (F.expr("0L") != word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))))
    return out


def passing(df: DataFrame, key: str, filter_: tuple[DataFrame, int, int], keep: bool = True) -> DataFrame:
    """Rows whose key may be in the filter (``keep``), or those whose key surely is not."""
    words, bits, hashes = filter_
    # one row, broadcast; as a join condition, so that no row carries the words along
    return df.join(F.broadcast(words), may_hold(F.col(key), F.col("words"), bits, hashes), "left_semi" if keep else "left_anti")
