"""Bloom filters of key sets that are too large to broadcast.

A semi join of a large fact with a large key set shuffles the whole fact, even
if few of its rows stay. Here the key set is first reduced, in Spark, to a
Bloom filter whose size is bounded whatever the number of keys, and the
fact is probed with it before its shuffle; the exact semi join follows, so
the filter's false positives cost a shuffled row each and change nothing.

The filter is blocked: a key sets ``BITS`` bits of one 64-bit word, chosen by its
hash. So it is a table (word number -> bits) that is built by one aggregation
(``bit_or``) and probed by one look-up, all in built-in functions. ``words``
times 16 bytes is what every executor holds; beyond ``MAX_WORDS`` (64 MB) the filter
doesn't grow with the keys, only its share of false positives does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4  # of a word that a key sets
BITS_PER_KEY = 16  # space for a key: about one false positive in a hundred
MAX_WORDS = 1 << 22  # of a filter: bounds what is broadcast to 64 MB


def words_for(keys: int) -> int:
    """Words (a power of two) of a filter of so many keys, within the bound."""
    return min(MAX_WORDS, max(64, 1 << (max(1, keys) * BITS_PER_KEY // 64).bit_length()))


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("int")


def _mask(h: Column) -> Column:
    """The bits of a key: six bits of its hash each, from above those that choose the word."""
    bits = None
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 30 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def bloom_filter(keys: DataFrame, on: str, words: int) -> DataFrame:
    """The filter of a key column: (word, bits), at most ``words`` rows. Null keys set no bit."""
    h = F.xxhash64(on)
    marked = keys.where(F.col(on).isNotNull()).select(_word(h, words).alias("_bloom_word"), _mask(h).alias("_bloom_bits"))
    return marked.groupBy("_bloom_word").agg(F.bit_or("_bloom_bits").alias("_bloom_bits"))


def bloom_probe(fact: DataFrame, filter: DataFrame, on: str, words: int) -> DataFrame:
    """Rows of ``fact`` whose key may be in the filter; the key must have the type it was built from."""
    if words > MAX_WORDS:
        raise ValueError(f"a filter of {words} words is larger than the bound for broadcasts")
    h = F.xxhash64(on)
    probed = fact.withColumns({"_bloom_word": _word(h, words), "_bloom_mask": _mask(h)})
    marks = F.broadcast(filter)  # at most MAX_WORDS rows of 16 bytes, by construction
    hit = (probed["_bloom_word"] == marks["_bloom_word"]) & (F.col("_bloom_mask") == F.col("_bloom_bits").bitwiseAND(F.col("_bloom_mask")))
    return probed.join(marks, hit & F.col(on).isNotNull(), "left_semi").drop("_bloom_word", "_bloom_mask")


def bloom_semi_join(fact: DataFrame, keys: DataFrame, on: str, keys_on: str | None = None, *, words: int | None = None) -> DataFrame:
    """``cohort_semi_join`` for a large key set: rows of ``fact`` whose key occurs in ``keys``.

    Without ``words`` the keys are counted first (approximately: only the
    filter's size depends on it). Null keys never match, as with SQL ``IN``.
    """
    keys = keys.select(F.col(keys_on or on).cast(fact.schema[on].dataType).alias(on))
    if words is None:
        words = words_for(keys.agg(F.approx_count_distinct(on)).first()[0])
    maybe = bloom_probe(fact, bloom_filter(keys, on, words), on, words)
    return maybe.join(keys, on, "left_semi")


def bloom_narrowed_join(fact: DataFrame, keys: DataFrame, on: str, *, words: int | None = None) -> DataFrame:
    """The same semi join where the key set is the larger side (the fact is filtered already): the filter holds the fact's keys, and the
    key set is probed before its shuffle."""
    if words is None:
        words = words_for(fact.agg(F.approx_count_distinct(on)).first()[0])
    keys = keys.select(F.col(on).cast(fact.schema[on].dataType).alias(on))
    return fact.join(bloom_probe(keys, bloom_filter(fact, on, words), on, words), on, "left_semi")
