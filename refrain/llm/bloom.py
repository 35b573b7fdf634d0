"""Blocked Bloom filters as DataFrames: one block of 256 bits per key, eight bits in it, one in each 32-bit word.

A filter is a table of the blocks that hold any bits. It never loses a key; how many others pass depends on the keys per
block. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys per block of 256 bits, on average; with 16 bits a key, about one other key in a thousand passes.
PER_BLOCK = 16
#: Blocks of a filter that is broadcast, at most: 8 MB of bits, some 60 MB as rows. With more than PER_BLOCK times as many keys more of the others pass.
MOST_BLOCKS = 1 << 18
WORDS = 8
#: Odd numbers that spread a hash over the words of a block; fixed values.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def blocks_for(n: int) -> int:
    """Blocks for n keys."""
    return max(1, -(-n // PER_BLOCK))


def bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key, and its eight 32-bit masks."""
    own = F.xxhash64(key)
    low = own.bitwiseAND(F.lit(0x7FFFFFFF))
    masks = F.transform(F.array(*map(F.lit, SALTS)), lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftrightunsigned", (low * s).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(27)).cast("int")))
    return F.pmod(F.call_function("shiftrightunsigned", own, F.lit(32)), F.lit(blocks)), masks


def filter_of(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """bloom_block and bloom_words of the blocks that hold any bits of the keys."""
    block, masks = bits(key, blocks)
    own = keys.select(block.alias("bloom_block"), masks.alias("masks"))
    return own.groupBy("bloom_block").agg(F.array(*(F.bit_or(F.get("masks", F.lit(i))) for i in range(WORDS))).alias("bloom_words"))


def _held(masks: str = "bloom_masks", words: str = "bloom_words") -> Column:
    found = F.lit(True)
    for i in range(WORDS):
        mask = F.get(masks, F.lit(i))
        found = found & (F.get(words, F.lit(i)).bitwiseAND(mask) == mask)
    return found


def _placed(rows: DataFrame, key: Column, blocks: int) -> DataFrame:
    block, masks = bits(key, blocks)
    return rows.select("*", block.alias("bloom_block"), masks.alias("bloom_masks"))


def possible(rows: DataFrame, key: Column, held: DataFrame, blocks: int, small: bool = True) -> DataFrame:
    """Those rows (of plain column names) whose key the filter may hold, and hardly any others. small: the filter is broadcast."""
    met = _placed(rows, key, blocks).join(F.broadcast(held) if small else held, "bloom_block")
    return met.where(_held()).select(*rows.columns)


def marked(rows: DataFrame, key: Column, held: DataFrame, blocks: int) -> DataFrame:
    """rows, with `maybe`: whether the filter, which is broadcast, may hold their key."""
    met = _placed(rows, key, blocks).join(F.broadcast(held), "bloom_block", "left")
    return met.select(*rows.columns, F.coalesce(_held(), F.lit(False)).alias("maybe"))
