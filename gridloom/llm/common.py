"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import materialize

#: What separates words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, as a pattern for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of text that one numpy step looks at.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, nothing to recompute."""
    return materialize(df, f"llm-{label}")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANKS, "")
    return F.length(marks).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to ``most`` at the most, or hold one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def hand_back() -> None:
    """Returns memory that this Python worker has freed to the system; workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with free memory handed back before and after."""

    def wrapped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        yield from run(it)
        hand_back()

    return wrapped


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "links") -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node.

    Alternates two star steps on stored tables: every node hands its larger
    neighbours, then its smaller ones, to its smallest neighbour. Each step is
    one aggregate and one join on narrow rows; no neighbour list is ever
    gathered. Nodes without links are not returned; null ends are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stored(edges, f"{label}-0")
    round_ = 0
    while True:
        round_ += 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = stored(large, f"{label}-{round_}a")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{round_}b")
        # Stars only: no node that is pointed at points on, and each node points once.
        roots = small.select(F.col("v").alias("u")).distinct()
        many = small.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if small.join(roots, "u", "left_semi").select("u").union(many).isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ------------------------------------------------------------ Bloom filters

#: Most bytes of one Bloom filter that is sent to all tasks.
FILTER_BYTES = 16 << 20


def bits_for(n: float, rate: float) -> float:
    """Bits that a filter of ``n`` keys needs for a false-positive rate."""
    return max(64.0, -n * np.log(max(rate, 1e-12)) / np.log(2) ** 2)


def bloom_bits(n: int, rate: float) -> tuple[int, int]:
    """Bits (a power of two, within FILTER_BYTES) and hash functions for ``n`` keys at a false-positive rate."""
    bits = min(1 << int(np.ceil(np.log2(bits_for(n, rate)))), FILTER_BYTES * 8)
    return bits, int(np.clip(np.ceil(-np.log2(rate)), 1, 16))


def bloom_positions(h: Column, bits: int, hashes: int) -> Column:
    """Positions of a well-mixed 64-bit number: double hashing with its own upper half."""
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[(h + step * F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)])


def bloom_build(keys: DataFrame, h: Column, bits: int, hashes: int) -> bytes:
    """The filter's bytes, set in Spark; at most FILTER_BYTES reach the driver."""
    at = F.explode(bloom_positions(h, bits, hashes)).alias("at")
    word = keys.select(at).groupBy(F.shiftrightunsigned("at", 3).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("b"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    got = word.toPandas()
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.uint8)
    return out.tobytes()


def bloom_test(h: Column, data: bytes, bits: int, hashes: int) -> Column:
    """Whether a filter holds the number."""
    words = F.lit(bytearray(data))

    def bit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substr(words, (F.shiftrightunsigned(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, p.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(bloom_positions(h, bits, hashes), bit)


def bloom_test_numpy(h: np.ndarray, data: bytes, bits: int, hashes: int) -> np.ndarray:
    """The same test for an array of 64-bit numbers."""
    words = np.frombuffer(data, dtype=np.uint8)
    step = (h >> np.uint64(32)) | np.uint64(1)
    out = np.ones(len(h), dtype=bool)
    for i in range(hashes):
        p = (h + step * np.uint64(i)) & np.uint64(bits - 1)
        out &= (words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
