"""Helpers shared by the operators: table reading, row keys, byte fingerprints, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.session import materialise

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(*cols: str) -> list:
    """Null-safe join key of a row: its id and a fingerprint of what it holds.

    Repeated rows share a key and so get the same result; rows that only share an id do not.
    """
    ident, *rest = cols
    return [
        F.coalesce(F.col(ident).cast("long"), F.lit(-(2**63))).alias("_k"),
        F.xxhash64(F.col(ident), *[F.col(c) for c in rest]).alias("_h"),
    ]


def shard_count(rows: int, per_shard: int) -> int:
    return max(1, -(-rows // per_shard))


# ------------------------------------------------------------------ fingerprints of byte strings

P = (1 << 61) - 1  # a prime, so strings of regular structure do not collide
BASES = (0x1E3779B97F4A7C15, 0x02B2AE3D27D4EB4F)
STRETCH = 1 << 22  # so many terms are summed before they are reduced
BITS = np.uint64(61)
LOW = np.uint64((1 << 32) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & np.uint64(P)) + (x >> BITS)
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def shifted(x: np.ndarray) -> np.ndarray:
    """``x * 2**32`` for values below 2**62, as a number below 2**62: 2**61 counts as 1."""
    return (x >> np.uint64(29)) + ((x & np.uint64((1 << 29) - 1)) << np.uint64(32))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 32 bits."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & LOW, b >> np.uint64(32), b & LOW
    low = a0 * b0
    middle = shifted(a1 * b0 + a0 * b1)
    return reduced(a1 * b1 * np.uint64(8) + middle + (low & np.uint64(P)) + (low >> BITS))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo the prime, kept between calls up to a million of them."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, product(known, np.uint64(pow(base, len(known), P)))])
    if len(known) <= 1 << 20:
        _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of shifts and products)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Polynomial prefix sums of one byte string, modulo a prime.

    ``at(lo, hi)`` is the fingerprint of ``bytes[lo:hi]`` for arrays of bounds: equal strings have
    equal fingerprints wherever they start.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        n = len(data)
        self.inverse = _powers(pow(base, -1, P), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        powers = _powers(base, n + 1)
        for at in range(0, n, STRETCH):
            terms = data[at : at + STRETCH].astype(np.uint64) + np.uint64(1)
            own = powers[at : at + len(terms)]
            high = np.cumsum(terms * (own >> np.uint64(32)))
            low = np.cumsum(terms * (own & LOW))
            self.sums[at + 1 : at + 1 + len(terms)] = reduced(
                shifted(high) + (low & np.uint64(P)) + (low >> BITS) + self.sums[at]
            )

    def between(self, low: np.ndarray, high: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return product(reduced(high + (np.uint64(P) - low)), inverse)

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        value = self.between(self.sums[lo], self.sums[hi], self.inverse[lo])
        return mix(value + (hi - lo).astype(np.uint64))

    def runs(self, length: int) -> np.ndarray:
        """Fingerprints of all strings of ``length`` bytes, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        value = self.between(self.sums[:n], self.sums[length:], self.inverse[:n])
        return mix(value + np.uint64(length))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(column) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each text of an Arrow column, without copies; a null is an empty string."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[lo:hi]


# ------------------------------------------------------------------------ connected components


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest reachable node of each node that has a smaller one.

    Large-star and small-star steps alternate until all edges lead to a smallest node; each round
    hangs nodes on smaller ones and keeps reachability.  The rounds are written tables, so a lost
    executor costs a re-read.  Minima are pre-aggregated, so a node with very many links is no hot spot.
    """
    current = materialise(
        edges.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).where("u <> v").distinct(),
        "edges",
    )
    while not stars(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct("u", F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        current = materialise(small, "edges")
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def stars(edges: DataFrame) -> bool:
    """Whether each node has one edge ``(u, v)`` down, to a node without one."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    down = edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    ends = up.union(down).groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return ends.where("ups > 1 OR (ups > 0 AND downs > 0)").count() == 0
