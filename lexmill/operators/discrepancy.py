"""Mean discrepancy of two sides of any size by random features: linear in rows, with permutations of fixed sizes.

A Gaussian kernel is the mean of ``cos(w (x - y))`` over random frequencies ``w``, so
sums of cosines and sines of each side hold all that its sums over pairs need. Rows
are dealt into blocks of equally many rows of one side, and a permutation deals the
blocks anew: as many to each side as there were.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.drift import PERMUTATIONS, median_distance, sided
from lexmill.operators.neighbours import met_once
from lexmill.operators.splits import DIGITS, ranks, sample

#: Frequencies, rows that the kernel's width is taken from at most, and blocks of both sides together.
FEATURES, WIDTH_ROWS, MOST_BLOCKS = 256, 2000, 1000
SEED = 5


def hashed(*keys: object) -> int:
    """:func:`lexmill.operators.splits.mixed` of the same keys, seed first."""
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:DIGITS], 16)


def frequencies(dims: int, features: int, seed: int = SEED) -> np.ndarray:
    """Standard normal numbers, a row a frequency, from pairs of hashed uniform ones."""
    u = np.array([[[(hashed(seed, f, d, k) + 0.5) / 16**DIGITS for k in (0, 1)] for d in range(dims)] for f in range(features)])
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])


def block_sums(rows: DataFrame, id_col: str, second: str, vec_col: str, scale: float, features: int, size: int, seed: int = SEED) -> DataFrame:
    """``side``, ``block``, ``n`` and ``sums`` (cosines, then sines) of every block of ``size`` rows of a side in hashed order."""
    placed = ranks(rows.select(F.col(id_col).alias("i"), F.col(second).cast("int").alias("side"), F.col(vec_col).cast("array<double>").alias("v")), "i", ("side",))
    dealt = placed.select("side", F.expr(f"place div {size}").alias("block"), "v").repartition("side", "block").sortWithinPartitions("side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, sums, w = None, 0, None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1]]), pa.array([n]), pa.array([sums])], names=["side", "block", "n", "sums"])
        for batch in batches:
            if not batch.num_rows:
                continue
            side, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(len(side), -1)
            w = frequencies(x.shape[1], features, seed) * scale if w is None else w
            edges = np.flatnonzero((side[1:] != side[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip((0, *edges), (*edges, len(side)), strict=True):
                angles = x[lo:hi] @ w.T
                found = np.concatenate((np.cos(angles).sum(axis=0), np.sin(angles).sum(axis=0)))
                if own != (side[lo], block[lo]):
                    if own is not None:
                        yield out()
                    own, n, sums = (side[lo], block[lo]), 0, 0.0
                n, sums = n + hi - lo, sums + found
        if own is not None:
            yield out()

    return dealt.mapInArrow(run, "side int, block long, n long, sums array<double>")


def _statistic(one: np.ndarray, n: np.ndarray, two: np.ndarray, m: np.ndarray, features: int) -> np.ndarray:
    """Unbiased discrepancy by frequency, from sums and sizes of both sides (the last axis: cosines, then sines)."""
    power = lambda s, t: s[..., :features] * t[..., :features] + s[..., features:] * t[..., features:]
    n, m = np.asarray(n, dtype=float)[..., None], np.asarray(m, dtype=float)[..., None]
    return (power(one, one) - n) / (n * (n - 1)) + (power(two, two) - m) / (m * (m - 1)) - 2 * power(one, two) / (n * m)


def linear_discrepancy(rows: DataFrame, id_col: str, second: str, vec_col: str, draws: int = PERMUTATIONS, features: int = FEATURES, seed: int = SEED) -> tuple[float, float, float]:
    """Squared mean discrepancy of all vectors of two sides, its standard error by the features, and its p-value by permutations.

    The kernel's width is the median squared distance of all pairs among
    ``WIDTH_ROWS`` hashed rows at most. Up to ``MOST_BLOCKS`` rows a block is one row,
    so permutations are those of rows; beyond, blocks grow, and sums of all of them
    reach the driver. Without two rows on both sides the result is nan, nan and 1.
    """
    counts = {r["side"]: r["n"] for r in rows.groupBy(F.col(second).cast("int").alias("side")).agg(F.count("*").alias("n")).collect()}  # two rows
    n, m = counts.get(0, 0), counts.get(1, 0)
    if min(n, m) < 2:
        return math.nan, math.nan, 1.0
    known = sided(rows, id_col, second)
    some = known if n + m <= WIDTH_ROWS else sample(known, "_sided", WIDTH_ROWS)
    scale = math.sqrt(2 / median_distance(met_once(some, "_sided", vec_col)))
    blocks = sorted(block_sums(rows, id_col, second, vec_col, scale, features, -(-(n + m) // MOST_BLOCKS), seed).collect())  # MOST_BLOCKS and one
    side, sizes, sums = np.array([r["side"] for r in blocks]), np.array([r["n"] for r in blocks]), np.array([r["sums"] for r in blocks])
    both, total, first = sums.sum(axis=0), sizes.sum(), int((side == 0).sum())

    def of(chosen: np.ndarray) -> np.ndarray:
        one, k = chosen @ sums, chosen @ sizes
        return _statistic(one, k, both - one, total - k, features)

    seen = of((side == 0).astype(float))
    extreme = 0
    for draw in range(draws):
        order = sorted(range(len(blocks)), key=lambda b: (hashed(seed, draw, blocks[b]["side"], blocks[b]["block"]), b))
        chosen = np.zeros(len(blocks))
        chosen[order[:first]] = 1
        extreme += of(chosen).mean() >= seen.mean() - 1e-12
    return float(seen.mean()), float(seen.std(ddof=1) / math.sqrt(features)), float((1 + extreme) / (1 + draws))
