"""Splits, folds, samples and draws that repeat exactly: they come from hashes of ids or numbers, never from a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.cumulative import cumulative
from lexmill.operators.ranking import head_per_group, numbered
from lexmill.operators.sized import broadcast_if_small

#: Hexadecimal digits of a hash that are read as a number: 60 bits, so no sign.
DIGITS = 15


def mixed(*keys: Column, seed: int = 13) -> Column:
    """A number of 60 bits that any SQL engine can repeat: the first digits of md5 of seed and keys, joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def mixed_sql(*keys: str, seed: int = 13) -> str:
    """:func:`mixed` as an expression of DuckDB."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, {DIGITS}))::BIGINT"


def ranks(rows: DataFrame, id_col: str, keys: tuple[str, ...], seed: int = 13) -> DataFrame:
    """``rows`` with ``place``, from 0, in hashed order within ``keys``; a group may be of any size, ids may be any numbers. Ids are unique."""
    return numbered(rows, [mixed(F.col(id_col), seed=seed).asc(), F.col(id_col).asc()], "place", keys).withColumn("place", F.col("place") - 1)


def stratified_split(groups: DataFrame, id_col: str, label: str, shares: tuple[float, float] = (0.7, 0.85), seed: int = 13) -> DataFrame:
    """``split`` of each group: within a label the first shares of the hashed order train and validate, the rest tests."""
    sizes = groups.groupBy(label).agg(F.count("*").alias("_n"))
    placed = ranks(groups, id_col, (label,), seed).join(broadcast_if_small(sizes), label)
    at = (F.col("place").cast("double") + F.lit(0.5)) / F.col("_n")
    return placed.withColumn("split", F.when(at < shares[0], "train").when(at < shares[1], "val").otherwise("test")).drop("_n")


def group_folds(groups: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 13) -> DataFrame:
    """``fold`` of each group, dealt in turn within a label."""
    return ranks(groups, id_col, (label,), seed).withColumn("fold", (F.col("place") % folds).cast("int"))


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 13) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement."""
    return rows.orderBy(mixed(F.col(id_col), seed=seed), id_col).limit(n)


def sample_per_group(rows: DataFrame, id_col: str, label: str, k: int, seed: int = 13) -> DataFrame:
    return head_per_group(rows, [label], [mixed(F.col(id_col), seed=seed), F.col(id_col)], k)


def stratified_share(rows: DataFrame, id_col: str, label: str, share: float, seed: int = 13) -> DataFrame:
    """The first ``share`` of every label's rows in hashed order, rounded, one row at least."""
    sizes = rows.groupBy(label).agg(F.greatest(F.floor(F.count("*") * F.lit(share) + F.lit(0.5)), F.lit(1)).alias("_k"))
    return ranks(rows, id_col, (label,), seed).join(broadcast_if_small(sizes), label).where(F.col("place") < F.col("_k")).drop("_k", "place")


def resample(rows: DataFrame, id_col: str, draws: int, seed: int = 13) -> DataFrame:
    """``draws`` rows with replacement: draw ``i`` takes the row at a hashed position of the id order."""
    numbered = cumulative(rows.withColumn("_1", F.lit(1).cast("long")), id_col, {"_r": "_1"})
    n = rows.count()
    if not n:
        return numbered.select(F.lit(0).cast("long").alias("draw"), *rows.columns)
    wanted = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), (mixed(F.col("id"), seed=seed) % n + 1).alias("_r"))
    return wanted.join(numbered, "_r").select("draw", *rows.columns)
