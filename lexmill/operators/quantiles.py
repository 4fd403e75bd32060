"""Exact quantiles of groups of any size: mergeable sketches bound them, one pass between the bounds settles them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.cumulative import cumulative
from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import cut

#: Size of a sketch, and the error of a rank that its bounds allow for: some three times the usual one.
SKETCH, ERROR = 800, 0.01


def sketched(rows: DataFrame, value: str, keys: tuple[str, ...] = (), size: int = SKETCH) -> DataFrame:
    """``sketch``, ``n``, ``least`` and ``most`` of the values of each group; null and NaN are no values.

    The rows may be kept, by day say, and merged by :func:`merged` whenever quantiles are asked for.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    return kept.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merged(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The sketches of finer groups, as one of each group of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _group(keys: tuple[str, ...]) -> Column:
    """One column that names a group: a struct, so that null keys meet each other in joins."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...] = (), sketches: DataFrame | None = None, error: float = ERROR) -> DataFrame:
    """``keys``, ``n`` and ``quantiles``: of each group, interpolated as usual between the two order statistics next to ``(n - 1) * share``.

    ``sketches`` may hold a row a group that is kept already. Between two bounds from
    its sketch a share of some ``2 * error`` of a group's values is counted by
    value, what lies below only counted; the order statistics are found by sums over
    ranges of values, so no group meets in one task. A sketch gives its bounds by
    chance: a group whose statistic they miss is done again with its least and
    largest value as bounds. Groups without values have no row.
    """
    found = sketched(rows, value, keys) if sketches is None else sketches
    inner = lambda s: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, s))))
    low = lambda s: F.col("least") if s - error <= 0 else inner(s - error)
    high = lambda s: F.col("most") if s + error >= 1 else inner(s + error)
    ends = F.array(*[F.struct(low(s).alias("lo"), high(s).alias("hi")) for s in shares])
    whole = F.array_repeat(F.struct(F.col("least").alias("lo"), F.col("most").alias("hi")), len(shares))
    bounds = cut(found.where("n > 0").select(_group(keys).alias("_g"), "n", ends.alias("ends"), whole.alias("whole")), "bounds")  # a row a group
    made = _refined(rows, value, shares, keys, bounds)
    lost = F.exists("quantiles", lambda q: q.isNull())
    if not (missed := made.where(lost).select("_g")).isEmpty():
        again = bounds.join(missed, "_g", "left_semi").withColumn("ends", F.col("whole"))
        made = made.where(~lost).unionByName(_refined(rows, value, shares, keys, cut(again, "bounds")))
    return made.select(*[F.col(f"_g.`{k}`").alias(k) for k in keys], "n", "quantiles")


def _refined(rows: DataFrame, value: str, shares: tuple[float, ...], keys: tuple[str, ...], bounds: DataFrame) -> DataFrame:
    """Exact quantiles of each group by the bounds of each share; null where the bounds miss one."""
    v = F.col(value).cast("double")
    met = rows.where(v.isNotNull() & ~F.isnan(v)).select(_group(keys).alias("_g"), v.alias("v")).join(broadcast_if_small(bounds.select("_g", "ends")), "_g")
    # Of each share: values between its bounds, and null for each below them.
    seen = F.transform("ends", lambda e, j: F.struct(j.alias("j"), F.when(F.col("v") >= e["lo"], F.col("v")).alias("v"), (F.col("v") <= e["hi"]).alias("ok")))
    each = met.select("_g", F.explode(F.filter(seen, lambda x: x["ok"])).alias("x"))
    counts = cut(each.groupBy("_g", "x.j", "x.v").agg(F.count("*").alias("c")), "between")
    place = (F.col("n") - 1) * F.col("share")
    # A place that is whole but for the rounding of the product is whole.
    place = F.when(F.abs(place - F.round(place)) < 1e-9, F.round(place)).otherwise(place)
    wanted = bounds.select("_g", "n", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("j", "share"))
    wanted = wanted.select("_g", "j", "n", F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("part"))
    below = counts.where("v is null").select("_g", "j", F.col("c").alias("below"))
    running = cumulative(counts.where("v is not null"), "v", {"upto": "c"}, ("_g", "j"))
    found = wanted.join(below, ["_g", "j"], "left").na.fill(0, ["below"]).join(running, ["_g", "j"], "left")
    end = F.col("below") + F.col("upto")
    at = lambda p: F.max(F.when((F.col(p) < end) & (F.col(p) >= end - F.col("c")), F.col("v")))
    one = found.groupBy("_g", "j", "n", "part").agg(at("low").alias("a"), at("high").alias("b"))
    values = F.sort_array(F.collect_list(F.struct("j", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q"))))  # one a share
    return one.groupBy("_g", "n").agg(F.transform(values, lambda x: x["q"]).alias("quantiles"))
