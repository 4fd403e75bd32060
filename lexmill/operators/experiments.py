"""Resampled intervals, paired comparisons, winner rule, counterfactual copies and active learning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators.metrics import macro_scores
from lexmill.operators.selection import smallest
from lexmill.operators.splits import mixed
from lexmill.sources.shared import cut

PREFIXES = tuple(tx.PREFIX_CLASS)
#: The prime that arithmetic hashes of places are taken by, and the steps between ids and copies.
MODULUS = 2147483647
COPY_STEP, PLACE_STEP = 1000003, 7919
#: A pattern that matches nothing.
NEVER = "(?!)"


def scattered(number: Column) -> Column:
    """A number below ``MODULUS`` that any SQL engine can repeat: two products and a shift mix the bits."""
    once = F.pmod(number, F.lit(MODULUS)) * 48271 % MODULUS
    return (once.bitwiseXOR(F.shiftright(once, 15)) * 69621) % MODULUS


def bootstrap(rows: DataFrame, id_col: str, label: str, pred: str, replicates: int, seed: int = 13) -> DataFrame:
    """Percentile interval of macro-F1 and accuracy over resamples with replacement, which SQL can repeat draw by draw.

    A resample of rows only matters through its pairs of label and prediction, so
    each draw picks a pair by a hashed place among the cumulated pair counts; rows are
    neither numbered nor joined. The work is rows times replicates:
    :func:`bootstrap_counts` draws the same distribution at a cost that does not grow.
    """
    pairs = rows.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(1)).orderBy("label", "pred").rowsBetween(Window.unboundedPreceding, 0)
    table = pairs.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c"))
    n = rows.count()
    draws = rows.sparkSession.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("b"), (mixed(F.col("id"), seed=seed) % max(n, 1)).alias("r"))
    # A confusion matrix: labels squared rows.
    met = draws.join(F.broadcast(table), (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).groupBy("b", "label", "pred").agg(F.count("*").alias("k"))
    sides = met.select("b", "label", "pred", "k", F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("l"), F.lit(0).alias("t")))).alias("s"))
    per = sides.groupBy("b", "s.l").agg(F.sum(F.when(F.col("s.t") == 1, F.col("k")).otherwise(0)).alias("nt"), F.sum(F.when(F.col("s.t") == 0, F.col("k")).otherwise(0)).alias("np"), F.sum(F.when((F.col("s.t") == 1) & (F.col("label") == F.col("pred")), F.col("k")).otherwise(0)).alias("tp"))
    scores = per.groupBy("b").agg(F.avg((2 * F.col("tp")).cast("double") / (F.col("nt") + F.col("np")).cast("double")).alias("f1"), (F.sum("tp").cast("double") / F.sum("nt").cast("double")).alias("acc"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return scores.agg(q("f1", 0.025).alias("f1_lo"), q("f1", 0.975).alias("f1_hi"), q("acc", 0.025).alias("acc_lo"), q("acc", 0.975).alias("acc_hi"))


def bootstrap_counts(rows: DataFrame, label: str, pred: str, replicates: int = 1000, seed: int = 13) -> DataFrame:
    """The interval of :func:`bootstrap` with a resample drawn as multinomial counts over the confusion matrix.

    Its cost does not grow with the rows but for their count by pair: labels squared rows reach the driver.
    """
    pairs = rows.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("c")).orderBy("label", "pred").collect()
    schema = "f1_lo double, f1_hi double, acc_lo double, acc_hi double"
    if not pairs:
        return rows.sparkSession.createDataFrame([(None,) * 4], schema)
    names = {v: k for k, v in enumerate(dict.fromkeys(v for r in pairs for v in (r["label"], r["pred"])))}
    true, said, c = (np.array(x) for x in zip(*[(names[r["label"]], names[r["pred"]], r["c"]) for r in pairs], strict=True))
    rng, n, f1, acc = np.random.default_rng(seed), int(c.sum()), [], []
    for _ in range(replicates):
        k = rng.multinomial(n, c / n)
        sides = np.bincount(true, k, len(names)) + np.bincount(said, k, len(names))
        tp = np.bincount(true[true == said], k[true == said], len(names))
        f1.append((2 * tp[sides > 0] / sides[sides > 0]).mean())
        acc.append(tp.sum() / n)
    ends = [float(x) for values in (f1, acc) for x in np.percentile(values, [2.5, 97.5])]
    return rows.sparkSession.createDataFrame([tuple(ends)], schema)


def paired(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Mean difference ``a - b``, folds better, tied and worse, and the verdict. Folds that one side lacks do not count."""
    d = a.select(on, F.col(value).alias("_a")).join(b.select(on, F.col(value).alias("_b")), on).select((F.col("_a") - F.col("_b")).alias("d"))
    sums = d.agg(F.avg("d").alias("mean_diff"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") == 0).alias("tied"), F.count_if(F.col("d") < 0).alias("worse"), F.count("*").alias("n"))
    verdict = F.when((F.col("mean_diff") > 0) & (F.col("better") > F.col("n") / 2), "helps").when((F.col("mean_diff") < -0.01) & (F.col("worse") > F.col("n") / 2), "hurts").otherwise("no difference")
    return sums.withColumn("verdict", verdict)


def winner(runs: DataFrame, name: str, score: str, spread: str, size: str) -> DataFrame:
    """The best run; of the best two, if they are within one spread of the best, the smaller one."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(score).desc(), name)
    ranked = runs.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead(F.struct(name, score, size)).over(w)).where("_r = 1")
    close = F.col("_next").isNotNull() & (F.col(score) - F.col(f"_next.{score}") <= F.col(spread)) & (F.col(f"_next.{size}") < F.col(size))
    return ranked.select(F.when(close, F.col(f"_next.{name}")).otherwise(F.col(name)).alias("winner"), F.when(close, "smaller within one spread").otherwise("best").alias("reason"))


def swapped(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every row with an entity id, once for each other prefix: ``original``, ``swapped_to`` and ``probe``."""
    prefixes = F.array(*[F.lit(p) for p in PREFIXES])
    own = tx.entity_prefix(F.col(text))
    with_id = rows.withColumn("original", own).where(F.col("original") != "")
    others = with_id.withColumn("swapped_to", F.explode(F.array_except(prefixes, F.array("original"))))
    return others.select(*keep, "original", "swapped_to", tx.swap_prefix(F.col(text), F.col("swapped_to")).alias("probe"))


def swap_copies(rows: DataFrame, id_col: str, text: str, keep: list[str], least_words: int = 6) -> DataFrame:
    """One copy of each row with an entity id and ``least_words`` words, under another prefix chosen by a hash of its id."""
    prefixes = F.array(*[F.lit(p) for p in PREFIXES])
    base = rows.withColumn("_own", tx.entity_prefix(F.col(text))).where((F.col("_own") != "") & (tx.n_words(F.col(text)) >= least_words))
    others = F.array_except(prefixes, F.array("_own"))
    choice = F.element_at(others, (F.col(id_col) * 7919 % F.size(others) + 1).cast("int"))
    return base.withColumn("swapped_to", choice).select(*keep, "swapped_to", tx.swap_prefix(F.col(text), F.col("swapped_to")).alias("copy"))


def noisy_copies(rows: DataFrame, id_col: str, text: str, copies: int, rate: float = 0.04, seed: int = 3) -> DataFrame:
    """``id``, ``copy``, ``text``: ``copies`` of each text as it might be typed in a hurry.

    Hashes of id, copy and place decide: each shorthand is used by half the copies,
    half are lower-cased, three in ten lose their punctuation. A share ``rate`` of
    the letters is touched, a third each way: dropped, doubled, or swapped with the
    next character (pairs of places do, so that no two swaps meet). A text that
    would vanish stays as it is; null gives null. Expressions over columns alone.
    """
    every = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), F.col(text).alias("text"))
    base = F.pmod("id", F.lit(MODULUS)) * COPY_STEP + F.col("copy") * PLACE_STEP + seed
    chance = lambda place: scattered(base + place)
    typed = F.col("text")
    # Each step names the text before it once: twice, and its cost would double with every step.
    for place, (word, short) in enumerate(tx.SHORTHAND.items()):
        pattern = F.when(chance(F.lit(place)) < MODULUS // 2, rf"(?i)\b{word}\b").otherwise(NEVER)
        typed = F.regexp_replace(typed, pattern, F.lit(short))
    typed = F.regexp_replace(typed, F.when(chance(F.lit(101)) < MODULUS * 3 // 10, "[?.!,]").otherwise(NEVER), F.lit(""))
    typed = F.when(chance(F.lit(100)) < MODULUS // 2, F.lower(typed)).otherwise(typed)
    third = int(MODULUS * rate / 3)
    # A variable for the characters: inside the function they would be made anew for every place.
    letter = lambda c: c.rlike(r"\p{L}")

    def changed(chars: Column) -> Column:
        def at(c: Column, i: Column) -> Column:
            pair = i.cast("long") - i % 2
            swapped = letter(chars[pair.cast("int")]) & (pair + 1 < F.size(chars)) & (chance(1000 + pair) < 2 * third)
            other = chars[F.when(i % 2 == 0, i + 1).otherwise(i - 1)]
            fate = chance(F.lit(1_000_000) + i)
            own = F.when(letter(c) & (fate < third), "").when(letter(c) & (fate < 2 * third), F.concat(c, c)).otherwise(c)
            return F.when(swapped, other).otherwise(own)

        return F.array_join(F.transform(chars, at), "")

    made = every.withColumn("_made", F.transform(F.array(F.split(typed, "")), changed)[0])
    return made.select("id", "copy", F.when(F.col("_made") == "", F.col("text")).otherwise(F.col("_made")).alias("text"))


def flips(rows: DataFrame, before: Column, after: Column, keys: tuple[str, ...]) -> DataFrame:
    """Share of rows whose prediction changes, by ``keys``."""
    return rows.groupBy(*keys).agg(F.avg((before != after).cast("double")).alias("flip_rate"), F.count("*").alias("n"))


def active_learning(pool: DataFrame, seeds: DataFrame, id_col: str, keys: tuple[str, ...], fractions: list[float], confidence: Callable[[DataFrame, DataFrame], DataFrame], predict: Callable[[DataFrame], DataFrame], orders: dict[str, Column], done: DataFrame | None = None) -> DataFrame:
    """Grow the labelled part of each pool to each fraction of it, and evaluate a classifier of what is labelled.

    ``pool`` and ``seeds`` have ``keys``, one of them ``strategy``; all groups grow at
    the same time, so a step is one job, however many folds and strategies there
    are. ``orders`` has the strategies that pick by an order of their own; the
    others pick the rows least sure by ``confidence(labelled, rest)``. ``predict``
    gives ``label`` and ``pred`` of the evaluation rows by what is labelled. Groups in
    ``done`` (an earlier result) are not grown again; their rows are returned.
    """
    rest_of = lambda labelled: pool.join(labelled, [*keys, id_col], "left_anti")
    if done is not None:
        finished = done.where(F.col("fraction") == fractions[-1]).select(*keys).distinct()
        pool, seeds = pool.join(F.broadcast(finished), list(keys), "left_anti"), seeds.join(F.broadcast(finished), list(keys), "left_anti")
    sizes = cut(pool.groupBy(*keys).agg(F.count("*").alias("_all")), "sizes")  # a row a group
    labelled, found = cut(seeds.select(*keys, id_col), "labelled"), []
    for fraction in fractions:
        want = sizes.join(labelled.groupBy(*keys).agg(F.count("*").alias("_have")), list(keys), "left")
        want = want.select(*keys, (F.floor(F.col("_all") * F.lit(fraction) + F.lit(0.5)) - F.coalesce("_have", F.lit(0))).alias("_want")).where("_want > 0")
        rest = rest_of(labelled)
        sure = confidence(pool.join(labelled, [*keys, id_col], "left_semi"), rest.where(~F.col("strategy").isin(*orders)))
        picked = [sure.select(*keys, id_col, F.round("confidence", 9).alias("_order"))]
        picked += [rest.where(F.col("strategy") == name).select(*keys, id_col, order.cast("double").alias("_order")) for name, order in orders.items()]
        chosen = smallest(cut(reduce(DataFrame.unionByName, picked), "pool"), list(keys), "_order", id_col, want, "_want")
        labelled = cut(labelled.unionByName(chosen), "labelled")
        scores = macro_scores(predict(pool.join(labelled, [*keys, id_col], "left_semi")), keys=keys)
        counts = labelled.groupBy(*keys).agg(F.count("*").alias("n_labelled"))
        found.append(scores.join(F.broadcast(counts), list(keys)).select(*keys, F.lit(fraction).alias("fraction"), "n_labelled", "macro_f1", "accuracy", "n"))
    made = cut(reduce(DataFrame.unionByName, found), "curve")
    return made if done is None else done.unionByName(made)
