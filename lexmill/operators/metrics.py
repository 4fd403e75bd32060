"""Classification metrics as aggregates. Inputs are columns of labels, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.cumulative import by_score, cumulative


def label_counts(rows: DataFrame, label: str = "label", pred: str = "pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """``n_true``, ``n_pred`` and ``tp`` of every label that occurs as either, per group of ``keys``.

    Pairs are counted first, so what is shuffled has the size of a confusion matrix.
    """
    pairs = rows.groupBy(*keys, F.col(label).alias("_t"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    sides = F.array(F.struct(F.col("_t").alias("label"), F.lit(1).alias("true")), F.struct(F.col("_p").alias("label"), F.lit(0).alias("true")))
    long = pairs.select(*keys, "_t", "_p", "_n", F.explode(sides).alias("s"))
    is_true = F.col("s.true") == 1
    return long.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.when(is_true, F.col("_n")).otherwise(0)).alias("n_true"),
        F.sum(F.when(~is_true, F.col("_n")).otherwise(0)).alias("n_pred"),
        F.sum(F.when(is_true & (F.col("_t") == F.col("_p")), F.col("_n")).otherwise(0)).alias("tp"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b.cast("double"))


def f1_of(tp: Column, n_true: Column, n_pred: Column) -> Column:
    return _ratio(2 * tp, n_true + n_pred)


def macro_scores(rows: DataFrame, label: str = "label", pred: str = "pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """``macro_f1`` over the labels that occur as true or predicted, ``accuracy`` and ``n``, per group of ``keys``."""
    counts = label_counts(rows, label, pred, keys)
    return counts.groupBy(*keys).agg(
        F.avg(f1_of(F.col("tp"), F.col("n_true"), F.col("n_pred"))).alias("macro_f1"), (F.sum("tp").cast("double") / F.sum("n_true").cast("double")).alias("accuracy"), F.sum("n_true").alias("n")
    )


def per_class(rows: DataFrame, label: str = "label", pred: str = "pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    c = label_counts(rows, label, pred, keys)
    return c.select(
        *keys,
        "label",
        _ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        _ratio(F.col("tp"), F.col("n_true")).alias("recall"),
        f1_of(F.col("tp"), F.col("n_true"), F.col("n_pred")).alias("f1"),
        F.col("n_true").alias("support"),
    )


def full_report(rows: DataFrame, slice_of: Column, coarse_of, label: str = "label", pred: str = "pred") -> DataFrame:
    """Everything at once, as rows of ``part`` and ``name``: all rows, slices, merged labels, and each label.

    ``macro_f1``, ``accuracy`` and ``n`` of the first three parts; ``precision``,
    ``recall``, ``f1`` and ``n`` of the labels. ``coarse_of`` maps a column of labels
    to the merged ones. Rows are counted once, by slice, label and prediction.
    """
    counts = rows.groupBy(slice_of.alias("slice"), F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("_c"))
    views = F.array(
        F.struct(F.lit("all").alias("part"), F.lit("all").alias("name"), F.col("label").alias("t"), F.col("pred").alias("p")),
        F.struct(F.lit("slice").alias("part"), F.col("slice").alias("name"), F.col("label").alias("t"), F.col("pred").alias("p")),
        F.struct(F.lit("coarse").alias("part"), F.lit("coarse").alias("name"), coarse_of(F.col("label")).alias("t"), coarse_of(F.col("pred")).alias("p")),
    )
    viewed = counts.select(F.explode(views).alias("v"), "_c").groupBy("v.part", "v.name", "v.t", "v.p").agg(F.sum("_c").alias("_c"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("true")), F.struct(F.col("p").alias("label"), F.lit(0).alias("true")))
    per = viewed.select("part", "name", "t", "p", "_c", F.explode(sides).alias("s")).groupBy("part", "name", F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.true") == 1, F.col("_c")).otherwise(0)).alias("n_true"),
        F.sum(F.when(F.col("s.true") == 0, F.col("_c")).otherwise(0)).alias("n_pred"),
        F.sum(F.when((F.col("s.true") == 1) & (F.col("t") == F.col("p")), F.col("_c")).otherwise(0)).alias("tp"),
    )
    f1, none = f1_of(F.col("tp"), F.col("n_true"), F.col("n_pred")), F.lit(None).cast("double")
    whole = per.groupBy("part", "name").agg(F.avg(f1).alias("macro_f1"), (F.sum("tp").cast("double") / F.sum("n_true").cast("double")).alias("accuracy"), F.sum("n_true").alias("n"))
    each = per.where("part = 'all'").select(
        F.lit("label").alias("part"), F.col("label").alias("name"), F.col("n_true").alias("n"), _ratio(F.col("tp"), F.col("n_pred")).alias("precision"), _ratio(F.col("tp"), F.col("n_true")).alias("recall"), f1.alias("f1")
    )
    columns = ["part", "name", "macro_f1", "accuracy", "precision", "recall", "f1", "n"]
    return whole.withColumns({c: none for c in ("precision", "recall", "f1")}).select(columns).unionByName(each.withColumns({c: none for c in ("macro_f1", "accuracy")}).select(columns))


def histogram(rows: DataFrame, value: str, bins: int = 25, lo: float = 0.0, hi: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``bin`` (from 1), ``n`` and ``density`` over equal bins ``[lo, hi)``, the last one closed; empty bins are absent, values outside are left out."""
    inside = rows.where(F.col(value).between(lo, hi))
    number = F.least(F.width_bucket(F.col(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins)).cast("int")
    counts = inside.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, F.lit(1)))
    return counts.withColumn("density", F.col("n").cast("double") * F.lit(bins / (hi - lo)) / total.cast("double"))


def confusion(rows: DataFrame, labels: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts over the full grid of ``labels``, zeros kept."""
    grid = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "true string, pred string")
    counts = rows.groupBy(F.col(label).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def top_confusions(rows: DataFrame, most: int, label: str = "label", pred: str = "pred") -> DataFrame:
    wrong = rows.where(F.col(label) != F.col(pred)).groupBy(F.col(label).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.col("n").desc(), "true", "pred").limit(most)


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``n / (classes * count)``."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    return counts.select(label, "n", (F.sum("n").over(every).cast("double") / (F.count("*").over(every) * F.col("n")).cast("double")).alias("weight"))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Accuracy, mean confidence and count of each bin ``(lo, hi]``; empty bins are absent."""
    number = F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1)).cast("int")
    return rows.groupBy(number.alias("bin")).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"), F.count("*").alias("n"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    table = reliability(rows, confidence, correct, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def _scored(rows: DataFrame, score: str, positive: str, keys: tuple[str, ...]) -> DataFrame:
    """Distinct scores with running and total counts."""
    table = cumulative(by_score(rows, score, positive, keys), score, {"cum_pos": "n_pos", "cum_neg": "n_neg"}, keys)
    totals = rows.groupBy(*keys).agg(F.sum(positive).cast("long").alias("pos"), F.sum(1 - F.col(positive)).cast("long").alias("neg"))
    # One row is broadcast; a table of groups joins as its size asks for.
    return table.join(totals, list(keys)) if keys else table.crossJoin(F.broadcast(totals))


def auroc(rows: DataFrame, score: str, positive: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Probability that a positive outscores a negative, ties one half; null without both."""
    table = _scored(rows, score, positive, keys)
    won = F.col("n_pos").cast("double") * (F.col("cum_neg") - F.col("n_neg") / F.lit(2).cast("double"))
    return table.groupBy(*keys, "pos", "neg").agg(F.sum(won).alias("_w")).select(*keys, F.try_divide(F.col("_w"), F.col("pos").cast("double") * F.col("neg")).alias("auroc"))


def average_precision(rows: DataFrame, score: str, positive: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of recall steps times precision over distinct scores, largest first."""
    table = _scored(rows, score, positive, keys)
    tp = (F.col("pos") - F.col("cum_pos") + F.col("n_pos")).cast("double")
    fp = (F.col("neg") - F.col("cum_neg") + F.col("n_neg")).cast("double")
    step = F.col("n_pos").cast("double") / F.col("pos") * tp / (tp + fp)
    return table.where("pos > 0").groupBy(*keys).agg(F.sum(step).alias("average_precision"))


def retention_curve(rows: DataFrame, score: str, unknown: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """At each distinct score: share of known rows at or below it, share of unknown rows above it."""
    table = _scored(rows, score, unknown, keys)
    return table.select(
        *keys, F.col(score).alias("tau"), F.try_divide(F.col("cum_neg").cast("double"), F.col("neg").cast("double")).alias("retention"), (1 - F.try_divide(F.col("cum_pos").cast("double"), F.col("pos").cast("double"))).alias("rejection")
    )


def order_statistic(rows: DataFrame, score: str, index: Column, keys: tuple[str, ...] = (), name: str = "tau") -> DataFrame:
    """The value at a position from 0 of each group's ascending scores; ``index`` is an expression in ``n``."""
    table = cumulative(rows.groupBy(*keys, score).agg(F.count("*").alias("_c")), score, {"_cum": "_c"}, keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, index.cast("long").alias("_i"))
    joined = table.join(sizes, list(keys)) if keys else table.crossJoin(F.broadcast(sizes))
    return joined.where(F.col("_cum") > F.col("_i")).groupBy(*keys).agg(F.min(score).alias(name))


def threshold_lower(rows: DataFrame, score: str, retention: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantile ``1 - retention`` by the lower neighbour: confidences at or above it are kept."""
    return order_statistic(rows, score, F.floor((F.col("n") - 1) * F.lit(1 - retention).cast("double") + F.lit(1e-9)), keys)


def threshold_higher(rows: DataFrame, score: str, retention: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantile ``retention`` by the higher neighbour: scores at or below it are kept."""
    return order_statistic(rows, score, F.ceil((F.col("n") - 1) * F.lit(retention).cast("double") - F.lit(1e-9)), keys)


def ks_statistic(rows: DataFrame, score: str, second: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest distance of the two samples' distribution functions."""
    table = _scored(rows, score, second, keys)
    gap = F.abs(F.col("cum_pos").cast("double") / F.col("pos") - F.col("cum_neg").cast("double") / F.col("neg"))
    return table.where("pos > 0 and neg > 0").groupBy(*keys).agg(F.max(gap).alias("ks"))
