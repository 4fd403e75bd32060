"""Metrics of derived predictions and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import experiments as ex
from lexmill.operators import metrics as m
from lexmill.plans.registry import query
from lexmill.sources.tables import load

_PRED = """pred AS (SELECT doc_id, lang AS label, source, doc_id % 5 AS fold,
  CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñíóúá]') THEN 'es' WHEN regexp_matches(text, '[çèêéâ]') THEN 'fr' ELSE 'en' END AS pred
  FROM documents)"""
_COUNTS = """counts AS (SELECT {k} lab AS label, sum(t) AS n_true, sum(p) AS n_pred, sum(tp) AS tp FROM (
  SELECT {k} label AS lab, 1 AS t, 0 AS p, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp FROM {src} UNION ALL SELECT {k} pred, 0, 1, 0 FROM {src}) GROUP BY {k} lab)"""
_MACRO = "round(avg(CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (n_true + n_pred)::DOUBLE END), 9) AS macro_f1, round(sum(tp)::DOUBLE / sum(n_true)::DOUBLE, 9) AS accuracy, sum(n_true)::BIGINT AS n"
_SCORED = """scored AS (SELECT doc_id, CAST(quality AS INTEGER) AS y, n_chars::DOUBLE / (n_chars::DOUBLE + 1500.0::DOUBLE) AS s FROM documents JOIN labels USING (doc_id))"""


def counts_sql(keys: str = "", source: str = "pred") -> str:
    return _COUNTS.format(k=keys, src=source)


def predicted(spark, sf_dir):
    """Language by letters against the language given; folds by id."""
    return load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), "source", (F.col("doc_id") % 5).alias("fold"), tx.guessed_lang(F.col("text")).alias("pred"))


def scored(spark, sf_dir):
    """A score that grows with length, against quality."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n")).join(load(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("int").alias("y"), (F.col("n") / (F.col("n") + F.lit(1500.0))).alias("s"))


def rounded(rows, *columns, digits: int = 9):
    return rows.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT lang, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n)::DOUBLE, 9) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def class_weights(spark, sf_dir):
    return rounded(m.class_weights(load(spark, sf_dir, "documents"), "lang"), "weight")


@query(f"WITH {_PRED}, {counts_sql()} SELECT {_MACRO} FROM counts")
def macro_f1(spark, sf_dir):
    return rounded(m.macro_scores(predicted(spark, sf_dir)), "macro_f1", "accuracy")


@query(f"""WITH {_PRED}, {counts_sql()} SELECT label, round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(n_true, 0), 0), 9) AS recall,
  round(coalesce((2 * tp)::DOUBLE / nullif(n_true + n_pred, 0), 0), 9) AS f1, n_true::BIGINT AS support FROM counts""")
def per_class_prf(spark, sf_dir):
    return rounded(m.per_class(predicted(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {_PRED}, l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lab) SELECT a.lab AS "true", b.lab AS pred, count(p.doc_id) AS n
FROM l a CROSS JOIN l b LEFT JOIN pred p ON p.label = a.lab AND p.pred = b.lab GROUP BY 1, 2""")
def confusion_grid(spark, sf_dir):
    return m.confusion(predicted(spark, sf_dir), ["de", "en", "es", "fr"])


@query(f"""WITH {_PRED} SELECT label AS "true", pred, count(*) AS n FROM pred WHERE label <> pred GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5""")
def top_confusions(spark, sf_dir):
    return m.top_confusions(predicted(spark, sf_dir), 5)


@query(f"""WITH {_PRED}, sliced AS (SELECT *, CASE WHEN label = 'en' THEN 'en' ELSE 'other' END AS slice FROM pred UNION ALL SELECT *, 'all' FROM pred),
{counts_sql("slice,", "sliced")} SELECT slice, {_MACRO} FROM counts GROUP BY slice""")
def slice_metrics(spark, sf_dir):
    slices = F.array(F.lit("all"), F.when(F.col("label").isin("en", "und"), "en").otherwise("other"))
    return rounded(m.macro_scores(predicted(spark, sf_dir).withColumn("slice", F.explode(slices)), keys=("slice",)), "macro_f1", "accuracy")


_COARSE = "CASE WHEN {c} IN ('de', 'en') THEN 'germanic' ELSE 'romance' END"


@query(f"""WITH {_PRED}, coarse AS (SELECT {_COARSE.format(c="label")} AS label, {_COARSE.format(c="pred")} AS pred FROM pred), {counts_sql("", "coarse")} SELECT {_MACRO} FROM counts""")
def coarse_metrics(spark, sf_dir):
    dotted = lambda c: F.concat(F.when(F.col(c).isin("de", "en"), "germanic.").otherwise("romance."), F.col(c))
    rows = predicted(spark, sf_dir).select(tx.parent(dotted("label")).alias("label"), tx.parent(dotted("pred")).alias("pred"))
    return rounded(m.macro_scores(rows), "macro_f1", "accuracy")


@query(f"WITH {_PRED}, {counts_sql('fold,')} SELECT fold, {_MACRO} FROM counts GROUP BY fold")
def fold_f1(spark, sf_dir):
    return rounded(m.macro_scores(predicted(spark, sf_dir), keys=("fold",)), "macro_f1", "accuracy")


@query(f"""WITH {_PRED}, {counts_sql("fold,")}, f AS (SELECT fold, {_MACRO} FROM counts GROUP BY fold)
SELECT round(avg(macro_f1), 8) AS mean_f1, round(stddev_pop(macro_f1), 8) AS std_f1, min(macro_f1) AS least, max(macro_f1) AS most, count(*) AS folds FROM f""")
def oof_report(spark, sf_dir):
    return fold_f1(spark, sf_dir).agg(
        F.round(F.avg("macro_f1"), 8).alias("mean_f1"), F.round(F.stddev_pop("macro_f1"), 8).alias("std_f1"), F.min("macro_f1").alias("least"), F.max("macro_f1").alias("most"), F.count("*").alias("folds")
    )


@query(f"""WITH {_PRED}, {counts_sql("fold,")} SELECT fold, round(coalesce((2 * tp)::DOUBLE / nullif(n_true + n_pred, 0), 0), 9) AS f1 FROM counts WHERE label = 'fr'""")
def single_class_f1(spark, sf_dir):
    return rounded(m.per_class(predicted(spark, sf_dir), keys=("fold",)).where("label = 'fr'").select("fold", "f1"), "f1")


_WHOLE = "round(avg(CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (n_true + n_pred)::DOUBLE END), 9) AS macro_f1, round(sum(tp)::DOUBLE / sum(n_true)::DOUBLE, 9) AS accuracy, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1, sum(n_true)::BIGINT AS n"


@query(f"""WITH {_PRED}, views AS (SELECT 'all' AS part, 'all' AS name, label, pred FROM pred UNION ALL SELECT 'slice', CASE WHEN label = 'en' THEN 'english' ELSE 'non_english' END, label, pred FROM pred
UNION ALL SELECT 'coarse', 'coarse', {_COARSE.format(c="label")}, {_COARSE.format(c="pred")} FROM pred), {counts_sql("part, name,", "views")}
SELECT part, name, {_WHOLE} FROM counts GROUP BY part, name UNION ALL
SELECT 'label', label, NULL, NULL, round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 9), round(coalesce(tp::DOUBLE / nullif(n_true, 0), 0), 9), round(coalesce((2 * tp)::DOUBLE / nullif(n_true + n_pred, 0), 0), 9), n_true::BIGINT FROM counts WHERE part = 'all'""")
def full_report(spark, sf_dir):
    """All rows, slices, merged labels and each label; :func:`full_report_interval` adds the bootstrap interval."""
    slice_of = F.when(F.col("label").isin("en", "und"), "english").otherwise("non_english")
    coarse = lambda c: F.when(c.isin("de", "en"), "germanic").otherwise("romance")
    return rounded(m.full_report(predicted(spark, sf_dir), slice_of, coarse), "macro_f1", "accuracy", "precision", "recall", "f1")


@query()
def full_report_interval(spark, sf_dir):
    """The report with the ends of the interval of 1,000 resamples beside all rows."""
    ends = rounded(ex.bootstrap_counts(predicted(spark, sf_dir), "label", "pred"), "f1_lo", "f1_hi", "acc_lo", "acc_hi")
    return full_report(spark, sf_dir).join(F.broadcast(ends.withColumn("part", F.lit("all"))), "part", "left")


@query(f"""WITH {_SCORED}, b AS (SELECT greatest(ceil(s * 10), 1)::INTEGER AS bin, avg(y::DOUBLE) AS accuracy, avg(s) AS confidence, count(*) AS n FROM scored GROUP BY 1)
SELECT bin, round(accuracy, 9) AS accuracy, round(confidence, 9) AS confidence, n FROM b""")
def reliability(spark, sf_dir):
    return rounded(m.reliability(scored(spark, sf_dir), "s", "y"), "accuracy", "confidence")


@query(f"""WITH {_SCORED}, b AS (SELECT greatest(ceil(s * 10), 1)::INTEGER AS bin, avg(y::DOUBLE) AS accuracy, avg(s) AS confidence, count(*) AS n FROM scored GROUP BY 1)
SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece FROM b""")
def ece(spark, sf_dir):
    return rounded(m.calibration_error(scored(spark, sf_dir), "s", "y"), "ece")


@query(f"WITH {_SCORED} SELECT round(avg(-ln(CASE WHEN y = 1 THEN s ELSE 1 - s END)), 9) AS nll FROM scored")
def nll(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(F.avg(-F.ln(F.when(F.col("y") == 1, F.col("s")).otherwise(1 - F.col("s")))), 9).alias("nll"))


@query(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1)::DOUBLE / 2 AS r FROM scored),
t AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS sr, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * n), 9) AS auroc FROM t""")
def auroc(spark, sf_dir):
    return rounded(m.auroc(scored(spark, sf_dir), "s", "y"), "auroc")


_CURVE = f"""WITH {_SCORED}, g AS (SELECT s, sum(y) AS np, sum(1 - y) AS nn FROM scored GROUP BY s),
c AS (SELECT s, np, sum(np) OVER (ORDER BY s DESC) AS tp, sum(nn) OVER (ORDER BY s DESC) AS fp, sum(np) OVER (ORDER BY s) AS cp, sum(nn) OVER (ORDER BY s) AS cn, sum(np) OVER () AS p, sum(nn) OVER () AS n FROM g)"""


@query(f"{_CURVE} SELECT round(sum(np::DOUBLE / p::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE), 9) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return rounded(m.average_precision(scored(spark, sf_dir), "s", "y"), "average_precision")


@query(f"{_CURVE} SELECT round(s, 9) AS tau, round(cn::DOUBLE / n::DOUBLE, 9) AS retention, round(1 - cp::DOUBLE / p::DOUBLE, 9) AS rejection FROM c")
def retention_curve(spark, sf_dir):
    return rounded(m.retention_curve(scored(spark, sf_dir), "s", "y"), "tau", "retention", "rejection")


@query(f"""WITH {_SCORED}, k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM scored WHERE y = 0),
t AS (SELECT max(CASE WHEN i = ceil((n - 1) * 0.95 - 1e-9) THEN s END) AS hi, max(CASE WHEN i = floor((n - 1) * (1 - 0.95) + 1e-9) THEN s END) AS lo FROM k)
SELECT round(hi, 9) AS tau_higher, round(lo, 9) AS tau_lower, round(avg(CASE WHEN y = 1 THEN CASE WHEN s <= hi THEN 1.0 ELSE 0.0 END END), 9) AS unknown_accepted,
  round(avg(CASE WHEN y = 0 THEN CASE WHEN s <= hi THEN 1.0 ELSE 0.0 END END), 9) AS known_kept FROM scored CROSS JOIN t GROUP BY hi, lo""")
def threshold_report(spark, sf_dir):
    rows = scored(spark, sf_dir)
    known = rows.where("y = 0")
    taus = m.threshold_higher(known, "s", 0.95).withColumnRenamed("tau", "hi").crossJoin(m.threshold_lower(known, "s", 0.95).withColumnRenamed("tau", "lo"))
    kept = (F.col("s") <= F.col("hi")).cast("double")
    return (
        rows.crossJoin(F.broadcast(taus))
        .groupBy("hi", "lo")
        .agg(F.round(F.avg(F.when(F.col("y") == 1, kept)), 9).alias("unknown_accepted"), F.round(F.avg(F.when(F.col("y") == 0, kept)), 9).alias("known_kept"))
        .select(F.round("hi", 9).alias("tau_higher"), F.round("lo", 9).alias("tau_lower"), "unknown_accepted", "known_kept")
    )


@query(f"""WITH {_SCORED}, e AS (SELECT ep, round(avg(CASE WHEN (s >= ep::DOUBLE / 10) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS acc FROM scored CROSS JOIN range(1, 10) t(ep) GROUP BY ep),
b AS (SELECT *, max(acc) OVER (ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e)
SELECT ep AS epoch, acc, coalesce(acc > best_before, true) AS improves, row_number() OVER (ORDER BY acc DESC, ep) = 1 AS best FROM b""")
def best_config(spark, sf_dir):
    grid = F.explode(F.sequence(F.lit(1), F.lit(9)))
    per = scored(spark, sf_dir).withColumn("epoch", grid).groupBy("epoch").agg(F.round(F.avg(((F.col("s") >= F.col("epoch").cast("double") / 10) == (F.col("y") == 1)).cast("double")), 9).alias("acc"))
    one = Window.partitionBy(F.lit(1))
    before = F.max("acc").over(one.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return per.select(F.col("epoch").cast("long"), "acc", F.coalesce(F.col("acc") > before, F.lit(True)).alias("improves"), (F.row_number().over(one.orderBy(F.col("acc").desc(), "epoch")) == 1).alias("best"))


@query(f"""WITH {_SCORED}, g AS (SELECT ep::BIGINT AS epoch, doc_id % 5 AS fold, y AS label, CASE WHEN s >= ep::DOUBLE / 10 THEN 1 ELSE 0 END AS pred FROM scored CROSS JOIN range(1, 10) t(ep)),
pooled AS (WITH {counts_sql("epoch,", "g")} SELECT epoch, {_MACRO} FROM counts GROUP BY epoch), folds AS (WITH {counts_sql("epoch, fold,", "g")} SELECT epoch, fold, {_MACRO} FROM counts GROUP BY epoch, fold),
f AS (SELECT epoch, round(avg(macro_f1), 8) AS fold_mean, round(stddev_pop(macro_f1), 8) AS fold_std FROM folds GROUP BY epoch)
SELECT epoch, macro_f1, accuracy, fold_mean, fold_std, row_number() OVER (ORDER BY macro_f1 DESC, epoch) = 1 AS best FROM pooled JOIN f USING (epoch)""")
def epoch_report(spark, sf_dir):
    """Pooled and by fold at every epoch (here a threshold); the best has the largest pooled macro-F1, the first of equals."""
    grid = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long")))
    rows = scored(spark, sf_dir).withColumn("epoch", grid).select("epoch", (F.col("doc_id") % 5).alias("fold"), F.col("y").alias("label"), (F.col("s") >= F.col("epoch").cast("double") / 10).cast("int").alias("pred"))
    pooled = rounded(m.macro_scores(rows, keys=("epoch",)), "macro_f1", "accuracy").drop("n")
    folds = rounded(m.macro_scores(rows, keys=("epoch", "fold")), "macro_f1").groupBy("epoch").agg(F.round(F.avg("macro_f1"), 8).alias("fold_mean"), F.round(F.stddev_pop("macro_f1"), 8).alias("fold_std"))
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("macro_f1").desc(), "epoch"))
    return pooled.join(folds, "epoch").withColumn("best", first == 1)
