"""Intervals, comparisons of variants, counterfactual copies and learning curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vec
from lexmill.operators import experiments as ex
from lexmill.operators import metrics as m
from lexmill.operators import openset, stopping
from lexmill.operators.splits import mixed, mixed_sql, stratified_share
from lexmill.plans.evaluation import _PRED, counts_sql, predicted, rounded
from lexmill.plans.registry import query
from lexmill.sources.tables import load

#: Fixed value: replicates of an interval.
_B = 1000


@query(f"""WITH {_PRED}, pc AS (SELECT label, pred, count(*) AS c FROM pred GROUP BY 1, 2), tb AS (SELECT *, sum(c) OVER (ORDER BY label, pred) AS hi FROM pc), nn AS (SELECT count(*) AS n FROM pred),
dr AS (SELECT id // n AS b, {mixed_sql("id")} % n AS r FROM range(0, (SELECT {_B} * n FROM nn)) t(id) CROSS JOIN nn),
met AS (SELECT b, label, pred, count(*) AS k FROM dr JOIN tb ON r >= hi - c AND r < hi GROUP BY 1, 2, 3),
sides AS (SELECT b, label AS l, k AS nt, 0 AS np, CASE WHEN label = pred THEN k ELSE 0 END AS tp FROM met UNION ALL SELECT b, pred, 0, k, 0 FROM met),
per AS (SELECT b, l, sum(nt) AS nt, sum(np) AS np, sum(tp) AS tp FROM sides GROUP BY 1, 2),
s AS (SELECT b, avg((2 * tp)::DOUBLE / (nt + np)::DOUBLE) AS f1, sum(tp)::DOUBLE / sum(nt)::DOUBLE AS acc FROM per GROUP BY b)
SELECT round(quantile_cont(f1, 0.025), 8) AS f1_lo, round(quantile_cont(f1, 0.975), 8) AS f1_hi, round(quantile_cont(acc, 0.025), 8) AS acc_lo, round(quantile_cont(acc, 0.975), 8) AS acc_hi FROM s""")
def bootstrap_ci(spark, sf_dir):
    return rounded(ex.bootstrap(predicted(spark, sf_dir), "doc_id", "label", "pred", _B), "f1_lo", "f1_hi", "acc_lo", "acc_hi", digits=8)


@query()
def bootstrap_ci_1000(spark, sf_dir):
    """The interval of ``bootstrap_ci`` from multinomial counts over the confusion matrix, at a cost that does not grow with the rows."""
    return rounded(ex.bootstrap_counts(predicted(spark, sf_dir), "label", "pred"), "f1_lo", "f1_hi", "acc_lo", "acc_hi", digits=8)


_P = str(list(ex.PREFIXES))
_MARKED = "marked AS (SELECT doc_id, length(text) AS chars, text || ' ' || (" + _P + ")[doc_id % 5 + 1] || '-' || CAST(10000 + doc_id % 80000 AS VARCHAR) AS text, (" + _P + ")[doc_id % 5 + 1] AS original FROM documents)"
_SWAP = "regexp_replace(text, '(^|[^A-Za-z])(APT|PO|DOC|TR|LD)-([0-9]+)', '\\1' || swapped_to || '-\\3', 'g')"
_OTHERS = f"unnest(list_filter({_P}, lambda p: p <> original))"


def marked(spark, sf_dir):
    """Documents with a synthetic entity id at the end."""
    prefix = F.element_at(F.array(*[F.lit(p) for p in ex.PREFIXES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.concat_ws("", F.col("text"), F.lit(" "), prefix, F.lit("-"), (10000 + F.col("doc_id") % 80000).cast("string")).alias("text"))


@query(f"WITH {_MARKED}, p AS (SELECT *, {_OTHERS} AS swapped_to FROM marked) SELECT doc_id, original, swapped_to, md5({_SWAP}) AS probe FROM p")
def id_swap_probe(spark, sf_dir):
    return ex.swapped(marked(spark, sf_dir), "text", ["doc_id"]).withColumn("probe", F.md5("probe"))


@query(f"""WITH {_MARKED}, o AS (SELECT *, list_filter({_P}, lambda p: p <> original) AS others FROM marked WHERE len(regexp_extract_all(text, '\\S+')) >= 6),
p AS (SELECT *, others[(doc_id * 7919 % 4) + 1] AS swapped_to FROM o) SELECT doc_id, swapped_to, md5({_SWAP}) AS copy FROM p""")
def idswap_copies(spark, sf_dir):
    return ex.swap_copies(marked(spark, sf_dir), "doc_id", "text", ["doc_id"]).withColumn("copy", F.md5("copy"))


_CLASS = "CASE WHEN chars % 3 = 0 THEN {p} ELSE 'other' END"


@query(f"""WITH {_MARKED}, p AS (SELECT *, {_OTHERS} AS swapped_to FROM marked)
SELECT swapped_to, round(avg(CASE WHEN {_CLASS.format(p="original")} <> {_CLASS.format(p="swapped_to")} THEN 1.0 ELSE 0.0 END), 9) AS flip_rate, count(*) AS n FROM p GROUP BY swapped_to""")
def flip_rates(spark, sf_dir):
    probes = ex.swapped(marked(spark, sf_dir), "text", ["doc_id", "chars"])
    predict = lambda prefix: F.when(F.col("chars") % 3 == 0, prefix).otherwise("other")
    return rounded(ex.flips(probes, predict(F.col("original")), predict(tx.entity_prefix(F.col("probe"))), ("swapped_to",)), "flip_rate")


def _scattered(number: str) -> str:
    once = f"(({number}) % {ex.MODULUS} * 48271 % {ex.MODULUS})"
    return f"(xor({once}, {once} >> 15) * 69621 % {ex.MODULUS})"


def _noise_sql() -> str:
    half, third = ex.MODULUS // 2, int(ex.MODULUS * 0.04 / 3)
    chance = lambda place: _scattered(f"base + {place}")
    steps, name = [], "text"
    for place, (word, short) in enumerate(tx.SHORTHAND.items()):
        pattern = word.replace("'", "''")
        steps.append(f"s{place} AS (SELECT id, copy, text, base, CASE WHEN {chance(place)} < {half} THEN regexp_replace({name}, '\\b{pattern}\\b', '{short}', 'gi') ELSE {name} END AS typed FROM {'every' if not place else f's{place - 1}'})")
        name = "typed"
    last = f"s{len(tx.SHORTHAND) - 1}"
    pair = "(i - i % 2)"
    return f"""WITH every AS (SELECT conv_id * 1000 + turn AS id, c AS copy, text, (conv_id * 1000 + turn) % {ex.MODULUS} * {ex.COPY_STEP} + c * {ex.PLACE_STEP} + 3 AS base FROM conversations CROSS JOIN range(1, 3) r(c)),
{", ".join(steps)}, low AS (SELECT id, copy, text, base, CASE WHEN {chance(100)} < {half} THEN lower(typed) ELSE typed END AS typed FROM {last}),
bare AS (SELECT id, copy, text, base, string_split(CASE WHEN {chance(101)} < {ex.MODULUS * 3 // 10} THEN translate(typed, '?.!,', '') ELSE typed END, '') AS chars FROM low),
places AS (SELECT id, copy, text, base, chars, unnest(range(0, len(chars))) AS i FROM bare),
fates AS (SELECT id, copy, text, i, chars[i + 1] AS c, chars[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END] AS other,
  regexp_matches(chars[{pair} + 1], '\\p{{L}}') AND {pair} + 1 < len(chars) AND {_scattered(f"base + 1000 + {pair}")} < {2 * third} AS swapped, {chance("1000000 + i")} AS fate FROM places),
made AS (SELECT id, copy, any_value(text) AS text, string_agg(CASE WHEN swapped THEN other WHEN regexp_matches(c, '\\p{{L}}') AND fate < {third} THEN '' WHEN regexp_matches(c, '\\p{{L}}') AND fate < {2 * third} THEN c || c ELSE c END, '' ORDER BY i) AS typed FROM fates GROUP BY id, copy)
SELECT id, copy::INTEGER AS copy, CASE WHEN typed = '' THEN text ELSE typed END AS text FROM made"""


@query(_noise_sql())
def noise_copies(spark, sf_dir):
    return ex.noisy_copies(load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text", 2)


_TWO = """two AS (SELECT *, CASE WHEN pred = 'es' THEN 'en' ELSE pred END AS other FROM pred)"""
_VARIANT = "SELECT fold, avg(CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (n_true + n_pred)::DOUBLE END) AS f FROM ({inner}) GROUP BY fold"
_SIDE = """SELECT fold, lab, sum(t) AS n_true, sum(p) AS n_pred, sum(tp) AS tp FROM (SELECT fold, label AS lab, 1 AS t, 0 AS p, CASE WHEN label = {c} THEN 1 ELSE 0 END AS tp FROM two
UNION ALL SELECT fold, {c}, 0, 1, 0 FROM two) GROUP BY fold, lab"""


@query(f"""WITH {_PRED}, {_TWO}, a AS ({_VARIANT.format(inner=_SIDE.format(c="other"))}), b AS ({_VARIANT.format(inner=_SIDE.format(c="pred"))}),
s AS (SELECT avg(a.f - b.f) AS d, count(*) FILTER (WHERE a.f > b.f) AS better, count(*) FILTER (WHERE a.f = b.f) AS tied, count(*) FILTER (WHERE a.f < b.f) AS worse, count(*) AS n FROM a JOIN b USING (fold))
SELECT round(d, 9) AS mean_diff, better, tied, worse, n, CASE WHEN d > 0 AND better > n / 2.0 THEN 'helps' WHEN d < -0.01 AND worse > n / 2.0 THEN 'hurts' ELSE 'no difference' END AS verdict FROM s""")
def paired_verdict(spark, sf_dir):
    rows = predicted(spark, sf_dir).withColumn("other", F.when(F.col("pred") == "es", "en").otherwise(F.col("pred")))
    score = lambda c: m.macro_scores(rows, pred=c, keys=("fold",)).select("fold", "macro_f1")
    return rounded(ex.paired(score("other"), score("pred"), "fold", "macro_f1"), "mean_diff")


@query("""WITH r AS (SELECT source AS name, round(avg(quality), 6) AS score, round(stddev_pop(quality), 6) AS spread, count(*) AS size FROM documents JOIN labels USING (doc_id) GROUP BY source),
t AS (SELECT *, row_number() OVER w AS r, lead(name) OVER w AS n2, lead(score) OVER w AS s2, lead(size) OVER w AS z2 FROM r WINDOW w AS (ORDER BY score DESC, name))
SELECT CASE WHEN n2 IS NOT NULL AND score - s2 <= spread AND z2 < size THEN n2 ELSE name END AS winner, CASE WHEN n2 IS NOT NULL AND score - s2 <= spread AND z2 < size THEN 'smaller within one spread' ELSE 'best' END AS reason FROM t WHERE r = 1""")
def winner_rule(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    runs = rows.groupBy(F.col("source").alias("name")).agg(F.round(F.avg("quality"), 6).alias("score"), F.round(F.stddev_pop("quality"), 6).alias("spread"), F.count("*").alias("size"))
    return ex.winner(runs, "name", "score", "spread", "size")


#: Labelled shares of the pool, and folds.
_FRACTIONS, _FOLDS = [0.10, 0.20, 0.35, 0.50, 0.75, 1.00], [0, 1, 2]
_STRATEGIES = ["least confident", "random"]
_HASHED = mixed_sql("p.vec_id", "p.k")


def _centers_sql(name: str, of: str) -> str:
    """Centroids by strategy, fold and label of the ids in ``of``."""
    return f"""{name}_l AS (SELECT s, k, label, i, avg(v[i]) AS x FROM {of} JOIN e USING (vec_id) CROSS JOIN range(1, 65) t(i) GROUP BY s, k, label, i),
{name}_m AS (SELECT s, k, label, list(x ORDER BY i) AS m FROM {name}_l GROUP BY s, k, label), {name} AS (SELECT s, k, label, [x / sqrt(list_sum([y * y for y in m])) for x in m] AS c FROM {name}_m)"""


def _curve_sql() -> str:
    dot = "list_sum([v[i] * c[i] for i in range(1, 65)]) * 10.0::DOUBLE"
    parts = [
        "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 8)",
        f"pool AS (SELECT s, k, vec_id FROM e CROSS JOIN (SELECT unnest({_STRATEGIES}) AS s) CROSS JOIN (SELECT unnest({_FOLDS}) AS k) WHERE vec_id % 5 <> k)",
        "size AS (SELECT s, k, count(*) AS n FROM pool GROUP BY s, k)",
        f"""r0 AS (SELECT s, k, vec_id, row_number() OVER (PARTITION BY s, k, label ORDER BY {mixed_sql("vec_id")}, vec_id) AS r, count(*) OVER (PARTITION BY s, k, label) AS n FROM pool JOIN e USING (vec_id))""",
        "l0 AS (SELECT s, k, vec_id FROM r0 WHERE r <= greatest(floor(n * 0.1 + 0.5), 1))",
    ]
    for step, fraction in enumerate(_FRACTIONS, 1):
        old, new = f"l{step - 1}", f"l{step}"
        parts += [
            _centers_sql(f"c{step}", old),
            f"""o{step} AS (SELECT p.s, p.k, p.vec_id, row_number() OVER (PARTITION BY p.s, p.k ORDER BY CASE WHEN p.s = 'random' THEN {_HASHED}::DOUBLE ELSE round(conf, 9) END, p.vec_id) AS r
FROM pool p LEFT JOIN {old} USING (s, k, vec_id) LEFT JOIN (SELECT s, k, vec_id, 1 / sum(exp(z - m)) AS conf FROM (SELECT p.s, p.k, p.vec_id, {dot} AS z, max({dot}) OVER (PARTITION BY p.s, p.k, p.vec_id) AS m FROM pool p JOIN e USING (vec_id) JOIN c{step} c ON c.s = p.s AND c.k = p.k) GROUP BY s, k, vec_id) f USING (s, k, vec_id)
WHERE {old}.vec_id IS NULL)""",
            f"h{step} AS (SELECT s, k, floor(n * {fraction}::DOUBLE + 0.5) - count(*) AS want FROM {old} JOIN size USING (s, k) GROUP BY s, k, n)",
            f"{new} AS (SELECT * FROM {old} UNION ALL SELECT s, k, vec_id FROM o{step} JOIN h{step} USING (s, k) WHERE r <= want)",
            _centers_sql(f"d{step}", new),
            f"""p{step} AS (SELECT s, k, vec_id, any_value(label) AS label, arg_max(name, (round(z, 12), -name)) AS pred FROM (SELECT c.s, c.k, vec_id, e.label, c.label AS name, {dot} AS z FROM e JOIN d{step} c ON vec_id % 5 = c.k) GROUP BY s, k, vec_id)""",
        ]
    union = " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, s, k, label, pred FROM p{i}" for i, f in enumerate(_FRACTIONS, 1))
    sizes = " UNION ALL ".join(f"SELECT {f}::DOUBLE AS fraction, s, k, count(*) AS n_labelled FROM l{i} GROUP BY s, k" for i, f in enumerate(_FRACTIONS, 1))
    parts += [f"judged AS ({union})", f"sizes AS ({sizes})", counts_sql("fraction, s, k,", "judged")]
    macro = "round(avg(CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (n_true + n_pred)::DOUBLE END), 8) AS macro_f1, round(sum(tp)::DOUBLE / sum(n_true)::DOUBLE, 8) AS accuracy, sum(n_true)::BIGINT AS n"
    return f"WITH {', '.join(parts)}, m AS (SELECT fraction, s, k, {macro} FROM counts GROUP BY fraction, s, k) SELECT k::INTEGER AS fold, s AS strategy, fraction, n_labelled, macro_f1, accuracy, n FROM m JOIN sizes USING (fraction, s, k)"


def curve(spark, sf_dir, folds=_FOLDS, done=None):
    """Learning curves of nearest-centroid classifiers by fold and strategy; resumes after what is ``done``."""
    keys = ("fold", "strategy")
    rows = load(spark, sf_dir, "embeddings").where("label < 8").select("vec_id", "label", "embedding")
    every = rows.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in _STRATEGIES]))).withColumn("fold", F.explode(F.array(*[F.lit(k) for k in folds])))
    pool, held = every.where("vec_id % 5 <> fold"), every.where("vec_id % 5 = fold")
    group = F.concat_ws("/", "strategy", "fold", "label")
    seeds = stratified_share(pool.withColumn("_g", group), "vec_id", "_g", 0.1).select(*keys, "vec_id")
    logits = lambda labelled, of: openset.with_logits(of, openset.centroids(labelled, "label", "embedding", keys), "label", "embedding", 10.0, keys)
    sure = lambda labelled, rest: logits(labelled, rest).withColumn("confidence", F.array_max(vec.softmax(F.col("logits"))))
    best = vec.argmax(F.transform("logits", lambda z: F.round(z, 12))) + 1
    predict = lambda labelled: logits(labelled, held).withColumn("pred", F.element_at("names", best))
    order = mixed(F.col("vec_id"), F.col("fold")).cast("double")
    return ex.active_learning(pool, seeds, "vec_id", keys, _FRACTIONS, sure, predict, {"random": order}, done)


@query(_curve_sql())
def learning_curve(spark, sf_dir):
    return rounded(curve(spark, sf_dir), "macro_f1", "accuracy", digits=8)


_PATIENCE = 3


@query(f"""WITH RECURSIVE log AS (SELECT event_type, user_id % 7 AS seed, day(ts) AS epoch, round(avg(value), 6) AS score FROM events GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type, seed ORDER BY epoch) AS i FROM log),
walk(event_type, seed, i, best_epoch, best_score, last_epoch, waited, stopped) AS (SELECT event_type, seed, i, epoch, score, epoch, 0, false FROM o WHERE i = 1 UNION ALL
  SELECT o.event_type, o.seed, o.i, CASE WHEN score > best_score THEN epoch ELSE best_epoch END, CASE WHEN score > best_score THEN score ELSE best_score END, epoch, CASE WHEN score > best_score THEN 0 ELSE waited + 1 END, score <= best_score AND waited + 1 >= {_PATIENCE}
  FROM walk w JOIN o ON o.event_type = w.event_type AND o.seed = w.seed AND o.i = w.i + 1 WHERE NOT stopped)
SELECT event_type, seed, best_epoch, best_score, last_epoch, i::BIGINT AS epochs, stopped FROM (SELECT *, row_number() OVER (PARTITION BY event_type, seed ORDER BY i DESC) AS r FROM walk) WHERE r = 1""")
def early_stops(spark, sf_dir):
    """Runs are event types by groups of users, epochs are days: where each stops that has waited three epochs for a better mean."""
    log = load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("seed"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("score"))
    return stopping.early_stops(log, ["event_type", "seed"], "epoch", "score", _PATIENCE)


@query(f"""WITH {_PRED}, {counts_sql("source,")}, f AS (SELECT source, avg(CASE WHEN n_true + n_pred = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (n_true + n_pred)::DOUBLE END) AS f FROM counts GROUP BY source)
SELECT round(avg(f), 9) AS mean, round(stddev_samp(f), 9) AS std, round(min(f), 9) AS least, count(*) AS n FROM f""")
def seed_spread(spark, sf_dir):
    per = m.macro_scores(predicted(spark, sf_dir), keys=("source",))
    return per.agg(F.round(F.avg("macro_f1"), 9).alias("mean"), F.round(F.stddev_samp("macro_f1"), 9).alias("std"), F.round(F.min("macro_f1"), 9).alias("least"), F.count("*").alias("n"))
