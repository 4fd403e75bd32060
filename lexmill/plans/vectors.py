"""Centroids, neighbours, scorers and reject rules on the embeddings.

Labels 0 to 7 are known, 8 and 9 unknown; of every 20 ids, 14 train, 3 validate, 3 test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vec
from lexmill.operators import metrics, neighbours, openset
from lexmill.operators.ranking import head_per_group
from lexmill.operators.sized import broadcast_if_small
from lexmill.plans.registry import query
from lexmill.sources.shared import cut
from lexmill.sources.tables import load

KNOWN = 8
SCALE = 10.0
_TRAIN, _VAL, _TEST = "vec_id % 20 < 14", "vec_id % 20 BETWEEN 14 AND 16", "vec_id % 20 > 16"


def _dot(a: str, b: str) -> str:
    return f"list_sum([{a}[i] * {b}[i] for i in range(1, 65)])"


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _centers(where: str = "true", name: str = "c") -> str:
    return f"""{name}_long AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM e CROSS JOIN range(1, 65) t(i) WHERE {where} GROUP BY label, i),
{name}_raw AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS m FROM {name}_long GROUP BY label),
{name} AS (SELECT label, n, [x / sqrt(list_sum([y * y for y in m])) for x in m] AS v FROM {name}_raw)"""


_LOGITS = f"""{_E}, {_centers(f"label < {KNOWN} AND {_TRAIN}")}, logit AS (SELECT e.vec_id, e.label, c.label AS name, {_dot("e.v", "c.v")} * 10.0::DOUBLE AS z FROM e CROSS JOIN c),
lse AS (SELECT vec_id, label, max(z) AS m, max(z) + ln(sum(exp(z - mm))) AS lse, avg(z) AS mean_z FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mm FROM logit) GROUP BY vec_id, label),
best AS (SELECT vec_id, arg_max(name, (round(z, 12), -name)) AS best FROM logit GROUP BY vec_id)"""


def _embeddings(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def _logits(spark, sf_dir) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    centers = openset.centroids(rows.where(f"label < {KNOWN} AND {_TRAIN}"), "label", "embedding")
    return openset.with_logits(rows, centers, "label", "embedding", SCALE)


@query(f"WITH {_E}, {_centers()} SELECT label, n, i - 1 AS pos, round(v[i], 6) AS x FROM c CROSS JOIN range(1, 65) t(i)")
def centroids(spark, sf_dir):
    return openset.centroids(_embeddings(spark, sf_dir), "label", "embedding").select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {_E}, {_centers()} SELECT a.label AS a, b.label AS b, round({_dot('a.v', 'b.v')}, 6) AS sim FROM c a JOIN c b ON a.label < b.label")
def centroid_similarity(spark, sf_dir):
    c = openset.centroids(_embeddings(spark, sf_dir), "label", "embedding")
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("va")), c.select(F.col("label").alias("b"), F.col("centroid").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vec.dot(F.col("va"), F.col("vb")), 6).alias("sim"))


@query(f"WITH {_LOGITS} SELECT vec_id, label, best AS nearest, round(m / 10, 6) AS sim FROM lse JOIN best USING (vec_id)")
def nearest_centroid(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    rounded = F.transform("logits", lambda z: F.round(z, 12))
    return rows.select("vec_id", "label", F.element_at("names", vec.argmax(rounded) + 1).alias("nearest"), F.round(F.array_max("logits") / 10, 6).alias("sim"))


_BANK = f"vec_id % 20 < 14 AND label < {KNOWN}"


@query(f"""WITH {_E}, s AS (SELECT q.vec_id, {_dot("q.v", "b.v")} AS sim, b.vec_id AS near FROM e q CROSS JOIN (SELECT * FROM e WHERE {_BANK}) b WHERE q.vec_id % 20 > 16 AND q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, near) AS k FROM s) SELECT vec_id, k, round(sim, 6) AS sim FROM r WHERE k IN (1, 5, 10)""")
def knn_scores(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    found = neighbours.nearest(rows.where(_TEST), rows.where(_BANK), 10)
    return found.where("place in (1, 5, 10)").select(F.col("query").alias("vec_id"), F.col("place").cast("long").alias("k"), F.round("sim", 6).alias("sim"))


@query(f"""WITH {_E}, s AS (SELECT q.vec_id, {_dot("q.v", "b.v")} AS sim, b.vec_id AS near, b.label AS near_label FROM e q CROSS JOIN (SELECT * FROM e WHERE {_BANK}) b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, near) AS k FROM s) SELECT vec_id, near, near_label, round(sim, 6) AS sim FROM r WHERE k = 1""")
def nearest_neighbour(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    found = neighbours.nearest(rows.where("vec_id % 20 = 0"), rows.where(_BANK), 1)
    labels = rows.select(F.col("vec_id").alias("near"), F.col("label").alias("near_label"))
    return found.join(labels, "near").select(F.col("query").alias("vec_id"), "near", "near_label", F.round("sim", 6).alias("sim"))


@query(f"WITH {_E} SELECT a.vec_id AS a, b.vec_id AS b, round({_dot('a.v', 'b.v')}, 6) AS sim, a.label = b.label AS same_label FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_dot('a.v', 'b.v')} >= 0.38")
def embedding_pairs(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    side = lambda c: rows.select(F.col("vec_id").alias(c), F.col("label").alias(f"label_{c}"))
    pairs = neighbours.pairs_above(rows, 0.38).join(side("a"), "a").join(side("b"), "b")
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"), (F.col("label_a") == F.col("label_b")).alias("same_label"))


_TAU = 0.2


@query(f"""WITH {_LOGITS}, p AS (SELECT vec_id, name, exp(z - lse) AS p FROM logit JOIN lse USING (vec_id)),
t AS (SELECT vec_id, string_agg(name, ',' ORDER BY p DESC, name) FILTER (WHERE k <= 3) AS top3, max(p) AS conf, max(name) FILTER (WHERE k = 1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, name) AS k FROM p) GROUP BY vec_id)
SELECT vec_id, round(conf, 6) AS confidence, CAST(best AS VARCHAR) AS best, CASE WHEN conf < {_TAU} THEN 'unknown' ELSE CAST(best AS VARCHAR) END AS decision, top3 FROM t""")
def score_record(spark, sf_dir):
    made = openset.score_record(_logits(spark, sf_dir), _TAU)
    return made.select("vec_id", F.round("confidence", 6).alias("confidence"), "best", "decision", F.array_join(F.transform("top3", lambda t: t["label"]), ",").alias("top3"))


_SCORERS = f"""{_LOGITS}, kb AS (SELECT q.vec_id, b.vec_id AS near, {_dot("q.v", "b.v")} AS sim FROM e q CROSS JOIN (SELECT * FROM e WHERE {_BANK}) b WHERE q.vec_id <> b.vec_id AND q.vec_id % 20 >= 14),
k5 AS (SELECT vec_id, -sim AS s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, near) AS k FROM kb) WHERE k = 5),
scores AS (SELECT 'msp' AS scorer, vec_id, label, round(-exp(m - lse), 9) AS s FROM lse UNION ALL SELECT 'max_logit', vec_id, label, round(-m, 9) FROM lse UNION ALL SELECT 'energy', vec_id, label, round(-lse, 9) FROM lse
  UNION ALL SELECT 'knn5', k5.vec_id, e.label, round(k5.s, 9) FROM k5 JOIN e USING (vec_id)),
ev AS (SELECT *, CASE WHEN label >= {KNOWN} THEN 1 ELSE 0 END AS u FROM scores)"""


def scorer_table(spark, sf_dir) -> DataFrame:
    """One long table of all scorers: ``scorer``, ``vec_id``, ``label``, ``s``, ``u`` (unknown)."""
    rows = _logits(spark, sf_dir)
    z = F.col("logits")
    named = {"msp": openset.msp(z), "max_logit": openset.max_logit(z), "energy": openset.energy(z)}
    long = rows.select("vec_id", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("scorer"), v.alias("s")) for k, v in named.items()])).alias("r")).select("r.scorer", "vec_id", "label", "r.s")
    every = _embeddings(spark, sf_dir)
    near = neighbours.nearest(every.where("vec_id % 20 >= 14"), every.where(_BANK), 5).where("place = 5").select(F.col("query").alias("vec_id"), (-F.col("sim")).alias("s"))
    knn = near.join(every.select("vec_id", "label"), "vec_id").select(F.lit("knn5").alias("scorer"), "vec_id", "label", "s")
    return long.unionByName(knn).select("scorer", "vec_id", "label", F.round("s", 9).alias("s"), (F.col("label") >= KNOWN).cast("int").alias("u"))


@query(f"""WITH {_SCORERS}, v AS (SELECT scorer, s, row_number() OVER (PARTITION BY scorer ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY scorer) AS n FROM ev WHERE u = 0 AND {_VAL}),
tau AS (SELECT scorer, s AS tau FROM v WHERE i = ceil((n - 1) * 0.95 - 1e-9)),
r AS (SELECT *, rank() OVER (PARTITION BY scorer ORDER BY s) + (count(*) OVER (PARTITION BY scorer, s) - 1)::DOUBLE / 2 AS r FROM ev WHERE {_TEST}),
a AS (SELECT scorer, (sum(CASE WHEN u = 1 THEN r END) - sum(u)::DOUBLE * (sum(u) + 1) / 2) / (sum(u)::DOUBLE * sum(1 - u)) AS auroc FROM r GROUP BY scorer),
g AS (SELECT scorer, s, sum(u) AS np, sum(1 - u) AS nn FROM ev WHERE {_TEST} GROUP BY scorer, s),
cc AS (SELECT scorer, np, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER (PARTITION BY scorer) AS p FROM g WINDOW w AS (PARTITION BY scorer ORDER BY s DESC)),
ap AS (SELECT scorer, sum(np::DOUBLE / p * tp / (tp + fp)) AS ap FROM cc GROUP BY scorer),
k AS (SELECT scorer, avg(CASE WHEN u = 1 THEN CASE WHEN s > tau THEN 1.0 ELSE 0.0 END END) AS rejected, avg(CASE WHEN u = 0 THEN CASE WHEN s <= tau THEN 1.0 ELSE 0.0 END END) AS kept FROM ev JOIN tau USING (scorer) WHERE {_TEST} GROUP BY scorer)
SELECT scorer, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(tau, 6) AS tau, round(rejected, 6) AS rejected, round(kept, 6) AS kept FROM a JOIN ap USING (scorer) JOIN tau USING (scorer) JOIN k USING (scorer)""")
def open_set_table(spark, sf_dir):
    rows = cut(scorer_table(spark, sf_dir), "scores")
    test, keys = rows.where(_TEST), ("scorer",)
    tau = metrics.threshold_higher(rows.where("u = 0").where(_VAL), "s", 0.95, keys)
    rules = test.join(F.broadcast(tau), "scorer").groupBy("scorer").agg(
        F.avg(F.when(F.col("u") == 1, (F.col("s") > F.col("tau")).cast("double"))).alias("rejected"), F.avg(F.when(F.col("u") == 0, (F.col("s") <= F.col("tau")).cast("double"))).alias("kept")
    )
    parts = [metrics.auroc(test, "s", "u", keys), metrics.average_precision(test, "s", "u", keys).withColumnRenamed("average_precision", "ap"), tau, rules]
    joined = reduce(lambda a, b: a.join(b, "scorer"), parts)
    return joined.select("scorer", *[F.round(c, 6).alias(c) for c in ("auroc", "ap", "tau", "rejected", "kept")])


_PRECISION = f"""{_E}, bank AS (SELECT label, v FROM e WHERE {_BANK}), mu AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS x FROM bank CROSS JOIN range(1, 65) t(i) GROUP BY label, i) GROUP BY label),
c AS (SELECT [v[i] - m[i] for i in range(1, 65)] AS d FROM bank JOIN mu USING (label)), pooled AS (SELECT i, j, avg(d[i] * d[j]) AS p FROM c CROSS JOIN range(1, 65) a(i) CROSS JOIN range(1, 65) b(j) GROUP BY i, j),
tr AS (SELECT sum(CASE WHEN i = j THEN p END) / 64 AS mu, sum(p * p) AS squares FROM pooled), q AS (SELECT count(*)::DOUBLE AS n, sum(s * s) AS quartic FROM (SELECT list_sum([x * x for x in d]) AS s FROM c)),
sp AS (SELECT sum((p - CASE WHEN i = j THEN mu ELSE 0 END) * (p - CASE WHEN i = j THEN mu ELSE 0 END)) / 64 AS spread FROM pooled CROSS JOIN tr),
sh AS (SELECT CASE WHEN spread = 0 THEN 1 ELSE least(1.0, greatest(0.0, (quartic / n - squares) / n / 64) / spread) END AS shrink FROM tr CROSS JOIN q CROSS JOIN sp),
rows AS (SELECT i, list((1 - shrink) * p + CASE WHEN i = j THEN shrink * mu + 1e-12 ELSE 0 END ORDER BY j) || [CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for k in range(1, 65)] AS r FROM pooled CROSS JOIN tr CROSS JOIN sh GROUP BY i),
solved(k, a) AS (SELECT 0, list(r ORDER BY i) FROM rows UNION ALL
  SELECT k + 1, [CASE WHEN i = k + 1 THEN [x / a[i][i] for x in a[i]] ELSE [a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] for j in range(1, 129)] END for i in range(1, 65)] FROM solved WHERE k < 64),
inverse AS (SELECT [r[65:128] for r in a] AS w FROM solved WHERE k = 64)"""


@query(f"""WITH RECURSIVE {_PRECISION}, gaps AS (SELECT vec_id, mu.label, [v[i] - m[i] for i in range(1, 65)] AS g FROM e CROSS JOIN mu WHERE vec_id % 20 >= 14)
SELECT vec_id, round(min(list_sum([g[i] * list_sum([g[j] * w[i][j] for j in range(1, 65)]) for i in range(1, 65)])), 6) AS distance FROM gaps CROSS JOIN inverse GROUP BY vec_id""")
def mahalanobis(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    means, precision, _ = openset.pooled_shrunk_precision(rows.where(_BANK), "label", "embedding")
    return openset.mahalanobis(rows.where("vec_id % 20 >= 14"), "vec_id", "embedding", means, precision).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


_CATCH_ALL = (0, 1)


@query(f"""WITH {_SCORERS}, v AS (SELECT scorer, s, row_number() OVER (PARTITION BY scorer ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY scorer) AS n FROM ev WHERE u = 0 AND {_VAL}),
tau AS (SELECT scorer, s AS tau FROM v WHERE i = ceil((n - 1) * 0.95 - 1e-9)),
r AS (SELECT scorer, label, CASE WHEN s > tau THEN 1.0 ELSE 0.0 END AS strict, CASE WHEN s > tau OR best IN {_CATCH_ALL} THEN 1.0 ELSE 0.0 END AS lenient FROM ev JOIN tau USING (scorer) JOIN best USING (vec_id) WHERE u = 1 AND {_TEST})
SELECT scorer, round(avg(strict), 8) AS strict, round(avg(lenient), 8) AS lenient, round(avg(CASE WHEN label = 8 THEN strict END), 8) AS strict_8, round(avg(CASE WHEN label = 9 THEN strict END), 8) AS strict_9 FROM r GROUP BY scorer""")
def rejection_recall(spark, sf_dir):
    """Share of unknown rows that each scorer rejects: strictly, with catch-all classes as good as a rejection, and by label."""
    rows = cut(scorer_table(spark, sf_dir), "scores")
    tau = metrics.threshold_higher(rows.where("u = 0").where(_VAL), "s", 0.95, ("scorer",))
    best = _logits(spark, sf_dir).select("vec_id", F.element_at("names", vec.argmax(F.transform("logits", lambda z: F.round(z, 12))) + 1).alias("best"))
    judged = rows.where("u = 1").where(_TEST).join(broadcast_if_small(tau), "scorer").join(best, "vec_id")
    strict = F.col("s") > F.col("tau")
    share = lambda c, name: F.round(F.avg(c), 8).alias(name)
    return judged.groupBy("scorer").agg(
        share(strict.cast("double"), "strict"), share((strict | F.col("best").isin(*_CATCH_ALL)).cast("double"), "lenient"), *[share(F.when(F.col("label") == k, strict.cast("double")), f"strict_{k}") for k in (8, 9)]
    )


@query(f"""WITH {_LOGITS}, kb AS (SELECT q.vec_id, max({_dot("q.v", "b.v")}) AS sim FROM e q CROSS JOIN (SELECT * FROM e WHERE {_BANK}) b WHERE q.label = 9 GROUP BY q.vec_id)
SELECT vec_id, round(sim, 6) AS sim, best AS centroid, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'keyword' WHEN sim >= 0.35 THEN 'near duplicate' WHEN best IN (0, 1) THEN 'protected class' ELSE '' END AS reason
FROM kb JOIN best USING (vec_id) LEFT JOIN documents ON doc_id = vec_id""")
def outlier_screen(spark, sf_dir):
    """Why an outlier is dropped, first reason first: a keyword of its text, a near row, a protected class."""
    rows = _embeddings(spark, sf_dir)
    aux = rows.where("label = 9")
    near = neighbours.nearest(aux, rows.where(_BANK), 1).select(F.col("query").alias("vec_id"), "sim")
    best = _logits(spark, sf_dir).where("label = 9").select("vec_id", F.element_at("names", vec.argmax(F.transform("logits", lambda z: F.round(z, 12))) + 1).alias("centroid"))
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").rlike("(?i)license|copyright").alias("keyword"))
    reason = F.when(F.col("keyword"), "keyword").when(F.col("sim") >= 0.35, "near duplicate").when(F.col("centroid").isin(0, 1), "protected class").otherwise("")
    return near.join(best, "vec_id").join(words, "vec_id", "left").select("vec_id", F.round("sim", 6).alias("sim"), "centroid", reason.alias("reason"))


@query(f"""WITH {_E}, s AS (SELECT q.vec_id, {_dot("q.v", "b.v")} AS sim, b.vec_id AS near FROM e q CROSS JOIN e b WHERE q.vec_id <> b.vec_id)
SELECT vec_id, near, place, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, near) AS place FROM s) WHERE place <= 5""")
def nearest_indexed(spark, sf_dir):
    """The five nearest rows of every row, by best-first search of lists."""
    rows = _embeddings(spark, sf_dir)
    return neighbours.nearest_indexed(rows, rows, 5).select(F.col("query").alias("vec_id"), "near", F.col("place").cast("long").alias("place"), F.round("sim", 6).alias("sim"))


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]


@query(f"""WITH {_LOGITS}, g AS (SELECT l.vec_id, t, max(z / t) AS m, max(CASE WHEN name = label THEN z / t END) AS own FROM logit l CROSS JOIN (SELECT unnest({_GRID})::DOUBLE AS t) WHERE label < {KNOWN} AND {_VAL} GROUP BY l.vec_id, t),
s AS (SELECT g.vec_id, g.t, g.m + ln(sum(exp(z / g.t - g.m))) - g.own AS nll FROM g JOIN logit l ON l.vec_id = g.vec_id GROUP BY g.vec_id, g.t, g.m, g.own) SELECT t AS temperature, round(avg(nll), 6) AS nll FROM s GROUP BY t""")
def temperature_grid(spark, sf_dir):
    rows = _logits(spark, sf_dir).where(f"label < {KNOWN}").where(_VAL)
    return openset.nll_by_temperature(rows, "logits", "label", _GRID).withColumn("nll", F.round("nll", 6))


def _fit_sql(lo: float = 0.05, hi: float = 20.0, rounds: int = 4, points: int = 15) -> str:
    parts = [f"own AS (SELECT vec_id, name, z, label FROM logit WHERE label < {KNOWN} AND {_VAL})", f"b0 AS (SELECT ln({lo}::DOUBLE) AS a, ln({hi}::DOUBLE) AS b)"]
    for k in range(1, rounds + 1):
        parts.append(f"""g{k} AS (SELECT a, b, exp(a + (b - a) * i / {points - 1}) AS t FROM b{k - 1} CROSS JOIN range(0, {points}) r(i)),
n{k} AS (SELECT a, b, t, avg(m + ln(s) - o) AS nll FROM (SELECT a, b, t, vec_id, max(m) AS m, sum(exp(z / t - m)) AS s, max(CASE WHEN name = label THEN z / t END) AS o
  FROM (SELECT *, max(z / t) OVER (PARTITION BY vec_id, t) AS m FROM own CROSS JOIN g{k}) GROUP BY a, b, t, vec_id) GROUP BY a, b, t),
w{k} AS (SELECT * FROM n{k} ORDER BY nll, t LIMIT 1), b{k} AS (SELECT ln(t) - (b - a) / {points - 1} AS a, ln(t) + (b - a) / {points - 1} AS b FROM w{k})""")
    return f"WITH {_LOGITS}, {', '.join(parts)} SELECT round(t, 4) AS temperature, round(nll, 6) AS nll FROM w{rounds}"


@query(_fit_sql())
def temperature_fit(spark, sf_dir):
    t, nll = openset.fit_temperature(_logits(spark, sf_dir).where(f"label < {KNOWN}").where(_VAL), "logits", "label")
    return spark.createDataFrame([(round(t, 4), round(nll, 6))], "temperature double, nll double")


@query(f"""WITH {_LOGITS}, g AS (SELECT vec_id, label, max(CASE WHEN name = label THEN z END) AS own, ln(sum(CASE WHEN (name < 4) = (label < 4) THEN exp(z) ELSE 0 END)) AS parent FROM logit GROUP BY vec_id, label)
SELECT vec_id, round(lse - own, 6) AS ce, round(lse - parent, 6) AS parent_ce, round(lse - mean_z, 6) AS uniform FROM g JOIN lse USING (vec_id) WHERE g.label < {KNOWN} AND {_VAL}""")
def loss_components(spark, sf_dir):
    rows = _logits(spark, sf_dir).where(f"label < {KNOWN}").where(_VAL)
    z = F.col("logits")
    members = F.when(F.col("label") < 4, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(4), F.lit(7)))
    return rows.select(
        "vec_id", F.round(openset.cross_entropy(z, F.col("label")), 6).alias("ce"), F.round(openset.group_cross_entropy(z, members), 6).alias("parent_ce"), F.round(openset.uniform_term(z), 6).alias("uniform")
    )


@query(f"""WITH {_LOGITS} SELECT vec_id, round(exp(m - lse), 6) AS confidence FROM lse WHERE {_TRAIN} AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 20 < 2)
ORDER BY round(exp(m - lse), 9), vec_id LIMIT 20""")
def least_confident_k(spark, sf_dir):
    labelled = _embeddings(spark, sf_dir).where("vec_id % 20 < 2").select("vec_id")
    pool = _logits(spark, sf_dir).where(_TRAIN).join(labelled, "vec_id", "left_anti")
    return pool.select("vec_id", (-openset.msp(F.col("logits"))).alias("c")).orderBy(F.round("c", 9), "vec_id").limit(20).select("vec_id", F.round("c", 6).alias("confidence"))


@query(f"WITH {_E} SELECT label, vec_id, place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY v[1] DESC, vec_id) AS place FROM e) WHERE place <= 5")
def head5_per_label(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return head_per_group(rows, ["label"], [F.col("x").desc(), F.col("vec_id")], 5).select("label", "vec_id", F.col("place").cast("long").alias("place"))
