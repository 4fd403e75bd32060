"""Drift: of event windows (days 1 to 7 are the reference, 22 to 28 the window) and of batches of scored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import vec
from lexmill.operators import discrepancy, metrics
from lexmill.operators import drift as dr
from lexmill.operators.cumulative import cumulative
from lexmill.operators.splits import mixed, mixed_sql, resample, sample
from lexmill.plans import vectors
from lexmill.plans.registry import query
from lexmill.sources.shared import cut, fresh_path
from lexmill.sources.tables import load
from lexmill.streaming import monitor, windows

_EV = """ev AS (SELECT event_id, event_type, value / (value + 50.0::DOUBLE) AS x, CASE WHEN day(ts) <= 7 THEN 0 ELSE 1 END AS cur FROM events WHERE day(ts) <= 7 OR day(ts) BETWEEN 22 AND 28)"""
_SHARES = """sh AS (SELECT *, ref::DOUBLE / (sum(ref) OVER ())::DOUBLE AS r, cur::DOUBLE / (sum(cur) OVER ())::DOUBLE AS c FROM (SELECT {k} AS k, sum(1 - cur) AS ref, sum(cur) AS cur FROM ev GROUP BY 1))"""
_PSI = "round(sum((c - r) * ln((c + 1e-4) / (r + 1e-4))), 8) AS psi"


def compared(spark, sf_dir):
    """Events of both weeks: ``cur`` 0 for the reference, 1 for the window; ``x`` is the value on the unit interval."""
    day = F.dayofmonth("ts")
    rows = load(spark, sf_dir, "events").where((day <= 7) | day.between(22, 28))
    return rows.select("event_id", "event_type", (F.col("value") / (F.col("value") + F.lit(50.0))).alias("x"), F.when(day <= 7, 0).otherwise(1).alias("cur"))


@query(f"WITH {_EV}, {_SHARES.format(k='least(floor(x * 10) + 1, 10)')} SELECT {_PSI} FROM sh")
def psi_numeric(spark, sf_dir):
    return dr.psi_numeric(compared(spark, sf_dir), "x", "cur").select(F.round("psi", 8).alias("psi"))


@query(f"WITH {_EV}, {_SHARES.format(k='event_type')} SELECT {_PSI} FROM sh")
def psi_categorical(spark, sf_dir):
    return dr.psi_categorical(compared(spark, sf_dir), "event_type", "cur").select(F.round("psi", 8).alias("psi"))


@query(f"""WITH {_EV}, {_SHARES.format(k="event_type")}, e AS (SELECT cur, (r + 1e-6) / sum(r + 1e-6) OVER () * sum(cur) OVER () AS e FROM sh)
SELECT round(sum((cur - e) * (cur - e) / e), 6) AS chi2, count(*) - 1 AS df FROM e""")
def chi2_stat(spark, sf_dir):
    return dr.chi_square(compared(spark, sf_dir), "event_type", "cur").select(F.round("chi2", 6).alias("chi2"), "df")


@query()
def chi2_p(spark, sf_dir):
    table = dr.shares(compared(spark, sf_dir), "event_type", "cur").orderBy("event_type").collect()  # one row a category
    return spark.createDataFrame([(dr.chi_square_p([r["cur"] for r in table], [r["ref_share"] for r in table]),)], "p double")


@query(f"""WITH {_EV}, g AS (SELECT x, sum(cur) AS a, sum(1 - cur) AS b FROM ev GROUP BY x),
c AS (SELECT (sum(a) OVER (ORDER BY x))::DOUBLE / (sum(a) OVER ())::DOUBLE AS fa, (sum(b) OVER (ORDER BY x))::DOUBLE / (sum(b) OVER ())::DOUBLE AS fb FROM g) SELECT round(max(abs(fa - fb)), 9) AS ks FROM c""")
def ks_stat(spark, sf_dir):
    return metrics.ks_statistic(compared(spark, sf_dir), "x", "cur").select(F.round("ks", 9).alias("ks"))


_KS_P = "CASE WHEN lam > 0.2 THEN least(1.0, greatest(0.0, list_sum([2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * lam * lam) for k in range(1, 101)]))) ELSE 1.0 END"
_LAM = "(sqrt(n * m / (n + m)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n * m / (n + m))) * ks AS lam"


@query(f"""WITH {_EV}, g AS (SELECT x, sum(cur) AS a, sum(1 - cur) AS b FROM ev GROUP BY x),
c AS (SELECT (sum(a) OVER (ORDER BY x))::DOUBLE / (sum(a) OVER ())::DOUBLE AS fa, (sum(b) OVER (ORDER BY x))::DOUBLE / (sum(b) OVER ())::DOUBLE AS fb FROM g),
d AS (SELECT max(abs(fa - fb)) AS ks FROM c), z AS (SELECT sum(cur)::DOUBLE AS n, sum(1 - cur)::DOUBLE AS m FROM ev), l AS (SELECT ks, {_LAM} FROM d CROSS JOIN z)
SELECT round(ks, 9) AS ks, round({_KS_P}, 8) AS p FROM l""")
def ks_p(spark, sf_dir):
    rows = compared(spark, sf_dir)
    n, m = rows.agg(F.sum("cur"), F.sum(1 - F.col("cur"))).first()
    d = metrics.ks_statistic(rows, "x", "cur").first()["ks"]
    return spark.createDataFrame([(round(d, 9), round(dr.ks_asymptotic_p(d, n, m), 8))], "ks double, p double")


def _lattice(key: str, of: str) -> str:
    """CTEs ``walk`` and ``exact`` (``key``, ``p``): exact p-values of the samples in ``of`` (``key``, ``ks``, ``n``, ``m``), one diagonal of the lattice a row."""
    return f"""walk({key}, t, n, m, h, w) AS (SELECT {key}, 0, n::BIGINT, m::BIGINT, round(ks * n * m)::BIGINT, [0.0::DOUBLE for i in range(0, n::BIGINT + 1)] FROM {of} UNION ALL
  SELECT {key}, t + 1, n, m, h, [CASE WHEN abs(i * m - (t + 1 - i) * n) >= h THEN 1.0::DOUBLE ELSE (i * coalesce(w[i], 0.0::DOUBLE) + (t + 1 - i) * w[i + 1]) / (t + 1) END for i in range(0, n + 1)] FROM walk WHERE t < n + m),
exact AS (SELECT {key}, w[n + 1] AS p FROM walk WHERE t = n + m)"""


_DAYS = """e AS (SELECT day(ts) AS day, value / (value + 50.0::DOUBLE) AS x FROM events), both_days AS (SELECT day, x, 1 AS cur FROM e WHERE day > 1 UNION ALL SELECT day + 1, x, 0 FROM e WHERE day + 1 IN (SELECT day FROM e)),
g AS (SELECT day, x, sum(cur) AS a, sum(1 - cur) AS b FROM both_days GROUP BY day, x),
c AS (SELECT day, (sum(a) OVER w)::DOUBLE / (sum(a) OVER o)::DOUBLE AS fa, (sum(b) OVER w)::DOUBLE / (sum(b) OVER o)::DOUBLE AS fb, sum(a) OVER o AS n, sum(b) OVER o AS m FROM g WINDOW w AS (PARTITION BY day ORDER BY x), o AS (PARTITION BY day)),
d AS (SELECT day, max(abs(fa - fb)) AS ks, max(n) AS n, max(m) AS m FROM c GROUP BY day HAVING max(n) > 0 AND max(m) > 0)"""


@query(f"WITH RECURSIVE {_DAYS}, {_lattice('day', 'd')} SELECT day, n::BIGINT AS n, m::BIGINT AS m, round(ks, 9) AS ks, round(p, 8) AS p FROM d JOIN exact USING (day)")
def ks_daily(spark, sf_dir):
    """Every day's values against those of the day before, by the exact test."""
    rows = load(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("day"), (F.col("value") / (F.col("value") + F.lit(50.0))).alias("x"))
    days = rows.select("day").distinct()
    before = rows.select((F.col("day") + 1).alias("day"), "x", F.lit(0).alias("cur")).join(F.broadcast(days), "day", "left_semi")  # a row a day of the month
    both = rows.where("day > 1").select("day", "x", F.lit(1).alias("cur")).unionByName(before)
    sizes = both.groupBy("day").agg(F.sum("cur").alias("n"), F.sum(1 - F.col("cur")).alias("m")).where("n > 0 and m > 0")
    found = metrics.ks_statistic(both, "x", "cur", ("day",)).join(sizes, "day")
    p = F.pandas_udf(lambda d, n, m: pd.Series([dr.ks_p(*x) for x in zip(d, n, m, strict=True)], dtype=float), "double")
    return found.select("day", "n", "m", F.round("ks", 9).alias("ks"), F.round(p("ks", "n", "m"), 8).alias("p"))


@query(f"""WITH {_EV}, t AS (SELECT x AS tau FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ev WHERE cur = 0) WHERE i = ceil((n - 1) * 0.95 - 1e-9)),
k AS (SELECT count(*) AS n, sum(CASE WHEN x > tau THEN 1 ELSE 0 END) AS k FROM ev CROSS JOIN t WHERE cur = 1),
f AS (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(i::DOUBLE) END) OVER (ORDER BY i) AS f FROM range(0, (SELECT n + 1 FROM k)) r(i)),
pmf AS (SELECT f.i, k.k, t.f - f.f - g.f + f.i * ln(0.05::DOUBLE) + (k.n - f.i) * ln(0.95::DOUBLE) AS lp FROM k JOIN f ON true JOIN f g ON g.i = k.n - f.i JOIN f t ON t.i = k.n),
pk AS (SELECT lp AS lk FROM pmf WHERE i = k)
SELECT max(pmf.k)::BIGINT AS k, round(sum(CASE WHEN i >= pmf.k THEN exp(lp) ELSE 0 END), 8) AS greater, round(least(1.0, sum(CASE WHEN lp <= lk + 1e-7 THEN exp(lp) ELSE 0 END)), 8) AS two_sided FROM pmf CROSS JOIN pk""")
def binom_p(spark, sf_dir):
    rows = compared(spark, sf_dir)
    tau = metrics.threshold_higher(rows.where("cur = 0"), "x", 0.95).first()["tau"]
    n, k = rows.where("cur = 1").agg(F.count("*"), F.count_if(F.col("x") > tau)).first()
    return dr.binomial_p(spark, k, n, 0.05).select(F.lit(k).cast("long").alias("k"), F.round("greater", 8).alias("greater"), F.round("two_sided", 8).alias("two_sided"))


_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IN (0, 1))"


@query(f"""WITH {_V}, p AS (SELECT a.label AS la, b.label AS lb, a.vec_id < b.vec_id AS up, list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) for i in range(1, 65)]) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
g AS (SELECT 1 / median(d) AS g FROM p WHERE up AND d > 0), k AS (SELECT la, lb, avg(exp(-g * d)) AS k FROM p CROSS JOIN g GROUP BY la, lb)
SELECT round(sum(CASE WHEN la = lb THEN k ELSE -k END), 8) AS mmd2 FROM k""")
def mmd2(spark, sf_dir):
    """All vectors of label 0 against all of label 1."""
    found, _ = dr.mean_discrepancy(_two_labels(spark, sf_dir), "vec_id", "label", "embedding")
    return spark.createDataFrame([(round(found, 8),)], "mmd2 double")


def _two_labels(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings").where("label in (0, 1)")


@query()
def mmd2_p(spark, sf_dir):
    return spark.createDataFrame([dr.mean_discrepancy(_two_labels(spark, sf_dir), "vec_id", "label", "embedding", dr.PERMUTATIONS)], "mmd2 double, p double")


def _linear_sql(features: int = discrepancy.FEATURES, draws: int = dr.PERMUTATIONS, seed: int = discrepancy.SEED) -> str:
    """Random features of single rows: equal to the operator as long as a block is one row."""
    u = lambda k: f"(({mixed_sql('f', 'd', str(k), seed=seed)}) + 0.5::DOUBLE) / pow(16.0::DOUBLE, 15)"
    return f"""WITH {_V}, p AS (SELECT a.vec_id < b.vec_id AS up, list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) for i in range(1, 65)]) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
g AS (SELECT sqrt(2 / median(d)) AS scale FROM p WHERE up AND d > 0),
w AS (SELECT f, list(scale * sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}) ORDER BY d) AS w FROM range(0, {features}) a(f) CROSS JOIN range(0, 64) b(d) CROSS JOIN g GROUP BY f),
z AS (SELECT vec_id, list(a ORDER BY f) AS a FROM (SELECT vec_id, f, list_sum([v.v[i] * w.w[i] for i in range(1, 65)]) AS a FROM v CROSS JOIN w) GROUP BY vec_id),
b AS (SELECT vec_id, label AS side, row_number() OVER (PARTITION BY label ORDER BY {mixed_sql("vec_id")}, vec_id) - 1 AS block, count(*) FILTER (WHERE label = 0) OVER () AS n, count(*) FILTER (WHERE label = 1) OVER () AS m FROM v),
k AS (SELECT x.vec_id AS i, y.vec_id AS j, [cos(x.a[q] - y.a[q]) for q in range(1, {features + 1})] AS c FROM z x JOIN z y ON x.vec_id <> y.vec_id),
c AS (SELECT i, j, list_sum(c) / {features} AS c FROM k WHERE i < j),
weight AS (SELECT c, CASE WHEN x.side <> y.side THEN -1.0::DOUBLE / (x.n * x.m) WHEN x.side = 0 THEN 1.0::DOUBLE / (x.n * (x.n - 1)) ELSE 1.0::DOUBLE / (x.m * (x.m - 1)) END AS wt FROM k JOIN b x ON x.vec_id = i JOIN b y ON y.vec_id = j),
by_f AS (SELECT q, sum(wt * c[q]) AS x FROM weight CROSS JOIN range(1, {features + 1}) t(q) GROUP BY q), seen AS (SELECT avg(x) AS mmd2 FROM by_f),
drawn AS (SELECT draw, vec_id, n, m, row_number() OVER (PARTITION BY draw ORDER BY {mixed_sql("draw", "side", "block", seed=seed)}, side, block) <= n AS one FROM b CROSS JOIN range(0, {draws}) t(draw)),
made AS (SELECT x.draw, 2 * sum(CASE WHEN x.one <> y.one THEN -c / (x.n * x.m)::DOUBLE WHEN x.one THEN c / (x.n * (x.n - 1))::DOUBLE ELSE c / (x.m * (x.m - 1))::DOUBLE END) AS x FROM drawn x JOIN c ON c.i = x.vec_id JOIN drawn y ON y.draw = x.draw AND y.vec_id = c.j GROUP BY x.draw)
SELECT round(mmd2, 8) AS mmd2, round((SELECT stddev_samp(x) FROM by_f) / sqrt({features}), 8) AS error, round((1 + (SELECT count(*) FROM made WHERE x >= mmd2 - 1e-12))::DOUBLE / {draws + 1}, 8) AS p FROM seen"""


@query(_linear_sql())
def mmd2_linear(spark, sf_dir):
    """The discrepancy by random features, its error, and its p-value by permutations of fixed sizes."""
    found = discrepancy.linear_discrepancy(_two_labels(spark, sf_dir), "vec_id", "label", "embedding")
    return spark.createDataFrame([tuple(round(x, 8) for x in found)], "mmd2 double, error double, p double")


@query("""WITH d AS (SELECT day(ts) AS day, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT day, sum(n) AS total FROM d GROUP BY 1),
ref AS (SELECT k, sum(CASE WHEN day <= 7 THEN n ELSE 0 END)::DOUBLE / (sum(sum(CASE WHEN day <= 7 THEN n ELSE 0 END)) OVER ())::DOUBLE AS r FROM d GROUP BY k),
g AS (SELECT t.day, ref.k, r, coalesce(d.n, 0) AS n, total, coalesce(d.n, 0)::DOUBLE / total::DOUBLE AS c FROM t CROSS JOIN ref LEFT JOIN d ON d.day = t.day AND d.k = ref.k)
SELECT day, max(total)::BIGINT AS n, round(sum((c - r) * ln((c + 1e-4) / (r + 1e-4))), 8) AS psi, sum((c - r) * ln((c + 1e-4) / (r + 1e-4))) > 0.02 AS alert FROM g GROUP BY day""")
def drift_daily(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("day"), F.col("event_type").alias("k"))
    per = dr.psi_by_window(events, "day", "k", F.col("day") <= 7)
    return per.select("day", "n", F.round("psi", 8).alias("psi"), (F.col("psi") > 0.02).alias("alert"))


#: Sizes of the windows of a power study, and windows of each.
_SIZES, _REPS = (65, 130, 260, 520), 40


@query(f"""WITH {_EV}, t AS (SELECT x AS tau FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ev WHERE cur = 0) WHERE i = ceil((n - 1) * 0.95 - 1e-9)),
pool AS (SELECT cur, row_number() OVER (PARTITION BY cur ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY cur) AS m, x > tau AS far FROM ev CROSS JOIN t),
sizes AS (SELECT cur, max(m) AS m FROM pool GROUP BY cur),
draws AS (SELECT size, mixed, rep, i, CASE WHEN mixed = 1 AND i % 5 < 2 THEN 1 ELSE 0 END AS cur, {mixed_sql("size", "mixed", "rep", "i")} AS h
  FROM (SELECT unnest([65, 130, 260, 520]) AS size) CROSS JOIN (SELECT unnest([0, 1]) AS mixed) CROSS JOIN range(0, {_REPS}) a(rep) CROSS JOIN range(0, 520) b(i) WHERE i < size),
w AS (SELECT size, mixed, rep, sum(CASE WHEN far THEN 1 ELSE 0 END) AS k FROM draws JOIN sizes USING (cur) JOIN pool ON pool.cur = draws.cur AND pool.r = draws.h % sizes.m GROUP BY 1, 2, 3)
SELECT size, mixed, round(avg(k::DOUBLE / size), 8) AS far, round(avg(CASE WHEN k > size * 0.05 + 1.645 * sqrt(size * 0.05 * 0.95) THEN 1.0 ELSE 0.0 END), 8) AS power FROM w GROUP BY size, mixed""")
def power_grid(spark, sf_dir):
    rows = compared(spark, sf_dir)
    tau = metrics.threshold_higher(rows.where("cur = 0"), "x", 0.95).first()["tau"]
    placed = cumulative(rows.withColumn("_1", F.lit(1).cast("long")), "event_id", {"r": "_1"}, ("cur",)).select("cur", (F.col("r") - 1).alias("r"), (F.col("x") > tau).alias("far"))
    sizes = rows.groupBy("cur").agg(F.count("*").alias("m"))
    grid = (
        spark.range(_REPS)
        .withColumnRenamed("id", "rep")
        .withColumn("size", F.explode(F.array(*[F.lit(s) for s in _SIZES])))
        .withColumn("mixed", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    )
    draws = grid.withColumn("cur", ((F.col("mixed") == 1) & (F.col("i") % 5 < 2)).cast("int")).join(F.broadcast(sizes), "cur")
    draws = draws.withColumn("r", mixed(F.col("size"), F.col("mixed"), F.col("rep"), F.col("i")) % F.col("m"))
    per = draws.join(placed, ["cur", "r"]).groupBy("size", "mixed", "rep").agg(F.count_if("far").alias("k"))
    n = F.col("size").cast("double")
    fires = (F.col("k") > n * 0.05 + F.lit(1.645) * F.sqrt(n * 0.05 * 0.95)).cast("double")
    return per.groupBy("size", "mixed").agg(F.round(F.avg(F.col("k") / n), 8).alias("far"), F.round(F.avg(fires), 8).alias("power"))


_FOUND = "n long, ks double, ks_p double, unknown_p double, mix_p double, share_p double, alerts string, day date"


def judged_days(reference: DataFrame, tau: float):
    """A judge of whole days of events against reference rows: the exact two-sample test of ``x``, the rate above ``tau``, the mix of types, and the share of a quarter of the users."""
    (quarter,) = reference.agg(F.avg(F.col("quarter").cast("double"))).first()

    def judge(rows: DataFrame) -> DataFrame:
        rows = marked_events(rows)
        days = rows.select("day").distinct()  # a row a day
        both = rows.withColumn("cur", F.lit(1)).unionByName(reference.withColumn("cur", F.lit(0)).crossJoin(F.broadcast(days)))
        sums = both.groupBy("day").agg(F.sum("cur").alias("n"), F.sum(1 - F.col("cur")).alias("m"), F.count_if((F.col("cur") == 1) & (F.col("x") > tau)).alias("far"), F.sum(F.col("cur") * F.col("quarter").cast("int")).alias("some"))
        mix = dr.chi_square(both, "event_type", "cur", ("day",))
        found = sums.join(metrics.ks_statistic(both, "x", "cur", ("day",)), "day").join(mix, "day")

        @F.pandas_udf("ks_p double, unknown_p double, mix_p double, share_p double")
        def p_values(ks: pd.Series, n: pd.Series, m: pd.Series, far: pd.Series, chi2: pd.Series, df: pd.Series, some: pd.Series) -> pd.DataFrame:
            made = [(dr.ks_p(d, a, b), dr.binomial_tails(k, a, 0.05)[0], dr.chi_square_tail(c, f), dr.binomial_tails(s, a, quarter)[1]) for d, a, b, k, c, f, s in zip(ks, n, m, far, chi2, df, some, strict=True)]
            return pd.DataFrame(made, columns=["ks_p", "unknown_p", "mix_p", "share_p"])

        given = found.select("day", "n", "ks", p_values("ks", "n", "m", "far", "chi2", "df", "some").alias("p")).select("day", "n", "ks", "p.*")
        fired = [F.when(F.col(c) < dr.alert_level(), F.lit(name)) for name, c in (("values", "ks_p"), ("unknown rate", "unknown_p"), ("mix", "mix_p"), ("share", "share_p"))]
        return given.withColumn("alerts", F.concat_ws(", ", *fired)).select("n", "ks", "ks_p", "unknown_p", "mix_p", "share_p", "alerts", "day")

    return judge


def marked_events(events: DataFrame) -> DataFrame:
    return events.select("day", "event_type", (F.col("value") / (F.col("value") + F.lit(50.0))).alias("x"), (F.col("user_id") % 4 == 0).alias("quarter"))


_TAIL_OF = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"


@query(f"""WITH RECURSIVE e AS (SELECT ts::DATE AS day, day(ts) AS d, event_type, value / (value + 50.0::DOUBLE) AS x, user_id % 4 = 0 AS quarter FROM events), ref AS (SELECT * FROM e WHERE d <= 7),
tau AS (SELECT x AS tau FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ref) WHERE i = ceil((n - 1) * 0.95 - 1e-9)), qs AS (SELECT avg(quarter::INT::DOUBLE) AS share FROM ref),
days AS (SELECT DISTINCT day FROM e WHERE d > 7), both_sides AS (SELECT day, event_type, x, quarter, 1 AS cur FROM e WHERE d > 7 UNION ALL SELECT days.day, event_type, x, quarter, 0 FROM ref CROSS JOIN days),
g AS (SELECT day, x, sum(cur) AS a, sum(1 - cur) AS b FROM both_sides GROUP BY day, x),
c AS (SELECT day, (sum(a) OVER w)::DOUBLE / (sum(a) OVER o)::DOUBLE AS fa, (sum(b) OVER w)::DOUBLE / (sum(b) OVER o)::DOUBLE AS fb, sum(a) OVER o AS n, sum(b) OVER o AS m FROM g WINDOW w AS (PARTITION BY day ORDER BY x), o AS (PARTITION BY day)),
d AS (SELECT day, max(abs(fa - fb)) AS ks, max(n) AS n, max(m) AS m FROM c GROUP BY day), {_lattice("day", "d")},
k AS (SELECT day, count(*) AS n, sum(CASE WHEN x > tau THEN 1 ELSE 0 END) AS far, sum(quarter::INT) AS quarters, max(share) AS share FROM both_sides CROSS JOIN tau CROSS JOIN qs WHERE cur = 1 GROUP BY day),
up AS (SELECT day, sum({_TAIL_OF.format(p="0.05::DOUBLE")}) AS p FROM (SELECT day, n, unnest(range(far::BIGINT, n::BIGINT + 1)) AS i FROM k) GROUP BY day),
sm AS (SELECT day, i, quarters, {_TAIL_OF.format(p="share")} AS mass FROM (SELECT day, n, quarters, share, unnest(range(0, n::BIGINT + 1)) AS i FROM k)),
sp AS (SELECT a.day, least(1.0, sum(CASE WHEN a.mass <= b.mass * exp(1e-7::DOUBLE) THEN a.mass ELSE 0 END)) AS p FROM sm a JOIN sm b ON a.day = b.day AND b.i = b.quarters GROUP BY a.day),
t AS (SELECT day, event_type, sum(1 - cur) AS ref, sum(cur) AS cur FROM both_sides GROUP BY day, event_type), s AS (SELECT *, ref::DOUBLE / (sum(ref) OVER o)::DOUBLE AS r FROM t WINDOW o AS (PARTITION BY day)),
x AS (SELECT day, cur, (r + 1e-6) / (sum(r + 1e-6) OVER o) * (sum(cur) OVER o) AS e FROM s WINDOW o AS (PARTITION BY day)), q AS (SELECT day, sum((cur - e) * (cur - e) / e) AS chi2 FROM x GROUP BY day),
f AS (SELECT day, d.n::BIGINT AS n, ks, exact.p AS ks_p, up.p AS unknown_p, exp(-chi2 / 2) * (1 + chi2 / 2) AS mix_p, sp.p AS share_p FROM d JOIN exact USING (day) JOIN up USING (day) JOIN q USING (day) JOIN sp USING (day))
SELECT strftime(day, '%Y-%m-%d') AS day, n, round(ks, 9) AS ks, round(ks_p, 7) AS ks_p, round(unknown_p, 7) AS unknown_p, round(mix_p, 7) AS mix_p, round(share_p, 7) AS share_p,
  concat_ws(', ', CASE WHEN ks_p < 0.002 THEN 'values' END, CASE WHEN unknown_p < 0.002 THEN 'unknown rate' END, CASE WHEN mix_p < 0.002 THEN 'mix' END, CASE WHEN share_p < 0.002 THEN 'share' END) AS alerts FROM f""")
def stream_monitor(spark, sf_dir):
    """Every day of the event stream after the first week, judged once it is over against that week."""
    first = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).where(F.dayofmonth("ts") <= 7)
    reference = cut(marked_events(first).drop("day"), "reference")
    tau = metrics.threshold_higher(reference, "x", 0.95).first()["tau"]
    live = monitor.Monitor(spark, fresh_path(spark, "monitor"), judged_days(reference, tau), _FOUND)
    found = live.run(windows.read_events(spark, sf_dir).where(F.dayofmonth("ts") > 7), last=True)
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("ks", 9).alias("ks"), *[F.round(c, 7).alias(c) for c in ("ks_p", "unknown_p", "mix_p", "share_p")], "alerts")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def stream_daily_counts(spark, sf_dir):
    counts = windows.replay(windows.window_counts(windows.read_events(spark, sf_dir)))
    return counts.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n", F.round("mean_value", 6).alias("mean_value"))


_FOREIGN = "coalesce(lang, 'und') NOT IN ('en', 'und')"
_SHARE, _RETENTION = 0.4, 0.95
_SCORED = f"""{vectors._LOGITS}, sc AS (SELECT l.vec_id AS id, l.label, exp(l.m - l.lse) AS confidence, b.best AS pred, CASE WHEN {_FOREIGN} THEN 1 ELSE 0 END AS foreign_text, e.v AS vec
  FROM lse l JOIN best b USING (vec_id) JOIN e USING (vec_id) LEFT JOIN documents d ON d.doc_id = l.vec_id),
tr AS (SELECT * FROM sc WHERE label < {vectors.KNOWN} AND {vectors._TRAIN.replace("vec_id", "id")}), va AS (SELECT * FROM sc WHERE label < {vectors.KNOWN} AND {vectors._VAL.replace("vec_id", "id")}),
te AS (SELECT *, row_number() OVER (ORDER BY {mixed_sql("id")}, id) AS place FROM sc WHERE label < {vectors.KNOWN} AND {vectors._TEST.replace("vec_id", "id")}),
un AS (SELECT *, row_number() OVER (ORDER BY {mixed_sql("id")}, id) AS place FROM sc WHERE label >= {vectors.KNOWN}), size AS (SELECT count(*) AS n, floor({_SHARE}::DOUBLE * count(*)) AS u FROM te),
ba AS (SELECT 'known' AS batch, * FROM te UNION ALL SELECT 'mixed', te.* FROM te CROSS JOIN size WHERE place <= n - u UNION ALL SELECT 'mixed', un.* FROM un CROSS JOIN size WHERE place <= u)"""
_TAIL = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"


def scored_vectors(spark, sf_dir) -> DataFrame:
    """Every vector with its confidence, predicted class, and whether its document is in another language than English."""
    rows = vectors._logits(spark, sf_dir)
    pred = F.element_at("names", vec.argmax(F.transform("logits", lambda z: F.round(z, 12))) + 1)
    scored = rows.select(F.col("vec_id").alias("id"), "label", F.array_max(vec.softmax(F.col("logits"))).alias("confidence"), pred.alias("pred"), vec.doubles(F.col("embedding")).alias("vec"))
    langs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return scored.join(langs, "id", "left").withColumn("foreign", (~F.coalesce("lang", F.lit("und")).isin("en", "und")).cast("int")).drop("lang")


def batches(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Training and validation rows, and two batches: known traffic, and the same with a share of unknown labels."""
    rows = cut(scored_vectors(spark, sf_dir), "scored")  # a report reads them many times
    known = rows.where(f"label < {vectors.KNOWN}")
    train, val, test = (known.where(part.replace("vec_id", "id")) for part in (vectors._TRAIN, vectors._VAL, vectors._TEST))
    n = test.count()
    unknown = int(_SHARE * n)
    mixed_rows = sample(test, "id", n - unknown).unionByName(sample(rows.where(f"label >= {vectors.KNOWN}"), "id", unknown))
    return train, val, {"known": test, "mixed": cut(mixed_rows, "mixed")}


_REPORT = "batch string, n long, confidence_ks double, confidence_ks_p double, confidence_psi double, unknown_rate double, unknown_rate_p double, mix_chi2 double, mix_psi double, foreign_share double, foreign_share_train double, language_mix_p double, embedding_mmd2 double"


@query(f"""WITH RECURSIVE {_SCORED}, counts AS (SELECT batch, count(*)::DOUBLE AS n, sum(foreign_text)::DOUBLE AS f FROM ba GROUP BY batch),
tau AS (SELECT confidence AS tau FROM (SELECT confidence, row_number() OVER (ORDER BY confidence) - 1 AS i, count(*) OVER () AS n FROM va) WHERE i = floor((n - 1) * (1 - 0.95::DOUBLE) + 1e-9)),
unk AS (SELECT batch, sum(CASE WHEN confidence < tau THEN 1 ELSE 0 END) AS u FROM ba CROSS JOIN tau GROUP BY batch),
cf AS (SELECT b.batch, x.confidence, x.cur FROM (SELECT DISTINCT batch FROM ba) b JOIN (SELECT batch, confidence, 1 AS cur FROM ba UNION ALL SELECT NULL, confidence, 0 FROM va) x ON x.batch = b.batch OR x.batch IS NULL),
kg AS (SELECT batch, confidence, sum(cur) AS a, sum(1 - cur) AS b FROM cf GROUP BY 1, 2),
kc AS (SELECT batch, (sum(a) OVER w)::DOUBLE / (sum(a) OVER o)::DOUBLE AS fa, (sum(b) OVER w)::DOUBLE / (sum(b) OVER o)::DOUBLE AS fb FROM kg WINDOW w AS (PARTITION BY batch ORDER BY confidence), o AS (PARTITION BY batch)),
kd AS (SELECT batch, max(abs(fa - fb)) AS ks FROM kc GROUP BY batch), km AS (SELECT batch, sum(cur)::DOUBLE AS n, sum(1 - cur)::DOUBLE AS m FROM cf GROUP BY batch), kn AS (SELECT batch, ks, n, m FROM kd JOIN km USING (batch)), {_lattice("batch", "kn")},
kp AS (SELECT batch, ks, p FROM kn JOIN exact USING (batch)),
hb AS (SELECT batch, least(floor(confidence * 10) + 1, 10) AS k, sum(1 - cur) AS ref, sum(cur) AS cur FROM cf GROUP BY 1, 2),
hs AS (SELECT batch, ref::DOUBLE / (sum(ref) OVER o)::DOUBLE AS r, cur::DOUBLE / (sum(cur) OVER o)::DOUBLE AS c FROM hb WINDOW o AS (PARTITION BY batch)),
hp AS (SELECT batch, sum((c - r) * ln((c + 1e-4) / (r + 1e-4))) AS psi FROM hs GROUP BY batch),
mx AS (SELECT b.batch, x.pred, sum(1 - cur) AS ref, sum(cur) AS cur FROM (SELECT DISTINCT batch FROM ba) b JOIN (SELECT batch, pred, 1 AS cur FROM ba UNION ALL SELECT NULL, pred, 0 FROM tr) x ON x.batch = b.batch OR x.batch IS NULL GROUP BY 1, 2),
ms AS (SELECT *, ref::DOUBLE / (sum(ref) OVER o)::DOUBLE AS r, cur::DOUBLE / (sum(cur) OVER o)::DOUBLE AS c FROM mx WINDOW o AS (PARTITION BY batch)),
me AS (SELECT *, (r + 1e-6) / (sum(r + 1e-6) OVER o) * (sum(cur) OVER o) AS e FROM ms WINDOW o AS (PARTITION BY batch)),
mp AS (SELECT batch, sum((cur - e) * (cur - e) / e) AS chi2, sum((c - r) * ln((c + 1e-4) / (r + 1e-4))) AS psi FROM me GROUP BY batch),
ft AS (SELECT avg(foreign_text::DOUBLE) AS share FROM tr),
up AS (SELECT batch, sum({_TAIL.format(p="0.05::DOUBLE")}) AS p FROM (SELECT batch, n, unnest(range(u::BIGINT, n::BIGINT + 1)) AS i FROM unk JOIN counts USING (batch)) GROUP BY batch),
lm AS (SELECT batch, i, f, {_TAIL.format(p="share")} AS mass FROM (SELECT batch, n, f, share, unnest(range(0, n::BIGINT + 1)) AS i FROM counts CROSS JOIN ft)),
lp AS (SELECT a.batch, least(1.0, sum(CASE WHEN a.mass <= b.mass * exp(1e-7::DOUBLE) THEN a.mass ELSE 0 END)) AS p FROM lm a JOIN lm b ON a.batch = b.batch AND b.i = b.f GROUP BY a.batch),
vv AS (SELECT b.batch, x.cur, x.id, x.vec FROM (SELECT DISTINCT batch FROM ba) b JOIN (SELECT batch, 1 AS cur, id, vec FROM ba UNION ALL SELECT NULL, 0, id, vec FROM tr) x ON x.batch = b.batch OR x.batch IS NULL),
vp AS (SELECT a.batch, a.cur AS ca, b.cur AS cb, a.id < b.id AS up, list_sum([(a.vec[i] - b.vec[i]) * (a.vec[i] - b.vec[i]) for i in range(1, 65)]) AS d FROM vv a JOIN vv b ON a.batch = b.batch AND a.id <> b.id),
vg AS (SELECT batch, 1 / median(d) AS g FROM vp WHERE up AND d > 0 GROUP BY batch), vk AS (SELECT batch, ca, cb, avg(exp(-g * d)) AS k FROM vp JOIN vg USING (batch) GROUP BY 1, 2, 3),
vm AS (SELECT batch, sum(CASE WHEN ca = cb THEN k ELSE -k END) AS mmd2 FROM vk GROUP BY batch)
SELECT batch, n::BIGINT AS n, round(ks, 8) AS confidence_ks, round(kp.p, 8) AS confidence_ks_p, round(hp.psi, 8) AS confidence_psi, round(u / n, 8) AS unknown_rate, round(up.p, 8) AS unknown_rate_p, round(mp.chi2, 6) AS mix_chi2, round(mp.psi, 8) AS mix_psi,
  round(f / n, 8) AS foreign_share, round(share, 8) AS foreign_share_train, round(lp.p, 8) AS language_mix_p, round(mmd2, 8) AS embedding_mmd2
FROM counts JOIN unk USING (batch) JOIN kp USING (batch) JOIN hp USING (batch) JOIN mp USING (batch) JOIN up USING (batch) JOIN lp USING (batch) JOIN vm USING (batch) CROSS JOIN ft""")
def drift_report(spark, sf_dir):
    """Five signals of two batches: statistics and the p-values that have a closed form."""
    train, val, every = batches(spark, sf_dir)
    found = [{"batch": name} | dr.drift_report(train, val, batch, _RETENTION) for name, batch in every.items()]
    digits = {"mix_chi2": 6}
    return spark.createDataFrame([{k: round(v, digits.get(k, 8)) if isinstance(v, float) else v for k, v in r.items()} for r in found], _REPORT)


@query()
def drift_alerts(spark, sf_dir):
    """The same with the simulated p-values of class mix and vectors, and the signals that alert at a fifth of the level."""
    train, val, every = batches(spark, sf_dir)
    found = [{"batch": name} | dr.drift_report(train, val, batch, _RETENTION, dr.PERMUTATIONS) for name, batch in every.items()]
    return spark.createDataFrame(found, f"{_REPORT}, mix_p double, embedding_mmd_p double, alerts array<string>")


#: Rows of each reference set of the power study, drawn by a hash: a study simulates references as large as its windows.
_REFERENCE = 500
_ALERTS = [*dr.SIGNALS, "any"]


@query()
def power_study(spark, sf_dir):
    """Share of windows that alert, by size and traffic: five signals and any of them, 40 windows each drawn with replacement."""
    train, val, every = batches(spark, sf_dir)
    rows = scored_vectors(spark, sf_dir)
    columns = ["confidence", "pred", "foreign", "vec"]
    held = lambda df: {c: np.array([r[c] for r in df], dtype=float) for c in columns}
    reference = held(sample(train, "id", _REFERENCE).select(*columns).collect())
    reference["confidence"] = np.array([r["confidence"] for r in sample(val, "id", _REFERENCE).collect()])
    tau = metrics.threshold_lower(val, "confidence", _RETENTION).first()["tau"]
    sets = [(size, share) for size in _SIZES for share in (0.0, _SHARE)]
    wanted = [(size, share, rep, unknown, size - int(share * size) if not unknown else int(share * size)) for size, share in sets for rep in range(_REPS) for unknown in (0, 1)]
    upto = np.cumsum([0, *[w[4] for w in wanted if not w[3]]]), np.cumsum([0, *[w[4] for w in wanted if w[3]]])
    # Which window a draw belongs to: draws of either pool are numbered through.
    windows_of = [(*w[:4], int(upto[w[3]][k // 2]), int(upto[w[3]][k // 2 + 1])) for k, w in enumerate(wanted)]
    table = spark.createDataFrame(windows_of, "size int, share double, rep int, unknown int, first long, upto long")
    draws = table.where("upto > first").select("size", "share", "rep", "unknown", F.explode(F.expr("sequence(first, upto - 1)")).alias("draw"))
    pools = [every["known"], rows.where(f"label >= {vectors.KNOWN}")]
    drawn = [resample(pool.select("id", *columns), "id", int(upto[k][-1]), seed=13 + k).withColumn("unknown", F.lit(k)) for k, pool in enumerate(pools)]
    met = drawn[0].unionByName(drawn[1]).join(F.broadcast(draws), ["unknown", "draw"])

    def judged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        window = {c: np.stack(pdf[c]) if c == "vec" else pdf[c].to_numpy(dtype=float) for c in columns}
        ref = reference | {"n": len(pdf)}
        fired = dr.window_alerts({c: ref[c] for c in columns}, window, tau, seed=int(key[2]))
        return pd.DataFrame([[key[0], key[1], *[float(a in fired) for a in dr.SIGNALS], float(bool(fired))]], columns=["size", "share", *names])

    names = [a.replace(" ", "_") for a in _ALERTS]
    found = met.groupBy("size", "share", "rep").applyInPandas(judged, f"size int, share double, {', '.join(f'{n} double' for n in names)}")
    return found.groupBy("size", "share").agg(*[F.avg(n).alias(n) for n in names])
