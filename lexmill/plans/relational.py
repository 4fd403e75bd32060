"""Joins, set operations and lookups between tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import checks, ranking
from lexmill.operators.quantiles import merged, quantiles, sketched
from lexmill.plans.registry import query
from lexmill.sources.shared import cut
from lexmill.sources.tables import latest, load


@query("SELECT doc_id, lang, quality, toxic, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def labels_left_join(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return checks.one_to_one(docs, load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic", F.col("quality").isNull().alias("unlabelled"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def labelled_semi(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_anti(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS left_repeats, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS right_repeats,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_only, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS right_only,
  (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS "both" """)
def one_to_one_check(spark, sf_dir):
    return checks.key_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


_SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END"


@query(f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM documents) SELECT 'known split' AS rule, count(*) FILTER (WHERE split NOT IN ('train', 'val', 'test')) AS broken FROM s
UNION ALL SELECT 'held out absent', count(*) FILTER (WHERE NOT (split <> 'train' OR source <> 'src0')) FROM s UNION ALL SELECT 'has text', count(*) FILTER (WHERE length(text) = 0) FROM s""")
def split_checks(spark, sf_dir):
    split = F.when(F.col("doc_id") % 20 < 14, "train").when(F.col("doc_id") % 20 < 17, "val").otherwise("test")
    rows = load(spark, sf_dir, "documents").withColumn("split", split)
    return checks.violations(rows, {"known split": F.col("split").isin("train", "val", "test"), "held out absent": (F.col("split") != "train") | (F.col("source") != "src0"), "has text": F.length("text") > 0})


@query("""SELECT origin, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS origin, quality::INTEGER AS label, text FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'benchmark', -1, text FROM benchmark) GROUP BY origin, label""")
def union_with_outliers(spark, sf_dir):
    known = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select(F.lit("documents").alias("origin"), F.col("quality").cast("int").alias("label"), "text")
    outliers = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.lit(-1).alias("label"), "text")
    return known.unionByName(outliers).groupBy("origin", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT 'union' AS operation, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL
SELECT 'intersection', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL
SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'outside', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def set_ops(spark, sf_dir):
    ordered = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    known = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    # One shuffle for all four: each key once, with the sides that hold it.
    sides = ordered.distinct().withColumn("o", F.lit(1)).withColumn("c", F.lit(0)).unionByName(known.distinct().withColumn("o", F.lit(0)).withColumn("c", F.lit(1)))
    both = sides.groupBy("k").agg(F.max("o").alias("o"), F.max("c").alias("c"))
    counts = both.agg(F.count("*").alias("union"), F.count_if((F.col("o") == 1) & (F.col("c") == 1)).alias("intersection"), F.count_if(F.col("o") == 0).alias("difference"), F.count_if(F.col("c") == 0).alias("outside"))
    return counts.unpivot([], ["union", "intersection", "difference", "outside"], "operation", "n")


@query("SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def latest_per_key(spark, sf_dir):
    return latest(load(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k,
  round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value FROM events GROUP BY event_type""")
def event_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_samp("value"), 6).alias("sd_value")
    )


@query("SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)")
def label_ids(spark, sf_dir):
    return ranking.dense_ids(load(spark, sf_dir, "documents"), "source")


@query("""SELECT count(*) AS groups, count(*) FILTER (WHERE n_langs > 1) AS mixed, sum(other)::BIGINT AS other FROM (
SELECT text, count(DISTINCT lang) AS n_langs, sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS other FROM documents GROUP BY text)""")
def group_label_check(spark, sf_dir):
    groups = load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("lang").alias("lo"), F.max("lang").alias("hi"), F.min_by("lang", "doc_id").alias("first"), F.sum((F.col("lang") != "en").cast("int")).alias("other"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("lo") != F.col("hi")).alias("mixed"), F.sum("other").alias("other"))


@query("SELECT n AS place, vec_id, label FROM (SELECT n, n * 7 % 50 AS k FROM range(0, 20) t(n)) JOIN embeddings ON vec_id = k")
def ordered_lookup(spark, sf_dir):
    wanted = spark.range(20).select(F.col("id").alias("place"), (F.col("id") * 7 % 50).alias("vec_id"))
    return load(spark, sf_dir, "embeddings").select("vec_id", "label").join(F.broadcast(wanted), "vec_id").select("place", "vec_id", "label")


@query("""SELECT src_id, lang, source, chars FROM (SELECT doc_id AS src_id, l.lang, length(text) AS chars FROM documents CROSS JOIN (SELECT unnest(['xx', 'yy']) AS lang) l) t
JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 20 < 14 AND lang = 'es') d ON t.src_id = d.doc_id""")
def translated_copies_in_train(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    copies = docs.select(F.col("doc_id").alias("src_id"), F.explode(F.array(F.lit("xx"), F.lit("yy"))).alias("lang"), F.length("text").cast("long").alias("chars"))
    train = docs.where((F.col("doc_id") % 20 < 14) & (F.col("lang") == "es")).select("doc_id", "source")
    return copies.join(train, copies["src_id"] == train["doc_id"]).select("src_id", "lang", "source", "chars")


@query("""SELECT role, count(*) AS n, round(avg(words), 6) AS mean_words, quantile_cont(words, 0.5)::DOUBLE AS p50, round(quantile_cont(words, 0.95)::DOUBLE, 6) AS p95
FROM (SELECT role, len(regexp_extract_all(text, '\\S+')) AS words FROM conversations) GROUP BY role""")
def usage_summary(spark, sf_dir):
    words = load(spark, sf_dir, "conversations").select("role", F.regexp_count("text", F.lit(r"(?U)\S+")).alias("words"))
    means = words.groupBy("role").agg(F.round(F.avg("words"), 6).alias("mean_words"))
    found = quantiles(words, "words", (0.5, 0.95), ("role",))
    return found.join(means, "role").select("role", "n", "mean_words", F.col("quantiles")[0].alias("p50"), F.round(F.col("quantiles")[1], 6).alias("p95"))


@query("""SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.05), 9) AS p05, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.999), 9) AS p999 FROM events GROUP BY event_type""")
def event_quantiles(spark, sf_dir):
    """Exact quantiles by type from sketches that are kept by day and merged."""
    rows = load(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    kept = cut(sketched(rows, "value", ("event_type", "day")), "sketches")
    found = quantiles(rows, "value", (0.05, 0.5, 0.95, 0.999), ("event_type",), merged(kept, ("event_type",)))
    return found.select("event_type", "n", *[F.round(F.col("quantiles")[k], 9).alias(name) for k, name in enumerate(("p05", "p50", "p95", "p999"))])


@query("""SELECT l_returnflag, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT n_name) AS nations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def joined_crosstab(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("revenue"), F.countDistinct("n_name").alias("nations"))


@query("SELECT user_id, n, n > avg(n) OVER () AS busy FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def busy_users(spark, sf_dir):
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select("user_id", "n", (F.col("n") > F.col("mean")).alias("busy"))


@query("""WITH p AS (SELECT doc_id % 5 AS fold, avg(n_chars) AS m FROM documents GROUP BY 1), a AS (SELECT fold, m FROM p WHERE fold <> 3), b AS (SELECT fold, m * 2 AS m FROM p WHERE fold <> 1)
SELECT coalesce(a.fold, b.fold) AS fold, round(a.m - b.m, 6) AS diff FROM a FULL JOIN b ON a.fold = b.fold""")
def aligned_fold_diff(spark, sf_dir):
    per = load(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg("n_chars").alias("m"))
    a, b = per.where("fold <> 3").withColumnRenamed("m", "ma"), per.where("fold <> 1").select("fold", (F.col("m") * 2).alias("mb"))
    return a.join(b, "fold", "full_outer").select("fold", F.round(F.col("ma") - F.col("mb"), 6).alias("diff"))


@query("SELECT lang, label, n, (sum(n) OVER (PARTITION BY lang ORDER BY label))::BIGINT AS running FROM (SELECT lang, quality AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)")
def running_counts(spark, sf_dir):
    counts = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id").groupBy("lang", F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.partitionBy("lang").orderBy("label")))
