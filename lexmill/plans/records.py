"""Fields of records, lookups and reshaped tables, and round trips through files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import vec
from lexmill.operators import checks, leaks, metrics, openset, ranking, splits
from lexmill.plans import vectors
from lexmill.plans.registry import query
from lexmill.sources import npz, tables
from lexmill.sources.shared import fresh_path
from lexmill.sources.tables import load
from lexmill.streaming import windows
from lexmill.streaming.latest import latest_rows


@query("""SELECT conv_id, turn, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped, role || '/' || (conv_id % 7) AS path, split_part(role || '/' || (conv_id % 7), '/', -1) AS last,
  CASE WHEN starts_with(role, 'us') THEN substr(role, 3) ELSE role END AS bare, regexp_extract('ref PO-' || (10000 + conv_id) || ' ' || role, '(PO|DOC)-([0-9]+)', 2) AS number FROM conversations""")
def text_pieces(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    path = F.concat_ws("/", "role", (F.col("conv_id") % 7).cast("string"))
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    marked = F.concat(F.lit("ref PO-"), (10000 + F.col("conv_id")).cast("string"), F.lit(" "), F.col("role"))
    return rows.select("conv_id", "turn", F.length(tx.strip(padded)).cast("long").alias("stripped"), path.alias("path"), tx.last_part(path, "/").alias("last"), tx.without_prefix(F.col("role"), "us").alias("bare"), tx.entity_number(marked).alias("number"))


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def prefixed_sources(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").where(F.startswith("source", F.lit("src1")))


_OVERRIDES = {3: "xx", 5: "yy", 8: "zz"}


@query("SELECT doc_id, CASE doc_id WHEN 3 THEN 'xx' WHEN 5 THEN 'yy' WHEN 8 THEN 'zz' ELSE lang END AS lang FROM documents")
def label_overrides(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.override(F.col("doc_id").cast("int"), _OVERRIDES, F.col("lang")).alias("lang"))


@query("""SELECT item_id, 'Choose one language.' || chr(10) || chr(10) || '- de: ' || length(text) || ' characters' || chr(10) || '- en: ' || len(string_split(text, ' ')) || ' words' || chr(10) || chr(10) || 'Answer with one of them.' AS prompt FROM benchmark""")
def prompt_lines(spark, sf_dir):
    about = [F.format_string("%d characters", F.length("text")), F.format_string("%d words", F.size(F.split("text", " ")))]
    return load(spark, sf_dir, "benchmark").select("item_id", tx.prompt("Choose one language.", ["de", "en"], about, "Answer with one of them.").alias("prompt"))


_LANGS = ("de", "en", "es", "fr")
_ABOUT = "count(*) FILTER (WHERE lang = '{l}') || ' documents of ' || coalesce(CAST(round(avg(n_chars) FILTER (WHERE lang = '{l}'))::BIGINT AS VARCHAR), '0') || ' characters'"


@query(f"""WITH s AS (SELECT source, lang, left(text, 80) AS t, row_number() OVER (PARTITION BY source, lang ORDER BY {splits.mixed_sql("doc_id")}, doc_id) AS r FROM documents WHERE lang IN {_LANGS}),
l AS (SELECT source, string_agg('"' || t || '" -> ' || lang, chr(10) ORDER BY lang, r) AS shots FROM s WHERE r <= 3 GROUP BY source),
c AS (SELECT source, {", ".join(f"{_ABOUT.format(l=x)} AS {x}" for x in _LANGS)} FROM documents GROUP BY source), m AS (SELECT unnest(['closed', 'open']) AS mode, unnest([0, 3]) AS shots)
SELECT c.source, mode, 'You say which language a text is in.' || chr(10) || 'Texts may be short.' || chr(10) || chr(10) || 'Labels:' || chr(10) || {" || chr(10) || ".join(f"'- {x}: ' || {x}" for x in _LANGS)}
  || CASE WHEN mode = 'open' THEN chr(10) || '- unknown: none of the languages above' ELSE '' END || CASE WHEN m.shots > 0 AND l.shots IS NOT NULL THEN chr(10) || chr(10) || 'Examples:' || chr(10) || l.shots ELSE '' END || chr(10) || chr(10) || 'Answer with the best label.' AS prompt
FROM c CROSS JOIN m LEFT JOIN l ON l.source = c.source""")
def shots_prompts(spark, sf_dir):
    """A prompt for each source: closed set without examples, and open set with three texts of each language."""
    docs = load(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    quoted = F.concat(F.lit('"'), F.left("text", F.lit(80)), F.lit('" -> '), "lang")
    group = F.concat_ws("/", "source", "lang")
    drawn = splits.sample_per_group(docs.where(F.col("lang").isin(*_LANGS)).withColumn("_g", group), "doc_id", "_g", 3).select("source", "lang", "place", quoted.alias("line"))
    shots = drawn.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "place", "line"))), lambda x: x["line"]).alias("shots"))
    of = lambda x: F.col("lang") == x
    counts = docs.groupBy("source").agg(*[F.format_string("%d documents of %s characters", F.count_if(of(x)), F.coalesce(F.round(F.avg(F.when(of(x), F.col("n_chars")))).cast("long").cast("string"), F.lit("0"))).alias(x) for x in _LANGS])
    intro, outro = ["You say which language a text is in.", "Texts may be short."], "Answer with the best label."
    made = lambda unknown, lines: tx.shots_prompt(intro, list(_LANGS), [F.col(x) for x in _LANGS], unknown, lines, outro)
    modes = F.array(F.struct(F.lit("closed").alias("mode"), made(None, F.lit(None).cast("array<string>")).alias("prompt")), F.struct(F.lit("open").alias("mode"), made("none of the languages above", F.col("shots")).alias("prompt")))
    return counts.join(shots, "source", "left").select("source", F.explode(modes).alias("m")).select("source", "m.mode", "m.prompt")


@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN (conv_id % 50) + 0.5 + 1 WHEN 1 THEN (conv_id % 9) + 1 ELSE least(60, pow(2.0, turn)) END::DOUBLE AS wait FROM conversations""")
def retry_delays(spark, sf_dir):
    asked = lambda m: F.format_string(m, F.col("conv_id") % 50)
    message = F.when(F.col("conv_id") % 3 == 0, asked("429 'retryDelay': '%d.5s' now")).when(F.col("conv_id") % 3 == 1, F.format_string("please Retry: %ds", F.col("conv_id") % 9)).otherwise("overloaded")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.retry_delay(message, F.col("turn")).alias("wait"))


@query("""SELECT source, CASE WHEN (n % 8) = 4 AND (n // 8) % 2 = 0 THEN (n // 8)::DOUBLE WHEN (n % 8) = 4 THEN (n // 8 + 1)::DOUBLE ELSE round(n / 8.0)::DOUBLE END AS eighths,
  printf('%.1f%%', round(n::DOUBLE / sum(n) OVER (), 6) * 100) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def rounded_shares(spark, sf_dir):
    """Counts in eighths rounded half to even, and shares as percentages."""
    table = ranking.value_counts(load(spark, sf_dir, "documents"), "source")
    return table.select("source", F.bround(F.col("n") / 8, 0).alias("eighths"), tx.percent(F.round("share", 6)).alias("share"))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), -1) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.other.k') AS DOUBLE), 0.5) AS other, '{"type":"' || event_type || '","user":' || user_id || '}' AS record FROM events""")
def json_defaults(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", tx.json_number(F.col("props"), "$.k", -1.0).alias("k"), tx.json_number(F.col("props"), "$.other.k", 0.5).alias("other"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("record"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 2 AS odd FROM embeddings)
SELECT vec_id, i - 1 AS pos, round(CASE WHEN odd = 1 THEN (v[i] + v[65 - i]) / 2 ELSE v[i] END, 6) AS x FROM e CROSS JOIN range(1, 65) t(i)""")
def masked_pooling(spark, sf_dir):
    """Mean over three token vectors of which the mask keeps the first and, for odd ids, the second."""
    v = vec.doubles(F.col("embedding"))
    tokens = F.array(v, F.reverse(v), F.transform(v, lambda x: x * 100))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", vec.masked_mean(tokens, F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0))).alias("m"))
    return rows.select("vec_id", F.posexplode("m").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH {vectors._E}, {vectors._centers()} SELECT vec_id, round(exp(-0.5::DOUBLE * list_sum([(e.v[i] - c.v[i]) * (e.v[i] - c.v[i]) for i in range(1, 65)])), 8) AS near FROM e JOIN c USING (label)""")
def kernel_to_centroid(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    centers = openset.centroids(rows, "label", "embedding").select("label", "centroid")
    return rows.join(F.broadcast(centers), "label").select("vec_id", F.round(vec.rbf(vec.doubles(F.col("embedding")), F.col("centroid"), F.lit(0.5)), 8).alias("near"))


@query("""WITH k AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT vec_id FROM embeddings), c AS (SELECT id, count(*) AS n FROM k GROUP BY id)
SELECT count(*) FILTER (WHERE n = 3) AS in_all, count(*) FILTER (WHERE n < 3) AS in_some FROM c""")
def shared_ids(spark, sf_dir):
    ids = lambda name, key: load(spark, sf_dir, name).select(F.col(key).alias("id"))
    return checks.same_keys(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("embeddings", "vec_id"), on="id")


@query("SELECT md5(text) AS key, min(source) AS least, max(source) AS most, count(*) AS n FROM documents GROUP BY text HAVING min(source) <> max(source)")
def mixed_text_groups(spark, sf_dir):
    return checks.mixed_groups(load(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "source"), "key", "source")


@query("""WITH x AS (SELECT lang, n_chars::DOUBLE / (n_chars + 1500)::DOUBLE AS x FROM documents), b AS (SELECT lang, least(floor(x * 25) + 1, 25)::INTEGER AS bin, count(*) AS n FROM x GROUP BY 1, 2)
SELECT lang, bin, n, round(n::DOUBLE * 25 / (sum(n) OVER (PARTITION BY lang))::DOUBLE, 9) AS density FROM b""")
def length_histogram(spark, sf_dir):
    chars = F.col("n_chars").cast("double")
    rows = load(spark, sf_dir, "documents").select("lang", (chars / (chars + F.lit(1500.0))).alias("x"))
    return metrics.histogram(rows, "x", keys=("lang",)).withColumn("density", F.round("density", 9))


@query(f"""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {splits.mixed_sql("doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
WHERE r <= greatest(floor(n * 0.1 + 0.5), 1)""")
def stratified_tenth(spark, sf_dir):
    return splits.stratified_share(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.1).select("doc_id", "quality")


@query("WITH i AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, id AS source_id FROM documents JOIN i USING (source)")
def rows_with_label_ids(spark, sf_dir):
    return ranking.with_ids(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "source_id")


_ROWS, _COLUMNS = ["src3", "src0", "absent", "src1"], ["zh", "fr", "en"]


@query(f"""WITH o AS (SELECT unnest({_ROWS}) AS source, unnest(range(0, 4))::INTEGER AS place) SELECT source, place, count(*) FILTER (WHERE lang = 'zh') AS zh, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'en') AS en
FROM o LEFT JOIN documents USING (source) GROUP BY source, place""")
def reindexed_crosstab(spark, sf_dir):
    return ranking.counts_in_order(load(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", _ROWS, _COLUMNS)


@query("""SELECT 'n' AS metric, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents
UNION ALL SELECT 'chars', sum(n_chars) FILTER (WHERE lang = 'de')::BIGINT, sum(n_chars) FILTER (WHERE lang = 'en')::BIGINT, sum(n_chars) FILTER (WHERE lang = 'fr')::BIGINT FROM documents""")
def transposed_summary(spark, sf_dir):
    table = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return ranking.transposed(table, "lang", ["de", "en", "fr"], ["n", "chars"])


_TERMS = ("license", "copyright", "secret")


@query(f"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '{"|".join(_TERMS)}'))) AS n_terms FROM documents WHERE regexp_matches(lower(text), '{"|".join(_TERMS)}')""")
def leak_terms(spark, sf_dir):
    """Documents that hold a listed term, the last part of the contamination verdict."""
    found = load(spark, sf_dir, "documents").select("doc_id", F.size(leaks.listed_terms(F.col("text"), _TERMS)).cast("long").alias("n_terms"))
    return found.where("n_terms > 0")


@query("SELECT conv_id || '-' || turn AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, role AS label FROM conversations")
def csv_messages(spark, sf_dir):
    """Messages written as CSV, marks, quotes and line ends included, and read back."""
    path = fresh_path(spark, "messages")
    tables.write_csv(load(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.col("role").alias("label")), path)
    return tables.read_messages(spark, path)


@query("SELECT 'm' AS model, CAST(conv_id AS VARCHAR) AS id, max(turn) AS turn, count(*) AS answers FROM conversations GROUP BY conv_id")
def answers_log(spark, sf_dir):
    """A log that two runs append to: the last answer of each key counts, whatever was answered before."""
    path = fresh_path(spark, "answers")
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    answer = lambda turn, n: rows.select(F.lit("m").alias("model"), F.lit("open").alias("mode"), F.lit(0).alias("shots"), F.col("conv_id").cast("string").alias("id"), F.lit("p").alias("pred"), turn.alias("in_tokens"), n.alias("out_tokens"), F.lit(0.1).alias("latency_s"))
    for turn, n in ((F.lit(-1).cast("long"), F.lit(0).cast("long")), (F.col("last"), F.col("n"))):
        tables.append_json(answer(turn, n), path)
    return tables.read_answers(spark, path).select("model", "id", F.col("in_tokens").alias("turn"), F.col("out_tokens").alias("answers"))


@query("SELECT (item_id % 8)::INTEGER AS part, length(string_agg(text, chr(10) ORDER BY item_id)) + 1 AS chars, md5(string_agg(text, chr(10) ORDER BY item_id) || chr(10)) AS digest FROM benchmark GROUP BY 1")
def corpus_files(spark, sf_dir):
    """The benchmark as eight text files, found again below their folder."""
    path = fresh_path(spark, "corpus")
    rows = load(spark, sf_dir, "benchmark").withColumn("part", (F.col("item_id") % 8).cast("int"))
    rows.repartition("part").sortWithinPartitions("part", "item_id").select("part", "text").write.partitionBy("part").text(path)
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int")
    return tables.read_corpus(spark, path).select(part.alias("part"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum([x::DOUBLE * x for x in embedding]), 6) AS power, len(embedding) AS dims FROM embeddings")
def array_archives(spark, sf_dir):
    """The embeddings as NumPy archives, found again."""
    path = fresh_path(spark, "arrays")
    npz.register(spark)
    load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").write.format("npz").mode("append").save(path)
    back = spark.read.format("npz").load(path)
    power = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return back.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(power, 6).alias("power"), F.size("embedding").cast("long").alias("dims"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def resumed_parts(spark, sf_dir):
    """A job that stops after two languages, redoes one and goes on with those that are missing."""
    path = fresh_path(spark, "parts")
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    tables.write_parts(rows.where("lang in ('de', 'en')"), path, "lang")
    tables.write_parts(rows.where("lang = 'en'"), path, "lang")
    tables.write_parts(tables.missing_parts(rows, path, "lang"), path, "lang")
    return spark.read.schema(rows.schema).parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stream_latest_rows(spark, sf_dir):
    """The last event of every user, from a stream that keeps one row of state a user."""
    events = windows.read_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    given = windows.replay_append(latest_rows(events, ["user_id"], ["ts", "event_id"], "ts"), "latest", "update")
    return tables.latest(given, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_first_answers(spark, sf_dir):
    """A log that is replayed from its start: every event arrives twice and counts once."""
    twice = windows.read_events(spark, sf_dir).union(windows.read_events(spark, sf_dir))
    kept = windows.replay_append(windows.first_answers(twice, ["event_id"], "40 days").select("event_id", "event_type", "value"), "first")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
