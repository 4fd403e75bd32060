"""Mixing sources to target weights along a golden-ratio schedule.

Every source is a stream: its documents in a seeded order, cut into blocks of
equally many words. Slot ``i`` of the mix takes the point ``frac(i / phi)``,
finds the source whose share of the cumulative weights covers it, and joins the
block whose number is the slot's rank among that source's slots; a stream that
is used up starts again. A source gets the slots its target needs, no more: the
points beyond are void, missing ones follow at the end.

DataFrame operations only. Ranks and offsets are two-level sums (within a
bucket, then over the buckets), so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK_WORDS = 256
SEED = "mix-1"
#: Points are multiples of STRIDE modulo RING: the odd number next to RING / phi.
RING_BITS = 31
RING = 1 << RING_BITS
STRIDE = 1327217885
#: Slots whose ranks are counted together, and documents in a bucket of a stream.
RUN = 1 << 13
BUCKET_ROWS = 4096
#: A bucket is named by leading bits of the key, so many at most.
MOST_BUCKET_BITS = 31
#: Up to so many sources their table is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, repeat: int = REPEAT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target words of each row of ``sizes`` (``source``, ``source_size``).

    Sources weigh in code point order, null last. Targets share ``share`` times
    the total by weight; one that would exceed ``repeat`` times its source's size
    stops there and the others share the excess. One row per source, so the
    ordering windows hold as many rows as there are sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("nr") - 1) % len(weights) + 1).cast("int")).cast("long")
    one = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("nr", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    capped = ranked.withColumn("cap", F.lit(repeat) * F.col("source_size")).withColumn("limit", F.col("cap").cast("double") / F.col("weight"))
    before = one.orderBy("limit", "nr").rowsBetween(Window.unboundedPreceding, -1)
    everything = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything).cast("double") * F.lit(float(share))
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (budget - spent.cast("double")) / left.cast("double")
    free = capped.withColumn("level", level)
    free = free.withColumn("level", F.max(F.when(F.col("level") <= F.col("limit"), F.col("level"))).over(everything))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight").cast("double")), F.col("cap").cast("double"))
    return free.withColumn("target", target).select("source", "nr", "source_size", "target")


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Blocks, words and slots of each source, and its part of the ring of points."""
    quota = F.least(F.floor(F.col("target") + F.lit(0.5).cast("double")), F.lit(REPEAT) * F.col("source_size")).cast("long")
    sized = targets.withColumn("quota", quota).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    need = F.expr(f"CASE WHEN source_size = 0 THEN 0L ELSE (quota div source_size) * blocks + (quota % source_size + {block - 1}) div {block} END")
    slots = sized.withColumn("slots", need)
    one = Window.partitionBy(F.lit(1)).orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    ends = slots.withColumn("end", F.sum("slots").over(one)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1))))
    at = lambda c: F.expr(f"coalesce(cast(try_divide(cast({c} as decimal(20,0)) * {RING}, cast(all_slots as decimal(20,0))) as bigint), 0L)")
    return ends.withColumn("hi", at("end")).withColumn("lo", at("(end - slots)")).withColumn("n_sources", F.count("*").over(Window.partitionBy(F.lit(1))))


def _schedule(plan: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """``slot``, ``nr``, ``rank``: every slot of the mix and its rank within its source."""
    bits = max(12, (4 * n_sources).bit_length())
    shift = RING_BITS - bits
    cells = plan.where("hi > lo").select("nr", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {shift}), shiftright(hi - 1, {shift}))")).alias("cell"))
    points = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"((id % {RING}) * {STRIDE}) % {RING}").alias("x"))
    points = points.withColumn("cell", F.expr(f"shiftright(x, {shift})"))
    mine = points.join(cells, "cell").where("x >= lo and x < hi").select("slot", "nr", F.expr(f"slot div {RUN}").alias("run"))
    counts = mine.groupBy("nr", "run").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("nr").orderBy("run")) - F.col("n"))
    local = F.row_number().over(Window.partitionBy("nr", "run").orderBy("slot")) - 1
    ranked = mine.withColumn("local", local).join(base.select("nr", "run", "base"), ["nr", "run"]).select("slot", "nr", (F.col("base") + F.col("local")).alias("rank"))
    kept = ranked.join(_hint(plan.select("nr", "slots"), n_sources), "nr").where("rank < slots").select("slot", "nr", "rank")
    had = counts.groupBy("nr").agg(F.sum("n").alias("had"))
    short = plan.join(had, "nr", "left").where("slots > coalesce(had, 0)").select("nr", "n_sources", F.explode(F.expr("sequence(coalesce(had, 0L), slots - 1)")).alias("rank"))
    tail = short.select((F.lit(n_slots) + F.col("rank") * F.col("n_sources") + F.col("nr") - 1).alias("slot"), "nr", "rank")
    return kept.unionByName(tail)


def _hint(table: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS) -> DataFrame:
    """What a mix of all sources takes from every document.

    Returns one row per input row: ``doc_id``, ``size`` (words), ``source_size``,
    ``target`` (of its source), ``taken`` (words the mix takes, repeats counted),
    ``first_slot`` (the mix's first slot with one of its words, null if none).

    Null texts have size 0, as have blank ones; nothing is taken from them and they
    go round every join. Null is a source of its own, the last. Equal ids stand next to each other in the
    seeded order. An empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    words = cut(words.withColumn("key", key), "words")
    plan = cut(_plan(source_targets(words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).select("source", "source_size")), block), "sources")
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    rows = words.count()
    bits = min(MOST_BUCKET_BITS, (rows // BUCKET_ROWS).bit_length())

    columns = ["source", "nr", "source_size", "target", "blocks", "quota"]
    side = _hint(plan.select(F.col("source").alias("_source"), *columns[1:]), n_sources)
    placed = words.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    nothing = F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")
    blank = placed.where("size = 0").select("doc_id", "size", "source_size", "target", *nothing)  # takes no part in the joins
    placed = placed.where("size > 0").withColumn("bucket", F.expr(f"shiftright(cast(conv(substring(key, 1, 8), 16, 10) as bigint), {32 - bits})"))
    sums = placed.groupBy("nr", "bucket").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.sum("n").over(Window.partitionBy("nr").orderBy("bucket")) - F.col("n")).select("nr", "bucket", "base")
    inside = Window.partitionBy("nr", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(base, ["nr", "bucket"]).withColumn("lo", F.col("base") + F.col("upto") - F.col("size"))

    covers = F.expr(f"sequence(lo div {block}, (lo + size - 1) div {block})")
    pieces = placed.select("doc_id", "nr", "size", "source_size", "target", "lo", F.explode(covers).alias("number"))
    schedule = _schedule(plan, n_slots, n_sources).join(_hint(plan.select("nr", "blocks", "quota", F.col("source_size").alias("words")), n_sources), "nr")
    used = schedule.select(
        "nr",
        "slot",
        F.expr("rank % blocks").alias("number"),
        F.expr(f"least({block}L, words - (rank % blocks) * {block}, quota - (rank div blocks) * words - (rank % blocks) * {block})").alias("take"),
    )
    overlap = F.expr(f"CASE WHEN take > 0 THEN greatest(0L, least(lo + size, number * {block} + take) - greatest(lo, number * {block})) ELSE 0L END")
    met = pieces.join(used, ["nr", "number"], "left").withColumn("overlap", overlap)
    out = met.groupBy("nr", "lo", "doc_id", "size", "source_size", "target").agg(F.sum("overlap").alias("taken"), F.min(F.when(F.col("overlap") > 0, F.col("slot"))).alias("first_slot"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot").unionByName(blank)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as often as the mix takes it, ``REPEAT`` times at most.

    A document that the mix takes in part stays whole, so each source exceeds its
    target by less than the documents where its rounds end; one that is much longer
    than its target is still there. Rows of one id count together, as do rows
    without id. A document without words takes no part in a mix and is left out;
    one of which nothing is taken goes. An empty table stays empty; names never
    clash. Texts move only where the ids of the mix are too many to broadcast.
    """
    plan = mix_sources(docs, id_col, text_col, source_col).where("taken > 0")
    copies = plan.groupBy("doc_id").agg(F.least(F.ceil(F.sum("taken") / F.sum("size")), F.lit(REPEAT)).cast("int").alias("copies"))
    copies = broadcast_if_small(cut(copies, "copies").select(F.col("doc_id").alias("_id"), "copies"))
    packed = docs.where(F.col(text_col).rlike(NO_SPACE)).select(F.struct("*").alias("row"), F.col(id_col).alias("_doc"))
    return packed.join(copies, F.col("_doc").eqNullSafe(F.col("_id"))).select("row", F.explode(F.expr("sequence(1, copies)")).alias("n")).select("row.*")


def op8_golden_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes from each of ``documents``, by expressions and joins alone."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH words AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS key
  FROM documents
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM words GROUP BY source)
), capped AS (
  SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {REPEAT} * source_size AS cap FROM ranked
), leveled AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS lim,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM capped WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, nr, source_size,
    coalesce(least(CAST(cap AS DOUBLE), max(CASE WHEN level <= lim THEN level END) OVER () * CAST(weight AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM leveled
), quotas AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), {REPEAT} * source_size) AS quota,
    (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
  FROM targets
), needs AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * blocks + (quota % source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} END AS slots
  FROM quotas
), ends AS (
  SELECT *, CAST(sum(slots) OVER (ORDER BY nr) AS HUGEINT) AS upto, CAST(sum(slots) OVER () AS HUGEINT) AS all_slots, count(*) OVER () AS n_sources FROM needs
), plan AS (
  SELECT *, CASE WHEN all_slots = 0 THEN 0 ELSE upto * {RING} // all_slots END AS hi,
    CASE WHEN all_slots = 0 THEN 0 ELSE (upto - slots) * {RING} // all_slots END AS lo
  FROM ends
), points AS (
  SELECT i AS slot, ((i % {RING}) * {STRIDE}) % {RING} AS x
  FROM range((SELECT CAST(coalesce(max(all_slots), 0) AS BIGINT) FROM plan)) t(i)
), body AS (
  SELECT slot, nr, row_number() OVER (PARTITION BY nr ORDER BY slot) - 1 AS rnk, slots
  FROM points JOIN plan ON x >= lo AND x < hi
), schedule AS (
  SELECT slot, nr, rnk FROM body WHERE rnk < slots
  UNION ALL
  SELECT CAST(all_slots AS BIGINT) + r * n_sources + nr - 1, nr, r
  FROM (SELECT *, unnest(range(coalesce(had, 0), slots)) AS r FROM plan LEFT JOIN (SELECT nr AS hnr, count(*) AS had FROM body GROUP BY 1) ON hnr = nr)
), used AS (
  SELECT nr, slot, rnk % blocks AS number,
    least({BLOCK_WORDS}, source_size - (rnk % blocks) * {BLOCK_WORDS}, quota - (rnk // blocks) * source_size - (rnk % blocks) * {BLOCK_WORDS}) AS take
  FROM schedule JOIN plan USING (nr)
), placed AS (
  SELECT doc_id, size, nr, source_size, target,
    sum(size) OVER (PARTITION BY nr ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS lo,
    row_number() OVER () AS row_nr
  FROM words JOIN plan ON words.source IS NOT DISTINCT FROM plan.source
), pieces AS (
  SELECT row_nr, nr, size, CAST(lo AS BIGINT) AS lo, unnest(range(CAST(lo AS BIGINT) // {BLOCK_WORDS}, (CAST(lo AS BIGINT) + size - 1) // {BLOCK_WORDS} + 1)) AS number
  FROM placed WHERE size > 0
), met AS (
  SELECT row_nr, slot, greatest(0, least(lo + size, number * {BLOCK_WORDS} + take) - greatest(lo, number * {BLOCK_WORDS})) AS overlap
  FROM pieces JOIN used USING (nr, number)
), sums AS (
  SELECT row_nr, CAST(sum(overlap) AS BIGINT) AS taken, min(CASE WHEN overlap > 0 THEN slot END) AS first_slot FROM met GROUP BY 1
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM placed LEFT JOIN sums USING (row_nr)
"""
