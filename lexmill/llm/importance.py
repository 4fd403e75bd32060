"""Importance resampling towards a target distribution of hashed words.

Words are found and hashed in the contiguous UTF-8 buffer of an Arrow column: a
lookup table classifies every byte, differences of the classes give the bounds of
words, and a table-driven CRC-32 advances over all words at the same time, one
byte a step. A bucket's gain is the log ratio of its smoothed shares in target and
corpus; a document's weight is the mean gain of its words, and seeded Gumbel noise
turns the best scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._words import text_slices
from lexmill.sources.shared import bounded_batches, cut

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a word that are advanced with all others; what a longer word has beyond goes through zlib.
STEPS = 64
#: Copies of a row that are dealt out together.
COPIES = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_lo : _hi + 1] = False


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of an Arrow string array and the offsets of its texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    body = texts.buffers()[2]
    buf = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return _LOWER[buf], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer; a word never spans two texts."""
    classes = np.zeros(len(buf) + 2, dtype=np.int8)
    classes[1:-1] = _WORD[buf]
    steps = np.diff(classes)
    # A text that begins inside a run of word bytes ends one word and starts another.
    joints = offsets[1:-1]
    joints = joints[(joints > 0) & (joints < len(buf))]
    joints = np.unique(joints[_WORD[buf[joints - 1]] & _WORD[buf[joints]]])
    starts = np.sort(np.concatenate((np.flatnonzero(steps == 1), joints)))
    ends = np.sort(np.concatenate((np.flatnonzero(steps == -1), joints)))
    return starts, ends


def crc32_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every ``buf[start:end]``, advanced one byte a step over all that are long enough."""
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    sizes = ends - starts
    open_ = np.flatnonzero(sizes > 0)
    for step in range(STEPS):
        if not len(open_):
            break
        c = crc[open_]
        crc[open_] = _CRC[(c ^ buf[starts[open_] + step]) & 0xFF] ^ (c >> 8)
        open_ = open_[sizes[open_] > step + 1]
    crc = ~crc
    for i in open_:
        crc[i] = zlib.crc32(buf[starts[i] + STEPS : ends[i]], int(crc[i]))
    return crc


def hashed_words(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Word offsets by text (one more than texts), and the bucket of every word."""
    buf, offsets = _buffer(texts)
    starts, ends = word_bounds(buf, offsets)
    return np.searchsorted(starts, offsets), (crc32_of(buf, starts, ends) % np.uint32(buckets)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    for lo, hi in text_slices(column):
        yield column.slice(lo, hi - lo)


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: words of all texts in each bucket that has any. A task sends a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch.column(0)):
                total += np.bincount(hashed_words(part, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    bounded_batches(rows.sparkSession)
    texts = rows.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths: the floored log ratio of its smoothed shares in target and corpus."""

    def counted(rows: DataFrame, column: str) -> np.ndarray:
        out = np.zeros(buckets)
        for r in bucket_counts(rows, column, buckets).collect():  # a row a bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counted(corpus, text_col), counted(target, target_text)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_features`` and ``weight``: the floored mean gain of a text's words, 0 without words."""
    send = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for part in _slices(batch.column(1)):
                bounds, found = hashed_words(part, len(send.value))
                upto = np.concatenate(([0], np.cumsum(send.value[found])))
                counts.append(np.diff(bounds))
                sums.append(upto[bounds[1:]] - upto[bounds[:-1]])
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of sha256 of ``seed:doc_id``; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... over the highest scores among rows of ``least_words`` or more, ``percent`` of them; null elsewhere.

    Ties go to the smaller id, null last; rows that agree in all columns are
    combined before anything is ordered, so a group of copies costs one row until
    its ranks are dealt. Ranges of the order are numbered by themselves and start
    after the rows of the ranges before them.
    """
    columns = ["doc_id", "n_features", "weight", "score"]
    rows = cut(scored.groupBy(*columns).agg(F.count("*").alias("copies")), "scored")
    eligible = rows.where(F.col("n_features") >= least_words)
    most = (eligible.agg(F.sum("copies")).first()[0] or 0) * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    dealt = cut(eligible.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy("_range")
    starts = dealt.groupBy("_range").agg(F.sum("copies").alias("_n")).select("_range", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))  # a row a range
    upto = F.sum("copies").over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_upto", upto).join(F.broadcast(starts), "_range").select(*columns, "copies", (F.col("_start") + F.col("_upto") - F.col("copies")).alias("first"))
    every = placed.unionByName(rows.where(F.col("n_features") < least_words).withColumn("first", F.lit(None).cast("long")))
    # Copies are dealt by their number, a few thousand in a row, and made where they land.
    parts = every.withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    spread = parts.repartition("doc_id", "part")
    copy = F.explode(F.expr(f"sequence(part * {COPIES}, least(copies, (part + 1) * {COPIES}) - 1)"))
    made = spread.withColumn("copy", copy).withColumn("rank", F.col("first") + F.col("copy") + 1)
    return made.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, gain: Callable[..., np.ndarray] = gains) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``; rows with a rank are the draw.

    Texts are read twice, once to count all buckets and once to weigh; only counts
    of buckets and narrow rows move. Null and empty texts, and texts without a word,
    have no features, weight 0 and no rank; a null id draws its noise from the empty
    text and comes last among ties; rows that repeat an id and a text share a score
    and take ranks one after the other; very long texts and words are hashed whole;
    other columns of ``docs`` are not read. An empty table gives an empty result, an
    empty target or corpus counts zero everywhere.
    """
    weighed = with_weights(docs, gain(docs, target, text_col, target_text, buckets), id_col, text_col)
    return drawn(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), least_words, percent)


def op12_target_resampling(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, drawn towards the words of ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHIFT = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
OP12_SQL = f"""WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: {_SHIFT}, i)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY row, word), bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY word),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bytes AS (SELECT word, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT for i in range(0, len(h) // 2)] AS x FROM v),
crc AS (SELECT word, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM bytes CROSS JOIN tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT row, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY row),
sc AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features, weight) END AS r FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT {PERCENT} * count(*) // 100 FROM sc WHERE n_features >= {LEAST_WORDS}) THEN r END AS rank FROM r"""
