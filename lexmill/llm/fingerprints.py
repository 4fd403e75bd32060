"""Document fingerprints by quartile bucket digests.

A text's byte triplets (three shapes within a window of four bytes, the text
padded at both ends) are hashed into ``BUCKETS`` counters. The digest holds the
length on a log scale, the ratios of the quartiles and, for every bucket, the
quarter its count falls in. The difference of two digests sums the quarter steps
and the header's steps; it is bounded by ``FAR``, where likeness reaches 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import bounded_batches

BUCKETS = 256
#: What two unrelated digests differ by: a quarter step of 0 to 3 costs 0, 1, 2 or 6.
STEP_COST = (0, 1, 2, 6)
FAR = 1.625 * BUCKETS
LENGTH_COST = 6
MOST_LENGTH_STEPS = 12
_PIECE = 1 << 18
#: Bytes of text in a range of ids, and the most ranges; larger ranges are sorted on disk and read as a stream.
RANGE_BYTES, MOST_RANGES = 16 << 20, 4096

_draw = np.random.default_rng(77)
_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_TABLES = _draw.permuted(np.tile(np.arange(256, dtype=np.uint8), (len(_SHAPES) * 3, 1)), axis=1).reshape(len(_SHAPES), 3, 256)
_COST = np.array(STEP_COST, dtype=np.int64)
_EDGE = b"\x00\x00\x00"


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if not data:
        return counts
    padded = np.frombuffer(_EDGE + data + _EDGE, dtype=np.uint8)
    for at in range(0, len(padded) - 3, _PIECE):
        b = padded[at : at + _PIECE + 3]
        m = len(b) - 3
        for shape, tables in zip(_SHAPES, _TABLES, strict=True):
            h = tables[0][b[shape[0] : shape[0] + m]]
            h ^= tables[1][b[shape[1] : shape[1] + m]]
            h ^= tables[2][b[shape[2] : shape[2] + m]]
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def fingerprint(text: str | bytes) -> str:
    """Digest of a text as hex: length step, quartile ratios, two bits a bucket. Empty: all zeros."""
    data = text.encode() if isinstance(text, str) else text
    counts = _counts(data)
    low, mid, high = np.partition(counts, (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4))[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).astype(np.uint8)
    length = min(255, round(math.log(len(data)) / math.log(1.1)) + 1) if data else 0
    ratios = (int(16 * low // (high + 1)) << 4 | int(16 * mid // (high + 1))) if data else 0
    body = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return bytes([length, ratios]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> float:
    """Difference of two digests, 0 to ``FAR``."""
    x, y = np.frombuffer(bytes.fromhex(a), dtype=np.uint8), np.frombuffer(bytes.fromhex(b), dtype=np.uint8)
    p, q = x[2:], y[2:]
    total = sum(int(_COST[np.abs((p >> s & 3).astype(np.int8) - (q >> s & 3).astype(np.int8))].sum()) for s in (0, 2, 4, 6))
    total += LENGTH_COST * min(MOST_LENGTH_STEPS, abs(int(x[0]) - int(y[0])))
    total += abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    return float(min(total, FAR))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those as different as unrelated ones."""
    return 1.0 - difference(a, b) / FAR


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``fingerprint`` of whole texts, however long: one row per input row, equal texts alike.

    Null texts are empty, an empty table gives an empty result, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])], names=["doc_id", "n_chars", "fingerprint"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids, descending, then the row that follows the range."""
    names = [c.split()[0] for c in _PAIR.split(", ")]
    rows: list[tuple] = []
    first = held = None
    closed = False

    def compare(own: tuple, after: tuple) -> tuple:
        doc_id, text, mark = own
        third = len(text) // 3
        edited = (text[: len(text) - third] + after[1][:third]).encode()
        edited_mark = fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after[2])

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for doc_id, text, follows in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if closed:
                continue  # repeats of the row that follows
            text = text or ""
            now = (doc_id, text, fingerprint(text))
            if held is not None:
                rows.append(compare(held, now))
            first, held, closed = first or now, now, bool(follows)
            if len(rows) >= 500:
                yield flush()
                rows = []
    if held is not None and not closed:
        rows.append(compare(held, first))  # no id at all: one range holds every row
    if rows:
        yield flush()


def _array(heads: list[tuple]) -> Column:
    """Places as one constant, written as SQL: a call for each of thousands of numbers would take seconds."""
    one = lambda x: f"named_struct('n', {str(x[0]).lower()}, 'i', bigint('{x[1]}'), 'h', bigint('{x[2]}'))"
    return F.expr(f"array({', '.join(map(one, heads))})")


def _range_of(heads: list[tuple], place: Column) -> Column:
    """Number of the last of the sorted ``heads`` at or before a row's place: first among some of them, then among those that follow."""
    step = max(1, math.isqrt(len(heads)))
    upto = lambda some: F.size(F.filter(some, lambda head: head <= place))
    first = (upto(_array(heads[::step])) - 1) * step
    return (first + upto(F.slice(_array(heads), first + 1, F.lit(step))) - 1).cast("int")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text ends with the start of the next document, by descending id
    (after the last: the first). Rows of one id follow each other by the hash of their
    text, then by text, however many there are; rows without id come last; null texts
    are empty; a single row is its own next. One row per input row; other columns are
    ignored; an empty table stays empty; texts are taken whole.

    Ranges of ids are cut by quantiles. An id, or none, that fills several is cut by
    hashes of its texts. The least row of every range is found beforehand: it is
    sent to the range before it as well, and texts move once. The order is a matter of
    the rows alone, the ranges are not. Rows that agree in id and text stand in one
    range.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shares = F.expr(f"array({', '.join(f'{i / MOST_RANGES!r}D' for i in range(1, MOST_RANGES))})") if MOST_RANGES > 1 else F.array().cast("array<double>")
    cuts, top, total, count, unnamed = rows.agg(
        F.percentile_approx("doc_id", shares, 4 * MOST_RANGES), F.max("doc_id"), F.sum(F.octet_length("text")), F.count("*"), F.count_if(F.col("doc_id").isNull())
    ).first()
    if not count:
        return docs.sparkSession.createDataFrame([], _PAIR)
    n = min(MOST_RANGES, max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES)))
    cuts = [cuts[i * MOST_RANGES // n - 1] for i in range(1, n)] if cuts else []
    pieces = {i: k for i, k in Counter([*cuts, *([top] if top is not None else [])]).items()}
    pieces |= {None: max(1, round(n * unnamed / count))} if unnamed else {}
    # A place in the order: rows without id last, larger ids first, then the hash of the text.
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("i"), F.xxhash64("text").alias("h"))
    heads = sorted((i is None, 0 if i is None else ~i, -(1 << 63) + (j << 64) // k) for i, k in pieces.items() for j in range(k))
    placed = rows.withColumn("place", place)
    least = {r["k"]: tuple(r["p"]) for r in placed.groupBy(_range_of(heads, F.col("place")).alias("k")).agg(F.min("place").alias("p")).collect()}  # a row a range
    filled = sorted(least)
    heads = [least[k] for k in filled]
    last = len(heads) - 1
    placed = placed.withColumn("own", _range_of(heads, F.col("place")))
    leads = F.col("place") == F.element_at(_array(heads), F.col("own") + 1)
    before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1).cast("int")
    mine, also = F.struct(F.col("own").alias("range"), F.lit(False).alias("follows")), F.struct(before.alias("range"), F.lit(True).alias("follows"))
    sent = placed.withColumn("to", F.explode(F.when(leads, F.array(mine, also)).otherwise(F.array(mine))))
    dealt = sent.select("doc_id", "text", "place", F.col("to.follows").alias("follows"), F.col("to.range").alias("range")).repartitionById(last + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("follows", "place", "text").select("doc_id", "text", "follows")
    return ordered.mapInArrow(_against_next, _PAIR)


def op10_quartile_digest(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, each text against its edited self and the next one; texts move once."""
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
