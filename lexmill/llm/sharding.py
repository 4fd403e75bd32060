"""Two-pass external shuffle into shards.

Pass one scatters records by seeded hashes into buckets that fit in memory, as
many to each shard as its bytes ask for; pass two runs a Fisher-Yates shuffle over
each bucket and writes it as one file. The id alone decides the shard (highest random weight over the
shards), so one more shard only takes rows into itself. A bucket's slots start
where the bucket before it ends; both passes are functions of the records and
the seed, so a lost task repeats exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut, fresh_path

N_SHARDS = 24
SEED = 41
BUCKET_BYTES = 16 << 20
#: Parts of a shard that are counted first; counted again, finer, where buckets must be smaller.
FINE = 1 << 12
EMIT_ROWS = 2000
#: Bytes of the records of identical rows that are broadcast to where their copies are made.
HOT_BYTES = 16 << 20


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Shard of a key by highest random weight: of ``n`` and ``n + 1`` shards only the new one gains keys."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.lit(k).alias("k")) for k in range(n_shards)]))["k"]


def _shuffle(seed: int):
    """One bucket's records in Fisher-Yates order; what the records and the seed decide, arrival does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        bucket, at = table.column("bucket")[0].as_py(), table.column("at")[0].as_py()
        keys = table.select(["id", "tie", "whole"])
        table = table.take(pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("tie", "ascending"), ("whole", "ascending")]))
        n = table.num_rows
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
        order = list(range(n))
        for i in range(n - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            order[i], order[j] = order[j], order[i]
        order = np.array(order)
        for lo in range(0, n, EMIT_ROWS):
            part = table.select(["record", "shard", "bucket"]).take(pa.array(order[lo : lo + EMIT_ROWS]))
            slots = pa.array(np.arange(lo, lo + part.num_rows) + at, pa.int64())
            yield from part.append_column("slot", slots).combine_chunks().to_batches()

    return run


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash a column of this type: maps, and what holds them, have no order."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def external_shuffle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` in a uniformly shuffled order within hashed shards.

    Returns ``record`` (a struct of all columns of ``docs``, so names never
    clash), ``shard``, ``bucket`` and ``slot`` (gapless from 0 in each shard), one
    row per input row; every bucket is one partition in slot order. Buckets hold
    about ``bucket_bytes``, however much there is and however much of it one shard
    holds; one very long row makes its bucket larger.

    Null ids form one key, null texts are empty. Rows that repeat an id share its
    shard and are spread over its buckets by all their columns, maps included, and
    identical rows that would fill a bucket by their number; rows that differ in any
    column keep their places on every run. An empty table gives an empty result.
    """
    if docs.isEmpty():
        return docs.select(F.struct("*").alias("record"), F.lit(0).alias("shard"), F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("slot"))
    bounded_batches(docs.sparkSession)
    key = F.col(f"`{id_col}`").cast("long")
    named = {f.name: F.col(f"`{f.name}`") for f in docs.schema}
    texts = [F.octet_length(named[f.name]) for f in docs.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [named[f.name] for f in docs.schema if not _hashable(f.dataType)]
    # What Spark cannot hash is hashed as JSON.
    hashed = [named[f.name] for f in docs.schema if _hashable(f.dataType)] + ([F.to_json(F.struct(*nested))] if nested else [])
    size = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)).cast("long") for t in texts], F.lit(8 * len(named)).cast("long"))
    size = size + (F.octet_length(hashed[-1]) if nested else F.lit(0))
    marks = [F.xxhash64(F.lit(seed + 1), *hashed).alias("tie"), F.xxhash64(F.lit(seed + 2), *hashed).alias("whole"), shard_of(key, n_shards, seed).alias("shard")]
    rows = docs.select(F.struct(*named.values()).alias("record"), key.alias("id"), *marks, size.alias("bytes"))
    fine, counted = FINE, _counted(rows, FINE)
    held = {r["shard"]: r["bytes"] for r in counted.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    parts = [1 << max(0, -(-held.get(k, 0) // bucket_bytes) - 1).bit_length() for k in range(n_shards)]
    most = F.element_at(F.array(*[F.lit(4 * max(bucket_bytes, held.get(k, 0) * max(1, parts[k] // fine) // parts[k])) for k in range(n_shards)]), F.col("shard") + 1)
    if not (full := counted.where(F.col("bytes") > most)).isEmpty():
        rows, fine = _spread(rows, full, fine, bucket_bytes), 0
    if max(parts) > fine:
        fine = max(*parts, FINE)
        counted = _counted(rows, fine)
    of = lambda numbers: F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("shard") + 1)
    first = [sum(parts[:k]) for k in range(n_shards)]
    bucket = (of(first) + F.expr("fine div step")).cast("int")
    counted = counted.withColumn("step", of([fine // n for n in parts]))
    sums = counted.groupBy("shard", bucket.alias("bucket")).agg(F.sum("rows").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")
    starts = broadcast_if_small(cut(sums.select("bucket", before.alias("at")), "starts"))  # one row a bucket

    scattered = rows.withColumn("fine", F.pmod("tie", F.lit(fine)).cast("int")).withColumn("step", of([fine // n for n in parts])).withColumn("bucket", bucket).drop("fine", "step", "bytes")
    scattered = scattered.join(starts, "bucket").repartitionById(sum(parts), F.col("bucket"))
    schema = T.StructType([scattered.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.LongType())])
    return scattered.mapInArrow(_shuffle(seed), schema)


def _counted(rows: DataFrame, fine: int) -> DataFrame:
    """Rows and bytes of each of the ``fine`` parts of every shard."""
    by = F.pmod("tie", F.lit(fine)).cast("int")
    return cut(rows.groupBy("shard", by.alias("fine")).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")), "counts")


def _spread(rows: DataFrame, full: DataFrame, fine: int, bucket_bytes: int) -> DataFrame:
    """``rows`` with the copies of identical rows that would fill a bucket of their own dealt over all buckets of their shard.

    Such rows are counted, taken out, and made again from their numbers, each with a
    hash of its number in place of the common one; a full bucket without them stays.
    """
    mine = rows.withColumn("fine", F.pmod("tie", F.lit(fine)).cast("int")).join(broadcast_if_small(full.select("shard", "fine")), ["shard", "fine"], "left_semi")
    groups = mine.groupBy("tie", "whole").agg(F.count("*").alias("copies"), F.first("record").alias("record"), F.first("id").alias("id"), F.first("shard").alias("shard"), F.first("bytes").alias("bytes"))
    hot = groups.where((F.col("copies") > 1) & (F.col("copies") * F.col("bytes") > bucket_bytes))
    hot = cut(hot.withColumn("upto", F.sum("copies").over(Window.partitionBy(F.lit(1)).orderBy("tie", "whole"))), "hot")  # fewer rows than there are buckets
    n = hot.agg(F.max("upto")).first()[0]
    if n is None:
        return rows
    cool = rows.join(broadcast_if_small(hot.select("tie", "whole")), ["tie", "whole"], "left_anti")
    starts = hot.select("tie", "whole", (F.col("upto") - F.col("copies")).alias("first"), "upto")
    # Numbers meet their group by the part of the numbers that holds its range.
    step = 1 << 16
    spans = starts.withColumn("span", F.explode(F.expr(f"sequence(first div {step}, (upto - 1) div {step})")))
    numbers = rows.sparkSession.range(n).withColumn("span", F.expr(f"id div {step}")).withColumnRenamed("id", "number")
    copies = numbers.join(spans, "span").where("number >= first and number < upto").select("tie", "whole", "number", "first")
    records = hot.drop("upto", "copies")
    made = copies.join(F.broadcast(records) if (hot.agg(F.sum("bytes")).first()[0] or 0) <= HOT_BYTES else records, ["tie", "whole"])
    again = made.select("record", "id", F.xxhash64("tie", F.col("number") - F.col("first")).alias("tie"), "whole", "shard", "bytes")
    return cool.select(again.columns).unionByName(again)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write every bucket as one Parquet file below its shard's folder, rows in slot order.

    A row is ``record`` (all columns of the documents, whatever their names) and
    ``slot``; null ids and texts, repeated rows and an empty table are written as they are.
    """
    shuffled.select("record", "shard", "slot").write.partitionBy("shard").parquet(path)


def op4_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """``documents`` scattered, shuffled and written to the shared folder; the rows are those of the shards read back."""
    path = fresh_path(spark, "shards")
    write_shards(external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    written = spark.read.parquet(path)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    grown = shard_of(F.col("record.doc_id").cast("long"), N_SHARDS + 1)
    return written.select(
        "record.doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        grown.alias("grown_shard"),
    )
