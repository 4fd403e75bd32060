"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.text import strip

MESSAGES = "id string, text string, label string"
SPLIT = "id string, split string"
FOLDS = "id string, fold int"
LANG_META = "id string, lang string, lang_conf double"
PAIRS = "char_sim double, emb_sim double, id_i string, label_i string, lang_i string, text_i string, id_j string, label_j string, lang_j string, text_j string, cross_lingual boolean, same_label boolean"
FEATURES = "id string, label string, lang string, logits array<float>, cls array<float>, mean array<float>"
PREDICTIONS = "id string, label string, fold int, lang string, pred string"
OUTLIERS = "text string, topic string, lang string"
TRANSLATIONS = "src_id string, lang string, text string, split string"
ANSWERS = "model string, mode string, shots int, id string, pred string, in_tokens bigint, out_tokens bigint, latency_s double"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a table, dealt over all cores if its scan has fewer partitions than there are cores.

    For expressions that cost far more than a shuffle of a small table; a large
    table has partitions enough and is not shuffled.
    """
    rows, cores = load(spark, sf_dir, name).select(*columns), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages, their text as a stripped string."""
    return read_csv(spark, path, MESSAGES).withColumn("text", strip(F.col("text").cast("string")))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def read_optional(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A CSV table; if there is none, an empty one of the schema, or an error if ``required``."""
    if exists(spark, path):
        return read_csv(spark, path, schema)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def read_json_documents(spark: SparkSession, path: str, schema: str | StructType, name_glob: str = "*.json", without: tuple[str, ...] = ()) -> DataFrame:
    """One row per JSON file, with ``stem``; names that contain one of ``without`` are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name_glob).json(path)
    rows = rows.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.where(~F.col("stem").rlike("|".join(re.escape(w) for w in without))) if without else rows


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which must tell rows apart."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A log of answers, the last of each key: a later file wins over an earlier, a later line within one."""
    rows = spark.read.schema(ANSWERS).json(path).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return latest(rows, ["model", "mode", "shots", "id"], ["_at", "_file", "_line"]).drop("_at", "_file", "_line")


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_parts(rows: DataFrame, path: str, key: str) -> None:
    """Write rows below a folder for each ``key``. Parts that are written again are replaced, others stay: a job that is run again adds nothing twice."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def missing_parts(rows: DataFrame, path: str, key: str) -> DataFrame:
    """The rows of keys that :func:`write_parts` has not written yet."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    done = spark.read.schema(rows.schema).parquet(path).select(key).distinct()
    return rows.join(done, key, "left_anti")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, binary: tuple[str, ...] = (".png", ".pdf", ".npz")) -> DataFrame:
    """``path`` and ``text`` of all files below a folder but the binary ones; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.where(~F.lower("path").rlike("(" + "|".join(re.escape(s) for s in binary) + ")$"))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A pipe table of a report; of one with more than ``most`` rows the first of them, and a line that says so."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    found = rows.limit(most + 1).collect()
    lines = [head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in found[:most])]
    return "\n".join([*lines, f"\nOnly the first {most} rows are shown."] if len(found) > most else lines)
