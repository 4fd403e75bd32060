"""The working folder that driver and executors share.

Lineage is cut by writing a Parquet table there and reading it again: the
files outlive any executor, so a lost one costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_READ_SETTING = "spark.sql.parquet.columnarReaderBatchSize"
READ_ROWS = 256
_OWN: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder where it is unset and driver and executors are one process."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lexmill-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = _OWN[0]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets, so concurrent queries never collide."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` below the shared folder, in files of ``rows_a_file`` rows at most if given, and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no result reads any more; others are left alone."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            there = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _bytes(setting: str) -> int:
    """A setting of bytes, with or without a unit: ``64m``, ``1 GB``, ``4096``."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", str(setting), re.I)
    if found is None:
        raise ValueError(f"no number of bytes: {setting}")
    return int(found[1]) << (10 * (" kmgtp".index(found[2].lower()) if found[2] else 0))


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Read whole texts ``READ_ROWS`` at a time and exchange ``BATCH_BYTES`` of them with Python, in this session.

    The usual limits are 4096 rows and 64 MB a task. The reader's vectors of that
    many texts are arrays of tens of megabytes, and the executor's Arrow buffers
    and its Python workers hold a batch several times over. Smaller settings are
    left alone.
    """
    if _bytes(spark.conf.get(_BATCH_SETTING, "67108864")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    if int(spark.conf.get(_READ_SETTING, "4096")) > READ_ROWS:
        spark.conf.set(_READ_SETTING, str(READ_ROWS))
    return spark
