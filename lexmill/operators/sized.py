"""Broadcasts behind a check of size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a narrow table (ids, hashes, a few numbers) is broadcast: some 30 MB.
BROADCAST_ROWS = 300_000
#: Bytes up to which a table of texts or arrays is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(table: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int | None = None) -> DataFrame:
    """``table`` marked for broadcast if it holds ``most_rows`` rows at most, and ``most_bytes`` if they are given, else as it is, for a shuffle join.

    Tables of numbers and hashes need no ``most_bytes``; texts and arrays do.
    """
    some = table.limit(most_rows + 1)
    if most_bytes is None:
        return F.broadcast(table) if some.count() <= most_rows else table
    rows, held = some.agg(F.count("*"), F.sum(row_bytes(table))).first()
    return F.broadcast(table) if rows <= most_rows and (held or 0) <= most_bytes else table


def row_bytes(table: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a column, and what strings, arrays and nested values hold."""

    def of(field: T.StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return F.size(c) * 8
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(c)))
        return F.lit(0)

    return reduce(lambda a, b: a + b, [F.coalesce(of(f).cast("long"), F.lit(0)) for f in table.schema], F.lit(8 * len(table.columns)).cast("long"))
