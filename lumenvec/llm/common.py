"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..shared import dropped, folder, in_order, shared_dir, written  # noqa: F401

#: White space between words, as the contracts have it: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in either case of letters."""
    seen, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return out


def stable(rows: DataFrame) -> DataFrame:
    """rows, such that they keep their places when they are read again: what a shuffle deals out is written first, tables are taken as they are."""
    return written(rows, "rows") if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows


_TYPES = {"bigint": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string()), "binary": (T.BinaryType(), pa.binary())}


def spark_struct(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(k, _TYPES[v][0]) for k, v in fields.items()])


def arrow_struct(fields: dict[str, str]) -> pa.StructType:
    return pa.struct([(k, _TYPES[v][1]) for k, v in fields.items()])


def arrow_rows(fields: dict[str, str], rows: list[tuple]) -> pa.StructArray:
    """A struct array from one tuple a row."""
    kind = arrow_struct(fields)
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
