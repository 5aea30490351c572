"""Sums of vectors by group: each task adds its rows up in numpy, and only a row for each group and dimension leaves it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that a task holds at once; beyond, what it has so far goes out and is added up later.
HELD = 4_000_000


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers, 0 where a vector has none, and 1 where it has one."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()
    there = ~np.asarray(flat.is_null()) if flat.null_count else np.ones(len(flat), bool)
    values = np.where(there, np.asarray(flat.fill_null(0), float), 0.0)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim), there.reshape(len(sizes), dim).astype(float)
    m, n = np.zeros((len(sizes), dim)), np.zeros((len(sizes), dim))
    row, col = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    m[row, col], n[row, col] = values, there
    return m, n


def _padded(a: np.ndarray, dim: int) -> np.ndarray:
    return a if a.shape[-1] == dim else np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, dim - a.shape[-1])])


def _adder():
    """What a task does with batches of values and vectors: it holds HELD numbers and those of one batch, in however many batches the values are new."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for name, (s, n) in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), kept[0]), pa.array(at, pa.int32()), pa.array(s[at]), pa.array(n[at].astype(np.int64))], names=["value", "d", "s", "n"])

    kept: list[pa.DataType] = []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        numbers = 0
        for b in batches:
            if not b.num_rows:
                continue
            kept[:] = [b.schema.field(0).type]
            m, n = _matrix(b.column(1))
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            at = np.asarray(coded.indices)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums, counts, names = np.add.reduceat(m[order], cut), np.add.reduceat(n[order], cut), coded.dictionary.to_pylist()
            for k, s, c in zip(at[order][cut].tolist(), sums, counts, strict=True):
                old = held.get(names[k])
                if old is None:
                    held[names[k]] = s.copy(), c.copy()  # a view would keep the sums of its whole batch
                    numbers += 2 * len(s)
                else:
                    dim = max(len(s), len(old[0]))
                    held[names[k]] = _padded(old[0], dim) + _padded(s, dim), _padded(old[1], dim) + _padded(c, dim)
            if numbers > HELD:
                yield from rows(held)
                held, numbers = {}, 0
        yield from rows(held)

    return task


def group_sums(records: DataFrame, vector: str, value: Column | None = None) -> DataFrame:
    """value, d, s, n: sums and counts of the vectors' numbers by value (null without one) and dimension. Rows without a vector are left out."""
    own = records.where(F.col(vector).isNotNull()).select((F.lit(None).cast("int") if value is None else value).alias("value"), F.col(vector).alias("v"))
    kind = own.schema["value"].dataType
    schema = T.StructType([T.StructField("value", kind), T.StructField("d", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    return own.mapInArrow(_adder(), schema).groupBy("value", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


MOMENTS = "d int, n long, mx double, mv double, xx double, vv double, xv double"


def moments(records: DataFrame, vector: str, x: Column) -> DataFrame:
    """d, n, means (mx, mv) and centred sums of products (xx, vv, xv) of x and each dimension, for the rows that have both. A row for each task and dimension: merged_moments() adds them up, those of other batches too."""
    own = records.select(x.cast("double").alias("x"), F.col(vector).alias("v")).where("x is not null and v is not null")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = None
        for b in batches:
            if not b.num_rows:
                continue
            m, there = _matrix(b.column(1))
            x = np.asarray(b.column(0))[:, None]
            n = there.sum(0)
            safe = np.maximum(n, 1)
            mx, mv = (x * there).sum(0) / safe, m.sum(0) / safe
            dx, dv = (x - mx) * there, (m - mv) * there
            new = np.stack([n, mx, mv, (dx * dx).sum(0), (dv * dv).sum(0), (dx * dv).sum(0)])
            if all_ is None:
                all_ = new
                continue
            dim = max(all_.shape[1], new.shape[1])
            (n0, x0, v0, *s0), (n1, x1, v1, *s1) = _padded(all_, dim), _padded(new, dim)
            n = np.maximum(n0 + n1, 1)
            ex, ev, both = x1 - x0, v1 - v0, n0 * n1 / n
            all_ = np.stack([n0 + n1, x0 + ex * n1 / n, v0 + ev * n1 / n, *(p + q + c * both for p, q, c in zip(s0, s1, (ex * ex, ev * ev, ex * ev), strict=True))])
        if all_ is not None:
            at = np.flatnonzero(all_[0])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(all_[0][at].astype(np.int64)), *(pa.array(c[at]) for c in all_[1:])], names=["d", "n", "mx", "mv", "xx", "vv", "xv"])

    return own.mapInArrow(task, MOMENTS)


def merged_moments(*parts: DataFrame) -> DataFrame:
    """Moments of several tasks or batches as one row a dimension."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.sum("n")
    means = out.groupBy("d").agg(n.alias("_n"), (F.sum(F.col("n") * F.col("mx")) / n).alias("_x"), (F.sum(F.col("n") * F.col("mv")) / n).alias("_v"))
    dx, dv = F.col("mx") - F.col("_x"), F.col("mv") - F.col("_v")
    add = lambda c, p: F.sum(F.col(c) + F.col("n") * p).alias(c)
    found = out.join(means, "d").groupBy("d").agg(F.first("_n").alias("n"), F.first("_x").alias("mx"), F.first("_v").alias("mv"), add("xx", dx * dx), add("vv", dv * dv), add("xv", dx * dv))
    return found
