"""What the two vector operators share: rows that take part, numpy views of them, and blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches, written


def usable(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """place (a number for each row), id, vector (array<double>) and the columns to keep, stored; rows with a null id or vector, or a component that is null or not finite, are left out."""
    small_batches(rows.sparkSession)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    out = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), *keep)
    out = out.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    return written(out.withColumn("place", F.monotonically_increasing_id()))


def dimensions(rows: DataFrame) -> int:
    """The most components that a vector has; shorter vectors count as ending in zeros."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of vectors as rows of dims numbers."""
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def rows_of(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in vectors], pa.binary())


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of by: n, and every other column's values in one binary. The caller sees to it that groups are of bounded size."""
    rest = [c for c in rows.columns if c not in by]
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in rest)])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bytes_of = lambda c: b"".join(c.to_pylist()) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_numpy().tobytes()
        first = {c: group.column(c).slice(0, 1) for c in by}
        return pa.table([*(first[c] for c in by), pa.array([group.num_rows], pa.int64()), *(pa.array([bytes_of(group.column(c))], pa.binary()) for c in rest)], [*by, "n", *rest])

    return rows.groupBy(*by).applyInArrow(pack, schema)


def best(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Indices of each group's first k, the greater score first, then the smaller key."""
    order = np.lexsort((key, -score, group))
    return order[ranks(group[order]) < k]


def ranks(group: np.ndarray) -> np.ndarray:
    """Place of each element among those of its group, which stand together."""
    at = np.arange(len(group))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(group) else at
