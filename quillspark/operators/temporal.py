"""Joins over time: what was in force at a moment, and which periods a moment lies in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import cut, with_package

FINE = 0  # an interval is cut into pieces of half to all of its length


def in_force(left: DataFrame, right: DataFrame, on: str, at: str, since: str, by: str, take: list[str]) -> DataFrame:
    """left with the columns to take of the row of right with the same ``on`` that was the last one at the time ``at``: the greatest ``since`` up to and including it, the greater ``by`` among equals; nulls where there is none.

    Both sides are sorted once by key and time over range partitions. Every partition carries its last row forward and says what its last key ended with; those words, a row a
    partition, are handed on over the borders by broadcast. So a key with any share of the rows is spread over tasks, and nothing is gathered by key.

    Rows of left with a null key or time keep nulls; such rows of right are left out; repeated rows are kept.
    """
    with_package(left.sparkSession)
    kind = left.schema[at].dataType
    r_type, l_type = T.StructType([right.schema[c] for c in take]), left.schema
    null = lambda t: F.lit(None).cast(t)
    given = left.select(F.col(on).alias("k"), F.col(at).alias("t"), F.lit(1).alias("side"), null(right.schema[by].dataType).alias("tie"), F.struct(*left.columns).alias("l"), null(r_type).alias("r"))
    known = right.where(F.col(on).isNotNull() & F.col(since).isNotNull())
    known = known.select(F.col(on).cast(left.schema[on].dataType).alias("k"), F.col(since).cast(kind).alias("t"), F.lit(0).alias("side"), F.col(by).alias("tie"), null(l_type).alias("l"), F.struct(*take).alias("r"))
    schema = T.StructType([T.StructField("k", left.schema[on].dataType), T.StructField("l", l_type), T.StructField("r", r_type), T.StructField("side", T.IntegerType()), T.StructField("has", T.BooleanType()), T.StructField("part", T.IntegerType())])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of left: has tells whether r is known, null that an earlier partition may know it. At the end a row of side 2: what the last key ended with."""
        part, opening, last, held, like = TaskContext.get().partitionId(), True, None, None, None

        def out(k: pa.Array, left_rows: pa.Array, r: pa.Array, side: int, has: pa.Array) -> pa.RecordBatch:
            n = len(k)
            return pa.RecordBatch.from_arrays([k, left_rows, r, pa.array([side] * n, pa.int32()), has, pa.array([part] * n, pa.int32())], ["k", "l", "r", "side", "has", "part"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, r, at, like = batch.column("k"), batch.column("r"), np.arange(n), batch
            left_side = batch.column("side").to_numpy() == 1
            new = np.zeros(n, bool)
            nulls = np.asarray(k.is_null())
            new[1:] = (nulls[1:] != nulls[:-1]) | np.asarray(pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, n - 1)), False))
            new[0] = last is not None and last[0].as_py() != k[0].as_py()
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the key of the batch before
            source = np.maximum.accumulate(np.where(left_side, -1, at))
            source = np.where((source >= 0) & (source >= start), source, np.where((start < 0) & (held is not None), n, -1))
            values = pa.concat_arrays([r, held if held is not None else pa.nulls(1, r.type)])
            taken = values.take(pa.array(source, mask=source < 0))
            unknown = (source < 0) & (start < 0) & opening
            has = pa.array(source >= 0, mask=unknown)
            mask = pa.array(left_side)
            yield out(k.filter(mask), batch.column("l").filter(mask), taken.filter(mask), 1, has.filter(mask))
            opening = opening and not new.any()
            last, held = k.slice(n - 1), taken.slice(n - 1) if source[-1] >= 0 else None
        if last is not None:
            yield out(last, pa.nulls(1, like.column("l").type), held if held is not None else pa.nulls(1, like.column("r").type), 2, pa.array([held is not None]))

    order, n = ["k", "t", "side", "tie"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = given.unionByName(known).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = cut(both.mapInArrow(filled, schema))
    ended = F.last(F.when(F.col("has"), F.struct("r")), True).over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    words = rows.where("side = 2 and k is not null").select("k", F.lead("part").over(Window.orderBy("part")).alias("part"), ended.alias("told"))  # a row a partition
    out = rows.where("side = 1").join(F.broadcast(words), ["k", "part"], "left")
    return out.select("l.*", *(F.when(F.col("has").isNull(), F.col(f"told.r.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in take))


def within(points: DataFrame, at: str, periods: DataFrame, low: str, high: str, on: list[str]) -> DataFrame:
    """Each pair of a point and a period [low, high) that it lies in, of equal columns ``on``: all columns of both. Times are whole numbers.

    A period is cut into aligned pieces of the power of two that is half to all of its length, three at most, as every piece is a row to shuffle, and a point is looked up once for each
    piece length that occurs: an equi-join and a last test. Long periods have lengths of their own, so they don't multiply short ones.

    Null times or keys and empty periods match nothing; repeated rows match each.
    """
    length = F.col(high) - F.col(low)
    level = F.greatest(F.floor(F.log2(length.cast("double"))).cast("int") - FINE, F.lit(0))
    shifted = lambda c, by: F.expr(f"shiftright({c}, {by})")
    cuts = periods.where(F.col(high) > F.col(low)).withColumn("_level", level)
    cuts = cuts.withColumn("_piece", F.explode(F.sequence(shifted(f"`{low}`", "_level"), shifted(f"`{high}` - 1", "_level"))))
    levels = sorted(r[0] for r in cuts.select("_level").distinct().collect())  # 63 at most
    if not levels:
        levels = [0]
    looked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    looked = looked.withColumn("_piece", shifted(f"`{at}`", "_level"))
    return looked.join(cuts, [*on, "_level", "_piece"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_piece")
