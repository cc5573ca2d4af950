"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered
from quillspark.session import cut, shared_dir, with_package

__all__ = ["cut", "forget", "least_partitions", "let", "positioned", "read", "running", "same", "shared_dir", "small_batches", "texts", "written"]


STEPS = 128  # values of a running sum that are handled together
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so Python workers get no more than BATCH_ROWS of them, or some BATCH_BYTES, at once, unless the session says otherwise. Workers of this machine find this package."""
    with_package(spark)
    for name, default, ours in (("Records", "10000", BATCH_ROWS), ("Bytes", "67108864b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(ours))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text, null as empty; other columns can't clash after this."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def written(df: DataFrame) -> DataFrame:
    """As cut(), as a compressed table for results of the corpus' size."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(table: DataFrame) -> None:
    """Remove what written() wrote, once nothing will read it again."""
    for file in table.inputFiles()[:1]:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def least_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], first: int) -> Column:
    """For each of values (array<bigint>) what step makes of first and all values before it. An array grows by copying, so this goes piece by piece."""

    def grown(piece: Column, start: Column) -> Column:
        acc = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(piece, acc, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def pieced(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.size(v), F.lit(STEPS)), lambda k: F.slice(v, k, STEPS))).otherwise(F.array().cast("array<array<bigint>>"))

    start = F.lit(first).cast("bigint")
    ends = lambda pieces: F.transform(pieces, lambda piece: F.aggregate(piece, start, step))
    return let(values, lambda v: let(pieced(v), lambda pieces: F.flatten(F.zip_with(pieces, grown(ends(pieces), start), grown))))


def positioned(df: DataFrame, by: list[str], name: str, part: str | None = None, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """df with each row's place (from 0) in the order of the columns by, and the number of its sorted partition if a name for it is given."""
    return numbered(df, [F.col(c) for c in by], name, 0, part, keep)
