"""Events as they arrive: late ones set aside as rows, repeated ones dropped, closed windows counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.tables import read

FRESH, LATE, MARKS = "fresh", "late", "_marks"


def sift(spark: SparkSession, events: DataFrame, at: str, delay: str, root: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows below root: to ``late`` those without a time, or with one before the latest that earlier batches brought less the delay, to ``fresh`` all others. Takes what is there and stops.

    Each batch writes folders of its own, and notes the latest time so far before it ends. A batch that is tried again reads the notes of the batches before it only and writes
    its folders anew, so it splits its rows as the first time.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        marks = read(spark, root, MARKS, "latest timestamp, batch long").where(F.col("batch") < batch_id)
        before = marks.agg(F.max("latest").alias("latest"))  # one row
        limit = F.col("latest") - F.expr(f"interval {delay}")
        batch = batch.persist()
        told = batch.join(F.broadcast(before))
        late = F.col(at).isNull() | F.coalesce(F.col(at) < limit, F.lit(False))
        for name, rows in ((LATE, told.where(late)), (FRESH, told.where(~late))):
            rows.drop("latest").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        latest = batch.agg(F.max(F.col(at).cast("timestamp")).alias("latest"))
        latest.join(F.broadcast(before.withColumnRenamed("latest", "old"))).select(F.greatest("latest", "old").alias("latest")).write.mode("overwrite").parquet(f"{root}/{MARKS}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_closed(spark: SparkSession, schema: T.StructType, key: str, at: str, kind: str, size: str, delay: str, root: str, checkpoint: str) -> StreamingQuery:
    """Append start, kind, n to ``closed`` below root for each window of the fresh rows that no more rows can join: those that end by the latest time less the delay. Takes what is there and stops.

    Spark's state holds the keys seen within the delay, which drops rows that arrive twice within it, and the counts of open windows, by window and kind;
    both go when the watermark passes them. Counts are combined before the shuffle. As sift() lets nothing pass that is later than the delay, the watermark drops no row of its own.
    """
    fresh = spark.readStream.schema(schema).parquet(f"{root}/{FRESH}")
    once = fresh.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    counts = once.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"))
    rows = counts.select(F.col("w.start").alias("start"), kind, "n")
    return rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/closed").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed(spark: SparkSession, root: str, kind: T.StructField) -> DataFrame:
    """start, kind, n of the windows that are closed."""
    schema = T.StructType([T.StructField("start", T.TimestampType()), kind, T.StructField("n", T.LongType())])
    return read(spark, root, "closed", schema)


def late(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows that came too late."""
    return read(spark, root, LATE, schema)


def followed(spark: SparkSession, events: DataFrame, schema: T.StructType, key: str, at: str, kind: str, size: str, delay: str, root: str) -> DataFrame:
    """start, kind, n of all windows that are closed once the stream's rows so far are taken; call it again for those that came since."""
    sift(spark, events, at, delay, root, f"{root}/_sifted").awaitTermination()
    count_closed(spark, schema, key, at, kind, size, delay, root, f"{root}/_counted").awaitTermination()
    return closed(spark, root, schema[kind])
