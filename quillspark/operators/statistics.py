"""Statistics that are kept as states and merged: days into months, and any grouping into coarser ones, without the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many values a quantile sketch keeps a level: a rank is off by under 1.4 % (at 99 % confidence), whatever the number of rows.
QUANTILE_K = 200
#: log2 of the buckets of a distinct sketch: a relative standard error of 1.6 %.
DISTINCT_BITS = 12
STATE = ["rows", "n", "total", "least", "greatest", "quantile_state", "distinct_state"]


def states(records: DataFrame, by: list[str], value: str, distinct: str) -> DataFrame:
    """A state of value and of the different values of distinct for each group: by, and the columns STATE.

    rows counts all records, n those with a value. total is exact for whole numbers and decimals (a decimal of 38 digits; one that needs more is an error); of doubles it depends on the order of rows. NaN is a value like
    others for n, total and greatest, as in Spark; the quantile sketch leaves it out. A group without values has nulls for total, least and greatest, and empty sketches. Groups are combined before the shuffle, and a sketch is of
    bounded size, so a hot group costs each task one row.
    """
    kind = records.schema[value].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    v = F.col(value)
    total = F.sum(v.cast("decimal(38,0)") if whole else v)
    as_double = v.cast("double")
    return records.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count(v).alias("n"),
        total.alias("total"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
        F.kll_sketch_agg_double(F.when(~F.isnan(as_double), as_double), QUANTILE_K).alias("quantile_state"),
        F.hll_sketch_agg(F.col(distinct), DISTINCT_BITS).alias("distinct_state"),
    )


def merged(kept: DataFrame, by: list[str], sets: str = "") -> DataFrame:
    """States of groups of states. sets: "" for by alone, "rollup" or "cube" for all their grouping sets, told apart by ``level`` (as grouping_id: a bit a column, set where it is summed over)."""
    grouped = {"": kept.groupBy, "rollup": kept.rollup, "cube": kept.cube}[sets](*by)
    level = [F.grouping_id(*by).alias("level")] if sets else []
    return grouped.agg(
        *level,
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double("quantile_state", QUANTILE_K).alias("quantile_state"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
    )


def quantile(q: float) -> Column:
    """The estimated q-quantile (0 to 1) of a state's values; null without any."""
    return F.when(F.kll_sketch_get_n_double("quantile_state") > 0, F.kll_sketch_get_quantile_double("quantile_state", F.lit(float(q))))


def measures(kept: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """What states say: their groups, rows, n, total, least, greatest, mean, distinct (estimated), and a column for each of the named quantiles (estimated)."""
    groups = [c for c in kept.columns if c not in STATE]
    mean = F.col("total").cast("double") / F.col("n")
    return kept.select(
        *groups, "rows", "n", "total", "least", "greatest", F.when(F.col("n") > 0, mean).alias("mean"), F.hll_sketch_estimate("distinct_state").alias("distinct"), *(quantile(q).alias(c) for c, q in quantiles.items())
    )


def store_days(records: DataFrame, path: str, day: str, by: list[str], value: str, distinct: str) -> None:
    """Write the states of the days that records holds under path, a folder a day. Only those days are replaced, so records must hold all of a day, and a run that failed is run again. A null day has a folder of its own."""
    daily = states(records, [day, *by], value, distinct).repartition(day)
    daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
