"""Units that are given in terms of one another: exact factors along chains of them, and what contradicts itself."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import cut, with_package

ONE = "1/1"


@F.pandas_udf(T.StringType())
def _times(a: pd.Series, b: pd.Series) -> pd.Series:
    """The exact product of fractions "numerator/denominator"; null where either is."""
    return pd.Series([None if x is None or y is None else "{0.numerator}/{0.denominator}".format(Fraction(x) * Fraction(y)) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.StringType())
def _rounded(a: pd.Series) -> pd.Series:
    """A fraction with 18 digits behind its point, half away from zero."""

    def text(x: str) -> str:
        f = Fraction(x)
        n = (abs(f.numerator) * 2 * 10**18 + f.denominator) // (2 * f.denominator)
        return f"{'-' if f < 0 else ''}{n // 10**18}.{n % 10**18:018}"

    return pd.Series([None if x is None else text(x) for x in a], dtype=object)


def conversions(links: DataFrame) -> DataFrame:
    """unit, base, num, den, contradicted: one unit is num/den (decimal(38,0), in lowest terms) of its base, the least unit that links tie it to.

    links: unit, other, num, den (whole numbers): one unit is num/den of the other. Each link counts in both directions. Links with a null, or a zero numerator or denominator, have no inverse and raise. Repeated links
    count once. A unit tied only to itself is its own base. contradicted tells that two chains of links between the base and some unit of the same group give different factors (or that a unit is said to be another number of itself);
    the group's factors then are those of one of the chains. contradictions() lists the links at odds. num and den are null where a chain needs over 38 digits.

    Each round a unit takes the least label that a neighbour has, with the factor to it, and then the label of that label, multiplying factors, so that chains halve at least. Minima are combined before the shuffle, and rounds are checkpointed.
    """
    found = _ratios(links)
    bad = contradictions(links, found).select(F.col("base").alias("_bad")).distinct()
    parts = F.split("ratio", "/")
    return found.join(bad, F.col("base") == F.col("_bad"), "left").select(
        "unit", "base", parts[0].try_cast("decimal(38,0)").alias("num"), parts[1].try_cast("decimal(38,0)").alias("den"), F.col("_bad").isNotNull().alias("contradicted")
    )


def _known(links: DataFrame) -> DataFrame:
    """unit, other, factor of each different link."""
    wrong = F.raise_error(F.lit("a link needs two units and a factor that isn't 0")).cast("string")
    fine = F.coalesce((F.col("num") != 0) & (F.col("den") != 0) & F.col("unit").isNotNull() & F.col("other").isNotNull(), F.lit(False))
    written = F.concat(F.col("num").cast("string"), F.lit("/"), F.abs("den").cast("string"))
    signed = F.when(F.col("den") < 0, F.concat((-F.col("num")).cast("string"), F.lit("/"), F.abs("den").cast("string"))).otherwise(written)
    known = links.select("unit", "other", F.when(fine, signed).otherwise(wrong).alias("factor"))
    return known.withColumn("factor", _times("factor", F.lit(ONE))).distinct()


def _inverse(factor: str) -> Column:
    parts = F.split(factor, "/")
    sign = F.when(parts[0].startswith("-"), "-").otherwise("")
    return F.concat(sign, parts[1], F.lit("/"), F.ltrim(parts[0], F.lit("-")))


def _ratios(links: DataFrame) -> DataFrame:
    """unit, base, ratio."""
    with_package(links.sparkSession)
    known = _known(links)
    edges = cut(known.unionAll(known.select(F.col("other").alias("unit"), F.col("unit").alias("other"), _inverse("factor").alias("factor"))).distinct())
    labels = cut(edges.select("unit").distinct().select("unit", F.col("unit").alias("base"), F.lit(ONE).alias("ratio")))
    edges = edges.where("unit <> other")
    while True:
        near = labels.select(F.col("unit").alias("other"), "base", F.col("ratio").alias("beyond"))
        best = edges.join(near, "other").groupBy("unit").agg(F.min(F.struct("base", "other", "factor", "beyond")).alias("x"))
        heard = best.select("unit", F.col("x.base").alias("new"), _times("x.factor", "x.beyond").alias("new_ratio"))
        closer = F.coalesce(F.col("new") < F.col("base"), F.lit(False))
        pick = lambda a, b: F.when(closer, F.col(a)).otherwise(F.col(b))
        least = cut(labels.join(heard, "unit", "left").select("unit", F.col("base").alias("was"), pick("new", "base").alias("base"), pick("new_ratio", "ratio").alias("ratio")))
        jump = least.select(F.col("unit").alias("base"), F.col("base").alias("far"), F.col("ratio").alias("far_ratio"))
        # a label is a unit itself, so it has a row
        moved = cut(least.join(jump, "base").select("unit", "was", F.col("far").alias("base"), _times("ratio", "far_ratio").alias("ratio")))
        labels = moved.select("unit", "base", "ratio")
        if not moved.where("was <> base").limit(1).count():
            return labels


def contradictions(links: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """unit, other, factor, implied, base: links whose factor isn't the one that the chains of conversions() give, each as "numerator/denominator"."""
    ratios = _ratios(links) if ratios is None else ratios
    own = ratios.select("unit", "base", "ratio")
    far = ratios.select(F.col("unit").alias("other"), F.col("ratio").alias("other_ratio"))
    implied = _known(links).join(own, "unit").join(far, "other").withColumn("implied", _times("ratio", _inverse("other_ratio")))
    return implied.where("factor <> implied").select("unit", "other", "factor", "implied", "base")


def factors(found: DataFrame) -> DataFrame:
    """unit, factor (decimal text of 18 digits), normalized_unit, as evidence.normalized takes them: of groups without contradictions. Values of the others have no normalized value."""
    known = found.where("not contradicted and num is not null and den is not null")
    return known.select("unit", _rounded(F.concat(F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"))).alias("factor"), F.col("base").alias("normalized_unit"))
