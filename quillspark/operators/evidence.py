"""Questions to the evidence tables. The data model only suggests these; their rules are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import name_key, number_in, page_text
from quillspark.operators.numbering import numbered


def page_rows(docs: DataFrame, key: str, items: str) -> DataFrame:
    """key, page_number (from 1), extracted_text: a row for each element of the array column items."""
    pages = docs.select(key, F.posexplode(items).alias("at", "extracted_text"))
    return pages.select(key, (F.col("at") + 1).alias("page_number"), "extracted_text")


def document_text(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """key, doc_text, pages_detected: pages in order, joined by one space; null texts count as empty."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("at"), F.col(text).alias("text"))))
    return pages.groupBy(key).agg(ordered.alias("pages")).select(key, page_text(F.transform("pages", lambda p: p["text"])).alias("doc_text"), F.size("pages").cast("bigint").alias("pages_detected"))


def documents_with_pages(documents: DataFrame, pages: DataFrame, by: str | None = None) -> DataFrame:
    """Every document with each of its pages, or once with nulls; in the order of document_id and by if that is given."""
    found = documents.join(pages, "document_id", "left")
    return found.orderBy("document_id", by) if by else found


def incomplete(documents: DataFrame, pages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Documents without pages, or, given document_id and pages_detected, with fewer than were detected."""
    if expected is None:
        return documents.join(pages.select("document_id"), "document_id", "left_anti")
    have = pages.groupBy("document_id").agg(F.count("*").alias("have"))
    short = expected.join(have, "document_id", "left").where(F.coalesce("have", F.lit(0)) < F.col("pages_detected"))
    return documents.join(short.select("document_id"), "document_id", "left_semi")


def duplicates(files: DataFrame, key: str, content: str) -> DataFrame:
    """digest, n, first: contents that occur more than once."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def resolved(mentions: DataFrame, name: str, entities: DataFrame) -> DataFrame:
    """mentions with the least entity_id whose canonical_name has the same key; null if there is none."""
    known = entities.groupBy(name_key(F.col("canonical_name")).alias("_key")).agg(F.min("entity_id").alias("entity_id"))
    return mentions.withColumn("_key", name_key(F.col(name))).join(known, "_key", "left").drop("_key")


def rollup(records: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number, sum, mean, least and greatest of value by group."""
    v = F.col(value)
    return records.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def lineage(claims: DataFrame, evidence: DataFrame, records: DataFrame, pages: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """claim_id down to document_id, one row a claim, with the record's entity and the number of the page that the evidence names, null where there is none."""
    source = pages.select(F.col("page_id").alias("source_page_id"), F.col("page_number").alias("source_page_number"))
    return (
        claims.select("claim_id", "evidence_id")
        .join(evidence.select("evidence_id", "record_id", "source_page_id"), "evidence_id")
        .join(records.select("record_id", "page_id", "entity_id"), "record_id")
        .join(pages.select("page_id", "document_id", "page_number"), "page_id")
        .join(documents.select("document_id", "document_name"), "document_id")
        .join(entities.select("entity_id", "canonical_name"), "entity_id", "left")
        .join(source, "source_page_id", "left")
    )


def normalized(records: DataFrame, value: str, unit: str, units: DataFrame) -> DataFrame:
    """records with normalized_value (decimal(38,10)) and normalized_unit, by units (unit, factor, normalized_unit), one row a unit; null where the value is no number, has over 14 digits before its point, or the unit isn't known.

    Factors have up to 17 digits before their point and 18 behind it; one that is less than that, but not 0, is an error and not 0. Values keep 10 digits behind their point, or 6
    where they have over 10 before it. The whole part of a factor and the rest are multiplied apart, so that no product outgrows a decimal.
    """
    given, exact = F.col("factor"), F.col("factor").cast("decimal(38,18)")
    lost = F.raise_error(F.concat(F.lit("factor too small: "), given.cast("string"))).cast("decimal(38,18)")
    factor = F.when((given.cast("double") != 0) & (exact == 0), lost).otherwise(exact)
    known = units.select(F.col("unit").alias(unit), factor.alias("_factor"), "normalized_unit")
    whole = F.when(F.col("_factor") < 0, F.ceil("_factor")).otherwise(F.floor("_factor"))
    parts = whole.cast("decimal(17,0)"), (F.col("_factor") - whole).cast("decimal(18,18)")

    def product(number: Column) -> Column:
        return (number * parts[0]).try_cast("decimal(37,10)") + (number * parts[1]).try_cast("decimal(37,10)")

    number = number_in(F.col(value))
    found = F.coalesce(product(number.try_cast("decimal(20,10)")), product(number.try_cast("decimal(20,6)")))
    return records.join(known, unit, "left").withColumn("normalized_value", found.try_cast("decimal(38,10)")).drop("_factor")


def confidence(rows: DataFrame, value: str, low: float) -> DataFrame:
    """n, low and median of a column, one row: how many values there are, how many under low, and the mean of the middle one or two. Values are placed by a range-partitioned sort."""
    known = rows.select(F.col(value).alias("v")).where("v is not null")
    placed = numbered(known, [F.col("v")], "pos")
    n = placed.count()
    middle = F.col("pos").isin((n + 1) // 2, (n + 2) // 2)
    return placed.agg(F.count("*").alias("n"), F.count_if(F.col("v") < low).alias("low"), F.avg(F.when(middle, F.col("v"))).alias("median"))


def conflicts(items: DataFrame, key: str, same: list[str], value: str) -> DataFrame:
    """a_id < b_id of items that agree on the columns same (none null) and differ in value.

    Groups with one value never reach the join. The result is pairs, so a group of many values makes many; Spark's skew join splits a large one.
    """
    several = items.groupBy(*same).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high").select(*same)
    split = items.select(key, *same, value).join(several, same, "left_semi")
    b = split.select(F.col(key).alias("b_id"), *same, F.col(value).alias("b_value"))
    pairs = split.withColumnRenamed(key, "a_id").join(b, same)
    return pairs.where((F.col("a_id") < F.col("b_id")) & (F.col(value) != F.col("b_value"))).select("a_id", "b_id")


def conflict_classes(items: DataFrame, key: str, same: list[str], value: str) -> DataFrame:
    """The conflicts of items that agree on the columns same (none null), factored: a row for each value of a group that has several, with
    n (items that say so), first (their least key), rivals (items of the group that say something else) and against (the least key among those).

    Each of the n items conflicts with each of the rivals, so no pair is lost, and a group makes as many rows as it has values. Values and groups are combined before the shuffle.
    """
    known = items.where(" and ".join(f"`{c}` is not null" for c in [*same, value]))
    classes = known.groupBy(*same, value).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    several = classes.groupBy(*same).agg(F.sum("n").alias("_total"), F.min("first").alias("_least"), F.count("*").alias("_values")).where("_values > 1")
    split = classes.join(several, same)
    second = split.where(F.col("first") > F.col("_least")).groupBy(*same).agg(F.min("first").alias("_second"))
    against = F.when(F.col("first") == F.col("_least"), F.col("_second")).otherwise(F.col("_least"))
    return split.join(second, same).select(*same, value, "n", "first", (F.col("_total") - F.col("n")).alias("rivals"), against.alias("against"))


def current_decision(decisions: DataFrame, of: str, at: str, key: str, keep: list[str]) -> DataFrame:
    """Of each ``of`` the columns to keep of its latest decision; the greater key wins a tie. Combined before the shuffle."""
    latest = F.max_by(F.struct(key, *keep), F.struct(at, key))
    return decisions.groupBy(of).agg(latest.alias("x")).select(of, f"x.{key}", *(f"x.{c}" for c in keep))


def backed_claims(claims: DataFrame, current: DataFrame, verdict: str) -> DataFrame:
    """Claims whose evidence's current decision is verdict."""
    return claims.join(current.where(F.col("decision") == verdict).select("evidence_id"), "evidence_id", "left_semi")


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def open_queue(rows: DataFrame, status: str, is_open: str, by: list[str], size: int) -> DataFrame:
    """The first size open rows."""
    return rows.where(F.col(status) == is_open).orderBy(*by).limit(size)


def by_day(events: DataFrame, at: str, kind: str) -> DataFrame:
    """day, kind, n."""
    return events.groupBy(F.to_date(at).alias("day"), kind).agg(F.count("*").alias("n"))
