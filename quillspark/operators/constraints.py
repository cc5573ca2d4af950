"""Integrity rules as DataFrame checks, driven by the data model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import decimal_in, fitted, too_long
from quillspark.operators.numbering import numbered
from quillspark.schema import TABLES, key_of
from quillspark.session import cut


class Violation(ValueError):
    """Rows that break a rule; nothing has been written."""


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """All columns of the table but its key: absent ones get their default or null; a null that is given stays."""
    out = rows
    for f in TABLES[table][1:]:
        if f.name not in rows.columns:
            value = F.localtimestamp() if f.default == "now" else F.lit(f.default)
            out = out.withColumn(f.name, value.cast(f.type))
    return out.select(*([key_of(table)] if key_of(table) in rows.columns else []), *(f.name for f in TABLES[table][1:]))


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Columns cast as declared; what doesn't fit raises. Spaces beyond a varchar's limit are cut."""
    fields = {f.name: f for f in TABLES[table]}

    def cast(c: str) -> Column:
        if fields[c].limit:
            return fitted(F.col(c).cast("string"), fields[c].limit)
        if isinstance(kind := fields[c].type, T.DecimalType):
            value = F.col(c).cast("decimal(38,10)") if isinstance(rows.schema[c].dataType, (T.StringType, T.NullType)) else F.col(c)
            fit = decimal_in(value, kind.precision, kind.scale)
            lost = F.raise_error(F.concat(F.lit(f"{table}.{c} out of range: "), F.col(c).cast("string"))).cast(fields[c].type)
            return F.when(F.col(c).isNull() | fit.isNotNull(), fit).otherwise(lost)
        return F.col(c).cast(fields[c].type)

    return rows.select(*(cast(c).alias(c) for c in rows.columns if c in fields))


def with_ids(rows: DataFrame, table: str, taken: DataFrame | None, by: list[str] | None = None) -> DataFrame:
    """rows with new keys above every one in taken, in the order of by."""
    key = key_of(table)
    last = taken.agg(F.max(key)).first()[0] if taken is not None else None
    order = [F.col(c) for c in by or [c for c in rows.columns if c != key]]
    new = numbered(rows.drop(key), order, key, (last or 0) + 1)
    return new.select(F.col(key).cast("int").alias(key), *(c for c in rows.columns if c != key))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def null_violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """column, n: how many rows lack each required column; one pass, one small row a column."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in required))).alias("x")).select("x.column", "x.n")


def over_length(rows: DataFrame, column: str, limit: int) -> DataFrame:
    return rows.where(too_long(F.col(column), limit))


def missing_parents(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Child rows whose reference is not null and leads nowhere. Only the parent's key is read; Spark broadcasts it if it is small."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti")


def violations(rows: DataFrame, table: str, parents: dict[str, DataFrame]) -> DataFrame:
    """rule, column, n of each broken rule; empty if rows may be written."""
    fields, found = TABLES[table], []
    row_rules = [("not null", f.name, F.col(f.name).isNull()) for f in fields if f.required and f.name in rows.columns]
    row_rules += [("length", f.name, too_long(F.col(f.name), f.limit)) for f in fields if f.limit and f.name in rows.columns]
    if row_rules:
        counts = rows.agg(*(F.count_if(broken).alias(f"c{k}") for k, (_, _, broken) in enumerate(row_rules)))
        listed = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"c{k}").alias("n")) for k, (rule, c, _) in enumerate(row_rules)))
        found.append(counts.select(F.explode(listed).alias("x")).select("x.*"))
    if key_of(table) in rows.columns:
        found.append(duplicate_keys(rows, [key_of(table)]).agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), F.lit(key_of(table)).alias("column"), "n"))
    for f in fields:
        if f.parent in parents and f.name in rows.columns:
            lost = missing_parents(rows, parents[f.parent], f.name, key_of(f.parent))
            found.append(lost.agg(F.count("*").alias("n")).select(F.lit("reference").alias("rule"), F.lit(f.name).alias("column"), "n"))
    none = rows.sparkSession.createDataFrame([], "rule string, column string, n long")
    return reduce(DataFrame.unionByName, found, none).where("n > 0")


def judged(rows: DataFrame, table: str, parents: dict[str, DataFrame]) -> DataFrame:
    """rows with broken: the rules that each row breaks, as "rule: column" in the order of the rules (not null, length, unique, reference); empty where it may be written.

    Rules of a row alone are one projection. Uniqueness is a count by key, combined before the shuffle, of which only keys that occur twice or more are joined back; each reference is a
    join with the parent's distinct keys. All rows that share a key break the rule, as none of them is the right one. Null keys and null references break neither.
    """
    fields, key = TABLES[table], key_of(table)
    here = [f for f in fields if f.name in rows.columns]
    found = [F.when(F.col(f.name).isNull(), F.lit(f"not null: {f.name}")) for f in here if f.required]
    found += [F.when(too_long(F.col(f.name), f.limit), F.lit(f"length: {f.name}")) for f in here if f.limit]
    out, marks = rows, []
    if key in rows.columns:
        twice = duplicate_keys(rows.where(F.col(key).isNotNull()), [key]).select(key, F.lit(True).alias("_twice"))
        out, marks = out.join(twice, key, "left"), [*marks, "_twice"]
        found.append(F.when(F.col("_twice"), F.lit(f"unique: {key}")))
    for f in here:
        if f.parent in parents:
            known = parents[f.parent].select(F.col(key_of(f.parent)).alias(f.name)).distinct().withColumn(f"_has_{f.name}", F.lit(True))
            out, marks = out.join(known, f.name, "left"), [*marks, f"_has_{f.name}"]
            found.append(F.when(F.col(f.name).isNotNull() & F.col(f"_has_{f.name}").isNull(), F.lit(f"reference: {f.name}")))
    return out.withColumn("broken", F.array_compact(F.array(*found))).select(*rows.columns, "broken")


def quarantined(rows: DataFrame, table: str, parents: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows that may be written, typed, and those that break a rule, with broken. They are judged once."""
    known = cut(judged(rows.select(*(f.name for f in TABLES[table] if f.name in rows.columns)), table, parents))
    return typed(known.where(F.size("broken") == 0).drop("broken"), table), known.where(F.size("broken") > 0)


def checked(rows: DataFrame, table: str, parents: dict[str, DataFrame]) -> DataFrame:
    """rows, typed, if they break no rule; otherwise Violation."""
    rows = rows.select(*(f.name for f in TABLES[table] if f.name in rows.columns))
    broken = violations(rows, table, parents).collect()  # a row a rule at most
    if broken:
        raise Violation("; ".join(f"{table}.{r['column']}: {r['rule']} ({r['n']} rows)" for r in broken))
    return typed(rows, table)
