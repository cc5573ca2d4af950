"""Deletes that cascade where the data model says so, and are refused where other rows still refer to a victim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.constraints import Violation
from quillspark.schema import key_of, references
from quillspark.session import cut


def victims(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Keys, by table, of the rows that go with the rows of table whose key is in ids (one column)."""
    gone = {table: tables[table].select(key_of(table)).join(ids.toDF(key_of(table)).distinct(), key_of(table), "left_semi")}
    queue = [table]
    while queue:
        at = queue.pop(0)
        for child, f in references():
            if f.parent == at and f.cascade and child in tables:
                gone[child] = tables[child].join(gone[at].toDF(f.name), f.name, "left_semi").select(key_of(child))
                queue.append(child)
    return gone


def blockers(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> DataFrame | None:
    """table, column, id: rows that stay and refer to a victim; None if no table could hold one."""
    found = None
    for child, f in references():
        if f.parent in gone and not f.cascade and child in tables:
            kept = tables[child].join(gone[child], key_of(child), "left_anti") if child in gone else tables[child]
            hit = kept.join(gone[f.parent].toDF(f.name), f.name, "left_semi")
            part = hit.select(F.lit(child).alias("table"), F.lit(f.name).alias("column"), F.col(key_of(child)).alias("id"))
            found = part if found is None else found.unionByName(part)
    return found


def deletable(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The victims, held fast; Violation, before anything is changed, if a row that stays refers to one."""
    gone = {t: cut(df) for t, df in victims(tables, table, ids).items()}
    held = blockers(tables, gone)
    if held is not None and (first := held.limit(1).collect()):
        raise Violation(f"{first[0]['table']}.{first[0]['column']} refers to a row that would go")
    return gone


def after_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the victims; Violation if one is still referred to."""
    gone = deletable(tables, table, ids)
    return {t: df.join(gone[t], key_of(t), "left_anti") if t in gone else df for t, df in tables.items()}
