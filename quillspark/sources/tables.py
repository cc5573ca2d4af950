"""Tables as Parquet folders, and rows as JSON for clients."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import iso_millis
from quillspark.schema import struct_of
from quillspark.sources import files


def read(spark: SparkSession, root: str, table: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table of the data model with its declared types, or another with the schema given; one that was never written has no rows. Deleted rows aren't among them."""
    schema = schema or struct_of(table)
    found = files.paths(spark, root, table)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def append(rows: DataFrame, root: str, table: str, schema: str | None = None) -> None:
    rows.select(*((c.split()[0] for c in schema.split(", ")) if schema else (f.name for f in struct_of(table)))).write.mode("append").parquet(f"{root}/{table}")


def reply(rows: DataFrame, message: str, name: str | None = None) -> DataFrame:
    """One JSON object a row: status, message, and the row's columns, in an object called name if one is given."""
    given = as_json(rows, "given")
    body = F.col("given") if name is None else F.concat(F.lit(f'{{"{name}":'), "given", F.lit("}"))
    head = F.regexp_replace(F.to_json(F.struct(F.lit("ok").alias("status"), F.lit(message).alias("message"))), r"\}$", ",")
    return given.select(F.concat(head, F.substring(body, 2, 1 << 30)).alias("json"))


def failure(message: str) -> str:
    """What a client is told of an exception."""
    return json.dumps({"status": "error", "message": message}, ensure_ascii=False, separators=(",", ":"))


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object a row; nulls are written out, timestamps as ISO 8601 with milliseconds."""
    stamps = (T.TimestampNTZType, T.TimestampType)
    columns = [iso_millis(F.col(f.name)).alias(f.name) if isinstance(f.dataType, stamps) else F.col(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))
