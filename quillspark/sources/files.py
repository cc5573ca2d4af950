"""Which files of a library's tables count.

What is appended to a table counts at once. A delete writes what stays of the files it touches into a folder of its own, and then one small file that names the
files that were replaced and those that stand for them. It is written under another name and renamed last, so readers see all of a delete or nothing of it.
There is one writer at a time, no log and no way back: the state with the greatest number counts, and earlier ones go.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE, KEPT = "_state", "_kept"


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path as its object."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def state(spark: SparkSession, root: str) -> dict:
    """number; replaced: by table, names of files in its folder that no longer count; kept: by table, files below _kept that do; last: by table, the greatest key that was ever used."""
    numbers = [int(n) for n in _names(spark, f"{root}/{STATE}") if n.isdigit()]
    if not numbers:
        return {"number": 0, "replaced": {}, "kept": {}, "last": {}}
    fs, path = _at(spark, f"{root}/{STATE}/{max(numbers)}")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def swap(spark: SparkSession, root: str, new: dict) -> None:
    """Let a state count: the one step after which readers see what it names."""
    number = new["number"] + 1
    fs, path = _at(spark, f"{root}/{STATE}/{number}")
    _, draft = _at(spark, f"{root}/{STATE}/.{number}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(new | {"number": number}).encode()))
    out.close()
    if not fs.rename(draft, path):
        raise OSError(f"{path.toString()} can't be written")
    for n in _names(spark, f"{root}/{STATE}"):
        if n.isdigit() and int(n) < number:
            fs.delete(_at(spark, f"{root}/{STATE}/{n}")[1], False)


def paths(spark: SparkSession, root: str, table: str) -> list[str]:
    """What to read for a table: its folder, or the files that count; nothing if it has no rows."""
    fs, folder = _at(spark, f"{root}/{table}")
    known = state(spark, root)
    gone, kept = set(known["replaced"].get(table, ())), [f"{root}/{KEPT}/{table}/{f}" for f in known["kept"].get(table, ())]
    if not fs.exists(folder):
        return kept
    if not gone:
        return [f"{root}/{table}", *kept]
    found = spark.read.schema("_ int").parquet(f"{root}/{table}").inputFiles()
    return [f"{root}/{table}/{n}" for n in (f.rsplit("/", 1)[1] for f in found) if n not in gone] + kept


def without(spark: SparkSession, root: str, gone: dict[str, DataFrame], schemas: dict[str, T.StructType]) -> None:
    """Take the rows whose key, the first column, is in gone out of the tables, all at once. Only files that hold one of them are written anew; others aren't read beyond their keys."""
    known = state(spark, root)
    new, generation = json.loads(json.dumps(known)), uuid.uuid4().hex
    for table, keys in gone.items():
        schema, files = schemas[table], paths(spark, root, table)
        if not files:
            continue
        key = schema[0].name
        rows = spark.read.schema(schema).parquet(*files)
        hit = rows.select(key, F.col("_metadata.file_name").alias("name")).join(keys.toDF(key), key, "left_semi")
        touched = {r["name"] for r in hit.select("name").distinct().collect()}  # names of files, as a listing has them
        if not touched:
            continue
        new["last"][table] = max(known["last"].get(table, 0), rows.agg(F.max(key)).first()[0])
        kept = {f.rsplit("/", 1)[1]: f for f in known["kept"].get(table, ())}
        where = [f"{root}/{KEPT}/{table}/{kept[n]}" if n in kept else f"{root}/{table}/{n}" for n in sorted(touched)]
        stay = spark.read.schema(schema).parquet(*where).join(keys.toDF(key), key, "left_anti")
        stay.write.parquet(f"{root}/{KEPT}/{table}/{generation}")
        written = [f"{generation}/{n}" for n in _names(spark, f"{root}/{KEPT}/{table}/{generation}") if n.endswith(".parquet")]
        new["kept"][table] = [f for n, f in kept.items() if n not in touched] + written
        new["replaced"][table] = sorted({*known["replaced"].get(table, ()), *(touched - kept.keys())})
    if new != known:
        swap(spark, root, new)


def clean(spark: SparkSession, root: str) -> None:
    """Remove the files that no longer count and what broken deletes left. Readers that began before the last delete lose their files."""
    known = state(spark, root)
    for table, names in known["replaced"].items():
        for n in names:
            fs, path = _at(spark, f"{root}/{table}/{n}")
            fs.delete(path, False)
    for table in _names(spark, f"{root}/{KEPT}"):
        used = set(known["kept"].get(table, ()))
        for generation in _names(spark, f"{root}/{KEPT}/{table}"):
            inside = [f"{generation}/{n}" for n in _names(spark, f"{root}/{KEPT}/{table}/{generation}")]
            for f in [generation] if not used & set(inside) else [f for f in inside if f.endswith(".parquet") and f not in used]:
                fs, path = _at(spark, f"{root}/{KEPT}/{table}/{f}")
                fs.delete(path, True)
    if known["replaced"]:
        swap(spark, root, known | {"replaced": {}})
