from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import fitted, page_numbers, page_text, percent_in, too_long
from quillspark.operators import evidence
from quillspark.operators.constraints import Violation, checked, typed, violations, with_defaults, with_ids
from quillspark.operators.deletes import after_delete, blockers, victims
from quillspark.schema import TABLES, references, struct_of
from quillspark.sources.tables import as_json


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_model_has_all_tables_and_columns():
    assert len(TABLES) == 9 and sum(map(len, TABLES.values())) == 62 and len(references()) == 9
    assert sum(f.required for fs in TABLES.values() for f in fs) == 24 and sum(bool(f.limit) for fs in TABLES.values() for f in fs) == 25


@pytest.mark.parametrize(("items", "text"), [([], ""), (["a"], "a"), (["a", "", "b"], "a  b"), (["a", None, "b"], "a  b")])
def test_page_text(spark, items, text):
    assert spark.createDataFrame([(items,)], "i array<string>").select(page_text(F.col("i")).alias("x")).first()["x"] == text


@pytest.mark.parametrize(("n", "pages"), [(0, []), (1, [1]), (3, [1, 2, 3]), (-2, [])])
def test_page_numbers(spark, n, pages):
    assert one(spark, page_numbers(F.lit(n))) == pages


@pytest.mark.parametrize(("value", "bad", "kept"), [("a" * 5, False, "aaaaa"), ("a" * 6, True, None), ("abc     ", False, "abc  "), ("\U0001f600" * 5, False, "\U0001f600" * 5)])
def test_varchar(spark, value, bad, kept):
    assert one(spark, too_long(F.lit(value), 5)) == bad
    if not bad:
        assert one(spark, fitted(F.lit(value), 5)) == kept


@pytest.mark.parametrize(("value", "kept"), [("1.005", "1.01"), ("-1.005", "-1.01"), ("999.99", "999.99"), ("999.995", None), ("1000", None), (None, "null")])
def test_percent(spark, value, kept):
    rows = spark.createDataFrame([(value,)], "confidence_score string")
    if kept is None:
        with pytest.raises(Exception, match="(?i)overflow|out.of.range|cannot be represented"):
            typed(rows, "evidence_items").collect()
    else:
        assert typed(rows, "evidence_items").first()[0] == (None if kept == "null" else Decimal(kept))


@pytest.mark.parametrize("value", [0.0, 1.005, -1.005, 999.99, 999.994, 999.995, -999.995, 1000.0, float("nan"), None])
def test_percent_of_a_float(spark, value):
    rows = spark.createDataFrame([(value,)], "x double")
    a, b = rows.select(percent_in(F.col("x")), F.col("x").try_cast("decimal(5,2)")).first()
    assert a == b


def test_defaults_fill_absent_columns_only(spark):
    absent = with_defaults(spark.createDataFrame([("x",)], "document_name string"), "documents").first()
    assert absent["status"] == "UPLOADED" and absent["uploaded_at"] is not None and absent["document_type"] is None
    given = with_defaults(spark.createDataFrame([("x", None)], "document_name string, status string"), "documents").first()
    assert given["status"] is None


@pytest.mark.parametrize(("name", "rules"), [(None, ["not null"]), ("", []), ("a" * 256, ["length"]), ("a" * 255 + "  ", [])])
def test_document_rules(spark, name, rules):
    rows = with_defaults(spark.createDataFrame([(name,)], "document_name string"), "documents")
    assert [r["rule"] for r in violations(rows, "documents", {}).collect()] == rules
    if rules:
        with pytest.raises(Violation, match="documents.document_name"):
            checked(rows, "documents", {})


@pytest.mark.parametrize(("child", "field"), [(t, f) for t, f in references()], ids=lambda x: getattr(x, "name", x))
def test_references(spark, child, field):
    key = TABLES[field.parent][0].name
    parents = {field.parent: spark.createDataFrame([(7,)], f"{key} int")}

    def broken(value):
        rows = spark.createDataFrame([(value,)], f"{field.name} int")
        return [(r["rule"], r["column"]) for r in violations(rows, child, parents).collect() if r["column"] == field.name]

    assert broken(7) == [] and broken(8) == [("reference", field.name)]
    assert broken(None) == ([("not null", field.name)] if field.required else [])


def test_new_ids_follow_those_taken(spark):
    taken = spark.createDataFrame([(5,), (9,)], "entity_id int")
    rows = spark.range(50).select(F.lit("t").alias("entity_type"), F.lpad(F.col("id").cast("string"), 3, "0").alias("canonical_name"))
    got = with_ids(rows, "entities", taken, ["canonical_name"]).orderBy("entity_id").collect()
    assert [r["entity_id"] for r in got] == list(range(10, 60)) and [r["canonical_name"] for r in got] == sorted(r["canonical_name"] for r in got)


def tables(spark, evidence=(), **extra):
    data = {"documents": [(1,), (2,)], "document_pages": [(10, 1), (20, 2)], "extracted_records": [(100, 10), (200, 20)], "evidence_items": list(evidence)}
    columns = {"documents": ["document_id"], "document_pages": ["page_id", "document_id"], "extracted_records": ["record_id", "page_id"], "evidence_items": ["evidence_id", "record_id", "source_page_id"]}
    out = {}
    for t, rows in data.items():
        kinds = ", ".join(f"{c} int" for c in columns[t])
        out[t] = spark.createDataFrame(rows, kinds)
    out["extracted_records"] = out["extracted_records"].withColumn("entity_id", F.lit(None).cast("int"))
    return out


def test_delete_cascades(spark):
    t, ids = tables(spark), spark.createDataFrame([(1,)], "id int")
    assert {k: [r[0] for r in v.collect()] for k, v in victims(t, "documents", ids).items()} == {"documents": [1], "document_pages": [10], "extracted_records": [100]}
    assert {k: v.count() for k, v in after_delete(t, "documents", ids).items()} == {"documents": 1, "document_pages": 1, "extracted_records": 1, "evidence_items": 0}


@pytest.mark.parametrize("item", [(1, 100, None), (1, 200, 10)], ids=["record", "source page"])
def test_evidence_pins_its_sources(spark, item):
    t, ids = tables(spark, [item]), spark.createDataFrame([(1,)], "id int")
    assert blockers(t, victims(t, "documents", ids)).count() == 1
    with pytest.raises(Violation, match="evidence_items"):
        after_delete(t, "documents", ids)


def test_json_keeps_nulls_and_milliseconds(spark):
    rows = spark.sql("select 1 as a, cast(null as string) as b, timestamp_ntz'2025-03-01 02:03:04.567891' as c")
    assert as_json(rows).first()[0] == '{"a":1,"b":null,"c":"2025-03-01T02:03:04.567Z"}'


def test_normalized_values(spark):
    rows = spark.createDataFrame([("1,250.5", "t"), ("7", "kg"), ("7", "odd"), ("x", "t"), (None, "t"), ("7", None), ("9" * 20, "t")], "v string, u string")
    units = spark.createDataFrame([("t", 1000.0, "kg"), ("kg", 1.0, "kg")], "unit string, factor double, normalized_unit string")
    got = {(r.v, r.u): (r.normalized_value, r.normalized_unit) for r in evidence.normalized(rows, "v", "u", units).collect()}
    assert got == {("1,250.5", "t"): (Decimal("1250500"), "kg"), ("7", "kg"): (Decimal(7), "kg"), ("7", "odd"): (None, None), ("x", "t"): (None, "kg"), (None, "t"): (None, "kg"), ("7", None): (None, None), ("9" * 20, "t"): (None, "kg")}


def test_confidence_and_incomplete(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, None, 2.0, 9.0)], "v double")
    assert tuple(evidence.confidence(rows, "v", 2.5).first()) == (4, 2, 2.5) and tuple(evidence.confidence(rows.limit(0), "v", 1.0).first()) == (0, 0, None)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id int")
    pages = spark.createDataFrame([(1,), (1,), (2,)], "document_id int")
    expected = spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "document_id int, pages_detected int")
    assert [r[0] for r in evidence.incomplete(docs, pages, expected).collect()] == [2] and [r[0] for r in evidence.incomplete(docs, pages).collect()] == [3]


def test_struct_types(spark):
    assert struct_of("documents")["uploaded_at"].dataType.simpleString() == "timestamp_ntz" and not struct_of("documents")["document_name"].nullable


def test_quarantine_splits_rows(spark):
    from quillspark.operators.constraints import quarantined

    rows = [(1, 7, 1, "a"), (2, 7, None, "b"), (3, 9, 1, "c"), (4, None, None, "d"), (5, 7, 2, "e"), (5, 7, 3, "f"), (None, 7, 4, "g"), (6, 7, 5, None)]
    table = spark.createDataFrame(rows, "page_id int, document_id int, page_number int, extracted_text string")
    parents = {"documents": spark.createDataFrame([(7,), (7,), (None,)], "document_id int")}
    good, bad = quarantined(table.withColumn("other", table.page_id), "document_pages", parents)
    assert sorted(r.page_id for r in good.collect()) == [1, 6] and good.columns == table.columns
    assert {(r.page_id, r.extracted_text): r.broken for r in bad.collect()} == {
        (2, "b"): ["not null: page_number"],
        (3, "c"): ["reference: document_id"],
        (4, "d"): ["not null: document_id", "not null: page_number"],
        (5, "e"): ["unique: page_id"],
        (5, "f"): ["unique: page_id"],
        (None, "g"): ["not null: page_id"],
    }
    good, bad = quarantined(table.limit(0), "document_pages", parents)
    assert good.count() == bad.count() == 0


def test_quarantine_knows_lengths(spark):
    from quillspark.operators.constraints import quarantined

    rows = [("x" * 256, "o"), ("x" * 255 + "  ", "o" * 300), ("fine", None), (None, "o")]
    _, bad = quarantined(spark.createDataFrame(rows, "document_name string, source_organization string"), "documents", {})
    assert sorted(tuple(r.broken) for r in bad.collect()) == [("length: document_name",), ("length: source_organization",), ("not null: document_name",)]
