"""The data model: nine tables of documents, pages, records and evidence, as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # serial, int, text, varchar, timestamp, numeric, percent
    limit: int = 0
    required: bool = False
    default: str | None = None  # 'now' or a literal
    parent: str | None = None
    cascade: bool = False

    @property
    def type(self) -> T.DataType:
        return {
            "serial": T.IntegerType(),
            "int": T.IntegerType(),
            "text": T.StringType(),
            "varchar": T.StringType(),
            "timestamp": T.TimestampNTZType(),
            "numeric": T.DecimalType(38, 10),
            "percent": T.DecimalType(5, 2),
        }[self.kind]


def serial(name: str) -> Field:
    return Field(name, "serial", required=True)


def varchar(name: str, limit: int, required: bool = False, default: str | None = None) -> Field:
    return Field(name, "varchar", limit, required, default)


def text(name: str, required: bool = False) -> Field:
    return Field(name, "text", required=required)


def now(name: str) -> Field:
    return Field(name, "timestamp", default="now")


def parent(name: str, table: str, required: bool = True, cascade: bool = False) -> Field:
    return Field(name, "int", required=required, parent=table, cascade=cascade)


def integer(name: str, required: bool = False) -> Field:
    return Field(name, "int", required=required)


# Tables, columns, limits, defaults and references of the data model.
TABLES: dict[str, tuple[Field, ...]] = {
    "documents": (
        serial("document_id"),
        varchar("document_name", 255, required=True),
        varchar("source_organization", 255),
        varchar("reporting_period", 100),
        varchar("document_type", 100),
        now("uploaded_at"),
        varchar("status", 50, default="UPLOADED"),
    ),
    "document_pages": (
        serial("page_id"),
        parent("document_id", "documents", cascade=True),
        integer("page_number", required=True),
        text("extracted_text"),
    ),
    "entities": (
        serial("entity_id"),
        varchar("entity_type", 100, required=True),
        varchar("canonical_name", 255, required=True),
        now("created_at"),
    ),
    "extracted_records": (
        serial("record_id"),
        parent("page_id", "document_pages", cascade=True),
        parent("entity_id", "entities", required=False),
        varchar("metric_name", 255, required=True),
        varchar("original_value", 255),
        Field("normalized_value", "numeric"),
        varchar("original_unit", 100),
        varchar("normalized_unit", 100),
        varchar("reporting_period", 100),
        varchar("extraction_method", 100),
        Field("extraction_confidence", "percent"),
        now("created_at"),
    ),
    "evidence_items": (
        serial("evidence_id"),
        parent("record_id", "extracted_records"),
        varchar("evidence_type", 100),
        text("evidence_text"),
        parent("source_page_id", "document_pages", required=False),
        varchar("source_reference", 255),
        Field("confidence_score", "percent"),
        varchar("status", 50, default="PENDING"),
        now("created_at"),
    ),
    "claims": (
        serial("claim_id"),
        text("claim_text", required=True),
        parent("evidence_id", "evidence_items"),
        varchar("status", 50, default="UNVERIFIED"),
        now("created_at"),
    ),
    "verification_decisions": (
        serial("verification_id"),
        parent("evidence_id", "evidence_items"),
        varchar("decision", 50, required=True),
        text("reason"),
        varchar("verified_by", 255),
        now("verified_at"),
    ),
    "evidence_conflicts": (
        serial("conflict_id"),
        parent("evidence_a_id", "evidence_items"),
        parent("evidence_b_id", "evidence_items"),
        varchar("conflict_type", 100),
        text("description"),
        varchar("recommended_action", 100),
        varchar("resolution_status", 50, default="OPEN"),
        now("created_at"),
    ),
    "audit_events": (
        serial("audit_id"),
        varchar("event_type", 100, required=True),
        varchar("entity_type", 100),
        integer("entity_id"),
        text("description"),
        varchar("performed_by", 255),
        now("created_at"),
    ),
}


def key_of(table: str) -> str:
    return TABLES[table][0].name


def struct_of(table: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type, not f.required) for f in TABLES[table]])


def references() -> list[tuple[str, Field]]:
    """(child table, field) of every reference."""
    return [(t, f) for t, fields in TABLES.items() for f in fields if f.parent]
