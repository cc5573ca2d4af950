"""The document library: list, add and upload documents, delete them, and say whether it is there.

A writer at a time. An upload writes its pages, then which file becomes which document, then its documents; readers come to pages through
documents, so a failed upload shows nothing. New keys are above all that any row of a failed one refers to, so what it left behind never joins a later document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import page_text, too_long
from quillspark.operators.constraints import Violation, checked, with_defaults, with_ids
from quillspark.operators.deletes import after_delete, deletable
from quillspark.schema import TABLES, key_of, references, struct_of
from quillspark.session import cut
from quillspark.sources import files, pdf
from quillspark.sources.tables import append, read, reply

# What every uploaded file is filed under.
UPLOAD_ORGANIZATION = "Ministry of Coal"
UPLOAD_PERIOD = "March 2025"
UPLOAD_TYPE = "Monthly Statistical Report"

LEDGER, LEDGER_SCHEMA = "_uploads", "path string, document_id int"
REJECTED, REJECTED_SCHEMA = "_rejected", "path string, name string, error string"
REQUEST = "document_name string, source_organization string, reporting_period string, document_type string"


def newest_first(documents: DataFrame, at: str = "uploaded_at", key: str = "document_id") -> DataFrame:
    """All rows, latest first, unknown times before all; the greater key first among equals."""
    return documents.orderBy(F.desc_nulls_first(at), F.desc(key))


def now(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.current_timestamp().alias("now"))


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.root, name)

    def _taken(self, table: str) -> DataFrame:
        """Keys of a table that are used, be it by rows that refer to one that was never written."""
        key = key_of(table)
        found = self.table(table).select(key)
        for child, f in references():
            if f.parent == table:
                found = found.unionByName(self.table(child).select(F.col(f.name).alias(key)))
        last = files.state(self.spark, self.root)["last"].get(table)
        if last is not None:  # keys of deleted rows don't come again
            found = found.unionByName(self.spark.createDataFrame([(last,)], f"{key} int"))
        return found.unionByName(self.ledger().select(key)) if table == "documents" else found

    def ledger(self) -> DataFrame:
        """path, document_id of all files whose upload was begun."""
        return read(self.spark, self.root, LEDGER, LEDGER_SCHEMA)

    def uploaded(self) -> DataFrame:
        """path of the files whose upload was ended."""
        return self.ledger().join(self.table("documents").select("document_id"), "document_id", "left_semi").select("path").distinct()

    def rejected(self) -> DataFrame:
        """path, name, error of the files that a stream set aside."""
        return read(self.spark, self.root, REJECTED, REJECTED_SCHEMA)

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def clock(self, message: str = "database connected") -> DataFrame:
        """The reply to a client that asks for the time: status, message, time."""
        return reply(now(self.spark).select(F.col("now").alias("time")), message)

    def documents(self) -> DataFrame:
        return newest_first(self.table("documents"))

    def add(self, table: str, rows: DataFrame) -> DataFrame:
        """Write rows with new keys and defaults; the rows as written. Unknown columns are ignored; a broken rule raises Violation and writes nothing."""
        known = {f.name for f in TABLES[table][1:]}
        rows = rows.select(*(c for c in rows.columns if c in known))
        filled = cut(with_defaults(rows, table))  # the clock is read once
        parents = {f.parent: self.table(f.parent) for f in TABLES[table] if f.parent}
        new = cut(with_ids(checked(filled, table, parents), table, self._taken(table)))
        append(new, self.root, table)
        return new

    def add_document(self, document_name: str | None = None, source_organization: str | None = None, reporting_period: str | None = None, document_type: str | None = None) -> DataFrame:
        given = (document_name, source_organization, reporting_period, document_type)
        return self.add("documents", self.spark.createDataFrame([given], REQUEST))

    def add_requests(self, bodies: DataFrame) -> DataFrame:
        """Add a document for each JSON object in the column body; other fields are ignored, missing ones are null, and a body that is no object breaks a rule."""
        return self.add("documents", bodies.select(F.from_json("body", REQUEST).alias("x")).select("x.*"))

    def upload(self, path: str) -> DataFrame:
        """document_id, document_name, pages_detected of each PDF under path. An unreadable file fails the whole upload."""
        return self.store(pdf.files(self.spark, path))

    def judged(self, files: DataFrame) -> DataFrame:
        """path, name, pages and fault of each file: why it can't be uploaded, null if it can."""
        found = pdf.parsed(files)
        limit = next(f.limit for f in TABLES["documents"] if f.name == "document_name")
        zero = F.exists("pages", lambda items: F.exists(items, lambda x: F.contains(x, F.lit("\0"))))
        fault = F.when(zero, F.lit("document_pages.extracted_text: zero character")).when(too_long(F.col("name"), limit), F.lit("documents.document_name: length"))
        return cut(found.select("path", "name", "pages", F.coalesce("error", fault).alias("fault")))

    def reject(self, found: DataFrame) -> None:
        """Keep path, name and fault of judged files that can't be uploaded."""
        append(found.where("fault is not null").select("path", "name", F.col("fault").alias("error")), self.root, REJECTED, REJECTED_SCHEMA)

    def store(self, files: DataFrame) -> DataFrame:
        """Upload files (path, name, content), or judged ones. One that can't be uploaded fails them all."""
        found = files if "fault" in files.columns else self.judged(files)
        if not found.limit(1).count():
            raise Violation("no PDF file")
        if bad := found.where("fault is not null").select("name", "fault").limit(1).collect():
            raise Violation(f"{bad[0]['name']}: {bad[0]['fault']}")
        fixed = {"source_organization": UPLOAD_ORGANIZATION, "reporting_period": UPLOAD_PERIOD, "document_type": UPLOAD_TYPE}
        rows = found.select("path", "pages", F.col("name").alias("document_name"), *(F.lit(v).alias(k) for k, v in fixed.items()))
        checked(rows, "documents", {})
        numbered = cut(with_ids(rows, "documents", self._taken("documents"), ["document_name", "path"]))
        documents = cut(with_defaults(numbered, "documents").join(numbered.select("document_id", "pages"), "document_id"))
        pages = documents.select("document_id", F.posexplode("pages").alias("at", "items"))
        pages = pages.select("document_id", (F.col("at") + 1).alias("page_number"), page_text(F.col("items")).alias("extracted_text"))
        append(with_ids(pages, "document_pages", self._taken("document_pages"), ["document_id", "page_number"]), self.root, "document_pages")
        append(numbered.select("path", "document_id"), self.root, LEDGER, LEDGER_SCHEMA)
        append(documents.coalesce(1), self.root, "documents")  # one file, there or not
        return documents.select("document_id", "document_name", F.size("pages").alias("pages_detected"))

    def without_documents(self, ids: DataFrame) -> dict[str, DataFrame]:
        """All tables as they would be without the documents, for the caller to write where it wants."""
        return after_delete({t: self.table(t) for t in TABLES}, "documents", ids)

    def delete(self, table: str, ids: DataFrame) -> dict[str, DataFrame]:
        """Delete the rows of a table whose key is in ids (one column), with what goes with them: the keys, by table, that are gone. Violation if a row that stays refers to one; a failure leaves all as it was."""
        gone = deletable({t: self.table(t) for t in TABLES}, table, ids)
        files.without(self.spark, self.root, gone, {t: struct_of(t) for t in gone})
        return gone

    def clean(self) -> None:
        """Remove the files that deletes have replaced."""
        files.clean(self.spark, self.root)


