"""The library's operators over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for those of the data model: conversations for pages of documents, events for audit
events and decisions, customers, orders and lines for rows that refer to one another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import name_key, number_in, page_numbers, page_text, percent_in
from quillspark.operators import constraints, deletes, evidence, names, search, statistics, temporal, units
from quillspark.operators.numbering import numbered
from quillspark.plans.library import Library
from quillspark.schema import key_of
from quillspark.session import shared_dir
from quillspark.sources.tables import append, as_json
from quillspark.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("select event_id, ts, event_type, row_number() over (order by ts desc nulls first, event_id desc) pos from events")
def list_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return numbered(events, [F.desc_nulls_first("ts"), F.desc("event_id")])


@query("select doc_id document_id, cast(unnest(range(1, len(string_split(text, chr(10))) + 1)) as integer) page_number, unnest(string_split(text, chr(10))) extracted_text from documents")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("items"))
    return evidence.page_rows(docs, "document_id", "items")


@query("select doc_id, array_to_string(string_split(text, chr(10)), ' ') extracted_text from documents")
def page_text_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", page_text(F.split("text", "\n")).alias("extracted_text"))


@query("select conv_id, cast(unnest(range(1, count(*) + 1)) as integer) page_number from conversations group by conv_id")
def page_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("conv_id", F.explode(page_numbers(F.col("n"))).alias("page_number"))


@query("select conv_id, string_agg(text, ' ' order by turn) doc_text, count(*) pages_detected from conversations group by conv_id")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.document_text(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("select row_number() over (order by doc_id) document_id, source document_name, lang source_organization, cast(null as varchar) reporting_period, cast(null as varchar) document_type, 'UPLOADED' status from documents")
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_name"), F.col("lang").alias("source_organization"))
    filled = constraints.with_defaults(given.drop("doc_id"), "documents").columns
    ids = numbered(given, [F.col("doc_id")], "document_id")
    rows = constraints.with_defaults(ids, "documents")
    return rows.select(*(c for c in ["document_id", *filled] if c != "uploaded_at"))


@query("select event_id, event_type, case when value < 10 then null else 'PENDING' end status from events")
def explicit_null_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") >= 10, F.lit("PENDING")).alias("status"))
    kept = constraints.with_defaults(rows.select(F.col("event_id").cast("int").alias("record_id"), F.col("event_type").alias("evidence_type"), "status"), "evidence_items")
    return kept.select(F.col("record_id").cast("long").alias("event_id"), F.col("evidence_type").alias("event_type"), "status")


@query("select d.doc_id from documents d anti join labels l on d.doc_id = l.doc_id")
def fk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return constraints.missing_parents(docs, read(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "select 'quality' \"column\", count(*) filter (quality is null) n from (select l.quality, l.toxic from documents d left join labels l using (doc_id)) "
    "union all select 'toxic', count(*) filter (toxic is null) from (select l.quality, l.toxic from documents d left join labels l using (doc_id))"
)
def not_null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return constraints.null_violations(rows, ["quality", "toxic"])


@query("select doc_id, length(text) n from documents where length(rtrim(text, ' ')) > 255")
def over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.over_length(read(spark, sf_dir, "documents"), "text", 255).select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@query("select l_orderkey, l_linenumber, l_extendedprice, try_cast(l_extendedprice as decimal(5,2)) price, try_cast(l_quantity as decimal(5,2)) quantity from lineitem")
def decimal_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", percent_in(F.col("l_extendedprice")).alias("price"), percent_in(F.col("l_quantity")).alias("quantity"))


@query("select l_orderkey, count(*) n from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')) group by 1")
def cascade_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for documents, orders for their pages, lines for records on them."""
    tables = {
        "documents": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id")),
        "document_pages": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("document_id")),
        "extracted_records": read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_orderkey").alias("page_id")),
    }
    gone = deletes.victims(tables, "documents", read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return gone["extracted_records"].groupBy(F.col("record_id").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("select 'evidence_items' \"table\", 'record_id' \"column\", l_orderkey * 100 + l_linenumber id from lineitem semi join (select * from orders where o_orderstatus = 'F') x on l_orderkey = o_orderkey")
def delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for records, lines for evidence that refers to them."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), "o_orderstatus")
    evidence_items = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("record_id"))
    tables = {"extracted_records": orders, "evidence_items": evidence_items.withColumn("source_page_id", F.lit(None).cast("bigint"))}
    gone = deletes.victims(tables, "extracted_records", orders.where("o_orderstatus = 'F'").select("record_id"))
    return deletes.blockers(tables, gone)


@query(
    "select '{\"event_id\":' || event_id || ',\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(millisecond(ts) % 1000 as varchar), 3, '0') || 'Z\",\"event_type\":\"' || event_type || '\",\"reason\":null}' json from events"
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.lit(None).cast("string").alias("reason")))


@query("select doc_id, n, try_cast(replace(n, ',', '') as decimal(38,10)) v from (select doc_id, unnest(regexp_extract_all(text, '[0-9][0-9.,]*')) n from documents)")
def value_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9.,]*"), F.lit(0))).alias("n"))
    return found.select("doc_id", "n", number_in(F.col("n")).alias("v"))


@query(
    "select l_orderkey, l_linenumber, l_returnflag, case when u is not null then cast(cast(l_quantity as bigint) * f as decimal(38,10)) end normalized_value, u normalized_unit "
    "from lineitem left join (values ('A', 1, 'kg'), ('N', 1000, 'kg')) x(k, f, u) on l_returnflag = k"
)
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in units that their flags stand for; one flag is no known unit."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("bigint").cast("string").alias("original_value"))
    units = spark.createDataFrame([("A", 1, "kg"), ("N", 1000, "kg")], "unit string, factor int, normalized_unit string")
    return evidence.normalized(rows, "original_value", "l_returnflag", units).select("l_orderkey", "l_linenumber", "l_returnflag", "normalized_value", "normalized_unit")


@query("select a.event_id a_id, b.event_id b_id from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id where a.value <> b.value and cast(a.ts as date) = cast(b.ts as date)")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return evidence.conflicts(events, "event_id", ["user_id", "event_type", "day"], "value")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def current_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.current_decision(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_type"])


@query(
    "with c as (select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1) "
    "select c_custkey, c_name from customer semi join (select * from c where event_type = 'click') x on c_custkey = x.user_id"
)
def backed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = evidence.current_decision(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_type"])
    current = current.select(F.col("user_id").alias("evidence_id"), F.col("event_type").alias("decision"))
    claims = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id"), F.col("c_name"))
    return evidence.backed_claims(claims, current, "click").select(F.col("evidence_id").alias("c_custkey"), "c_name")


@query(
    "select l_orderkey, l_linenumber, l_quantity, o_custkey, c.c_nationkey, n.n_regionkey, r_name, s_name, cast(x.n_regionkey as integer) source_page from lineitem join orders on l_orderkey = o_orderkey "
    "join customer c on o_custkey = c_custkey join nation n on c.c_nationkey = n.n_nationkey join region on n.n_regionkey = r_regionkey "
    "left join supplier on s_suppkey = o_custkey left join nation x on x.n_nationkey = o_orderkey % 30"
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for claims, orders for evidence, customers for records, nations for pages, regions for documents, suppliers for entities."""
    claims = read(spark, sf_dir, "lineitem").select(F.struct("l_linenumber", "l_quantity").alias("claim_id"), F.col("l_orderkey").alias("evidence_id"))
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("record_id"), (F.col("o_orderkey") % 30).cast("int").alias("source_page_id"))
    records = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").alias("page_id"), F.col("c_custkey").alias("entity_id"))
    pages = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), F.col("n_regionkey").alias("document_id"), F.col("n_regionkey").alias("page_number"))
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("document_id"), F.col("r_name").alias("document_name"))
    entities = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"))
    found = evidence.lineage(claims, items, records, pages, regions, entities)
    names = {"evidence_id": "l_orderkey", "record_id": "o_custkey", "page_id": "c_nationkey", "document_id": "n_regionkey", "document_name": "r_name", "canonical_name": "s_name", "source_page_number": "source_page"}
    return found.select("claim_id.l_linenumber", "claim_id.l_quantity", *(F.col(k).alias(v) for k, v in names.items()))


@query("select o_orderstatus, count(*) n from orders group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.status_counts(read(spark, sf_dir, "orders"), "o_orderstatus")


@query("select o_orderkey, o_orderdate, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 50")
def open_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.open_queue(read(spark, sf_dir, "orders"), "o_orderstatus", "O", ["o_orderdate", "o_orderkey"], 50).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("select cast(ts as date) \"day\", event_type, count(*) n from events group by 1, 2")
def audit_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.by_day(read(spark, sf_dir, "events"), "ts", "event_type")


@query(
    "select l_suppkey, l_returnflag, count(q) n, sum(q) total, cast(sum(q) as double) / count(q) mean, min(q) least, max(q) greatest "
    "from (select l_suppkey, l_returnflag, cast(l_quantity as bigint) q from lineitem) group by 1, 2"
)
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return evidence.rollup(rows, ["l_suppkey", "l_returnflag"], "q")


@query("select count(c) n, count(*) filter (c < 0.05) low, quantile_cont(c, 0.5) median from (select l_discount c from lineitem)")
def confidence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.confidence(read(spark, sf_dir, "lineitem"), "l_discount", 0.05)


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def documents_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey")
    return evidence.documents_with_pages(customers, orders).withColumnRenamed("document_id", "c_custkey")


@query("select c_custkey from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey = o_custkey where coalesce(n, 0) < c_nationkey")
def incomplete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for documents of c_nationkey pages each, orders for the pages that are there."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("pages_detected"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"))
    return evidence.incomplete(customers.select("document_id"), orders, customers).withColumnRenamed("document_id", "c_custkey")


@query("select sha256(text) digest, count(*) n, min(doc_id) \"first\" from documents group by 1 having count(*) > 1")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("select p_partkey, entity_id from part left join (select k, min(n_nationkey) entity_id from (values ('promo', 1), ('small', 2), ('medium', 4), ('medium', 3)) v(k, n_nationkey) group by k) on lower(p_type) = k")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types against names of three sizes, two of which are spelt alike."""
    entities = read(spark, sf_dir, "nation").where("n_nationkey between 1 and 4").select(F.element_at(F.array(*map(F.lit, ("Promo", " small.", "MEDIUM", "Medium "))), F.col("n_nationkey")).alias("canonical_name"), F.col("n_nationkey").alias("entity_id"))
    return evidence.resolved(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", entities).select("p_partkey", "entity_id")


@query(
    "select user_id, event_type, value, n, first, cast(total - n as bigint) rivals, case when first = least then later else least end against from ("
    "select *, sum(n) over g total, min(first) over g least, count(*) over g k, nth_value(first, 2) over (partition by user_id, event_type order by first rows between unbounded preceding and unbounded following) later "
    "from (select user_id, event_type, value, count(*) n, min(event_id) first from events where value is not null group by 1, 2, 3) window g as (partition by user_id, event_type)) where k > 1"
)
def conflict_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conflict_classes(read(spark, sf_dir, "events"), "event_id", ["user_id", "event_type"], "value")


#: Claims about users at moments of the month that events cover; times are microseconds.
CLAIMED = "1704067200000000 + (o_orderkey * 7919 % 2592000) * 1000000"


@query(
    f"with claims as (select o_orderkey, o_custkey % 200 user_id, {CLAIMED} claimed_at from orders) "
    "select o_orderkey, c.user_id, claimed_at, x.event_id, x.event_type from (select o_orderkey, c.user_id, claimed_at, max({'ts': ts, 'event_id': event_id, 'event_type': event_type}) x "
    "from claims c left join events e on e.user_id = c.user_id and epoch_us(ts) <= claimed_at group by 1, 2, 3) c"
)
def decision_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for claims, events for decisions about their users."""
    claims = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("user_id"), F.expr(CLAIMED).alias("claimed_at"))
    decisions = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("since"))
    return temporal.in_force(claims, decisions, "user_id", "claimed_at", "since", "event_id", ["event_id", "event_type"])


#: Periods from an hour to a day, and one in 500 of a month.
PERIOD = "(case when o_orderkey % 500 = 0 then 720 else 1 + o_orderkey % 24 end) * 3600000000"


@query(
    f"select o_orderkey, count(*) n, min(event_id) first from (select o_orderkey, o_custkey % 200 u, {CLAIMED} low, {CLAIMED} + {PERIOD} high from orders) "
    "join events on user_id = u and epoch_us(ts) >= low and epoch_us(ts) < high group by 1"
)
def events_in_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for reporting periods, events for what is audited."""
    periods = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("user_id"), F.expr(CLAIMED).alias("low"), F.expr(f"{CLAIMED} + {PERIOD}").alias("high"))
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = temporal.within(events, "at", periods, "low", "high", ["user_id"])
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("select a.c_name a, b.c_name b, cast(1 as integer) edits from customer a join customer b on a.c_name < b.c_name and levenshtein(a.c_name, b.c_name) = 1")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.similar(read(spark, sf_dir, "customer"), "c_name", 1)


@query(
    "with recursive plain as (select lower(replace(p_name, '#', ' ')) as k, min(p_partkey) as least from part group by 1), "
    "links as (select a.k as a, b.k as b from plain a join plain b on a.k <> b.k and levenshtein(a.k, b.k) <= 3), "
    "reach as (select k as a, k as b from plain union select reach.a, links.b from reach join links on reach.b = links.a), "
    "groups as (select a, min(least) as entity_id from reach join plain on k = b group by 1) "
    "select p_partkey, p_name, entity_id from part join groups on a = lower(replace(p_name, '#', ' '))"
)
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.resolved_alike(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", 3)


@query(
    "select time_bucket(interval 1 day, ts) start, event_type, count(distinct event_id) n from events where ts is not null group by 1, 2 "
    "having time_bucket(interval 1 day, min(ts)) + interval 1 day <= (select max(ts) - interval 2 hours from events)"
)
def closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table read as a stream: events of each day that no more rows can join."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")  # a pattern, as the table may be a single file
    found = arrivals.followed(spark, stream, events.schema, "event_id", "ts", "event_type", "1 day", "2 hours", f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "with gone as (select c_custkey from customer where c_mktsegment = 'BUILDING') select 'documents' \"table\", c_custkey id, 1 n from customer where c_custkey not in (from gone) "
    "union all select 'document_pages', o_orderkey, 1 from orders where o_custkey not in (from gone) "
    "union all select 'extracted_records', l_orderkey, count(*) from lineitem semi join (select * from orders where o_custkey not in (from gone)) x on l_orderkey = o_orderkey group by 2"
)
def written_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of customers as documents, orders as pages and lines as records is written, and one segment's documents are deleted from it, half of them at a time: what can be read then."""
    library = Library(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    customers = read(spark, sf_dir, "customer")
    given = {
        "documents": customers.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("document_name")),
        "document_pages": read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("document_id"), F.lit(1).alias("page_number")),
        "extracted_records": read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("metric_name")),
    }
    for table, rows in given.items():
        append(constraints.typed(constraints.with_defaults(rows, table), table), library.root, table)
    segment = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    for half in (0, 1):
        library.delete("documents", segment.where(F.col("c_custkey") % 2 == half))
    left = [library.table(t).select(F.lit(t).alias("table"), F.col(key_of(t)).cast("bigint").alias("id")) for t in given]
    return reduce(DataFrame.unionByName, left).groupBy("table", "id").agg(F.count("*").alias("n"))


@query("select c_custkey, o_orderkey, row_number() over (order by c_custkey, o_orderkey nulls first) pos from customer left join orders on c_custkey = o_custkey")
def pages_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for documents, orders for their pages: all documents in order, with their pages in order."""
    return numbered(documents_with_pages(spark, sf_dir), [F.col("c_custkey"), F.asc_nulls_first("o_orderkey")])


@query(
    "with pages as (select case when o_orderkey % 200 < 2 then o_orderkey // 2 * 2 else o_orderkey end page_id, case when o_orderkey % 50 = 7 then null else o_custkey end document_id, "
    "case when o_orderstatus = 'P' then null else cast(o_orderkey % 9 as integer) end page_number from orders) "
    "select p.page_id, document_id, page_number, array_to_string(list_filter([case when document_id is null then 'not null: document_id' end, case when page_number is null then 'not null: page_number' end, "
    "case when n > 1 then 'unique: page_id' end, case when document_id is not null and c_custkey is null then 'reference: document_id' end], lambda x: x is not null), ', ') broken "
    "from (select *, count(*) over (partition by page_id) n from pages) p left join (select c_custkey from customer where c_nationkey < 20) on c_custkey = document_id where broken <> ''"
)
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for pages, some of them with keys that occur twice or fields that are missing; customers of some nations for the documents that are there."""
    number = F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 9).cast("int"))
    key = F.when(F.col("o_orderkey") % 200 < 2, F.floor(F.col("o_orderkey") / 2) * 2).otherwise(F.col("o_orderkey"))
    pages = read(spark, sf_dir, "orders").select(key.alias("page_id"), F.when(F.col("o_orderkey") % 50 != 7, F.col("o_custkey")).alias("document_id"), number.alias("page_number"))
    documents = read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("document_id"))
    _, bad = constraints.quarantined(pages, "document_pages", {"documents": documents})
    return bad.withColumn("broken", F.array_join("broken", ", "))


@query(
    "select year(l_shipdate) \"year\", l_returnflag, l_linestatus, cast(grouping_id(year(l_shipdate), l_returnflag, l_linestatus) as bigint) \"level\", count(*) \"rows\", count(q) n, cast(sum(q) as bigint) total, min(q) least, max(q) greatest, "
    "cast(sum(q) as double) / count(q) mean from (select *, cast(l_quantity as bigint) q from lineitem) group by cube (year(l_shipdate), l_returnflag, l_linestatus)"
)
def statistics_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of lines by year, flag and status, and by all coarser groupings, merged from the finest ones' states."""
    by = ["year", "l_returnflag", "l_linestatus"]
    rows = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"), "l_suppkey")
    found = statistics.measures(statistics.merged(statistics.states(rows, by, "q", "l_suppkey"), by, "cube"), {})
    return found.drop("distinct").withColumn("total", F.col("total").cast("bigint"))


@query(
    "select cast(date_trunc('month', ts) as date) \"month\", event_type, cast(grouping_id(cast(date_trunc('month', ts) as date), event_type) as bigint) \"level\", count(*) \"rows\", count(v) n, cast(sum(v) as bigint) total, min(v) least, max(v) greatest, "
    "true distinct_close, true median_close from (select *, cast(floor(value) as bigint) v from events) group by rollup (cast(date_trunc('month', ts) as date), event_type)"
)
def statistics_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values by day, stored, and merged into months and all of them; the estimates are held against exact figures of the rows."""
    v = F.floor("value").cast("bigint").alias("v")
    events = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", v, "user_id")
    path, by, month = f"{shared_dir(spark)}/{uuid.uuid4().hex}", ["month", "event_type"], F.trunc("day", "month").alias("month")
    statistics.store_days(events, path, "day", ["event_type"], "v", "user_id")
    kept = statistics.stored(spark, path).select("*", month)
    found = statistics.measures(statistics.merged(kept, by, "rollup"), {"median": 0.5})
    exact = events.select(month, "event_type", "v", "user_id").rollup(*by).agg(F.grouping_id().alias("level"), F.count_distinct("user_id").alias("users"), F.percentile("v", F.lit(0.47)).alias("under"), F.percentile("v", F.lit(0.53)).alias("over"))
    same = (found["level"] == exact["level"]) & found["month"].eqNullSafe(exact["month"]) & found["event_type"].eqNullSafe(exact["event_type"])
    near = F.abs(found["distinct"] - exact["users"]) <= F.greatest(F.lit(1), exact["users"] * 0.065)
    middle = F.col("median").isNull() | F.col("median").between(F.floor("under"), F.ceil("over"))
    return found.join(exact, same).select(found["month"], found["event_type"], found["level"], "rows", "n", F.col("total").cast("bigint").alias("total"), "least", "greatest", near.alias("distinct_close"), middle.alias("median_close"))


@query(
    "with recursive parts as (select p_partkey k, p_partkey // 8 block, count(*) over (partition by p_partkey // 8) size from part), "
    "chain as (select k, block, size, k base, cast(1 as hugeint) num, cast(1 as hugeint) den from parts where k % 8 = 0 or k - 1 not in (select k from parts) "
    "union all select p.k, p.block, p.size, base, num * (2 + p.k % 3), den * (1 + p.k % 5) from chain c join parts p on p.k = c.k + 1 and p.block = c.block) "
    "select k p_partkey, base, case when not odd then cast(num // gcd(num, den) as bigint) end num, case when not odd then cast(den // gcd(num, den) as bigint) end den, odd contradicted "
    "from (select *, size = 8 and block % 5 = 0 odd from chain) where size > 1"
)
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for units: each is given in terms of the one before it in its block of eight, and in one block of five a last link closes a circle that doesn't fit, so that its factors are unknown."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"))
    chain = parts.where("unit % 8 <> 0").select("unit", (F.col("unit") - 1).alias("other"), (F.col("unit") % 3 + 2).alias("num"), (F.col("unit") % 5 + 1).alias("den"))
    closing = parts.where("unit % 8 = 7 and unit div 8 % 5 = 0").select("unit", (F.col("unit") - 7).alias("other"), F.lit(1).cast("bigint").alias("num"), F.lit(1009).cast("bigint").alias("den"))
    there = parts.select(F.col("unit").alias("other"))
    found = units.conversions(chain.unionAll(closing).join(there, "other", "left_semi").select("unit", "other", "num", "den"))
    sound = lambda c: F.when(~F.col("contradicted"), F.col(c)).cast("bigint").alias(c)
    return found.select(F.col("unit").alias("p_partkey"), "base", sound("num"), sound("den"), "contradicted")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(
    f"with sizes as (select doc_id, coalesce(len({WORDS}), 0) size from documents), corpus as (select count(*) n, sum(size) / cast(count(*) as double) mean from sizes), "
    f"tf as (select doc_id, term, count(*) f from (select doc_id, unnest({WORDS}) term from documents) group by 1, 2), df as (select term, count(*) d from tf group by 1), "
    f"asked as (select distinct item_id, term from (select item_id, unnest({WORDS}) term from benchmark)), "
    "scores as (select item_id, doc_id, cast(sum(cast(floor(1e6 * (ln(1e0 + (n - d + 5e-1) / (d + 5e-1)) * (f * 2.2e0 / (f + 1.2e0 * (2.5e-1 + 7.5e-1 * size / mean))))) as bigint)) as bigint) score "
    "from asked join df using (term) join tf using (term) join sizes using (doc_id), corpus group by 1, 2) "
    "select item_id, rank, \"found\", score from (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank, doc_id \"found\", score from scores) where rank <= 10"
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions to an index of all documents."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    search.index(read(spark, sf_dir, "documents"), "doc_id", "text", path, buckets=16)
    return search.search(spark, path, read(spark, sf_dir, "benchmark"), "item_id", "text", 10)
