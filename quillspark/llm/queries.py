"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import backoff_lm, byte_bpe, hard_negatives, jaccard_join, link_graph, matroska, multi_index, page_diff, prefix_trie, quality_gam, quotation, secret_scan, string_tiling
from quillspark.llm.common import read, texts


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(texts(read(spark, sf_dir, "documents")))


def op2_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extracted(read(spark, sf_dir, "pages"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(read(spark, sf_dir, "documents"))
    model = quality_gam.learnt(docs, read(spark, sf_dir, "labels"))
    scores = quality_gam.scored(docs, model, ["doc_id"])
    return scores.select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.threads(read(spark, sf_dir, "conversations"))


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scored(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(read(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(texts(read(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(read(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(read(spark, sf_dir, "embeddings"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.searched(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_page_diff": op2_page_diff,
    "op3_quality_gam": op3_quality_gam,
    "op4_quotation": op4_quotation,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_string_tiling": op7_string_tiling,
    "op8_link_graph": op8_link_graph,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_multi_index": op13_multi_index,
}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB. Equal sets are merged first; pairs share a shingle; components are least keys reached.
ORACLE_SQL["op6_jaccard_join"] = r"""
with recursive words as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) end as s
  from words),
classes as (select s, min(r) as k, len(s) as n, min(doc_id) as least from sets where len(s) > 0 and doc_id is not null group by s),
grams as (select k, n, unnest(s) as g from classes),
links as (
  select a.k as a, b.k as b from grams a join grams b on a.g = b.g and a.k < b.k
  group by a.k, b.k, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select a, b from links union all select b, a from links),
reach as (select k, k as m from classes union select edges.b, reach.m from reach join edges on reach.k = edges.a),
component as (select reach.k, min(c.least) as component_id from reach join classes c on c.k = reach.m group by reach.k)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(component.component_id, sets.doc_id) as component_id
from sets left join classes on sets.s = classes.s and sets.doc_id is not null left join component on component.k = classes.k
"""

#: DuckDB. Every anchor against every row.
ORACLE_SQL["op12_hard_negatives"] = """
with vecs as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r, a.vec_id as anchor_id, b.r as o, b.vec_id as other_id, a.label = b.label as alike,
    cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
  from vecs a join vecs b on a.r <> b.r where a.vec_id % 50 = 0),
positives as (select * from scores where alike qualify row_number() over (partition by r order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id,
  cast(row_number() over (partition by p.r, p.o order by n.score desc, n.other_id) as integer) as rank,
  n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on p.r = n.r and not n.alike and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by p.r, p.o order by n.score desc, n.other_id) <= 3
"""

#: DuckDB. Prefixes are lists of turns; a node's descendants are the nodes that its members pass. crc32 goes bit by bit.
ORACLE_SQL["op11_prefix_trie"] = """
with recursive own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t
  from conversations where conv_id is not null),
steps as (select unnest(range(256)) as byte),
crc(byte, step, v) as (
  select byte, 0, cast(byte as bigint) from steps
  union all select byte, step + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from crc where step < 8),
crc_table as (select list(v order by byte) as x from crc where step = 8),
ids as (select distinct c, cast(c as varchar) as s from own),
sums(c, s, k, v) as (
  select c, s, 0, 4294967295 from ids
  union all select c, s, k + 1, xor(v // 256, x[1 + xor(v % 256, ascii(s[k + 1]))]) from sums, crc_table where k < len(s)),
convs as (select c, xor(v, 4294967295) % 6 as h from sums where k = len(s)),
paths as (
  select c, list_concat(
    coalesce((select list(t order by k) from own o where o.c = convs.c - convs.c % 100 and o.k <= convs.h), []),
    coalesce((select list(t order by k) from own o where o.c = convs.c and o.k > convs.h), [])) as p
  from convs),
passes as (select c, p[1:d] as p, d, len(p) as size from paths, (select unnest(range(1000)) as d) where d <= len(p)),
nodes as (
  select p, d as depth, min(c) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = size), '') as ends,
    case when d = 0 then 0 else (count(*) - 1) * length(p[d].text) end as saved
  from passes group by p, d),
up as (select n.p as p, m.p as top from nodes m join nodes n on n.depth >= m.depth and n.p[1:m.depth] = m.p),
kids as (select p[1:depth - 1] as p, count(*) as n from nodes where depth > 0 group by 1),
sub as (select top, sum(n.saved) as saved, count(*) filter (kids.n is null) as leaves from up join nodes n on n.p = up.p left join kids on kids.p = n.p group by top)
select n.conv_id, cast(n.depth as bigint) as depth, m.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children,
  cast(sub.leaves as bigint) as n_leaves, cast(sub.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n left join nodes m on m.depth = n.depth - 1 and m.p = n.p[1:n.depth - 1]
left join kids on kids.p = n.p join sub on sub.top = n.p
"""
