"""N-gram Jaccard join: sets of word shingles that overlap by 0.8 or more, as connected components.

A document's point is the vector of its shingles' counts in hash groups. Two sets can share
at most the sum of the coordinates' minima; boxes of points give the same bound for all pairs between
them, so they serve as the leaves of an R-tree. Boxes have GROUPS coordinates. Pairs are compared in as many as give PER_GROUP shingles a
group, a power of two, so that long texts are told apart as well as short ones; of two numbers of groups the smaller is taken, as neighbours add up. Over the whole corpus such a tree prunes nothing (all
texts of a length lie near one another), so the space is first divided by an exact equi-join:
sets with Jaccard 0.8 share at least one of their n - ceil(0.8 n) + 1 shingles that come first in
any fixed order. The order puts rare hash buckets first, counted over all documents.

1. Count shingles per bucket (ORDER_BUCKETS counts whatever the corpus' size).
2. Write doc_id, set key, size, point and first shingles of each document. Equal sets share a key from here on.
3. Within a shared shingle, pair each set with the one that meets most sets anywhere; verify each set's best such
   partner; components of these links. A group of near copies costs one pair a member.
4. Where a shingle still joins different components, bound pairs of points by their minima. Shingles of more than SMALL sets are merged into
   buckets with much the same sets, so that a pair meets about once; a bucket's points are packed into an R-tree by size and place, whose boxes are met
   level by level before points are, first in few coordinates, then in many. Verify what survives. Links inside a component can't change it, so no pairs within groups are made.

A shingle bucket with over HOT documents is salted in step 3, with a second level over the salts' own centers.

Defined results: null or empty texts have the empty set, n_shingles 0, and are linked with nothing; texts of one
to four words are one shingle; rows with a null doc_id get a null component and link nothing;
repeated rows are repeated in the result; extra columns are left out. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, forget, least_partitions, positioned, texts, written
from quillspark.llm.components import components

WORDS = 5
GROUPS = 32  # of the points in boxes
PER_GROUP = 2  # shingles in a group of the points that are compared in pairs, about
ORDER_BITS = 20
ORDER_BUCKETS, ORDER_PARTS = 1 << ORDER_BITS, 64
LEAF, FAN, SMALL = 128, 32, 16
BAND = 1.05  # sizes of points that are sorted by their coordinates alone
HOT = 200_000  # rows of a shingle, three numbers each, that one task sorts at most
BROADCAST_ROWS = 200_000  # of a few numbers; some 20 MB at most


class _Codes(dict):
    """64-bit hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


CHUNK = 1 << 17  # words hashed at once


def shingled(texts_: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles."""
    out, held, size, get = [], [], 0, _codes.__getitem__
    for x in texts_:
        words = (x or "").encode().lower().split()
        held.append(np.fromiter(map(get, words), np.uint64, len(words)))
        size += len(words)
        if size >= CHUNK:
            out += _sorted_shingles(held)
            held, size = [], 0
    return out + _sorted_shingles(held)


def _sorted_shingles(held: list[np.ndarray]) -> list[np.ndarray]:
    codes = np.concatenate([np.zeros(0, np.uint64), *held])
    mixed = _mixed(codes, max(0, len(codes) - WORDS + 1), WORDS)
    out, a = [], 0
    for own in held:
        n = len(own)
        s = np.sort(mixed[a : a + n - WORDS + 1] if n >= WORDS else _mixed(own, min(1, n), n))
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        a += n
    return out


def _mixed(codes: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of the first n runs of size codes."""
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out ^= codes[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)


def _bucket_counts(docs: DataFrame) -> np.ndarray:
    """Documents' shingles in each order bucket. A task sends one vector in ORDER_PARTS parts; ORDER_BUCKETS sums, 8 MB, come to the driver."""
    schema = "part int, task int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            sets = shingled(batch.column("text").to_pylist())
            for k in range(0, len(sets), 500):
                counts += np.bincount(_buckets(np.concatenate(sets[k : k + 500])), minlength=ORDER_BUCKETS)
        _codes.clear()
        task = pa.array([TaskContext.get().partitionId()] * ORDER_PARTS, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(ORDER_PARTS), pa.int32()), task, pa.array([x.tobytes() for x in counts.reshape(ORDER_PARTS, -1)], pa.binary())], ["part", "task", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    sums = docs.select("text").mapInArrow(run, schema)
    for fan in (1 << 8, 1 << 16, 1 << 32):  # 256 vectors are added at once
        sums = sums.groupBy("part", F.floor(F.col("task") / fan).alias("of")).applyInArrow(added, schema)
    found = sums.select("part", "counts").collect()
    counts = np.zeros((ORDER_PARTS, ORDER_BUCKETS // ORDER_PARTS), np.int64)
    for r in found:
        counts[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return counts.ravel()


Keep = Callable[[DataFrame], DataFrame]
TOKEN = T.StructType([T.StructField("token", T.LongType()), T.StructField("salt", T.IntegerType())])


def _key(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def _fine(s: np.ndarray) -> np.ndarray:
    """Counts in a power of two of hash groups, GROUPS at least."""
    bits = max(GROUPS, len(s) // PER_GROUP).bit_length() - 1
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _least_minima(a: bytes, b: bytes) -> int:
    """The sum of two fine points' minima. A count of 255 may stand for more, so it bounds nothing."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if y.max() == 255 or x.max() == 255:
        return 1 << 60
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _base(docs: DataFrame, counts: np.ndarray, hot: int) -> DataFrame:
    """doc_id, key, n and point of its set, and ``first``: the shingles of which it shares one with any partner (seldom more than once for a key in a task)."""
    ranks = np.empty(ORDER_BUCKETS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(ORDER_BUCKETS, dtype=np.uint32)
    order_of = docs.sparkSession.sparkContext.broadcast((ranks, np.maximum(1, -(-counts // hot)).astype(np.int32)))  # 8 MB
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_key"], T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("point", T.ArrayType(T.IntegerType())), T.StructField("fine", T.BinaryType()), T.StructField("first", T.ArrayType(TOKEN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        rank, salts = order_of.value
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, points, fine, tokens, salted = [], [], [], [], [], []
            if len(seen) > 100_000:
                seen.clear()
            for s, known in zip(shingled(batch.column("text").to_pylist()), batch.column("doc_id").is_valid().to_pylist()):
                keys.append(key := _key(s))
                counts = _fine(s)
                points.append(counts.reshape(GROUPS, -1).sum(1))
                fine.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                sizes.append(len(s))
                first = none
                if known and key not in seen:  # rows without an id link nothing
                    seen.add(key)
                    bucket = _buckets(s)
                    order = np.argsort((rank[bucket].astype(np.uint64) << np.uint64(64 - ORDER_BITS)) | (s >> np.uint64(ORDER_BITS)), kind="stable")
                    first = s[order[: len(s) - (4 * len(s) + 4) // 5 + 1]] if len(s) else none
                tokens.append(first)
                parts = salts[_buckets(first)]
                salted.append(np.where(parts > 1, 1 + key % parts.astype(np.int64), 0))
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = np.concatenate([none, *tokens]).view(np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat), pa.array(np.concatenate([np.zeros(0, np.int64), *salted]).astype(np.int32))], ["token", "salt"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.list_(pa.int32())), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pairs)], schema.names)
        _codes.clear()

    return docs.mapInArrow(run, schema)


def _points(base: DataFrame, shared: DataFrame) -> DataFrame:
    """key, doc_id of one document, n, point and fine point of each set that shares a first shingle with another."""
    one = base.where("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine"))
    return one.join(shared.select("key").distinct(), "key")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n and shingles of the wanted documents (doc_id, key)."""
    rows = docs.select("doc_id", "text").join(_small(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a doc_id may stand for several texts
            found = [(key, s) for key, s in zip(batch.column("key").to_pylist(), shingled(batch.column("text").to_pylist())) if _key(s) == key]
            keys, sets = [k for k, _ in found], [s.view(np.int64) for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "shingles"])
        _codes.clear()

    return rows.mapInArrow(run, "key long, n long, shingles array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, points: DataFrame, repeated: bool, held: Keep) -> DataFrame:
    """The pairs a, b whose sets link."""
    pairs = held(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    stored = written(_sets(docs, cut(points.join(keys, "key").select("doc_id", "key"))))
    sets = stored.dropDuplicates(["key"]) if repeated else stored
    side = lambda c: sets.select(*(F.col(x).alias(f"{c}_{x}") for x in ("key", "n", "shingles")))
    both = pairs.join(side("a"), F.col("a") == F.col("a_key")).join(side("b"), F.col("b") == F.col("b_key"))
    links = held(both.where(9 * F.size(F.array_intersect("a_shingles", "b_shingles")) >= 4 * (F.col("a_n") + F.col("b_n"))).select("a", "b"))
    forget(stored)
    return links


def _first_partners(shared: DataFrame, points: DataFrame) -> DataFrame:
    """For each key the pair that may link with the center of a bucket that it meets most often; salted buckets have a second level."""
    heads = shared.where("salt > 0").select("token", F.col("center").alias("key")).distinct()
    heads = heads.join(heads.groupBy("token").agg(F.min("key").alias("center")), "token")
    pairs = shared.select("key", "center").unionAll(heads.select("key", "center")).where("key <> center").groupBy(F.col("center").alias("a"), F.col("key").alias("b")).count()
    best = _close(pairs, points).groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    return best.select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS (narrow) rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _near(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """Whether sizes in these ranges can be within Jaccard 0.8."""
    return (5 * F.col(a_high) >= 4 * F.col(b_low)) & (5 * F.col(b_high) >= 4 * F.col(a_low))


def _across(shared: DataFrame, labels: DataFrame, points: DataFrame, held: Keep) -> DataFrame:
    """Pairs of different components that share a first shingle and may link by their points.

    Shingles with more than SMALL sets are merged into one bucket where their sets have the same member with the least hash: near copies share
    dozens of first shingles, all with much the same sets, and shall meet once or twice, not dozens of times.
    """
    known = cut(points.select("key", "n").join(labels, points.key == labels.node, "left").select("key", "n", F.coalesce("component", "key").alias("component")))
    placed = held(shared.select("token", "key").join(_small(known), "key"))
    buckets = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"), F.min(F.xxhash64("key")).alias("bucket"))
    mixed = held(placed.join(_small(buckets.where("least <> most").select("token", "size", "bucket")), "token"))
    side = lambda df, c, names: df.select("token", *(F.col(x).alias(f"{c}_{x}") for x in names))
    # shingles of SMALL sets or less: every pair of points
    few, names = mixed.where(F.col("size") <= SMALL), ("key", "n", "component")
    met = side(few, "a", names).join(side(few, "b", names), "token").where((F.col("a_component") < F.col("b_component")) & _near("a_n", "a_n", "b_n", "b_n"))
    pair = met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()
    large = _tree_met(mixed.where(F.col("size") > SMALL).select("bucket", *names).distinct(), points, held)
    return _close(pair, points).select("a", "b").unionAll(large).distinct()


def _box(point: str) -> Column:
    """The greatest of each coordinate."""
    return F.array(*(F.max(F.get(F.col(point), F.lit(g))) for g in range(GROUPS)))


def _boxes_met(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of nodes (a_id, b_id, with their buckets) that may hold a pair of points that may link: of others with others, once, and with those of the commonest component."""
    columns = ("bucket", "other", "id", "low", "high", "box", *[c for c in by if c != "bucket"])
    one, two = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in columns)) for s, df in (("a", a.where("other")), ("b", b)))
    minima = sum((F.least(F.get("a_box", F.lit(g)), F.get("b_box", F.lit(g))) for g in range(GROUPS)), F.lit(0))
    once = ~F.col("b_other") | (F.col("a_id") <= F.col("b_id"))
    return one.join(two, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]).where(once & _near("a_low", "a_high", "b_low", "b_high") & (9 * minima >= 4 * (F.col("a_low") + F.col("b_low"))))


def _tree_met(members: DataFrame, points: DataFrame, held: Keep = written) -> DataFrame:
    """Pairs a, b of different components whose points may link, of large buckets (bucket, key, n, component).

    A packed R-tree: within a bucket the members of its commonest component and all others are sorted by size and coordinates; LEAF neighbours
    make a leaf, and leaves of FAN times as many points a node. Nodes of others meet one another and those of the commonest
    component by their boxes, which don't meet among themselves; then the leaves of nodes that may hold a pair do; then the points of leaves that may.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
    common = counts.groupBy("bucket").agg(F.max_by("component", F.struct("rows", -F.col("component"))).alias("common"))
    sized = members.join(_small(common), "bucket").select("bucket", (F.col("component") != F.col("common")).alias("other"), F.floor(F.log(F.col("n")) / math.log(BAND)).alias("band"), "key", "n", "component")
    placed = positioned(sized.join(points.select("key", "point", "fine"), "key"), ["bucket", "other", "band", "point", "key"], "place", keep=held)
    place = lambda n: F.floor(F.col("place") / n)
    rows = F.collect_list(F.struct("key", "n", "component", "point", "fine")).alias("rows")
    leaves = held(placed.groupBy("bucket", "other", place(LEAF * FAN).alias("node"), place(LEAF).alias("leaf")).agg(F.min("place").alias("id"), F.min("n").alias("low"), F.max("n").alias("high"), _box("point").alias("box"), rows))
    nodes = cut(leaves.groupBy("bucket", "other", "node").agg(F.min("id").alias("id"), F.min("low").alias("low"), F.max("high").alias("high"), _box("box").alias("box")))
    near = _boxes_met(nodes, nodes, ["bucket"]).select("a_bucket", "a_id", "b_id")
    of_node = F.min("id").over(Window.partitionBy("bucket", "other", "node"))
    index = cut(leaves.select("bucket", "other", "id", "low", "high", "box", of_node.alias("of")))  # FAN rows a window
    sides = [index.withColumnRenamed("of", "via").join(near.select(F.col("a_bucket").alias("bucket"), F.col(f"{c}_id").alias("via"), F.struct("a_id", "b_id").alias("pair")), ["bucket", "via"]) for c in ("a", "b")]
    leaf_pairs = cut(_boxes_met(sides[0], sides[1], ["bucket", "pair"]).select("a_id", "b_id").distinct())
    whole = lambda c: leaves.select(F.col("id").alias(f"{c}_id"), F.col("rows").alias(f"{c}_rows"))
    met = leaf_pairs.join(whole("a"), "a_id").join(whole("b"), "b_id").repartition(least_partitions(members.sparkSession), "a_id", "b_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _Rows(batch.column("a_rows")), _Rows(batch.column("b_rows"))
            same = [x == y for x, y in zip(batch.column("a_id").to_pylist(), batch.column("b_id").to_pylist())]
            found = [np.zeros((2, 0), np.int64), *(_points_met(one.of(k), two.of(k), same[k]) for k in range(len(same)))]
            a, b = np.concatenate(found, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


class _Rows:
    """The points of leaves: one leaf a row."""

    def __init__(self, column: pa.ListArray):
        values = column.flatten()
        self.ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        self.keys, self.n, self.component = (values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "component"))
        self.point = values.field("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS)
        self.fine = values.field("fine")

    def of(self, k: int) -> tuple:
        at = slice(self.ends[k], self.ends[k + 1])
        return self.keys[at], self.n[at], self.component[at], self.point[at], self.fine[at]


def _points_met(a: tuple, b: tuple, same: bool) -> np.ndarray:
    """The keys of pairs of points that may link; same: both are one leaf."""
    (a_key, a_n, a_component, a_point, a_fine), (b_key, b_n, b_component, b_point, b_fine) = a, b
    x = np.flatnonzero(9 * np.minimum(a_point, b_point.max(0)).sum(1) >= 4 * (a_n + b_n.min()))
    y = np.flatnonzero(9 * np.minimum(b_point, a_point.max(0)).sum(1) >= 4 * (b_n + a_n.min()))
    n, m = a_n[x][:, None], b_n[y][None]
    may = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (a_component[x][:, None] != b_component[y][None])
    if same:
        may &= x[:, None] < y[None]
    i, j = np.nonzero(may)
    i, j = x[i], y[j]
    near = 9 * np.minimum(a_point[i], b_point[j]).sum(1) >= 4 * (a_n[i] + b_n[j])
    i, j = i[near], j[near]
    fine_a, fine_b = {k: a_fine[k].as_py() for k in set(i.tolist())}, {k: b_fine[k].as_py() for k in set(j.tolist())}
    keep = np.array([9 * _least_minima(fine_a[k], fine_b[m]) >= 4 * (a_n[k] + b_n[m]) for k, m in zip(i.tolist(), j.tolist())], bool)
    return np.stack([a_key[i[keep]], b_key[j[keep]]])


def _close(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs a, b (and what else is given of them) whose fine points may link."""
    side = lambda c: points.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("fine").alias(f"{c}_fine"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(_near("a_n", "a_n", "b_n", "b_n"))
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_fine", "b_fine")))
            keep = pa.array([9 * _least_minima(x, y) >= 4 * (n + m) for n, m, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns], columns).filter(keep)

    return met.mapInArrow(run, pairs.schema)


def _result(base: DataFrame, labels: DataFrame) -> DataFrame:
    first = base.where("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = first.join(labels, first.key == labels.node, "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = placed.join(ids, "component").select("key", "component_id")
    own = base.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "key", "n")
    return own.join(by_key, "key", "left").select("doc_id", "text_key", "n_shingles", F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def linked(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_key (a hash of its text), n_shingles and component_id of every row of docs (doc_id, text)."""
    docs = texts(docs).withColumn("text_key", F.xxhash64("text"))
    base = written(_base(docs, _bucket_counts(docs), hot))
    tokens = base.where("doc_id is not null").select("key", F.explode("first").alias("t")).select("key", "t.token", "t.salt")
    bucket = Window.partitionBy("token", "salt")
    met = tokens.select("*", F.min("key").over(bucket).alias("low"), F.max("key").over(bucket).alias("high"), F.count("*").over(bucket).alias("size"))
    scratch: list[DataFrame] = []

    def held(df: DataFrame) -> DataFrame:
        scratch.append(written(df))
        return scratch[-1]

    met = held(met.where("low <> high or salt > 0").select("token", "salt", "key", "size"))
    # the set that meets most others is the likeliest original of its copies
    degrees = cut(met.groupBy("key").agg(F.sum("size").alias("degree")))
    known = met.join(_small(degrees), "key").select("token", "salt", "key", "degree")
    centers = known.groupBy("token", "salt").agg(F.max(F.struct("degree", "key"))["key"].alias("center"))
    shared = held(known.drop("degree").join(centers, ["token", "salt"]))
    points = held(_points(base, shared))
    repeated = base.groupBy("doc_id", "key").count().where("count > 1").limit(1).count() > 0
    links = _verified(docs, _first_partners(shared, points), points, repeated, held)
    more = _across(shared, components(links), points, held).join(links, ["a", "b"], "left_anti")
    labels = components(links.unionAll(_verified(docs, more, points, repeated, held)))
    for table in scratch:  # labels are checkpointed
        forget(table)
    return _result(base, labels)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that stay: of each component the one with the least doc_id, and all that link to nothing.

    Rows with a null doc_id stay. Of rows that share the least doc_id the one with the least text_key stays, once.
    """
    found = written(linked(docs)).where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select("doc_id", "text_key")
    again = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("text_key").alias("stays")).where("rows > 1")
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))

    kept = keyed.join(_small(gone.select("doc_id", F.col("text_key").alias("_text_key"))), ["doc_id", "_text_key"], "left_anti")
    if again.limit(1).count():
        more = _small(again.select("doc_id"))
        one = kept.join(more, "doc_id", "left_semi").join(_small(again.select("doc_id", F.col("stays").alias("_text_key"))), ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(more, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)
