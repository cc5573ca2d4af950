"""Conversation prefix trie with count-min screening.

A prefix is told by its depth and the exclusive or of 128-bit hashes of its turns, each salted with its place, so digests of a whole conversation are a
running sum and can be carried over the borders of a range-partitioned sort. Nothing gathers a conversation: only what each partition holds of it meets.

Every task counts the digests it reads in a count-min sketch of two rows of cells, up to two; sketches are merged block by block, and a bit a
cell says whether more than one prefix fell there. An estimate is never too small, so an estimate of one proves that no other conversation has the
prefix, nor any longer one: such tails become nodes where they stand. Only prefixes that may be shared are shuffled and
grouped exactly. The sketch has 8 cells a turn, 2 ** CELL_BITS at most (bits of 4 MB to broadcast); where a table has more, more prefixes are
grouped exactly and the rows are the same.

Subtrees need no walk. A conversation owns the nodes of its path from the first that no lesser conversation shares, so all nodes
are the owned tails, and a subtree's leaves, children and saved tokens are sums over the members of its top: for a member that
comes to own its path at depth o, the code points of its path from the top to depth o - 1 are saved. All of them are combined before the shuffle;
nodes with more than one in HOT of all shared rows (HOT at most) are looked up by broadcast, so the root and a first turn that everybody says don't make a large task.

``ends_sha256`` is a hash of text, so one task must read a node's ids in order; they reach it as texts packed by the
partitions of a range-partitioned sort, and are hashed as they come.

Defined results: rows with a null conv_id are left out; null role or text counts as empty; turns of one number come by role, then by hash; repeated rows are
turns of their own; conv_id % 100 has the sign of conv_id; other columns are ignored; no rows give no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, least_partitions, positioned, same, small_batches, written

GROUP, HEADS = 100, 6  # conversations with one opening; one more than the most turns that are taken of it
CELL_BITS, LEAST_BITS, BLOCK = 24, 12, 1 << 12
HOT = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """c, turn, role, a, b (hashes of the turn), n (code points of the text)."""
    small_batches(conversations.sparkSession)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("c", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"), F.char_length("text").cast("bigint").alias("n"))


def _salted(depth: Column, turn: Column | None = None) -> tuple[Column, Column]:
    """Hashes of a turn (the columns a and b, or fields of a struct) that stands at a depth."""
    a, b = (F.col("a"), F.col("b")) if turn is None else (turn["a"], turn["b"])
    return F.xxhash64(F.lit(3), depth, a, b), F.xxhash64(F.lit(4), depth, a, b)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation behind the opening of its group: c, size (turns) of each; and a row a turn: c, depth, p and q (the digest of the prefix), n, total (code points up to here), size."""
    placed = positioned(turns(conversations), ["c", "turn", "role", "a", "b"], "place", "part")
    chunks = placed.groupBy("c", "part").agg(F.min("place").alias("start"), F.count("*").alias("rows"))
    own = chunks.groupBy("c").agg(F.min("start").alias("first"), F.sum("rows").alias("own"), F.count("*").alias("chunks"))
    w = Window.partitionBy("c").orderBy("place")
    opening = placed.where(F.col("c") % GROUP == 0).withColumn("k", F.row_number().over(w)).where(F.col("k") < HEADS)
    opening = opening.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "n"))).alias("head"))  # fewer than HEADS

    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int")
    full = own.withColumn("base", F.col("c") - F.col("c") % GROUP).withColumn("h", h).join(opening, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    head = F.coalesce(head, F.array().cast("array<struct<k:int,a:bigint,b:bigint,n:bigint>>"))
    start = F.struct(F.lit(0).cast("bigint").alias("depth"), *(F.lit(0).cast("bigint").alias(x) for x in ("p", "q", "n", "total")))

    def longer(acc: Column, turn: Column) -> Column:
        depth = F.element_at(acc, -1)["depth"] + 1
        x, y = _salted(depth, turn)
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(depth.alias("depth"), last["p"].bitwiseXOR(x).alias("p"), last["q"].bitwiseXOR(y).alias("q"), turn["n"].alias("n"), (last["total"] + turn["n"]).alias("total"))))

    path = F.aggregate(head, F.array(start), longer)  # HEADS structs at most, the root first
    size = (F.size(head) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint")
    convs = written(full.select("c", "first", "h", "chunks", path.alias("path"), size.alias("size")))

    last = F.element_at("path", -1)
    told = convs.select("c", "first", "h", "chunks", "size", F.size("path").alias("next"), *(last[x].alias(f"{x}0") for x in ("p", "q", "total")))
    info = chunks.select("c", "part").join(told, "c")
    mine = placed.join(info, ["c", "part"]).where(F.col("place") - F.col("first") >= F.col("h"))
    mine = mine.withColumn("depth", F.col("place") - F.col("first") - F.col("h") + F.col("next"))
    x, y = _salted(F.col("depth"))
    so_far = Window.partitionBy("c", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = mine.select("c", "part", "place", "chunks", "depth", "n", "size", "p0", "q0", "total0", x.alias("x"), y.alias("y"))
    local = written(local.withColumns({"p": F.bit_xor("x").over(so_far), "q": F.bit_xor("y").over(so_far), "total": F.sum("n").over(so_far)}))
    # what the earlier chunks of a conversation that crosses borders add: one row a chunk that isn't the first, so a row a border at most
    totals = local.where("chunks > 1").groupBy("c", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("c", "part", F.bit_xor("x").over(before).alias("xc"), F.bit_xor("y").over(before).alias("yc"), F.sum("n").over(before).alias("nc"))
    carried = local.join(F.broadcast(carry), ["c", "part"], "left")
    zero = F.lit(0).cast("bigint")
    add = lambda name, base, more: F.col(name).bitwiseXOR(F.col(base)).bitwiseXOR(F.coalesce(more, zero)).alias(name)
    tails = carried.select("c", "depth", add("p", "p0", "xc"), add("q", "q0", "yc"), "n", (F.col("total") + F.col("total0") + F.coalesce("nc", zero)).alias("total"), "size")
    heads = convs.select("c", F.explode("path").alias("x"), "size").select("c", "x.*", "size")
    return convs.select("c", "size"), tails.unionByName(heads)


def _cells(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(x).to_numpy() & ((1 << bits) - 1) for x in ("p", "q"))


def shared_cells(prefixes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each cell of both rows of the sketch: whether more than one prefix fell there."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, 1 << bits), np.uint8)
        for batch in batches:
            for row, cells in zip(sketch, _cells(batch, bits)):
                at, n = np.unique(cells, return_counts=True)
                row[at] = np.minimum(row[at] + np.minimum(n, 2), 2)
        flat = sketch.reshape(-1, BLOCK)
        used = np.nonzero(flat.any(1))[0]
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([flat[b].tobytes() for b in some], pa.binary())], ["block", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come sorted; one is held at a time."""
        at, held = None, np.zeros(BLOCK, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], ["block", "cells"])
        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                if block != at:
                    if at is not None:
                        yield done()
                    at, held = block, np.zeros(BLOCK, np.uint8)
                held = np.minimum(held + np.frombuffer(cells, np.uint8), 2)
        if at is not None:
            yield done()

    schema, n = "block long, cells binary", least_partitions(prefixes.sparkSession)
    sketches = prefixes.select("p", "q").mapInArrow(counted, schema)
    out = np.zeros((2 << bits) // 8, np.uint8)
    for r in sketches.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merged, schema).toLocalIterator():  # 2 << bits bits at most
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["cells"], np.uint8)
    return out[: (1 << bits) // 8], out[(1 << bits) // 8 :]


def screened(prefixes: DataFrame, bits: int) -> DataFrame:
    """prefixes with alone (no other conversation has this one) and top (the first of a tail as it was read)."""
    shared = prefixes.sparkSession.sparkContext.broadcast(shared_cells(prefixes.where("depth > 0"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, 0, False)  # conversation, depth and tail of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            c, depth = batch.column("c").to_numpy(), batch.column("depth").to_numpy()
            many = [(bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 for bitmap, cell in zip(shared.value, _cells(batch, bits))]
            one = (depth > 0) & ((many[0] & many[1]) == 0)
            at = np.arange(len(c))
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (depth[1:] <= depth[:-1])
            new[0] = not (held[0] == c[0] and held[1] < depth[0])
            start = np.maximum.accumulate(np.where(new, at, -1))  # -1: a run that began in the batch before
            last = np.maximum.accumulate(np.where(one, at, -2))
            alone = (last >= np.maximum(start, 0)) | ((start < 0) & held[2])
            before = np.concatenate([[held[2]], alone[:-1]]) & ~new
            held = (c[-1], depth[-1], bool(alone[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(alone & ~before)], [*batch.schema.names, "alone", "top"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(run, f"{kinds}, alone boolean, top boolean")


def hashed(ends: DataFrame) -> DataFrame:
    """depth, p, q, ends_sha256 of the ids c that end there, in order."""
    key, n = ["depth", "p", "q"], least_partitions(ends.sparkSession)
    names = [*key, "least", "ids"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(x).to_numpy() for x in key]
            new = np.any([x[1:] != x[:-1] for x in columns], axis=0)
            starts = np.concatenate([[0], np.nonzero(new)[0] + 1, [batch.num_rows]]).astype(int)
            ids = [str(i) for i in batch.column("c").to_pylist()]
            made = [",".join(ids[a:b]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[starts[:-1]]) for x in columns), batch.column("c").take(pa.array(starts[:-1])), pa.array(made)], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(key, at)) | {"ends_sha256": state.hexdigest()}], schema=pa.schema([*((x, pa.int64()) for x in key), ("ends_sha256", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                if at == (own := tuple(row[x] for x in key)):
                    state.update(b",")
                else:
                    if at is not None:
                        yield done()
                    at, state = own, hashlib.sha256()
                state.update(row["ids"].encode())
        if at is not None:
            yield done()

    kinds = "depth long, p long, q long"
    packed = ends.repartitionByRange(n, *key, "c").sortWithinPartitions(*key, "c").mapInArrow(texts, f"{kinds}, least long, ids string")
    return packed.repartition(n, *key).sortWithinPartitions(*key, "least").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, prefixes = rebuilt(conversations)
    prefixes = written(prefixes)  # read twice
    bits = min(CELL_BITS, max(LEAST_BITS, int(8 * prefixes.count()).bit_length()))
    rows = written(screened(prefixes, bits))
    key = ["depth", "p", "q"]
    maybe = rows.where("not alone").drop("alone", "top")  # the root of each conversation is among them
    ended = F.count_if(F.col("depth") == F.col("size"))
    groups = cut(maybe.groupBy(*key).agg(F.min("c").alias("owner"), F.count("*").alias("many"), ended.alias("ends")).where("many > 1"))
    hot = groups.where(F.col("many") * HOT > (maybe.count()))  # fewer than HOT
    often = maybe.join(F.broadcast(hot), key)
    rest = maybe.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.join(F.broadcast(hot.select(*key)), key, "left_anti"), key, "left")
    known = written(often.unionByName(rest))

    # where a conversation comes to own its path: below the deepest node that a lesser one shares
    above = F.max(F.when(F.col("owner") != F.col("c"), F.struct("depth", "owner", "total")))
    last = F.max(F.when((F.col("depth") == F.col("size")) & F.col("owner").isNotNull(), ((F.col("owner") == F.col("c")) & (F.col("many") == F.col("ends"))).cast("int")))
    owned = known.groupBy("c").agg(above.alias("x"), last.alias("last"))
    owned = written(owned.select("c", F.coalesce(F.col("x.depth") + 1, F.lit(0)).alias("from"), F.col("x.owner").alias("over"), F.coalesce("x.total", F.lit(0)).alias("kept"), F.coalesce("last", F.lit(1)).alias("leaf")))
    parent = F.when(F.col("from") == F.col("depth"), F.col("over")).otherwise(F.col("c"))

    members = known.where("owner is not null").join(owned, "c")
    later = F.col("from") > F.col("depth")
    shared = members.groupBy(*key).agg(
        F.min("c").alias("conv_id"),
        F.max(F.when(~later, parent)).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if((F.col("from") <= F.col("depth") + 1) & (F.col("size") > F.col("depth"))).alias("n_children"),
        F.sum("leaf").cast("bigint").alias("n_leaves"),
        F.sum(F.when(later, F.col("kept") - F.col("total") + F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("saved_tokens"),
    )
    ends = hashed(known.where((F.col("depth") == F.col("size")) & F.col("owner").isNotNull()).select(*key, "c"))
    shared = shared.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))

    one = F.lit(1).cast("bigint")
    more = (F.col("size") > F.col("depth")).cast("bigint")
    mine = F.when(F.col("depth") == F.col("size"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))
    single = [F.col("c").alias("conv_id"), "depth", "parent_conv_id", one.alias("n_convs"), more.alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), mine.alias("ends_sha256")]
    lone = known.where("owner is null").select("c", "depth", "size").unionByName(rows.where("top").select("c", "depth", "size"))
    lone = lone.join(owned, "c").withColumn("parent_conv_id", parent)
    tails = rows.where("alone and not top").withColumn("parent_conv_id", F.col("c"))  # the row above is the same conversation's
    out = shared.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return out.unionByName(lone.select(*single)).unionByName(tails.select(*single))
