"""Hard-negative mining by angular triangle filtering.

Components are whole numbers, so scores are whole numbers. Every row stores its norm and its angles to a few reference directions.
By the triangle inequality the angle between two rows lies between the largest difference and the least sum of their angles to a
reference; cosines of that interval times both norms, widened by more than rounding can lose, bound the score.
Only pairs whose bounds overlap what is wanted get their integer score.

Rows are sorted by nearest reference and angle and packed into blocks of ROW_BLOCK; anchors are packed
by the ANCHOR_SPAN sorted rows in which they stand. A block of anchors first meets the rows of its own span, which gives each anchor a
floor: its positives so far. Then it meets the other blocks, but for those whose widest bounds stay under its floors. The windows of
negatives follow from the positives, and again only blocks whose bounds overlap one are met. What a pair of blocks leaves is
a few rows an anchor, of which the first ones are kept before and after the shuffle. No block depends on how often a
label or a vector occurs.

Defined results: rows with a null vec_id, label or vector, or with a component that is null or not finite (also once
multiplied), take no part; vectors of unlike length are compared as if the shorter ended in zeros, so empty and zero ones score 0;
repeated rows are rows of their own, each other's positives, and anchors each; a score beyond a long counts as the nearest long; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, positioned, written
from quillspark.llm.vectors import best, dimensions, matrix, packed, ranks, rows_of, usable

SCALE = 256
REFERENCES = 8
ROW_BLOCK, ANCHOR_SPAN, CHUNK = 2048, 25_600, 512
POSITIVES, NEGATIVES = 5, 3
#: More than an angle or a product of norms can be wrong by.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
EXACT = 2.0**53  # products of norms under this have exact integer scores in doubles
LONG = (1 << 63) - 1
STORED = "place long, id long, label long, near int, angle double, norm double, angles binary, ints binary"
HITS = "place long, anchor_id long, slot int, other_id long, score long"


def stored(embeddings: DataFrame) -> tuple[DataFrame, int, int]:
    """Sorted and stored rows with at, their place by nearest reference and angle; dimensions; references."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings.where("label is not null").withColumn("label", F.col("label").cast("bigint")), keep=("label",)).withColumn("label", label)
    dims = dimensions(rows)
    some = rows.where(F.exists("vector", lambda v: F.floor(v * SCALE) != 0)).orderBy(F.xxhash64("id"), "place").limit(REFERENCES).select("vector").toArrow()
    refs = _ints(matrix(some.column("vector").combine_chunks(), dims)) if some.num_rows else np.zeros((0, dims))
    refs = refs[np.isfinite(refs).all(1)]
    size = np.abs(refs).max(axis=1, keepdims=True, initial=1)
    refs = refs / size
    refs /= np.linalg.norm(refs, axis=1, keepdims=True)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _ints(matrix(batch.column("vector"), dims))
            norm = _norm(ints)
            unit = ints / np.where(norm > 0, norm, 1)[:, None]
            at = np.arccos(np.clip(unit @ refs.T, -1, 1))
            near = at.argmin(1) if len(refs) else np.zeros(len(at), np.int64)
            angle = at[np.arange(len(at)), near] if len(refs) else np.zeros(len(at))
            out = pa.RecordBatch.from_arrays([batch.column("place"), batch.column("id"), batch.column("label"), pa.array(near, pa.int32()), pa.array(angle), pa.array(norm), rows_of(at), rows_of(ints)], [x.split()[0] for x in STORED.split(", ")])
            yield out.filter(pa.array(np.isfinite(ints).all(1)))

    return positioned(rows.mapInArrow(angles, STORED), ["near", "angle", "place"], "at"), dims, len(refs)


def _ints(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * vectors)


def _norm(ints: np.ndarray) -> np.ndarray:
    """Norms, without squares that overflow."""
    most = np.abs(ints).max(axis=1, initial=0)
    return most * np.linalg.norm(ints / np.where(most > 0, most, 1)[:, None], axis=1)


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, dims: int, refs: int, prefix: str = ""):
        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.place, self.id, self.label, self.norm = get("place", np.int64), get("id", np.int64), get("label", np.int64), get("norm", np.float64)
        self.angles, self.ints = get("angles", np.float64).reshape(-1, refs), get("ints", np.float64).reshape(-1, dims)

    def part(self, a: int, b: int) -> Block:
        out = object.__new__(Block)
        out.__dict__ = {k: v[a:b] for k, v in self.__dict__.items()}
        return out


def interval(least: np.ndarray, most: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of the angle and of the product of norms, beyond all rounding."""
    high, low = np.cos(np.maximum(least - ANGLE_SLACK, 0)), np.cos(np.minimum(most + ANGLE_SLACK, np.pi))
    slack = 1 + SCORE_SLACK * large
    return np.where(low > 0, small, large) * low - slack, np.where(high > 0, large, small) * high + slack


def bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each pair can have."""
    least, most = np.zeros((len(a.id), len(b.id))), np.full((len(a.id), len(b.id)), np.pi)
    for k in range(a.angles.shape[1]):
        x, y = a.angles[:, k, None], b.angles[None, :, k]
        np.maximum(least, np.abs(x - y), out=least)
        np.minimum(most, x + y, out=most)
        np.minimum(most, 2 * np.pi - x - y, out=most)
    norms = a.norm[:, None] * b.norm[None, :]
    return interval(least, most, norms, norms)


def scores(a: Block, b: Block, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and integer score of each wanted pair."""
    r, c = np.nonzero(wanted)
    if a.norm.max(initial=0) * b.norm.max(initial=0) >= EXACT:
        whole = [[int(x) for x in v] for v in a.ints], [[int(x) for x in v] for v in b.ints]
        made = (sum(x * y for x, y in zip(whole[0][i], whole[1][j])) for i, j in zip(r, c))
        return r, c, np.array([max(-LONG - 1, min(LONG, s)) for s in made], np.int64)
    if len(r) > wanted.size / 8:
        return r, c, (a.ints @ b.ints.T)[r, c].astype(np.int64)
    return r, c, np.einsum("ij,ij->i", a.ints[r], b.ints[c]).astype(np.int64)


def positives_in(a: Block, floor: np.ndarray, b: Block) -> tuple[np.ndarray, ...]:
    """Row, slot (0), column and score of the first POSITIVES rows of each anchor's label in a block."""
    low, high = bounds(a, b)
    wanted = (a.label[:, None] == b.label[None, :]) & (a.place[:, None] != b.place[None, :]) & (high >= floor[:, None])
    if b.id.size > POSITIVES:  # so many of the block are at least this good
        wanted &= high >= np.partition(np.where(wanted, low, -np.inf), -POSITIVES, axis=1)[:, -POSITIVES, None]
    r, c, s = scores(a, b, wanted)
    keep = best(r, s, b.id[c], POSITIVES)
    return r[keep], np.zeros(len(keep), np.int32), c[keep], s[keep]


def negatives_in(a: Block, first: np.ndarray, last: np.ndarray, b: Block) -> tuple[np.ndarray, ...]:
    """Row, slot, column and score of the first NEGATIVES rows of other labels in each window first to last (anchors x slots; first > last where there is none)."""
    low, high = bounds(a, b)
    any_window = first <= last
    least, most = np.where(any_window, first, LONG).min(1), np.where(any_window, last, -LONG).max(1)
    r, c, s = scores(a, b, (a.label[:, None] != b.label[None, :]) & (high >= least[:, None]) & (low <= most[:, None]))
    order = np.lexsort((b.id[c], -s, r))
    r, c, s, found = r[order], c[order], s[order], []
    for slot in range(first.shape[1]):
        inside = np.nonzero((s >= first[r, slot]) & (s <= last[r, slot]))[0]
        keep = inside[ranks(r[inside]) < NEGATIVES]
        found.append((r[keep], np.full(len(keep), slot, np.int32), c[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def windows(scores_of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last score of each positive's window: 50 p <= 100 s <= 95 p; slots from n on have none."""
    at = lambda f: np.array([[f(int(p)) for p in row] for row in scores_of], np.int64).reshape(scores_of.shape)
    first, last = at(lambda p: -(-p // 2)), at(lambda p: 19 * p // 20)
    none = np.arange(scores_of.shape[1])[None, :] >= n[:, None]
    return np.where(none, 1, first), np.where(none, 0, last)


def _frame(row: dict, prefix: str, dims: int, refs: int) -> tuple[np.ndarray, ...]:
    """Least and greatest norm and angles of a block."""
    b = Block(row, dims, refs, prefix)
    return b.norm.min(), b.norm.max(), b.angles.min(0), b.angles.max(0)


def _met(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, dims: int, refs: int, slots: int) -> DataFrame:
    """HITS of each pair (span, block): positives if slots is 0, else negatives in the windows of as many positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = Block(row, dims, refs, "a_"), Block(row, dims, refs)
                floor = np.frombuffer(row["a_floor"], np.int64)
                if slots:
                    first, last = windows(np.frombuffer(row["a_scores"], np.int64).reshape(-1, slots), np.frombuffer(row["a_found"], np.int64))
                for k in range(0, len(a.id), CHUNK):
                    part = a.part(k, k + CHUNK)
                    r, slot, c, s = negatives_in(part, first[k : k + CHUNK], last[k : k + CHUNK], b) if slots else positives_in(part, floor[k : k + CHUNK], b)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part.place[r], part.id[r], slot, b.id[c], s)], [x.split()[0] for x in HITS.split(", ")])

    found = pairs.join(anchors, "span").join(rows, "block").mapInArrow(run, HITS)
    return _first(found, NEGATIVES if slots else POSITIVES)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("place", "slot").orderBy(F.desc("score"), "other_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _overlapping(anchors: DataFrame, rows: DataFrame, blocks: int, dims: int, refs: int, slots: int) -> DataFrame:
    """span, block of the pairs of blocks in which a score may be wanted; told by frames, without the rows."""

    def framed(prefix: str, key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    small, large, low, high = _frame(row, prefix, dims, refs)
                    wanted = [-LONG - 1, LONG]
                    if prefix and slots:
                        first, last = windows(np.frombuffer(row["a_scores"], np.int64).reshape(-1, slots), np.frombuffer(row["a_found"], np.int64))
                        wanted = [int(np.where(first <= last, first, LONG).min(initial=LONG)), int(np.where(first <= last, last, -LONG).max(initial=-LONG))]
                    elif prefix:
                        wanted[0] = int(np.frombuffer(row["a_floor"], np.int64).min(initial=LONG))
                    yield pa.RecordBatch.from_pylist([{key: row[key], prefix + "norms": [small, large], prefix + "low": list(low), prefix + "high": list(high), prefix + "wanted": wanted}], schema=pa.schema([(key, pa.int64()), *((prefix + c, pa.list_(pa.float64())) for c in ("norms", "low", "high")), (prefix + "wanted", pa.list_(pa.int64()))]))

        return run, f"{key} long, {prefix}norms array<double>, {prefix}low array<double>, {prefix}high array<double>, {prefix}wanted array<long>"

    a = anchors.mapInArrow(*framed("a_", "span")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    both = a.join(rows.mapInArrow(*framed("", "block")).drop("wanted"), "block")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.array(batch.column(c).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            al, ah, bl, bh, an, bn = (get(c) for c in ("a_low", "a_high", "low", "high", "a_norms", "norms"))
            least = np.maximum(np.maximum(bl - ah, al - bh), 0).max(1, initial=0)
            most = np.minimum(ah + bh, 2 * np.pi - al - bl).min(1, initial=np.pi)
            low, high = interval(least, np.maximum(most, least), an[:, 0] * bn[:, 0], an[:, 1] * bn[:, 1])
            wanted = get("a_wanted")
            yield batch.select(["span", "block"]).filter(pa.array((high >= wanted[:, 0]) & (low <= wanted[:, 1])))

    return both.select("span", "block", "a_low", "a_high", "low", "high", "a_norms", "norms", "a_wanted").mapInArrow(kept, "span long, block long")


def mined(embeddings: DataFrame, anchor_every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: per anchor (vec_id divisible by anchor_every) and each of its first POSITIVES rows of its label,
    the first NEGATIVES rows of other labels that score 0.5 to 0.95 times as much."""
    rows, dims, refs = stored(embeddings)
    rows = written(rows)
    blocks = rows.agg(F.max("at")).first()[0]
    blocks = 0 if blocks is None else blocks // ROW_BLOCK + 1
    columns = ["place", "id", "label", "norm", "angles", "ints"]
    table = written(packed(rows.select(F.floor(F.col("at") / ROW_BLOCK).alias("block"), *columns), ["block"]))
    anchors = written(rows.where(F.col("id") % anchor_every == 0).select(F.floor(F.col("at") / ANCHOR_SPAN).alias("span"), *columns))

    def blocked(known: DataFrame) -> DataFrame:
        """Anchors in blocks, with what is known of their positives: slot, score by place."""
        each = known.groupBy("place").agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), "score"))).alias("x"))  # POSITIVES at most
        slots = F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.coalesce(F.get(F.col("x"), k)["score"], F.lit(0).cast("bigint")))
        full = anchors.join(each, "place", "left")
        floor = F.coalesce(F.get(F.col("x"), F.lit(POSITIVES - 1))["score"], F.lit(-LONG - 1).cast("bigint"))
        one = lambda k: F.element_at(slots, k + 1).alias(f"s{k}")
        wide = full.select("span", *columns, floor.alias("floor"), F.greatest(F.size("x"), F.lit(0)).cast("bigint").alias("found"), *(one(k) for k in range(POSITIVES)))
        out = packed(wide, ["span"])
        return out.mapInArrow(interleaved, f"span long, {', '.join(f'a_{c} binary' for c in [*columns, 'floor', 'found', 'scores'])}")

    def interleaved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.stack([np.frombuffer(row[f"s{k}"], np.int64) for k in range(POSITIVES)], 1).tobytes() for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("span"), *(batch.column(c) for c in [*columns, "floor", "found"]), pa.array(each, pa.binary())], ["span", *(f"a_{c}" for c in [*columns, "floor", "found", "scores"])])

    none = rows.sparkSession.createDataFrame([], f"{HITS}, rank int")
    if not blocks:
        return none.select("anchor_id", F.col("other_id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("positive_score"), F.col("score").alias("negative_score"))
    start, a_span = blocked(none), math.ceil(ANCHOR_SPAN / ROW_BLOCK)
    own = F.sequence(F.floor(F.col("span") * ANCHOR_SPAN / ROW_BLOCK), F.least(F.floor(F.col("span") * ANCHOR_SPAN / ROW_BLOCK) + a_span, F.lit(blocks - 1)))
    near = start.select("span", F.explode(own).alias("block"))
    seeds = cut(_met(near, start, table, dims, refs, 0))
    seeded = written(blocked(seeds))
    far = _overlapping(seeded, table, blocks, dims, refs, 0).join(near, ["span", "block"], "left_anti")
    both = seeds.drop("rank").unionByName(_met(far, seeded, table, dims, refs, 0).drop("rank"))
    positives = cut(_first(both, POSITIVES))
    known = written(blocked(positives))
    negatives = _met(_overlapping(known, table, blocks, dims, refs, POSITIVES), known, table, dims, refs, POSITIVES)
    of = positives.select("place", (F.col("rank") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(of, ["place", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
