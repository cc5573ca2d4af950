"""Benchmark decontamination by greedy string tiling.

Documents are joined to benchmark items by hashes of shared runs of ``least`` tokens (seeds).
For each pair that shares one, running Karp-Rabin repeatedly finds and marks the longest matches of
unmarked tokens, so that tiles don't overlap on either side; a passage whose parts were moved
about is still covered. A document is contaminated by an item if tiles cover at least
``coverage`` of the item's tokens.

The benchmark is the stated query set. It is taken in blocks of at most BLOCK_TOKENS tokens, each small
enough to broadcast, and every block meets all documents: a small benchmark is one block, a
larger one costs more passes and no more memory. Documents aren't shuffled, and
a passage that a third of them hold costs one tiling in each.

Defined results: tokens are lower-cased runs of characters that aren't ASCII punctuation or white
space; null text counts as empty; items of fewer than ``least`` tokens and empty texts match nothing; equal items
are reported each; a repeated document row gives repeated rows; extra columns are kept by ``clean`` and left out
by ``leaks``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST = 4  # tokens of the shortest tile
COVERAGE = 0.5
BLOCK_TOKENS = 200_000

_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PRIME, _BASE = (1 << 61) - 1, 911_382_323


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


@dataclass
class Block:
    """Some benchmark items, ready to be looked up."""

    ids: list[int | None]
    items: list[list[int]]
    words: dict[bytes, int]
    seeds: np.ndarray
    owners: dict[int, list[int]]
    least: int


def _windows(codes: np.ndarray, least: int) -> np.ndarray:
    """Hash of each run of least codes; 0 where one of them is unknown (0)."""
    n = len(codes) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(least):
        part = codes[k : k + n]
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= part != 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def block_of(rows: list[tuple[int | None, list[bytes]]], least: int = LEAST) -> Block:
    words = {w: (xxhash.xxh3_64_intdigest(w) or 1) for _, item in rows for w in item}
    ids, items = [i for i, _ in rows], [[words[w] for w in item] for _, item in rows]
    owners: dict[int, list[int]] = defaultdict(list)
    for k, item in enumerate(items):
        for seed in set(_windows(np.array(item, np.uint64), least).tolist()):
            owners[seed].append(k)
    return Block(ids, items, words, np.array(sorted(owners), np.uint64), dict(owners), least)


def _rolled(codes: list[int], marked: bytearray, start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """(Karp-Rabin hash, place) of each window of unmarked codes, each hash made from the one before it."""
    drop = pow(_BASE, size - 1, _PRIME)
    value, held = 0, 0
    for p in range(start, stop):
        if marked[p]:
            value = held = 0
            continue
        if held == size:
            value = (value - codes[p - size] * drop) % _PRIME
            held -= 1
        value = (value * _BASE + codes[p]) % _PRIME
        held += 1
        if held == size:
            yield value, p - size + 1


def tiled(item: list[int], doc: list[int], stretches: list[tuple[int, int]], least: int) -> int:
    """Tokens of item that non-overlapping tiles of at least least tokens cover. stretches: parts of doc outside which nothing can match.

    The longest match of unmarked tokens is marked first; of equally long ones the first in item, then in doc.
    """
    done_item, done_doc = bytearray(len(item)), bytearray(len(doc))
    size = max(least, min(len(item), max(b - a for a, b in stretches)))
    while True:
        places = defaultdict(list)
        for value, i in _rolled(item, done_item, 0, len(item), size):
            places[value].append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for a, b in stretches:
            for value, p in _rolled(doc, done_doc, a, b, size):
                for i in places.get(value, ()):
                    k = 0
                    while i + k < len(item) and p + k < b and item[i + k] == doc[p + k] and not done_item[i + k] and not done_doc[p + k]:
                        k += 1
                    if k >= size:
                        found.append((-k, i, p))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        again, left = False, 0
        for k, i, p in sorted(found):
            if -k <= left:  # what a tile left of a longer match may come first; the next pass finds it
                again = True
                break
            taken, in_doc = done_item[i : i - k], done_doc[p : p - k]
            if not any(taken) and not any(in_doc):
                done_item[i : i - k] = b"\1" * -k
                done_doc[p : p - k] = b"\1" * -k
            elif not all(taken) and not all(in_doc):
                both = (int.from_bytes(taken) | int.from_bytes(in_doc)).to_bytes(-k)
                rest = max(map(len, both.split(b"\1")))
                left = max(left, rest if rest >= size else 0)
        again = again or left > 0
        if size == least and not again:
            return sum(done_item)
        size = size if again else max(least, size // 2)


def covered(block: Block, text: str | None) -> list[tuple[int, int]]:
    """(place of the item in the block, tokens covered) for each item that shares a seed with text."""
    words = tokens(text)
    if len(words) < block.least or not len(block.seeds):
        return []
    get = block.words.get
    codes = [get(w, 0) for w in words]
    hashes = _windows(np.array(codes, np.uint64), block.least)
    at = np.flatnonzero(hashes)
    if not len(at):
        return []
    near = np.minimum(np.searchsorted(block.seeds, hashes[at]), len(block.seeds) - 1)
    at = at[block.seeds[near] == hashes[at]]
    shared: dict[int, list[int]] = defaultdict(list)
    for p, seed in zip(at.tolist(), hashes[at].tolist()):
        for k in block.owners[seed]:
            shared[k].append(p)
    out = []
    for k, places in shared.items():
        stretches: list[tuple[int, int]] = []
        for p in places:
            if stretches and p <= stretches[-1][1]:
                stretches[-1] = (stretches[-1][0], p + block.least)
            else:
                stretches.append((p, p + block.least))
        out.append((k, tiled(block.items[k], codes, stretches, block.least)))
    return out


def blocks(benchmark: DataFrame, least: int = LEAST) -> Iterator[Block]:
    """The benchmark in blocks of at most BLOCK_TOKENS tokens (or one item), made one after another; each stays broadcast while the result is in use."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        item = tokens(r["text"])
        if len(item) < least:
            continue
        if rows and size + len(item) > BLOCK_TOKENS:
            yield block_of(rows, least)
            rows, size = [], 0
        rows.append((r["item_id"], item))
        size += len(item)
    if rows:
        yield block_of(rows, least)


LEAK = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("item_tokens", T.LongType()),
        T.StructField("covered_tokens", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """One row for each document and item that contaminates it: doc_id, item_id, item_tokens, covered_tokens, coverage."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *LEAK.fields])
    found = None
    for block in blocks(benchmark, least):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                at, hits = [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    for k, marked in covered(block, text):
                        size = len(block.items[k])
                        if marked >= coverage * size:
                            at.append(n)
                            hits.append((block.ids[k], size, marked, marked / size))
                columns = list(zip(*hits)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    for block in blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keep = [all(marked < coverage * len(block.items[k]) for k, marked in covered(block, text)) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
