"""LM scoring: stupid-backoff scores of every document against the n-gram counts of all others.

The count tables hold all n-grams of the corpus, partitioned by ranges of their hash. Documents are packed into blocks; a
block's distinct n-grams are exploded, with their counts, into one sorted run for each partition of the count
tables; there the runs of all blocks are summed, and each run is joined to its totals, which go back to the block. Scores are then
summed per document. A document's own n-grams are taken off the totals, so a text isn't evidence for itself:

    S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else ALPHA * S(w | v);  S(w) = c(w) / N if c(w) > 0, else ALPHA / (N + 1)

Blocks and partitions hold a set number of characters, so both grow in number with the corpus, not in size. A run is dealt to at most
2 ** FAN_BITS partitions at once; where there are more, the runs of FAN blocks are first merged within such a part and then dealt on, level by level, so the
number of runs grows with the number of blocks and not with its square. A frequent n-gram
is one entry of a block's run however often it occurs, so it makes no partition hot, nor do rows that repeat, as blocks are packed from rows that
stand together. Runs are differences of sorted hashes, compressed. A block is known by its content: should rows come in another order when a lost task is
run again, the job fails and doesn't mix them up.

Defined results: words are lower-cased runs between ASCII white space; null or empty texts have n_tokens 0, log_score 0 and a
null mean; the first words of a text are scored with the history there is; repeated rows are documents of their own; ties can't arise;
extra columns are left out. N-grams are compared by hashes (KEPT_BITS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import texts

ORDER = 3
ALPHA = 0.4
BLOCK_CHARS, PART_CHARS = 6_000_000, 8_000_000
KEPT_BITS = 48  # of a hash, besides those that choose its partition; one in some 10 ** 8 n-grams shares its count with another
FAN_BITS, FAN = 8, 256


class _Codes(dict):
    """64-bit hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def _coded(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


class Grams:
    """The n-grams of a block of texts: for each order their places, distinct hashes and counts."""

    def __init__(self, texts_: list[bytes], order: int):
        held = [_coded(x.split()) for x in texts_]
        self.sizes = np.array(list(map(len, held)), np.int64)
        self.doc = np.repeat(np.arange(len(held)), self.sizes)
        start = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.doc)) - np.repeat(start, self.sizes)  # in its text
        codes = np.concatenate([np.zeros(0, np.uint64), *held])
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (last words' places, distinct hashes, which hash each has)
        self.counts: list[np.ndarray] = []
        mixed = np.zeros(len(codes), np.uint64)
        for n in range(1, order + 1):
            # the hash of the n words that end here, from that of the n - 1 that end one before
            before = np.concatenate([np.zeros(1, np.uint64), mixed[:-1]]) if n > 1 else np.zeros(len(codes), np.uint64)
            mixed = (before ^ codes) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            mixed ^= mixed >> np.uint64(32)
            at = np.flatnonzero(self.place >= n - 1)
            keys, which, counts = np.unique(mixed[at], return_inverse=True, return_counts=True)
            self.levels.append((at, keys, which))
            self.counts.append(counts)


_ZSTD = pa.Codec("zstd", 1)


def _squeezed(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes: all first bytes before all second ones, compressed; their number stands in front."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=8 * n), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _kept(hashes: np.ndarray, used: int, width: int) -> np.ndarray:
    """The bits of hashes that stand behind the first used of the first width bits."""
    return (hashes << np.uint64(used)) >> np.uint64(64 - width + used)


def _dealt(keys: np.ndarray, counts: np.ndarray, low: int, part: int, step: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Parts, keys and counts of sorted keys of low + step bits, dealt to 2 ** step parts by their first bits."""
    edges = np.searchsorted(keys, np.arange(1, 1 << step, dtype=np.uint64) << np.uint64(low))
    parts, runs, sums = [], [], []
    for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
        if a < b:
            parts.append((part << step) + p)
            runs.append(_packed(np.diff(keys[a:b] & np.uint64((1 << low) - 1), prepend=np.uint64(0))))
            sums.append(_packed(counts[a:b]))
    return parts, runs, sums


RUN = "part long, block long, keys binary, counts binary"
TOTALS = "part long, block long, totals binary"


def _run_table(parts: list[int], block: int, keys: list[bytes], counts: list[bytes]) -> pa.Table:
    return pa.table([pa.array(parts, pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "keys", "counts"])


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """block, and the ids and texts (lower case, UTF-8, compressed) of the documents in it."""
    ids = T.ArrayType(docs.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", ids), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = number = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            texts_ = [x.lower().encode() for x in rows.column("text").to_pylist()]
            data = b"".join(texts_)
            key = xxhash.xxh3_64_digest(b"%d %d " % (TaskContext.get().partitionId(), number) + data)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(key, "big", signed=True)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(texts_)], pa.int32()), rows.column("doc_id").combine_chunks()),
                    pa.array([list(map(len, texts_))], pa.list_(pa.int64())),
                    pa.array([_squeezed(data)], pa.binary()),
                ],
                schema.names,
            )

        for batch in batches:
            chars = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # as many more rows as fit, one at least
                stop = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + block_chars - size, "right")))
                size += int(chars[stop - 1] - (chars[at - 1] if at else 0))
                held.append(batch.slice(at, stop - at))
                at = stop
                if at < batch.num_rows or size >= block_chars:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    return docs.mapInArrow(run, schema)


def _texts_of(row: pa.Table) -> list[bytes]:
    """The texts of one block."""
    sizes = row.column("sizes")[0].as_py()
    data = _ZSTD.decompress(row.column("texts")[0].as_py(), decompressed_size=sum(sizes), asbytes=True) if sum(sizes) else b""
    ends = np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _runs(blocks: DataFrame, order: int, step: int, width: int) -> DataFrame:
    """A block's n-grams and counts by the 2 ** step first parts of each order's count table."""

    def run(table: pa.Table) -> pa.Table:
        grams = Grams(_texts_of(table), order)
        found = [_dealt(_kept(hashes, 0, width), sums, width - step, n, step) for n, ((_, hashes, _), sums) in enumerate(zip(grams.levels, grams.counts))]
        _codes.clear()
        return _run_table(sum((f[0] for f in found), []), table.column("block")[0].as_py(), sum((f[1] for f in found), []), sum((f[2] for f in found), []))

    return blocks.groupBy("block").applyInArrow(run, RUN)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of runs, their summed counts, which key each entry has, and where each run ends."""
    runs = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    keys, which = np.unique(np.concatenate(runs), return_inverse=True)
    counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
    return keys, np.bincount(which, counts).astype(np.int64), which, np.cumsum([0, *map(len, runs)]).tolist()


def _with_totals(table: pa.Table, totals: np.ndarray, ends: list[int]) -> pa.Table:
    return pa.table([table.column("part"), table.column("block"), pa.array([_packed(totals[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], ["part", "block", "totals"])


def _totals(runs: DataFrame, n_runs: int, low: int, bits: int) -> DataFrame:
    """Each run's counts over all blocks. low: bits of its keys; bits: how many of them tell the parts of the count tables that it meets."""
    if not bits:

        def total(table: pa.Table) -> pa.Table:
            _, sums, which, ends = _merged(table)
            return _with_totals(table, sums[which], ends)

        return runs.groupBy("part").applyInArrow(total, TOTALS)

    step, groups = min(FAN_BITS, bits), -(-n_runs // FAN)
    of = runs.withColumn("of", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def split(table: pa.Table) -> pa.Table:
        keys, sums, _, _ = _merged(table)
        parts, runs_, counts = _dealt(keys, sums, low - step, table.column("part")[0].as_py(), step)
        return _run_table(parts, table.column("of")[0].as_py(), runs_, counts)

    def back(table: pa.Table, found: pa.Table) -> pa.Table:
        keys, _, which, ends = _merged(table)
        order = np.argsort(found.column("part").to_numpy())
        data = found.column("totals").to_pylist()
        return _with_totals(table, _whole([data[k] for k in order], len(keys))[which], ends)

    beyond = _totals(of.groupBy("part", "of").applyInArrow(split, RUN), groups, low - step, bits - step)
    beyond = beyond.select("part", F.col("block").alias("of"), "totals", F.shiftright("part", step).alias("via"))
    return of.groupBy("part", "of").cogroup(beyond.groupBy("via", "of")).applyInArrow(back, TOTALS)


def _whole(totals: list[bytes], size: int) -> np.ndarray:
    found = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x).astype(np.int64) for x in totals)])
    if len(found) != size:
        raise RuntimeError("a block's rows came in another order when a lost task was run again; write the documents to a table first")
    return found


def _sums(grams: Grams, totals: list[np.ndarray], words: int) -> np.ndarray:
    """The summed log scores of a block's documents."""
    n_docs = len(grams.sizes)
    rest = words - grams.sizes[grams.doc]  # words of all other documents
    score, before = np.zeros(0), np.zeros(0, np.int64)
    for n, ((at, hashes, which), total) in enumerate(zip(grams.levels, totals)):
        pair = grams.doc[at] * max(1, len(hashes)) + which
        _, same, own = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.zeros(len(grams.doc), np.int64)
        count[at] = total[which] - own[same]
        if n == 0:
            new = np.where(count > 0, np.log(np.maximum(count, 1)) - np.log(np.maximum(rest, 1)), np.log(ALPHA) - np.log(rest + 1.0))
        else:
            history = np.concatenate([np.zeros(1, np.int64), before[:-1]])
            new = np.where(count > 0, np.log(np.maximum(count, 1)) - np.log(np.maximum(history, 1)), np.log(ALPHA) + score)
            new = np.where(grams.place >= n, new, score)
        score, before = new, count
    return np.bincount(grams.doc, score, n_docs)


def _size(docs: DataFrame) -> tuple[int, int, int]:
    """Characters and words of all texts, and the tasks that read them."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = words = 0
        for batch in batches:
            texts_ = batch.column("text")
            chars += pc.sum(pc.utf8_length(texts_)).as_py() or 0
            gap = space[np.frombuffer(("\n" + "\n".join(texts_.to_pylist())).encode(), np.uint8)]
            words += int(np.count_nonzero(gap[:-1] & ~gap[1:]))
        yield pa.RecordBatch.from_pydict({"chars": [chars], "words": [words]})

    found = docs.select("text").mapInArrow(run, "chars long, words long").agg(F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.count("*").alias("tasks")).first()
    return found["chars"] or 0, found["words"] or 0, found["tasks"]


def scored(docs: DataFrame, order: int = ORDER, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, mean_log_score (a token; texts of any length compare by it) and log_score (the sum) of every row of docs (doc_id, text)."""
    rows = texts(docs)
    chars, words, tasks = _size(rows)
    bits = max(0, (-(-chars // part_chars) - 1).bit_length())
    step, width = min(bits, FAN_BITS), min(64, KEPT_BITS + bits)
    blocks = _blocks(rows, block_chars)
    totals = _totals(_runs(blocks, order, step, width), -(-chars // block_chars) + tasks, width - step, bits - step)  # a task may end in a smaller block
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("mean_log_score", T.DoubleType()), T.StructField("log_score", T.DoubleType())])

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        grams = Grams(_texts_of(table), order)
        _codes.clear()
        known = sorted(zip(found.column("part").to_pylist(), found.column("totals").to_pylist()))
        by_level = [_whole([x for part, x in known if part >> step == n], len(grams.levels[n][1])) for n in range(order)]
        sums = _sums(grams, by_level, words)
        mean = pa.array(sums / np.maximum(grams.sizes, 1), mask=grams.sizes == 0)
        return pa.table([table.column("ids").combine_chunks().flatten(), pa.array(grams.sizes), mean, pa.array(np.where(grams.sizes > 0, sums, 0.0))], schema.names)

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, schema)
