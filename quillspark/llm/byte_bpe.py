"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) that isn't a token itself is cut in halves down to leaves of LEAF bytes. Leaves are
encoded by lowest-rank merges; neighbours are joined by re-encoding a window around the seam
that grows until it provably stops mattering. The proof rests on a property of BPE: a token
sequence is the encoding of its bytes exactly if each adjacent pair of tokens is the encoding
of the pair's own bytes. So a join may stop as soon as the pairs across both edges of the window
encode to themselves. Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: null text counts as empty; empty text has no tokens; ids are packed as
little-endian unsigned 32-bit integers in a binary column (``ids_as_array`` unpacks them).
Rows are independent, so repeated rows, ties and skewed sources need nothing special, and the
plan has no shuffle. A worker remembers what pieces, and short halves of them, encode to.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 4  # bytes of a leaf of the tree
SHORT = 6  # bytes of halves and windows that recur often enough to be remembered
PIECES, HALVES = 250_000, 60_000  # that a worker remembers before it starts anew


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(self.piece)
        self.windows: dict[bytes, list[bytes]] = {}
        self.trees: dict[bytes, list[bytes]] = {}
        self.seams = 0  # joined so far

    def merged(self, data: bytes) -> list[bytes]:
        """Encoding of data from scratch: merge the lowest rank, leftmost first, until none is left."""
        if len(data) > 64:
            return self._merged_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], _NO) for i in range(len(data) - 1)]
        while ranks:
            low = min(ranks)
            if low == _NO:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], _NO)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], _NO)
        return parts

    def _merged_long(self, data: bytes) -> list[bytes]:
        """The same with a heap and linked parts, for long windows."""
        get, n = self.ranks.get, len(data)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := get(data[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = end[i]
        return out

    def window(self, data: bytes) -> list[bytes]:
        """merged(), remembered if data is short."""
        if len(data) > SHORT:
            return self.merged(data)
        known = self.windows.get(data)
        if known is None:
            if len(self.windows) >= HALVES:
                self.windows.clear()
            known = self.windows[data] = self.merged(data)
        return known

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay two tokens beside each other."""
        both = self.window(a + b)
        return len(both) == 2 and len(both[0]) == len(a)

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        self.seams += 1
        if self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            low, high = max(0, len(left) - k), min(len(right), k)
            window = self.window(b"".join(left[low:] + right[:high]))
            if (not low or self.stable(left[low - 1], window[0])) and (high == len(right) or self.stable(window[-1], right[high])):
                return left[:low] + window + right[high:]
            k *= 2

    def tree(self, data: bytes) -> list[bytes]:
        n = len(data)
        if n <= LEAF:
            return self.window(data)
        half = n // 2
        if n > SHORT:
            return self.joined(self.tree(data[:half]), self.tree(data[half:]))
        known = self.trees.get(data)
        if known is None:
            if len(self.trees) >= HALVES:
                self.trees.clear()
            known = self.trees[data] = self.joined(self.tree(data[:half]), self.tree(data[half:]))
        return known

    def piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return struct.pack("<I", whole)
        ids = [self.ranks[t] for t in self.tree(data)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if len(text) < 1_000_000:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(self.pieces[m.group()] for m in self.pattern.finditer(text))

    def decode(self, ids: bytes) -> bytes:
        n = len(ids) // 4
        if n > 1 << 16:
            half = n // 2 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{n}I", ids)))


_NO = 1 << 62


class _Pieces(dict):
    """Encodings of pieces seen lately."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(text) <= 64:
            if len(self) >= PIECES:
                self.clear()
            self[text] = ids
        return ids


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file; a worker process reads the file once."""
    key = path, pattern
    if key not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        _loaded[key] = ByteBpe(ranks, pattern)
    return _loaded[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with a binary column of packed ids. path: a rank file that every executor has."""
    schema = T.StructType([f for f in df.schema if f.name != ids_col] + [T.StructField(ids_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(text_col).to_pylist()]
            yield _with(batch, ids_col, pa.array(ids, pa.binary()))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes that packed ids stand for; null ids count as none."""
    schema = T.StructType([f for f in df.schema if f.name != bytes_col] + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            out = [bpe.decode(x or b"") for x in batch.column(ids_col).to_pylist()]
            yield _with(batch, bytes_col, pa.array(out, pa.binary()))

    return df.mapInArrow(run, schema)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [values], [n for n, _ in kept] + [name])


def ids_as_array(ids):
    """Column of packed ids as array<bigint>."""
    n = F.octet_length(ids) / 4
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k, F.lit(1))), 16, 10).cast("bigint")
    some = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65536 + byte(i, 4) * 16777216)
    return F.when(n >= 1, some).otherwise(F.array().cast("array<bigint>"))


def transcoded(df: DataFrame, path: str, pattern: str, text_col: str = "text", give: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """df without its text and with what to give of: packed ``ids``, the bytes that they are ``decoded`` to, and whether those are the text's (``exact``). One worker does all."""
    kinds = {"ids": (T.BinaryType(), pa.binary()), "decoded": (T.BinaryType(), pa.binary()), "exact": (T.BooleanType(), pa.bool_())}
    kept = [f for f in df.schema if f.name != text_col and f.name not in give]
    schema = T.StructType([*kept, *(T.StructField(n, kinds[n][0]) for n in give)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            ids = [bpe.encode(x) for x in texts]
            decoded = [bpe.decode(x) for x in ids]
            found = {"ids": ids, "decoded": decoded, "exact": [x.encode() == y for x, y in zip(texts, decoded)]}
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(found[n], kinds[n][1]) for n in give)], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document (doc_id, text): n_tokens and the digests of its ids and of the bytes they decode to."""
    return transcoded(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
