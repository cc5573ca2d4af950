"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are counted in Arrow batches. Cyclic boosting visits the features in turn and
adds a shallow tree over each one's bins to its lookup table, then does the same for the
pairs of features that explain most of what is left. A score is the sum of a text's bins.

The model is fitted on at most ``sample_rows`` labelled rows (those with the least hash
of their id; a documented bound, so that the fit is a fixed amount of work on the driver and the sample can be
broadcast). Scoring is a map over all rows without a shuffle; the tables that tasks carry
are bounded by features * BINS + PAIRS * PAIR_BINS ** 2 numbers.

Defined results: null text counts as empty, and empty texts get a score like any other; rows
without a label, or with a null one, aren't learnt from; of several labels of an id their mean
counts, 0.5 or more as 1; without any label every score is 0.5. labels, lang, source and
doc_id are never inputs of a score. Columns called score or predicted are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF, SHRINK = 150, 60, 0.15, 15, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars",
    "word_length",
    "upper",
    "digits",
    "odd_symbols",
    "punctuation",
    "white_space",
    "byte_entropy",
    "distinct_words",
    "repeated_next",
    "odd_word_ends",
    "lone_symbols",
    "repeated_lines",
    "log_line_words",
)
_CODES = np.arange(256)
_LETTER = np.isin(_CODES, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)) | (_CODES >= 128)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = np.isin(_CODES, [32, 9, 10, 11, 12, 13])
_PLAIN = np.isin(_CODES, np.frombuffer(b".,;:'\"()-?", np.uint8))
_ODD = ~(_LETTER | _DIGIT | _SPACE | _PLAIN)


def features(text: str) -> list[float]:
    data = text.encode()
    codes = np.frombuffer(data, np.uint8)
    n = max(1, len(data))
    counts = np.bincount(codes, minlength=256)
    share = counts[counts > 0] / n
    letters = max(1, int(counts[_LETTER].sum()))
    words, lines = data.split(), data.split(b"\n")
    w = max(1, len(words))
    odd = _ODD[codes]
    ends = int(np.count_nonzero(odd[:-1] & _SPACE[codes[1:]])) + bool(odd[-1:].any())
    return [
        float(np.log1p(len(data))),
        min(sum(map(len, words)) / w, 100.0),
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_ODD].sum() / n,
        counts[_PLAIN].sum() / n,
        counts[_SPACE].sum() / n,
        float(-(share * np.log2(share)).sum()),
        float(np.log1p(len(set(words))) / np.log1p(w)),
        sum(map(operator.eq, words, words[1:])) / w,
        ends / w,
        sum(len(x) == 1 and bool(_ODD[x[0]]) for x in words) / w,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(w / len(lines))),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(x or "") for x in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    """Lookup tables of the features and of pairs of them."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _value(g: float, h: float) -> float:
    return g / (h + SHRINK)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int] | None:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return None
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
    gain = np.where((nl >= LEAST_LEAF) & (nr >= LEAST_LEAF), gain, 0.0)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else None


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A value for each bin: the tree that splits best first until it has so many leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(s[0], a, a + s[1], b) for a, b in parts if (s := _split(g[a:b], h[a:b], n[a:b]))]
        if not found:
            break
        _, a, cut, b = max(found)
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _value(g[a:b].sum(), h[a:b].sum())
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A value for each cell: one cut along one axis, then a cut of each side along the other."""
    best, kept = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b, c = (x.T if flip else x for x in (g, h, n))
        cut = _split(a.sum(1), b.sum(1), c.sum(1))
        k = cut[1] if cut else len(a)
        out = np.zeros_like(a)
        for s in (slice(0, k), slice(k, len(a))):
            if s.start < s.stop:
                out[s] = tree(a[s].sum(0), b[s].sum(0), c[s].sum(0), 2)
        gain = float((out * a).sum() - 0.5 * (out**2 * b).sum())
        if gain > best:
            best, kept = gain, out.T if flip else out
    return kept


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on the logistic loss; the same rows in any order give the same tables up to rounding."""
    width = x.shape[1]

    def cuts(k: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.array([]) for f in range(width)]

    edges, coarse_edges = cuts(BINS), cuts(PAIR_BINS)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], [], coarse_edges, [], float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            k = len(edges[f]) + 1
            step = RATE * tree(np.bincount(b, g, k), np.bincount(b, h, k), np.bincount(b, minlength=k))
            model.tables[f] += step
            total += step[b]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse_edges)]
    sizes = [len(e) + 1 for e in coarse_edges]

    def cells(i: int, j: int) -> list[np.ndarray]:
        at, k = coarse[i] * sizes[j] + coarse[j], sizes[i] * sizes[j]
        return [np.bincount(at, v, k).reshape(sizes[i], sizes[j]) for v in (*slopes(), np.ones(len(y)))]

    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            g, h, _ = cells(i, j)
            gains.append((float((g**2 / (h + SHRINK)).sum()), -i, -j))
    model.pairs = [(-i, -j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * pair_tree(*cells(i, j))
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnt(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """The model of at most sample_rows labelled rows that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # ids that repeat in docs can't make the sample larger
    bounded = _measured(rows, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample_rows).select("features", "y").toPandas()
    x = np.array(bounded["features"].tolist(), np.float64).reshape(len(bounded), len(FEATURES))
    return fit(x, bounded["y"].to_numpy(np.float64))


def _measured(df: DataFrame, keep: list[str]) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float64()))], [*keep, "features"])

    return df.mapInArrow(run, schema)


def scored(df: DataFrame, model: Gam, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, score and predicted."""
    kept = [c for c in keep if c not in ("score", "predicted")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(batch.column(text_col).to_pylist()))
            more = [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, "score", "predicted"])

    return df.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Gam) -> DataFrame:
    """The rows of docs, with their own columns, that the model doesn't reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(matrix(batch.column("text").to_pylist())) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
