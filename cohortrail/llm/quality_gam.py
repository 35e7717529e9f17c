"""Quality of a text by a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins. Cyclic boosting fits one shallow tree after another,
each on a single feature and in turn, then on the few pairs of features that explain most of what
is left; the trees of a feature add up to one lookup table. A score is the sum of the tables at a
text's bins through the logistic function, for a whole batch at a time.

The statistics of every text are computed in one scan without a shuffle. The model is fitted on
at most ``sample_rows`` labelled rows, those with the smallest hash of their id, on the driver.

Awkward input: a null text counts as an empty one, and is scored. Rows of ``labels`` without a
quality are left out; a document labelled twice has the smaller label. Without labelled rows every
score is 0.5; with one label only, the model is its constant. Repeated rows and null ids are
scored row by row. Very long texts are counted whole. An empty table gives an empty result. Further
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import keyed, keyed_schema, text_batches, tidy
from cohortrail.llm.textscan import (
    SPACED,
    Alphabet,
    buffers,
    distinct_per_row,
    shingle_hashes,
    slices,
    word_hashes,
)


@dataclass(frozen=True)
class GamParams:
    sample_rows: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    leaves: int = 3
    learning_rate: float = 0.1
    ridge: float = 2.0
    threshold: float = 0.3


FEATURES = (
    "log_words", "word_length", "capitals", "digits", "symbols", "exclamations", "punctuation",
    "beyond_ascii", "line_length", "distinct_words", "distinct_pairs", "distinct_lines",
    "capital_words",
)

_LINES = Alphabet(b"\n")


def _classes() -> np.ndarray:
    """One-hot columns per byte: capital, small, digit, symbol, '!', punctuation, beyond ASCII,
    line end, start of a character."""
    table = np.zeros((256, 9), dtype=np.int64)
    for c in range(256):
        char = chr(c)
        table[c] = (
            "A" <= char <= "Z", "a" <= char <= "z", "0" <= char <= "9", char in "#*$%&|<>",
            char == "!", char in ".,;:?'\"()-", c >= 0xC0, char == "\n", c & 0xC0 != 0x80,
        )
    return table


_CLASSES = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """The statistics of whole texts, one row each."""
    data, offsets = buffers(texts)
    ends, starts = offsets[1:], offsets[:-1]
    n = len(ends)
    sums = np.zeros((n, _CLASSES.shape[1]))
    for k in range(_CLASSES.shape[1]):
        running = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_CLASSES[data, k], out=running[1:])
        sums[:, k] = running[ends] - running[starts]
    upper, lower, digit, symbol, bang, mark, beyond, line, chars = sums.T
    words, counts, begin = word_hashes(texts, SPACED)
    lines, n_lines, _ = word_hashes(texts, _LINES)
    pairs, n_pairs = shingle_hashes(words, counts, 2, whole_if_short=False)
    capital = np.zeros(len(data), dtype=bool)
    capital[:] = (data >= 65) & (data <= 90)
    row = np.repeat(np.arange(n), counts)
    capital_words = np.bincount(row, weights=capital[begin], minlength=n) if n else np.zeros(0)
    letters, size = np.maximum(upper + lower, 1), np.maximum(chars, 1)
    share = lambda values, k: np.where(k > 0, distinct_per_row(values, k)[1] / np.maximum(k, 1), 1)
    return np.stack(
        [
            np.log1p(counts), chars / np.maximum(counts, 1), upper / letters, digit / size,
            symbol / size, bang / size, mark / size, beyond / size, chars / (line + 1),
            share(words, counts), share(pairs, n_pairs), share(lines, n_lines),
            capital_words / np.maximum(counts, 1),
        ],
        axis=1,
    )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gam:
    """Bin edges per feature and lookup tables for features and pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="left")]
        for (i, j), table in self.pair_tables.items():
            total += table[
                np.searchsorted(self.pair_edges[i], x[:, i], side="left"),
                np.searchsorted(self.pair_edges[j], x[:, j], side="left"),
            ]
        return _logistic(total)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton values of the bins of one feature, constant over up to ``leaves`` runs of bins."""
    runs = [(0, len(g))]
    left_g, left_h = np.cumsum(g), np.cumsum(h)
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for a, b in runs:
            if b - a < 2:
                continue
            before_g, before_h = (left_g[a - 1], left_h[a - 1]) if a else (0.0, 0.0)
            lg, lh = left_g[a : b - 1] - before_g, left_h[a : b - 1] - before_h
            tg, th = left_g[b - 1] - before_g, left_h[b - 1] - before_h
            gain = _gain(lg, lh, ridge) + _gain(tg - lg, th - lh, ridge) - _gain(tg, th, ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        runs.remove(best[1])
        runs += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def four_quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four quadrants: its gain and the Newton values."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = G[:-1, :-1], H[:-1, :-1]
    b_g, b_h = G[:-1, -1:] - a_g, H[:-1, -1:] - a_h
    c_g, c_h = G[-1:, :-1] - a_g, H[-1:, :-1] - a_h
    d_g, d_h = G[-1, -1] - a_g - b_g - c_g, H[-1, -1] - a_h - b_h - c_h
    parts = ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h))
    gain = sum(_gain(x, y, ridge) for x, y in parts)
    out = np.zeros_like(g)
    if not gain.size:
        return 0.0, out
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    for (x, y), rows, cols in zip(
        parts,
        (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
        (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)),
        strict=True,
    ):
        out[rows, cols] = -x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j] - _gain(G[-1, -1], H[-1, -1], ridge)), out


def fit(x: np.ndarray, y: np.ndarray, params: GamParams) -> Gam:
    """Cyclic boosting of the features in turn, then of the best pairs in turn."""
    model = Gam()
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        model.intercept = float(np.log(rate / (1 - rate)))
        return model
    cut = lambda column, n: np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))
    width = x.shape[1]
    model.edges = [cut(x[:, k], params.bins) for k in range(width)]
    model.pair_edges = [cut(x[:, k], params.pair_bins) for k in range(width)]
    bins = [np.searchsorted(model.edges[k], x[:, k], side="left") for k in range(width)]
    coarse = [np.searchsorted(model.pair_edges[k], x[:, k], side="left") for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(total)
        return p - y, p * (1 - p)

    for _ in range(params.rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = params.learning_rate * shallow_tree(
                np.bincount(bins[k], g, size), np.bincount(bins[k], h, size),
                params.leaves, params.ridge,
            )
            model.tables[k] += step
            total += step[bins[k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        n = shape[0] * shape[1]
        return np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)

    gains = {
        (i, j): four_quadrants(*grid(i, j), params.ridge)[0]
        for i in range(width)
        for j in range(i + 1, width)
    }
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[: params.pairs]
    model.pair_tables = {p: np.zeros_like(grid(*p)[0]) for p in chosen}
    for _ in range(params.pair_rounds):
        for i, j in chosen:
            step = params.learning_rate * four_quadrants(*grid(i, j), params.ridge)[1]
            model.pair_tables[i, j] += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """A fixed fifth of the documents, by id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _measured(docs: DataFrame, more: str, schema: str) -> DataFrame:
    names = [more, *FEATURES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"))
                columns = [pa.array(x[:, k], pa.float64()) for k in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([batch.column(more), *columns], names=names)

    columns = ", ".join(f"{name} double" for name in FEATURES)
    return docs.select(more, "text").mapInArrow(tidy(scan), f"{schema}, {columns}")


def train(docs: DataFrame, labels: DataFrame, params: GamParams) -> Gam:
    """Fit on a bounded sample of the labelled documents."""
    wanted = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.sample_rows)
    )
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(wanted), "doc_id"
    )
    rows = _measured(sample.select("quality", "text"), "quality", "quality double").toPandas()
    rows = rows.sort_values(list(rows.columns))
    return fit(rows[list(FEATURES)].to_numpy(), (rows["quality"] > 0).to_numpy(float), params)


def quality_scores(
    docs: DataFrame, labels: DataFrame, params: GamParams | None = None, key: str = "doc_id"
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the key, score and predicted; learned from the rows of
    ``labels`` (doc_id, quality). The key may be a column of any type."""
    params = params or GamParams()
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, params))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                score = model.score(features(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array(score, pa.float64()),
                        pa.array((score >= params.threshold).astype(np.int32)),
                    ],
                    names=["key", "score", "predicted"],
                )

    docs = keyed(docs, key)
    schema = keyed_schema(docs, "score double, predicted int")
    return docs.mapInArrow(tidy(scan), schema).withColumnRenamed("key", key)
