"""Language identification of mixed text: scripts narrow, words score, Viterbi labels spans.

A text is cut into words: runs of letters of one script. The languages that write this script in
the training texts are its candidates; character trigrams with word ends give each word a log
probability under each candidate; Viterbi with a constant penalty for a change of language labels
the words. Adjacent words of a label form a span. The document's language is the one with most
letters, its score their share.

Training counts the trigrams of every labelled text in one distributed pass. The model is a table
of fixed size per language (``buckets`` hashed trigrams), so it is collected and broadcast.

Awkward input: a null text, or one without a letter, is ``und`` with score 0 and no spans. Letters
in a script that no language of the training texts writes count for every language alike; a text
with only such letters gets the most frequent language with score 0. Ties go to the first language
in alphabetical order, or to no change. Without any labelled text every document is ``und``.
Repeated rows and null ids are answered row by row. Very long texts are labelled whole. An empty table
gives an empty result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import keyed, keyed_schema, text_batches, tidy
from cohortrail.llm.textscan import slices

UNKNOWN = "und"

# Unicode ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x323AF)],
}


@dataclass(frozen=True)
class LangIdParams:
    #: Log probability lost at each change of language.
    switch_penalty: float = 14.0
    #: Least share of a language's letters in a script for it to be a candidate there.
    least_share: float = 0.002
    smoothing: float = 0.1
    buckets: int = 1 << 16
    #: Words that are decoded together.
    words_at_once: int = 500_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: script (0: not part of a word), whether a letter, and its small letter."""
    top = 0x32400
    script = np.zeros(0x110000, dtype=np.uint8)
    letter = np.zeros(0x110000, dtype=bool)
    small = np.arange(0x110000, dtype=np.uint32)
    for cp in range(top):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            letter[cp] = True
            script[cp] = len(SCRIPTS) + 1
            low = chr(cp).lower()
            if len(low) == 1:
                small[cp] = ord(low)
        elif kind == "M":
            script[cp] = len(SCRIPTS) + 1
    for number, ranges in enumerate(SCRIPTS.values(), start=1):
        for first, last in ranges:
            inside = script[first : last + 1]
            inside[inside > 0] = number
    return script, letter, small


N_SCRIPTS = len(SCRIPTS) + 2


class Words:
    """The words of a batch of texts: where they begin, their scripts, letters and trigrams."""

    def __init__(self, texts: pa.Array, buckets: int):
        rows = [t or "" for t in texts.to_pylist()]
        script, letter, small = _tables()
        raw = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), dtype=np.uint32)
        sizes = np.array([len(t) for t in rows], dtype=np.int64)
        self.row_starts = np.cumsum(sizes) - sizes
        self.has_letter = np.zeros(len(rows), dtype=bool)
        kind = script[raw]
        start = kind > 0
        start[1:] &= kind[1:] != kind[:-1]
        begins = self.row_starts[sizes > 0]
        start[begins] = kind[begins] > 0
        at = np.flatnonzero(kind)
        self.starts = np.flatnonzero(start)
        n = len(self.starts)
        self.row = np.searchsorted(self.row_starts, self.starts, side="right") - 1
        if n:  # empty rows share their start with the next row
            self.row = np.repeat(np.arange(len(rows)), sizes)[self.starts]
        self.counts = np.bincount(self.row, minlength=len(rows)) if n else np.zeros(len(rows), int)
        self.script = kind[self.starts]
        word = np.cumsum(start[at]) - 1
        self.firsts = np.searchsorted(at, self.starts)
        self.lengths = np.diff(np.append(self.firsts, len(at)))
        letters = letter[raw[at]]
        self.letters = np.bincount(word, weights=letters, minlength=n).astype(np.int64)
        np.logical_or.at(self.has_letter, self.row, self.letters > 0)
        # Trigrams: one that ends at each character and one that ends at the word's end.
        cp = small[raw[at]].astype(np.uint64)
        place = np.arange(len(at)) - self.firsts[word] if n else at
        one, two = np.zeros_like(cp), np.zeros_like(cp)
        one[1:], two[2:] = cp[:-1], cp[:-2]
        one[place < 1], two[place < 2] = 0, 0
        last = self.firsts + self.lengths - 1
        self.inner = self._bucket(two, one, cp, buckets)
        self.final = self._bucket(one[last], cp[last], np.ones(n, np.uint64), buckets)

    @staticmethod
    def _bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray, buckets: int) -> np.ndarray:
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h + c * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class LangIdModel:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    candidates: np.ndarray  # scripts x languages
    fallback: int

    def word_scores(self, words: Words) -> np.ndarray:
        n, width = len(words.starts), len(self.languages)
        out = np.zeros((n, width), dtype=np.float32)
        if n:
            out += np.add.reduceat(self.log_probability[words.inner], words.firsts, axis=0)
            out += self.log_probability[words.final]
            among = self.candidates[words.script]
            out[~among] = -np.inf
            out[~among.any(axis=1)] = 0
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, for runs of words of the given lengths.

    All runs advance together, the longest first, so a step is one vector operation over the runs
    that still have words.
    """
    width = scores.shape[1]
    kind = np.min_scalar_type(max(width - 1, 0))
    labels = np.zeros(len(scores), dtype=kind)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    came = np.zeros(scores.shape, dtype=kind)
    own = np.arange(width, dtype=kind)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    state = scores[first].astype(np.float64)
    for t in range(1, int(lengths[0])):
        m = active[t]
        now = state[:m]
        best = now.argmax(axis=1)
        jump = now[np.arange(m), best] - penalty
        change = jump[:, None] > now
        at = first[:m] + t
        came[at] = np.where(change, best[:, None], own)
        state[:m] = np.where(change, jump[:, None], now) + scores[at]
    label = state.argmax(axis=1).astype(kind)
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        labels[at] = label[:m]
        label[:m] = came[at, label[:m]] if t else label[:m]
    return labels


def held_out(doc_id: str = "doc_id") -> Column:
    """A fixed quarter of the documents, by id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, params: LangIdParams) -> LangIdModel:
    """Learn from every row of (text, lang) with a language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for whole in batches:
            for lang in whole.column("lang").unique().to_pylist():
                mine = whole.filter(pa.compute.equal(whole.column("lang"), lang))
                for batch in slices(mine, "text", 1 << 20):
                    words = Words(batch.column("text"), params.buckets)
                    count = grams.setdefault(lang, np.zeros(params.buckets, np.int64))
                    count += np.bincount(words.inner, minlength=params.buckets)
                    count += np.bincount(words.final, minlength=params.buckets)
                    letters = scripts.setdefault(lang, np.zeros(N_SCRIPTS, np.int64))
                    letters += np.bincount(
                        words.script, weights=words.letters, minlength=N_SCRIPTS
                    ).astype(np.int64)
        for kind, tables in enumerate((grams, scripts)):
            for lang, table in tables.items():
                there = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(there), pa.string()),
                        pa.array([kind] * len(there), pa.int32()),
                        pa.array(there, pa.int64()),
                        pa.array(table[there], pa.int64()),
                    ],
                    names=["lang", "kind", "cell", "n"],
                )

    counts = (
        docs.select("text", F.col("lang").cast("string").alias("lang"))
        .where("lang is not null and text is not null")
        .mapInArrow(tidy(scan), "lang string, kind int, cell bigint, n bigint")
        .groupBy("lang", "kind", "cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique())
    number = {lang: k for k, lang in enumerate(languages)}
    grams = np.zeros((params.buckets, len(languages)))
    scripts = np.zeros((N_SCRIPTS, len(languages)))
    for kind, table in ((0, grams), (1, scripts)):
        own = counts[counts["kind"] == kind]
        table[own["cell"].to_numpy(), own["lang"].map(number).to_numpy(dtype=np.int64)] = own["n"]
    smooth = grams + params.smoothing
    return LangIdModel(
        languages,
        np.log(smooth / smooth.sum(axis=0)).astype(np.float32),
        scripts >= np.maximum(params.least_share * scripts.sum(axis=0), 1),
        int(scripts.sum(axis=0).argmax()) if languages else 0,
    )


LABELS = (
    "lang_pred string, score double, spans array<struct<lang:string,start:bigint,stop:bigint>>"
)
_SPAN = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _answer(held: list[tuple], model: LangIdModel, params: LangIdParams) -> pa.RecordBatch:
    """Decode the words of the held slices together and give a row for each text."""
    scores = np.concatenate([s for _, _, s in held])
    counts = np.concatenate([w.counts for _, w, _ in held])
    letters = np.concatenate([w.letters for _, w, _ in held])
    script = np.concatenate([w.script for _, w, _ in held])
    has_letter = np.concatenate([w.has_letter for _, w, _ in held])
    start = np.concatenate([w.starts - w.row_starts[w.row] for _, w, _ in held])
    stop = start + np.concatenate([w.lengths for _, w, _ in held])
    labels = viterbi(scores, counts, params.switch_penalty)
    row = np.repeat(np.arange(len(counts)), counts)
    width = len(model.languages)
    known = model.candidates[script].any(axis=1)
    weight = np.bincount(
        row * width + labels, weights=letters * known, minlength=len(counts) * width
    ).reshape(len(counts), width)
    total = np.bincount(row, weights=letters, minlength=len(counts))
    best = np.where(weight.sum(axis=1) > 0, weight.argmax(axis=1), model.fallback)
    score = np.where(
        has_letter, weight[np.arange(len(counts)), best] / np.maximum(total, 1), 0.0
    )
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(row)) - 1 if len(opens) else opens
    names = np.array(model.languages, dtype=object)
    spans = pa.StructArray.from_arrays(
        [
            pa.array(names[labels[opens]], pa.string()),
            pa.array(start[opens], pa.int64()),
            pa.array(stop[closes], pa.int64()),
        ],
        fields=list(_SPAN),
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[opens], minlength=len(counts)))])
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([keys for keys, _, _ in held]),
            pa.array(np.where(has_letter, names[best], UNKNOWN), pa.string()),
            pa.array(score, pa.float64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
        ],
        names=["key", "lang_pred", "score", "spans"],
    )


def label_languages(
    docs: DataFrame,
    labelled: DataFrame,
    params: LangIdParams | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Per row of ``docs`` (key, text): the key, lang_pred, score and spans (lang, start, stop in
    code points); learned from ``labelled`` (text, lang). The key may be of any type."""
    params = params or LangIdParams()
    spark = docs.sparkSession
    text_batches(spark)
    docs = keyed(docs, key)
    learned = train(labelled, params)
    if not learned.languages:
        return docs.select(
            F.col("key").alias(key),
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.from_json(F.lit("[]"), LABELS.partition("spans ")[2]).alias("spans"),
        )
    shared = spark.sparkContext.broadcast(learned)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words = Words(batch.column("text"), params.buckets)
                scores = model.word_scores(words)
                del words.inner, words.final, words.firsts
                held.append((batch.column("key"), words, scores))
                size += len(scores)
                if size >= params.words_at_once:
                    yield _answer(held, model, params)
                    held, size = [], 0
        if held:
            yield _answer(held, model, params)

    return docs.mapInArrow(tidy(scan), keyed_schema(docs, LABELS)).withColumnRenamed("key", key)
