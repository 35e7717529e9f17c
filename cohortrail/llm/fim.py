"""Fill-in-middle transformation of whole texts, cut at places found in a compressed boundary set.

The places where a text may be cut are a set of byte offsets: the first byte of every unit (code
point, word or line) and the end. The set is kept in containers of 65,536 offsets, each in the
smallest of three forms: a sorted array of 16-bit offsets, a bitmap, or runs. ASCII text makes one
run, mixed scripts make bitmaps, words and lines make arrays. The cardinalities of the containers
are summed, so the place of the k-th unit is found by one search over the containers and a select
within one; that gives both cut offsets, and the text's bytes are copied once.

What is done to a document depends on its id, its text and the parameters alone: four numbers from
the SHA-256 of seed and id choose the two cuts, whether the text is left plain, and the order of the
parts. ``restored`` rebuilds the text from output and form.

Awkward input: a null or empty text is plain and empty. A text that holds a marker stays plain. A
row with a null id is hashed as an empty id, so such rows are cut alike in proportion. Rows that
repeat an id and a text give equal rows. An empty table gives an empty result. Other columns are
not read, whatever their names, unless the key names them. Very long texts are cut whole; a task
holds one text, its output, and a flag of one byte for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import keyed_schema, text_batches, tidy
from cohortrail.llm.textscan import buffers, slices


@dataclass(frozen=True)
class FimParams:
    """Markers of prefix, suffix and middle; percent of texts that are cut, and of these the
    percent with the suffix first; the unit between cuts (char, word or line)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 90
    suffix_first_percent: int = 20
    unit: str = "char"
    seed: str = "1"

    def __post_init__(self):
        first = [m[:1] for m in self.markers]
        # A marker's first character nowhere else: then none can arise where parts meet.
        if "" in first or len(set(self.markers)) < 3:
            raise ValueError(f"markers must be three different texts: {self.markers}")
        if any(c in m[1:] for c in first for m in self.markers):
            raise ValueError(f"the first character of a marker comes again in one: {self.markers}")
        if any(a != b and b.startswith(a) for a in self.markers for b in self.markers):
            raise ValueError(f"a marker begins with another: {self.markers}")
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {', '.join(UNITS)}: {self.unit}")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


#: Offsets of one container, and 64-bit words of its bitmap.
SPAN = 1 << 16
_WORDS = SPAN // 64


class ArrayContainer:
    """Offsets in ascending order."""

    def __init__(self, present: np.ndarray):
        self.offsets = np.flatnonzero(present).astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.offsets[rank])


class BitmapContainer:
    """One bit per offset; select goes to the word by its cardinality, then to the bit."""

    def __init__(self, present: np.ndarray):
        packed = np.packbits(present, bitorder="little")
        self.words = np.zeros(_WORDS, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed

    def select(self, rank: int) -> int:
        ends = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        word = int(np.searchsorted(ends, rank, side="right"))
        before = int(ends[word - 1]) if word else 0
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[rank - before])


class RunContainer:
    """First offsets of runs, and the cardinality up to the end of each."""

    def __init__(self, present: np.ndarray):
        edges = np.flatnonzero(np.diff(present.view(np.int8), prepend=0, append=0))
        self.starts = edges[::2].astype(np.uint16)
        self.ends = np.cumsum(edges[1::2] - edges[::2])

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.ends, rank, side="right"))
        before = int(self.ends[run - 1]) if run else 0
        return int(self.starts[run]) + rank - before


def container(present: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three forms for the offsets at which ``present`` is true."""
    runs = int(np.count_nonzero(present[1:] & ~present[:-1])) + bool(present[0])
    sizes = {
        RunContainer: 4 * runs,
        ArrayContainer: 2 * int(np.count_nonzero(present)),
        BitmapContainer: 8 * _WORDS,
    }
    return min(sizes, key=sizes.get)(present)


class BoundarySet:
    """The offsets at which ``present`` is true, with select by rank."""

    def __init__(self, present: np.ndarray):
        self.keys, self.containers, counts = [], [], []
        for begin in range(0, len(present), SPAN):
            part = present[begin : begin + SPAN]
            count = int(np.count_nonzero(part))
            if count:
                self.keys.append(begin // SPAN)
                self.containers.append(container(part))
                counts.append(count)
        self.cumulative = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1]) if len(self.cumulative) else 0

    def select(self, rank: int) -> int:
        """The offset of the given rank, from 0."""
        at = int(np.searchsorted(self.cumulative, rank, side="right"))
        before = int(self.cumulative[at - 1]) if at else 0
        return self.keys[at] * SPAN + self.containers[at].select(rank - before)


def _chars(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray) -> np.ndarray:
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~blank
    starts[1:] &= blank[:-1]
    starts[:1] = True
    return starts


def _lines(data: np.ndarray) -> np.ndarray:
    starts = np.ones(len(data), dtype=bool)
    starts[1:] = data[:-1] == 10
    return starts


UNITS = {"char": _chars, "word": _words, "line": _lines}


def boundaries(data: np.ndarray, unit: str) -> BoundarySet:
    """Where a text in UTF-8 may be cut: before each unit, and at its end."""
    present = np.ones(len(data) + 1, dtype=bool)
    present[:-1] = UNITS[unit](data)
    return BoundarySet(present)


def cut(text: bytes, data: np.ndarray, draws: tuple[int, ...], params: FimParams) -> tuple:
    """Units, form, units of prefix and middle, and output, for a text and its four numbers."""
    prefix, suffix, middle = (m.encode() for m in params.markers)
    places = boundaries(data, params.unit)
    n = len(places) - 1
    if not text or draws[2] % 100 >= params.percent or any(m in text for m in (prefix, suffix, middle)):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = places.select(first), places.select(second)
    if draws[3] % 100 < params.suffix_first_percent:
        out = b"".join((suffix, text[b:], prefix, text[:a], middle, text[a:b]))
        return n, "spm", first, second - first, out
    out = b"".join((prefix, text[:a], suffix, text[b:], middle, text[a:b]))
    return n, "psm", first, second - first, out


_FORM = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(
    docs: DataFrame, params: FimParams = FimParams(), key: str = "doc_id"
) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (units, null if plain) and output of every
    document."""
    text_batches(docs.sparkSession)
    named = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), named), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    of = F.col(key).cast("bigint") if key == "doc_id" else F.col(key)
    handed = docs.select(of.alias("key"), "text", F.array(*numbers).alias("draws"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, ends = buffers(batch.column("text"))
                raw = memoryview(data)
                draws = batch.column("draws").flatten().to_numpy().reshape(-1, 4).tolist()
                rows = [
                    cut(bytes(raw[a:b]), data[a:b], tuple(four), params)
                    for a, b, four in zip(ends[:-1], ends[1:], draws, strict=True)
                ]
                n, form, first, second, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(first, pa.int64()),
                        pa.array(second, pa.int64()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    out = handed.mapInArrow(tidy(scan), keyed_schema(handed, _FORM))
    return out.withColumnRenamed("key", key)


def restored(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The text that was cut: its parts lie between the markers, which the text does not hold."""
    prefix, suffix, middle = (F.lit(m) for m in params.markers)

    def between(begin: Column, end: Column | None) -> Column:
        after = F.split_part(output, begin, F.lit(2))
        return F.split_part(after, end, F.lit(1)) if end is not None else after

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
