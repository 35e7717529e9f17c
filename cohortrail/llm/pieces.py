"""SentencePiece encoding and decoding: an automaton over the pieces drives Viterbi.

The pieces and scores of a model form an Aho-Corasick automaton. One pass over a text follows its
transitions; at each position the output links name every piece that ends there, the longest
first, and relax the best score of a segmentation up to it. A character that no piece covers alone
is an unknown of one character, written as byte pieces.

Where no piece of a model has a space mark after another character, or a line end among others,
no segmentation has one there either: the segments between are independent, and one that recurs is
looked up. This is checked when the automaton is built.

The segmentation is the one with the best sum of scores. For a model trained by merging, whose
scores are merge ranks, that is not in general the order of merges. The model file is read by the driver and broadcast; a file
over ``MOST_BYTES`` is refused.

Awkward input: a null or empty text has no pieces. Decoding gives back the text, but for the space
mark itself, which comes back as a space. Ties go to the longer last piece. Repeated rows and null
ids are encoded row by row. An empty table gives an empty result. Further columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cohortrail.llm.shared import text_batches, tidy
from cohortrail.llm.textscan import slices

MOST_BYTES = 64 << 20
SPACE = "▁"


@dataclass(frozen=True)
class PieceModel:
    """Surface, score and kind of every piece; kinds are those of the model format."""

    surfaces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    NORMAL, BYTE = (1, 4), 6

    @classmethod
    def load(cls, path: str) -> PieceModel:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} is too large for a piece model")
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte pieces are supported")
        return cls(
            [p.piece for p in proto.pieces],
            [p.score for p in proto.pieces],
            [p.type for p in proto.pieces],
            spec.add_dummy_prefix,
        )


class Automaton:
    """The pieces of a model as an Aho-Corasick automaton, and the segments seen so far."""

    #: Segments kept for their recurrence.
    CACHED = 600_000

    def __init__(self, model: PieceModel):
        self.model = model
        self.goto: list[dict[str, int]] = [{}]
        self.piece = [-1]
        self.length = [0]
        self.score = [0.0]
        self.bytes = [0] * 256
        single = {}
        for number, (text, score, kind) in enumerate(
            zip(model.surfaces, model.scores, model.kinds, strict=True)
        ):
            if kind == PieceModel.BYTE:
                self.bytes[int(text[3:5], 16)] = number
            elif kind in PieceModel.NORMAL:
                self._add(text, number, score)
                if len(text) == 1:
                    single[text] = score
        normal = [s for s, k in zip(model.scores, model.kinds, strict=True) if k in (1, 4)]
        self.unknown = min(normal, default=0.0) - 10
        self.single = single
        self._link()
        # Runs of space marks begin a segment, a line end stands alone.
        line = "\n" if self._alone("\n") else ""
        if self._leads(SPACE):
            parts = [f"{SPACE}*[^{SPACE}{line}]+", f"{SPACE}+"]
        else:
            parts = [f"[^{line}]+" if line else "(?s:.+)"]
        self.segment = re.compile("|".join([line, *parts] if line else parts))
        self.cache: dict[str, bytes] = {}
        self.bytes_of_piece = [self._bytes(k) for k in range(len(model.surfaces))]
        self.scores = np.array(model.scores)
        kinds = np.array(model.kinds)
        self.is_byte = kinds == PieceModel.BYTE
        self.begins_character = np.zeros(len(kinds), dtype=bool)
        for value, number in enumerate(self.bytes):
            self.begins_character[number] = self.is_byte[number] and value & 0xC0 != 0x80

    def _add(self, text: str, number: int, score: float) -> None:
        node = 0
        for char in text:
            if char not in self.goto[node]:
                self.goto[node][char] = len(self.goto)
                self.goto.append({})
                self.piece.append(-1)
                self.length.append(0)
                self.score.append(0.0)
            node = self.goto[node][char]
        if node and (self.piece[node] < 0 or score > self.score[node]):
            self.piece[node], self.length[node], self.score[node] = number, len(text), score

    def _link(self) -> None:
        """Failure links breadth-first, and from each node the nearest suffix that is a piece."""
        self.fail = [0] * len(self.goto)
        self.output = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for node in queue:
            for char, child in self.goto[node].items():
                back = self.fail[node]
                while back and char not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(char, 0)
                queue.append(child)
            back = self.fail[node]
            self.output[node] = back if self.piece[back] >= 0 else self.output[back]

    def _pieces_of_many(self) -> Iterator[str]:
        for text, kind in zip(self.model.surfaces, self.model.kinds, strict=True):
            if kind in PieceModel.NORMAL and len(text) > 1:
                yield text

    def _alone(self, char: str) -> bool:
        """Whether this character is in no piece with others."""
        return all(char not in text for text in self._pieces_of_many())

    def _leads(self, char: str) -> bool:
        """Whether in every piece this character has only its own kind before it."""
        return all(char not in text.lstrip(char) for text in self._pieces_of_many())

    def best(self, text: str) -> bytes:
        """The pieces of one segment, as 32-bit integers."""
        goto, fail, output = self.goto, self.fail, self.output
        piece, length, score, single = self.piece, self.length, self.score, self.single
        n = len(text)
        total = [0.0] * (n + 1)
        came = [0] * (n + 1)
        node = 0
        for at, char in enumerate(text, start=1):
            while node and char not in goto[node]:
                node = fail[node]
            node = goto[node].get(char, 0)
            best, end = None, node if piece[node] >= 0 else output[node]
            state = 0
            while end:
                value = total[at - length[end]] + score[end]
                if best is None or value > best:
                    best, state = value, end
                end = output[end]
            if char not in single:
                value = total[at - 1] + self.unknown
                if best is None or value > best:
                    best, state = value, 0
            total[at], came[at] = best, state
        found: list[int] = []
        while n:
            state = came[n]
            if state:
                found.append(piece[state])
                n -= length[state]
            else:
                found += [self.bytes[b] for b in reversed(text[n - 1].encode())]
                n -= 1
        return np.array(found[::-1], dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        cache = self.cache
        out = []
        for segment in self.segment.findall(text):
            ids = cache.get(segment)
            if ids is None:
                ids = self.best(segment)
                if len(segment) < 64:
                    if len(cache) >= self.CACHED:
                        cache.clear()
                    cache[segment] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def total_score(self, ids: np.ndarray) -> float:
        """The score of a segmentation; unknown characters count as such, not as their bytes."""
        of_pieces = self.scores[ids[~self.is_byte[ids]]].sum()
        return float(of_pieces + self.unknown * self.begins_character[ids].sum())

    def _bytes(self, number: int) -> bytes:
        text, kind = self.model.surfaces[number], self.model.kinds[number]
        if kind == PieceModel.BYTE:
            return bytes([int(text[3:5], 16)])
        return text.replace(SPACE, " ").encode() if kind in PieceModel.NORMAL else b""

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of_piece.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_WORKER: dict[str, Automaton] = {}


def _automaton(key: str, model: PieceModel) -> Automaton:
    """One automaton a worker process, kept between tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Automaton(model)
    return _WORKER[key]


def _shared(df: DataFrame, path: str):
    text_batches(df.sparkSession)
    model = PieceModel.load(path)
    parts = repr((model.surfaces, model.scores, model.kinds, model.dummy_prefix))
    key = hashlib.sha1(parts.encode()).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, pieces (identifiers), n_byte_pieces, score."""
    key, model = _shared(docs, path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, model.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [automaton.encode(t or "") for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.ListArray.from_arrays(
                            pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))
                        ),
                        pa.array([int(automaton.is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([automaton.total_score(x) for x in ids], pa.float64()),
                    ],
                    names=["doc_id", "pieces", "n_byte_pieces", "score"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(
        tidy(scan), "doc_id bigint, pieces array<int>, n_byte_pieces bigint, score double"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, pieces): doc_id and text."""
    key, model = _shared(encoded, path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, model.value)
        for batch in batches:
            texts = []
            for k in range(batch.num_rows):
                ids = batch["pieces"][k].values
                texts.append("" if ids is None else automaton.decode(ids.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return encoded.select("doc_id", "pieces").mapInArrow(tidy(scan), "doc_id bigint, text string")


DIGEST = (
    "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, score double, pieces_md5 string, "
    "round_trip boolean"
)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: DIGEST columns. The digest is of the identifiers as 32-bit
    integers; round_trip says whether the decoded text is the text with space marks as spaces."""
    key, model = _shared(docs, path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, model.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    ids = automaton.encode(text or "")
                    same = automaton.decode(ids) == (text or "").replace(SPACE, " ")
                    rows.append(
                        (len(ids), int(automaton.is_byte[ids].sum()), automaton.total_score(ids),
                         hashlib.md5(ids.tobytes()).hexdigest(), same)
                    )
                types = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
                columns = [
                    pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns],
                    names=[x.split()[0] for x in DIGEST.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        tidy(scan), DIGEST
    )
