from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from cohortrail.llm.pieces import SPACE, Automaton, PieceModel, decode, encode, round_trips
from cohortrail.llm.queries import TOKENIZERS, op8_sentencepiece
from conftest import SF_DIR
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


def small_model(seed: int) -> PieceModel:
    rng = random.Random(seed)
    texts = {"".join(rng.choices("ab" + SPACE, k=rng.randint(1, 5))) for _ in range(25)} - {"b"}
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *sorted(texts)]
    scores = [0.0] * 257 + [-float(rng.randint(1, 9)) for _ in texts]
    return PieceModel(names, scores, [2] + [6] * 256 + [1] * len(texts), True)


def best_score(model: PieceModel, text: str) -> float:
    """Over every segmentation, by trying all pieces at all places."""
    known = {s: x for s, x, k in zip(model.surfaces, model.scores, model.kinds, strict=True) if k == 1}
    unknown = min(known.values()) - 10
    text = SPACE + text.replace(" ", SPACE)
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            piece = text[begin:end]
            if piece in known:
                best[end] = max(best[end], best[begin] + known[piece])
        if text[end - 1] not in known:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


@pytest.mark.parametrize("seed", range(12))
def test_segmentations_score_best(seed):
    model = small_model(seed)
    automaton, rng = Automaton(model), random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choices("aabc \n", k=rng.randint(1, 25)))
        ids = automaton.encode(text)
        assert automaton.decode(ids) == text
        assert automaton.total_score(ids) == pytest.approx(best_score(model, text))


def test_same_pieces_as_the_library(spark):
    """The library's own unigram encoder, given the same pieces and scores.

    The few scores of -1e9 are raised: they are beyond the single precision of the library.
    """
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -50_000.0)
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    loaded = PieceModel.load(PATH)
    automaton = Automaton(replace(loaded, scores=[max(x, -50_000.0) for x in loaded.scores]))
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(150).collect()
    compared = 0
    for (text,) in rows:
        for line in text.split("\n"):
            if line and all(c in automaton.single or c == " " for c in line):
                assert automaton.encode(line).tolist() == library.encode(line)
                compared += 1
    assert compared > 300


def test_awkward_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "\n\n a\n", "日本 🙂\x00 é\t", "w" * 300_000, "<unk><s><0x41>"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, texts[3]])],
                               "doc_id bigint, text string, pieces int")
    encoded = encode(df, PATH)
    got = {r.doc_id: r.text for r in decode(encoded, PATH).collect()}
    assert [got[k] for k in range(len(texts))] == [t or "" for t in texts]
    rows = {r.doc_id: r for r in round_trips(df, PATH).collect()}
    assert all(r.round_trip for r in rows.values()) and rows[0].n_pieces == rows[1].n_pieces == 0
    assert rows[3].pieces_md5 == rows[8].pieces_md5
    assert encode(df.limit(0), PATH).collect() == []


def test_query_round_trips_every_text(spark):
    got = op8_sentencepiece(spark, SF_DIR)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert got.where("not round_trip").count() == 0
