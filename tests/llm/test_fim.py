"""Fill-in-middle against slicing by code points, container forms, and awkward rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from cohortrail.llm import fim
from cohortrail.llm.fim import BoundarySet, FimParams, fill_in_middle, restored
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

TEXTS = st.text(st.sampled_from("aZ <>PSM\n\tä€😀"), max_size=60)


def draws_of(doc_id, seed="1"):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def by_the_book(doc_id, text):
    text = text or ""
    h = draws_of(doc_id)
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return len(text), "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("share", [0.0, 1e-4, 0.01, 0.3, 0.5, 0.99, 1.0])
def test_select_in_every_container(share):
    rng = np.random.default_rng(int(share * 1000))
    present = rng.random(3 * fim.SPAN + 17) < share
    present[fim.SPAN : 2 * fim.SPAN] = share >= 0.5
    present[-1] = True
    offsets = np.flatnonzero(present)
    places = BoundarySet(present)
    assert len(places) == len(offsets)
    for rank in {0, len(offsets) - 1, *rng.integers(0, len(offsets), 200).tolist()}:
        assert places.select(rank) == offsets[rank]


def test_the_smallest_form_is_taken():
    data = lambda text: np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = lambda text, unit: {type(c) for c in fim.boundaries(data(text), unit).containers}
    assert kinds("a" * 200_000, "char") == {fim.RunContainer}
    assert fim.BitmapContainer in kinds("ä€x" * 50_000, "char")
    assert kinds(("x" * 80 + "\n") * 3000, "line") <= {fim.ArrayContainer, fim.RunContainer}
    assert fim.ArrayContainer in kinds(("x" * 80 + "\n") * 3000, "line")


@given(TEXTS, st.integers(-5, 10**12))
def test_cut_equals_slicing(text, doc_id):
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    assert fim.cut(raw, data, draws_of(doc_id), FimParams())[:-1] == by_the_book(doc_id, text)[:-1]
    assert fim.cut(raw, data, draws_of(doc_id), FimParams())[-1].decode() == by_the_book(doc_id, text)[-1]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_fall_between_units(spark, unit):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["wörd", " ", "\n", "a b", "\t"]) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = FimParams(unit=unit, percent=100, suffix_first_percent=50, seed="other")
    out = fill_in_middle(df, params).withColumn("back", restored(F.col("output"), F.col("form"), params))
    found = out.collect()
    assert {r.form for r in found} == {"psm", "spm"}
    for r in found:
        text = texts[r.doc_id]
        assert r.back == text
        middle = r.output.split("<M>")[1]
        prefix = r.output.split("<P>")[1].split("<S>")[0].split("<M>")[0]
        for at in (len(prefix), len(prefix) + len(middle)):
            inside = 0 < at < len(text)
            if unit == "line":
                assert not inside or text[at - 1] == "\n"
            else:
                assert not inside or (text[at - 1].isspace() and not text[at].isspace())


def test_awkward_rows(spark):
    long = "Längeres 😀 wort " * 40_000
    rows = [
        (1, None), (2, ""), (3, "<P>"), (4, "x<S"), (5, "<M> inside"), (6, "😀"), (7, long),
        (8, "a" * 3_000_000), (9, ">P<"), (None, "no id"), (None, "no id"), (6, "😀"), (10, "\u0000<"),
        *[(k, "<S P> <" * (k % 7) + "é") for k in range(11, 80)],
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(
        "doc_id", "text", "'x' as output", "1 as n", "2 as draws", "3 as key", "4 as form"
    )
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((d, *by_the_book(d, t), t or "")) for d, t in rows))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).collect() == []


def test_whole_rows_can_be_carried(spark):
    df = spark.createDataFrame([(5, "abc", "x")], "doc_id long, text string, output string")
    rows = df.select(F.struct("*").alias("row"), "doc_id", "text")
    got = fill_in_middle(rows, key="row").first()
    assert got.row.output == "x" and got.output == by_the_book(5, "abc")[-1]


def test_bad_parameters_are_refused():
    for bad in (
        {"prefix": ""}, {"prefix": "<S>"}, {"prefix": "<<"}, {"prefix": "a<"}, {"unit": "page"},
        {"prefix": "<S"},
    ):
        with pytest.raises(ValueError):
            FimParams(**bad)
