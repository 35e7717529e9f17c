from __future__ import annotations

import random
import re

import numpy as np
import pytest
from cohortrail.llm.outliers import (
    OutlierParams,
    VECTOR,
    _consistency,
    chi_square_quantile,
    least_determinant,
    reject_outliers,
)
from cohortrail.llm.queries import op9_robust_outliers
from cohortrail.llm.shared import Store
from conftest import SF_DIR


def base(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {
        i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)
    }
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 6)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(0, 160))]
        for _ in range(rng.choice([0, 0, 0, 3, 20])):
            if words:
                at = rng.randrange(len(words))
                words[at:at] = words[:4]
        seps = [" ", " ", " ", "\n", "  ", "\t", "\v", "\n \n"]
        text = "".join(w + rng.choice(seps) + rng.choice(["", "", "", "#", "|"]) for w in words)
        out.append(rng.choice(["", " ", "\n"]) + text)
    return out


def test_base_statistics_equal_plain_counting(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(texts(1, 150))]
    rows += [(900, None, None, None), (901, "", "en", None), (902, " \n\n ", None, "s")]
    rows += [(903, "a b c", "x", "y"), (904, "a a a a", "x", "y"), (905, "# " * 40_000, "x", "y")]
    rows += [(0, rows[0][1], "en", "s"), (None, rows[1][1], "en", "s")]
    df = spark.createDataFrame([(*r, 5) for r in rows],
                               "doc_id bigint, text string, lang string, source string, cell int")
    got = reject_outliers(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        if doc_id != 905:
            assert columns(by_id[doc_id]) == base(text)
    assert columns(by_id[905]) == (40_000, 40_000, 40_000, 0, 40_000, True)
    assert not any(r.kept for r in got if r.base_failed)
    assert reject_outliers(df.limit(0)).collect() == []


def median(values):
    return np.quantile(values, 0.5, axis=0, method="inverted_cdf")


def by_the_book(x, chars, lines, params):
    """The least determinant of all steps from the three starts on one group, with numpy."""
    d, n = x.shape[1], len(x)
    m = median(x)
    words, chars, lines = max(np.expm1(m[0]), 1), max(median(chars), 1), max(median(lines), 1)
    floors = np.array([1 / words, 1 / chars, chars**-0.5, lines**-0.5, (4 / words) ** 0.5])
    s = np.maximum(1.4826 * median(np.abs(x - m)), floors)
    z = (x - m) / s
    directions = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    starts = [np.eye(d)]
    for form in (directions, np.tanh(z)):
        c = np.cov(form.T, bias=True)
        root = np.sqrt(np.outer(np.diag(c), np.diag(c)))
        r = np.where(root > 0, c / np.where(root > 0, root, 1), 0)
        np.fill_diagonal(r, 1)
        starts.append(r)

    def step(centre, scatter):
        away = x - centre
        distance = (away @ np.linalg.inv(scatter) * away).sum(axis=1)
        bins = np.floor(np.log2(np.maximum(distance, 1e-30)) * params.bins)
        half = np.sort(bins)[int(np.ceil(n * params.support)) - 1]
        near = x[bins <= half]
        cov = np.cov(near.T, bias=True)
        degrees = (np.diag(cov) * _consistency(params.support, d) > floors**2).sum()
        cov = cov * (_consistency(params.support, degrees) if degrees else 1)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), floors**2))
        return near.mean(axis=0), cov, np.linalg.slogdet(cov)[1]

    found, ends = [], []
    for r in starts:
        at = (m, r * np.outer(s, s), np.inf)
        for _ in range(params.first_steps):
            at = step(*at[:2])
            found.append(at)
        ends.append(at)
    at = min(ends, key=lambda e: e[2])
    while True:
        now = step(*at[:2])
        found.append(now)
        if now[2] >= at[2] - params.least_fall:
            break
        at = now
    return min(found, key=lambda e: e[2])


@pytest.mark.parametrize(("seed", "share"), [(2, 0.0), (3, 0.2), (4, 0.4)])
def test_estimate_equals_numpy_and_resists_outliers(spark, seed, share):
    """Two groups at once, one of them with many outliers far away."""
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(5, 5))
    clean = rng.normal(size=(900, 5)) @ mixing.T + 5
    far = rng.normal(size=(int(900 * share / (1 - share)), 5)) * 0.1 + 60
    groups = {"g": np.concatenate([clean, far]), "h": rng.normal(size=(333, 5)) * 3 + 4}
    extra = {g: (rng.integers(200, 900, len(x)), rng.integers(1, 30, len(x))) for g, x in groups.items()}
    rows = [
        (g, *map(float, r), int(c), int(k))
        for g, x in groups.items()
        for r, c, k in zip(x, *extra[g], strict=True)
    ]
    schema = "cell string, " + ", ".join(f"{v} double" for v in VECTOR) + ", word_chars long, n_lines long"
    params = OutlierParams(accuracy=100_000)
    got = least_determinant(spark.createDataFrame(rows, schema), params, Store(spark, "mcd")).collect()
    assert len(got) == 2
    for row in got:
        lower = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                lower[i, j] = row[f"l_{i}_{j}"]
        centre, scatter, log_det = by_the_book(groups[row.cell], *extra[row.cell], params)
        assert np.allclose([row[f"m_{i}"] for i in range(5)], centre)
        assert np.allclose(lower @ lower.T, scatter)
        assert np.isclose(row.log_det, log_det)
        if row.cell == "g":
            assert np.abs(centre - clean.mean(axis=0)).max() < 0.6


def test_small_groups_are_judged_by_language_or_all(spark):
    """At this scale no group is kept unseen, and most rows are judged by their own group."""
    rows = op9_robust_outliers(spark, SF_DIR).where("not base_failed").collect()
    by = [r.judged_by for r in rows]
    assert all(r.distance is not None for r in rows)
    assert sum(b == "group" for b in by) >= len(by) / 2
    assert sum(b in ("group", "language") for b in by) == len(by)


def test_a_few_rows_are_judged_by_medians(spark):
    """Too few for any covariance: a text of symbols goes, the rest stays, whatever its language."""
    rows = [(k, " ".join(words), f"l{k % 3}", "s") for k, words in enumerate(documents(11, 12))]
    rows.append((99, " ".join(w + "##" for w in documents(12, 1)[0]), "l0", "s"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in reject_outliers(df).collect()}
    assert {r.judged_by for r in got.values()} == {"all"}
    assert not got[99].kept
    assert sum(not r.kept for k, r in got.items() if k != 99) <= 1


def test_hidden_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 6)))
    rows = []
    for k in range(400):
        words = [word() for _ in range(rng.randint(80, 300))]
        if k % 8 == 0:
            words = [w + "###" for w in words]
        rows.append((k, " ".join(words), "en", "big" if k < 380 else f"small{k}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in reject_outliers(df).collect()}
    assert all(got[k] == (k % 8 != 0) for k in range(400))


def documents(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 6)))
    return [[word() for _ in range(rng.randint(80, 300))] for _ in range(n)]


def test_a_few_symbols_or_repetitions_are_enough_to_go(spark):
    """No floor hides 8 % symbols or nearly half the words repeated; single ones, and clean texts, stay."""
    rows = []
    for k, words in enumerate(documents(7, 300)):
        if k % 20 == 0:
            words = [w + "#" * (i % 5 < 2) for i, w in enumerate(words)]
        elif k % 20 == 1:
            words = [*words, *words[: 31 * len(words) // 100]]
        elif k % 20 == 2:
            words = [*words, "#"]
        rows.append((k, " ".join(words), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in reject_outliers(df).collect()}
    assert [k for k, kept in got.items() if not kept and k % 20 > 1] == []
    assert [k for k, kept in got.items() if kept and k % 20 < 2] == []


@pytest.mark.parametrize("share", [0.33, 0.42])
def test_many_copies_of_one_bad_text_do_not_become_the_rule(spark, share):
    """Copies with a symbol a word, as a third of a source and as more than that."""
    clean = documents(8, 300)
    copies = int(len(clean) * share / (1 - share))
    bad = " ".join(w + "##" for w in clean[0])
    rows = [(k, " ".join(words), "en", "s") for k, words in enumerate(clean)]
    rows += [(1000 + k, bad, "en", "s") for k in range(copies)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in reject_outliers(df).collect()}
    assert not any(got[1000 + k] for k in range(copies))
    assert sum(not got[k] for k in range(len(clean))) <= 3


@pytest.mark.parametrize(("p", "d", "x"), [(0.95, 5, 11.0705), (0.5, 2, 1.3863), (0.999, 1, 10.8276)])
def test_chi_square(p, d, x):
    assert chi_square_quantile(p, d) == pytest.approx(x, abs=1e-3)


def test_query_uses_no_python_and_keeps_good_documents(spark):
    got = op9_robust_outliers(spark, SF_DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = got.join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.5
