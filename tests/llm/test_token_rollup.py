from __future__ import annotations

import base64

import pytest
import tiktoken
from cohortrail.llm.queries import TOKENIZERS, op3_token_rollup
from cohortrail.llm.shared import Store
from cohortrail.llm.token_rollup import PATTERN, TokenRollup, count_tokens, n_tokens
from conftest import SF_DIR

SCHEMA = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, change string"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def commit(rollup, batch, rows):
    return rollup.commit(batch, rollup.spark.createDataFrame(rows, SCHEMA))


def test_signed_batches(spark):
    rollup = TokenRollup(spark, Store(spark, "tokens").folder + "/r")
    assert totals(rollup) == {}
    assert commit(rollup, "1", [(k, "s" if k % 2 else "t", "en", "v1", 10 * k, "insert")
                                for k in range(6)])
    assert totals(rollup) == {("s", "en", "v1"): (3, 90), ("t", "en", "v1"): (3, 60)}
    # A revision moves a document to another source; one document goes; one version is added.
    rows = [(1, "t", "en", "v1", 7, "revise"), (4, None, None, "v1", 0, "delete"),
            (5, "s", "en", "v2", 80, "insert")]
    assert commit(rollup, "2", rows)
    expected = {("s", "en", "v1"): (2, 80), ("t", "en", "v1"): (3, 27), ("s", "en", "v2"): (1, 80)}
    assert totals(rollup) == expected
    assert not commit(rollup, "2", rows) and totals(rollup) == expected
    assert commit(rollup, "3", []) and totals(rollup) == expected
    present = {(r.doc_id, r.tokenizer): r.n_tokens for r in rollup.documents().collect()}
    assert present == {(0, "v1"): 0, (1, "v1"): 7, (2, "v1"): 20, (3, "v1"): 30, (5, "v1"): 50,
                       (5, "v2"): 80}


def test_a_lost_batch_is_run_again(spark):
    rollup = TokenRollup(spark, Store(spark, "tokens").folder + "/r")
    row = (1, "s", "en", "v1", 5, "insert")
    # What a job wrote before it was lost, without its mark, does not count.
    for kind in ("log", "sums"):
        path = f"{rollup.folder}/{kind}/1"
        spark.sql("select 1L doc_id, 's' source, 'en' lang, 'v1' tokenizer, 1L n_docs, 99L n_tokens"
                  ).write.parquet(path)
    assert totals(rollup) == {}
    assert commit(rollup, "1", [row]) and totals(rollup) == {("s", "en", "v1"): (1, 5)}


def test_awkward_changes(spark):
    rollup = TokenRollup(spark, Store(spark, "tokens").folder + "/r")
    rows = [(1, None, None, "v", 5, "insert")] * 2 + [(1, None, None, "v", 3, "insert")]
    rows += [(2, "s", None, "v", None, "insert"), (None, "s", "x", "v", 4, "insert")]
    rows += [(3, "s", "x", "v", 9, "insert"), (3, "s", "x", "v", 9, "delete")]
    rows += [(4, "s", "x", "v", 9, "delete")]
    assert commit(rollup, "a", rows)
    expected = {(None, None, "v"): (1, 5), ("s", None, "v"): (1, 0), ("s", "x", "v"): (1, 4)}
    assert totals(rollup) == expected
    assert commit(rollup, "b", [(None, "s", "x", "v", 6, "revise")])
    assert totals(rollup)["s", "x", "v"] == (1, 6)


def encoding(name):
    with open(f"{TOKENIZERS}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_whole_texts(spark):
    texts = ["Hello world", None, "", "é" * 5000, "<|endoftext|>", "x " * 50_000]
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)],
                               "doc_id bigint, text string, n_tokens string")
    enc = encoding("byte_bpe_50k")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "byte_bpe_50k", TOKENIZERS).collect()}
    assert got == {k: len(enc.encode_ordinary(t or "")) for k, t in enumerate(texts)}


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\t", "\u00a0", "\u2003 "])
def test_long_runs_are_cut_as_the_pattern_cuts(run):
    enc = encoding("byte_bpe_50k")
    for n in (999, 1000, 1001, 4000):
        for text in (run * n, f"a{run * n}b", f"a {run * n}\nb", f"{run * n}'s x{run * n}", f"x{run * n}\x1c1"):
            assert n_tokens(enc, text) == len(enc.encode_ordinary(text)), (n, text[:3])


def test_ten_megabytes_of_blanks_and_line_ends(spark):
    """Counts are the sum of the pieces'; a run of a million overflows the pattern's own stack."""
    size = 10 << 20
    texts = [" " * size, "\n" * size, "a" + " " * size + "b", "a" + "\n" * size + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    enc = encoding("byte_bpe_50k")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "byte_bpe_50k", TOKENIZERS).collect()}
    one = {c: len(enc._encode_single_piece(c * (size - 1))) for c in " \n"}
    last = {0: 1, 1: 1 if len(enc._encode_single_piece("\n" * size)) > one["\n"] else 0}
    assert got[0] == one[" "] + last[0] and got[1] == one["\n"] + last[1]
    assert got[2] == 1 + one[" "] + len(enc.encode_ordinary(" b"))
    assert got[3] == 1 + one["\n"] + len(enc.encode_ordinary("\nb"))


def test_the_log_is_reduced_to_the_batch_before_it_is_added_up(spark):
    rollup = TokenRollup(spark, Store(spark, "tokens").folder + "/r")
    commit(rollup, "1", [(k, "s", "en", "v", k, "insert") for k in range(50)])
    named = spark.createDataFrame([(3, "v"), (7, "v"), (None, "v")], "id bigint, t string")
    present = rollup.documents(named)
    lines = present._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {word: next(k for k, line in enumerate(lines) if word in line) for word in ("Aggregate", "LeftSemi")}
    assert at["Aggregate"] < at["LeftSemi"]
    assert {r.doc_id: r.n_tokens for r in present.collect()} == {3: 3, 7: 7}


def test_query_equals_recounting(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    enc, first, want = encoding("byte_bpe_50k"), {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)

    def add(row, tokenizer, n):
        key = (row.source, row.lang, tokenizer)
        have = want.get(key, (0, 0))
        want[key] = (have[0] + 1, have[1] + n)

    for r in docs:
        add(r, "utf8_bytes", len((r.text or "").encode()))
        if r.text is None or first[r.text] == r.doc_id:
            once = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            add(r, "byte_bpe_50k", len(enc.encode_ordinary(once)))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens)
           for r in op3_token_rollup(spark, SF_DIR).collect()}
    assert got == want
