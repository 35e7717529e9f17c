"""Exposure classification on tiny answer tables."""

from itertools import combinations

import pytest

from cohortrail.plans.tables import patient_transport
from cohortrail.study import Study

STUDY = Study()
Q1, Q2 = STUDY.questions
SCHEMA = "PatientDurableKey long, Domain string, DisplayName string, AnswerText string"


def answer(patient, text, domain=STUDY.domain, question=Q1):
    return (patient, domain, question, text)


def statuses(spark, rows):
    out = patient_transport(spark.createDataFrame(rows, SCHEMA), STUDY).collect()
    return {r.PatientDurableKey: r.transport_status for r in out}


def expected_status(texts):
    """A yes outweighs all, then a no, then an answer that declines."""
    if STUDY.yes in texts:
        return "barrier"
    if STUDY.no in texts:
        return "no_barrier"
    return "declined" if set(texts) & set(STUDY.declined) else "other"


def test_every_set_of_answers(spark):
    texts = [STUDY.yes, STUDY.no, *STUDY.declined, "unclear", None]
    subsets = [c for n in range(1, len(texts) + 1) for c in combinations(texts, n)]
    rows = [answer(k, t) for k, subset in enumerate(subsets) for t in subset]
    assert statuses(spark, rows) == {k: expected_status(s) for k, s in enumerate(subsets)}


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        (
            [answer(8, STUDY.yes, "Other domain", "Other question"), answer(8, STUDY.no)],
            {8: "no_barrier"},
        ),
        ([answer(None, "Yes")], {}),
        ([answer(30, "Maybe"), answer(31, None)], {30: "other", 31: "other"}),
        ([answer(40, "Yes", question=Q2)], {40: "barrier"}),
        ([answer(50, "Yes", question="Another question"), answer(50, "No")], {50: "no_barrier"}),
        ([answer(60, "No"), answer(60, "Patient declined")], {60: "no_barrier"}),
    ],
)
def test_status(spark, rows, expected):
    assert statuses(spark, rows) == expected


def test_counts(spark):
    rows = [answer(1, "Yes"), answer(1, "Yes", question=Q2), answer(1, "No"), answer(1, "Maybe")]
    row = patient_transport(spark.createDataFrame(rows, SCHEMA), STUDY).first()
    assert (row.n_yes, row.n_no) == (2, 1)
    assert (row.transport_yes, row.transport_no, row.transport_declined) == (1, 1, 0)
