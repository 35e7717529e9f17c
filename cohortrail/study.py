"""The parameters of one study: which answers, index groups and calendar it uses."""

from __future__ import annotations

from dataclasses import dataclass

# The two survey questions and the answers that define the exposure groups.
TRANSPORT_QUESTIONS = (
    "In the past 12 months, has lack of transportation kept you from medical appointments "
    "or from getting medications?",
    "In the past 12 months, has lack of transportation kept you from meetings, work, "
    "or from getting things needed for daily living?",
)

# Diagnosis groups followed up, in display order, with their chart labels.
CHRONIC_GROUPS = (
    ("ICD-10-CM: I10", "Hypertension\n(I10)"),
    ("ICD-10-CM: E11", "Type 2 diabetes\n(E11)"),
    ("ICD-10-CM: N18", "CKD\n(N18)"),
    ("ICD-10-CM: I48", "AFib / flutter\n(I48)"),
)

# The two compared groups, in display order, with their cohort names.
COMPARED = (
    ("no_barrier", "No transport barrier"),
    ("barrier", "Transport barrier"),
)


@dataclass(frozen=True)
class Study:
    domain: str = "Transportation Needs"
    questions: tuple[str, ...] = TRANSPORT_QUESTIONS
    yes: str = "Yes"
    no: str = "No"
    declined: tuple[str, ...] = ("Patient declined", "Patient unable to answer")
    index_groups: tuple[tuple[str, str], ...] = CHRONIC_GROUPS
    compared: tuple[tuple[str, str], ...] = COMPARED
    first_year: int = 2022
    last_year: int = 2025
    reference_year: int = 2026
    age_range: tuple[int, int] = (0, 100)
    #: Quantiles from a sketch of fixed size instead of exact ones.
    approx: bool = False

    @property
    def years(self) -> int:
        return self.last_year - self.first_year + 1

    @property
    def group_codes(self) -> list[str]:
        return [code for code, _ in self.index_groups]

    @property
    def compared_statuses(self) -> list[str]:
        return [status for status, _ in self.compared]
