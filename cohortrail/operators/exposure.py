"""Exposure groups from questionnaire answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_answers(
    answers: DataFrame,
    *,
    entity: str,
    answer: str,
    yes: str,
    no: str,
    declined: tuple[str, ...],
    prefix: str = "transport",
) -> DataFrame:
    """One row per known entity: ever-flags, answer counts and a status.

    Any yes outranks any no, which outranks declining; anything else is 'other'. The flags are
    maxima and sums, so map-side partial aggregation shrinks an entity with very many answers.
    """
    said = F.col(answer)

    def ever(test) -> Column:
        return F.max(F.when(test, 1).otherwise(0))

    def times(test) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    flags = (
        answers.where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(
            ever(said == yes).alias(f"{prefix}_yes"),
            ever(said == no).alias(f"{prefix}_no"),
            ever(said.isin(*declined)).alias(f"{prefix}_declined"),
            times(said == yes).alias("n_yes"),
            times(said == no).alias("n_no"),
        )
    )
    return flags.withColumn(
        f"{prefix}_status",
        F.when(F.col(f"{prefix}_yes") == 1, "barrier")
        .when(F.col(f"{prefix}_no") == 1, "no_barrier")
        .when(F.col(f"{prefix}_declined") == 1, "declined")
        .otherwise("other"),
    )
