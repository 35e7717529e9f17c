"""Quality rules: robust multivariate outliers of text statistics, in DataFrame functions only.

Each text gives base statistics and a vector of transformed ones. Within a language and source the
minimum-covariance-determinant estimate of centre and scatter is approached by concentration steps:
the half-sample (``support`` of the rows) with the smallest distances gives the next mean and
covariance. There are three starts, all from medians and median deviations, which stand up to half
of the rows: no correlation, that of the rows' directions, and that of values bounded by tanh. After
two steps only the start with the least determinant goes on, until that no longer falls; of all
steps the least determinant counts. A text whose Mahalanobis distance is beyond the cut-off is
rejected.

Statistics are computed within a row: shingles of a text are sorted in an array, never exploded,
so nothing is shuffled for them. The vectors are stored once, narrow. A step is one pass over them:
each row's distance puts it into a bin (``bins`` to a doubling), counts and moments of a bin are
partial sums, and the half-sample is the nearest bins that hold half of the rows, whole. Estimates
meet the rows in a join on the group, whose hot side adaptive execution can split.

A group with fewer than ``least_rows`` rows that pass the base rule is judged by the estimate of its
whole language; a language with fewer by that of all documents. If these are too few as well, their
medians and median deviations judge, without correlation. ``judged_by`` says which one did.

Statistics that are constant in most texts (no symbol, no repeated line) have no scatter of their
own, so no standard deviation is below the resolution of measurement: what one more word,
character, symbol or repeated line, or the least repetition of a window, makes of the statistic in
a text of the group's median size. It is a maximum, so a statistic that scatters more is not
touched; the factor that makes up for the left-out rows is that of as many dimensions as do.

Awkward input: a null text has no words and fails the base rule; a null language or source counts
as an empty one. Very long texts are counted whole, in one row. Rows at equal distances are in one
bin and are taken or left together. Repeated rows count and are answered each. Null ids stay. An
empty table gives an empty result. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store

_SEPARATORS = " \t\n\v\f\r"
_SPLIT = "[\\x09-\\x0D\\x20]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class OutlierParams:
    least_words: int = 50
    #: A text fails when this percentage of its words is in repeated windows.
    repeat_percent: int = 50
    support: float = 0.5
    #: Steps of every start, before the least determinant goes on alone.
    first_steps: int = 2
    #: A fall of the logarithm of a determinant that is none.
    least_fall: float = 1e-3
    #: Bins of squared distances between a value and its double.
    bins: int = 32
    #: Probability beyond the cut-off for texts of a normal distribution.
    tail: float = 1e-3
    #: Rows of a group that has an estimate of its own: five to a dimension.
    least_rows: int = 25
    accuracy: int = 2000


VECTOR = ("log_words", "log_word_length", "symbol_rate", "repeated_lines", "repeated_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _occurrences(text: Column, characters: str) -> Column:
    """How often ASCII characters occur in a text."""
    size = F.octet_length(text)
    return reduce(
        lambda a, b: a + b,
        (size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters),
    )


def words_in_repeated_windows(words: Column, width: int = 3) -> Column:
    """How many words of an array stand in a window of ``width`` words that occurs twice."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)),
        lambda i: F.struct(
            F.xxhash64(*(F.element_at(words, i + k) for k in range(width))).alias("h"),
            i.alias("i"),
        ),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = let(
        F.array_sort(windows),
        lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) >= width + 1, covered).otherwise(0)


def base_statistics(docs: DataFrame, params: OutlierParams) -> DataFrame:
    """doc_id, lang, source and the base statistics of whole texts, in one pass per row."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x09-\\x0D\\x20]"))
    counted = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                words_in_repeated_windows(w).cast("bigint").alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            ),
        ).alias("l"),
        (F.length(text) - _occurrences(text, _SEPARATORS)).cast("bigint").alias("word_chars"),
        _occurrences(text, _SYMBOLS).cast("bigint").alias("n_symbols"),
    )
    return counted.select(
        "doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines",
        "w.n_repeat_words", "l.n_lines",
        (
            (F.col("w.n_words") < params.least_words)
            | (100 * F.col("w.n_repeat_words") > params.repeat_percent * F.col("w.n_words"))
        ).alias("base_failed"),
    )


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    values = (
        F.log1p("n_words"),
        F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return [value.alias(name) for name, value in zip(VECTOR, values, strict=True)]


def _gamma_share(shape: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / shape
    k = 0
    while term > total * 1e-16 and k < 10_000:
        k += 1
        term *= x / (shape + k)
        total += term
    return min(1.0, total * math.exp(shape * math.log(x) - x - math.lgamma(shape)))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        if _gamma_share(degrees / 2, middle / 2) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


D = len(VECTOR)
#: Parts of a cell in a join with what is known of it.
SALTS = 16
_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _cholesky(estimate: DataFrame) -> DataFrame:
    """Columns l_i_j of the lower triangular factor of c_i_j, one group a row."""
    for j in range(D):
        square = F.col(f"c_{j}_{j}")
        for k in range(j):
            square = square - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        columns = {f"l_{j}_{j}": F.sqrt(F.greatest(square, F.lit(1e-9)))}
        estimate = estimate.withColumns(columns)
        below = {}
        for i in range(j + 1, D):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = value / F.col(f"l_{j}_{j}")
        estimate = estimate.withColumns(below) if below else estimate
    return estimate


_CENTRE = [f"m_{i}" for i in range(D)]
_FLOORS = [f"f_{i}" for i in range(D)]
_ESTIMATE = _CENTRE + [f"l_{i}_{j}" for i, j in _PAIRS]


def _with_distance(joined: DataFrame) -> DataFrame:
    """Squared Mahalanobis distances, by forward substitution, of rows with their estimate."""
    for i in range(D):
        value = F.col(VECTOR[i]) - F.col(f"m_{i}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        joined = joined.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
    total = reduce(lambda a, b: a + b, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D)))
    return joined.withColumn("distance", total)


def _met(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with what is known of their cell. Both are salted, so that where the cells are too many to
    be broadcast, a cell with a third of the rows is spread over tasks."""
    each = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(each, ["cell", "salt"])


def _consistency(support: float, degrees: int) -> float:
    """What the covariance of the ``support`` nearest rows of a normal distribution is short of."""
    at = chi_square_quantile(support, degrees)
    return support / _gamma_share(degrees / 2 + 1, at / 2)


def _scales(rows: DataFrame, params: OutlierParams, store: Store) -> DataFrame:
    """Per cell: rows, medians m_i, scales s_i from median deviations, and resolutions f_i, the least
    change of each of VECTOR in a text of median size."""
    median = lambda c: F.percentile_approx(c, 0.5, params.accuracy)
    medians = rows.groupBy("cell").agg(
        F.count("*").alias("rows"),
        *(median(v).alias(f"m_{i}") for i, v in enumerate(VECTOR)),
        *(F.greatest(median(c), F.lit(1)).alias(c) for c in ("word_chars", "n_lines")),
    )
    # The first of VECTOR rises with the words, so its median is that of the median words.
    words = F.greatest(F.expm1("m_0"), F.lit(1.0))
    least = (
        1 / words,
        1 / F.col("word_chars"),
        F.sqrt(1 / F.col("word_chars")),
        F.sqrt(1 / F.col("n_lines")),
        # A window of three words that occurs twice covers four words at least.
        F.sqrt(4 / words),
    )
    medians = store.keep(
        medians.select("cell", "rows", *_CENTRE, *(x.alias(f) for x, f in zip(least, _FLOORS, strict=True)))
    )
    away = [F.abs(F.col(v) - F.col(f"m_{i}")) for i, v in enumerate(VECTOR)]
    deviations = _met(rows, medians.select("cell", *_CENTRE)).groupBy("cell").agg(
        *(median(x).alias(f"d_{i}") for i, x in enumerate(away))
    )
    # 1.4826 median deviations are a normal distribution's standard deviation.
    scales = (F.greatest(F.col(f"d_{i}") * 1.4826, F.col(f"f_{i}")).alias(f"s_{i}") for i in range(D))
    return store.keep(deviations.join(medians, "cell").select("cell", "rows", *_CENTRE, *_FLOORS, *scales))


STARTS = ("plain", "directions", "bounded")


def _starts(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Centre and scatter factor of each cell and start."""
    parts = ("cell", *_CENTRE, *(f"s_{i}" for i in range(D)))
    scaled = _met(rows, scales.select(*parts)).select(
        "cell",
        *(((F.col(v) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, v in enumerate(VECTOR)),
    )
    length = F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(D))))
    forms = {
        "directions": lambda i: F.col(f"z_{i}") / F.greatest(length, F.lit(1e-9)),
        "bounded": lambda i: F.tanh(f"z_{i}"),
    }
    moments = scaled.groupBy("cell").agg(
        *(
            F.covar_pop(form(i), form(j)).alias(f"{name}_{i}_{j}")
            for name, form in forms.items()
            for i, j in _PAIRS
        )
    ).join(scales, "cell")

    def correlation(name: str, i: int, j: int) -> Column:
        if i == j or name == "plain":
            return F.lit(float(i == j))
        both = F.sqrt(F.col(f"{name}_{i}_{i}") * F.col(f"{name}_{j}_{j}"))
        return F.when(both > 0, F.col(f"{name}_{i}_{j}") / both).otherwise(0.0)

    each = F.array(
        *(
            F.struct(
                F.lit(name).alias("start"),
                *(
                    (correlation(name, i, j) * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}")
                    for i, j in _PAIRS
                ),
            )
            for name in STARTS
        )
    )
    starts = moments.select("cell", "rows", *_CENTRE, *_FLOORS, F.inline(each))
    return _cholesky(starts).select("cell", "start", "rows", *_FLOORS, *_ESTIMATE)


def _log_det() -> Column:
    return 2 * reduce(lambda a, b: a + b, (F.ln(f"l_{i}_{i}") for i in range(D)))


def concentrate(rows: DataFrame, estimate: DataFrame, params: OutlierParams) -> DataFrame:
    """The next estimate of each cell and start: mean and consistent covariance of its half-sample,
    variances at least f_i squared."""
    bin_ = F.floor(F.log2(F.greatest("distance", F.lit(1e-30))) * params.bins).cast("int")
    near = _with_distance(_met(rows, estimate))
    away = [F.col(VECTOR[i]) - F.col(f"m_{i}") for i in range(D)]
    binned = near.groupBy("cell", "start", bin_.alias("bin")).agg(
        F.count("*").alias("n"),
        *(F.sum(away[i]).alias(f"a_{i}") for i in range(D)),
        *(F.sum(away[i] * away[j]).alias(f"b_{i}_{j}") for i, j in _PAIRS),
    )
    all_bins = Window.partitionBy("cell", "start")
    nearer = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.ceil(F.sum("n").over(all_bins) * params.support)
    inside = binned.withColumn("before", F.sum("n").over(nearer) - F.col("n")).withColumn("half", half)
    sums = inside.where("before < half").groupBy("cell", "start").agg(
        F.sum("n").alias("n"),
        *(F.sum(f"a_{i}").alias(f"a_{i}") for i in range(D)),
        *(F.sum(f"b_{i}_{j}").alias(f"b_{i}_{j}") for i, j in _PAIRS),
    )
    known = estimate.select("cell", "start", "rows", *_FLOORS, *_CENTRE, F.col("log_det").alias("before"))
    found = sums.join(known, ["cell", "start"])
    share = [F.col(f"a_{i}") / F.col("n") for i in range(D)]
    plain = {f"c_{i}_{j}": F.col(f"b_{i}_{j}") / F.col("n") - share[i] * share[j] for i, j in _PAIRS}
    found = found.withColumns(plain)
    least = [F.col(f) * F.col(f) for f in _FLOORS]
    factors = [_consistency(params.support, k) for k in range(1, D + 1)]
    own = (F.col(f"c_{i}_{i}") * factors[-1] > least[i] for i in range(D))
    degrees = reduce(lambda a, b: a + b, (x.cast("int") for x in own))
    factor = F.get(F.array(*(F.lit(x) for x in [1.0, *factors])), degrees)
    scaled = {f"c_{i}_{j}": F.col(f"c_{i}_{j}") * F.col("factor") for i, j in _PAIRS}
    for i in range(D):
        scaled[f"c_{i}_{i}"] = F.greatest(scaled[f"c_{i}_{i}"], least[i])
    moved = {f"m_{i}": F.col(f"m_{i}") + share[i] for i in range(D)}
    return (
        _cholesky(found.withColumn("factor", factor).withColumns(scaled).withColumns(moved))
        .withColumn("log_det", _log_det())
        .select("cell", "start", "rows", *_FLOORS, *_ESTIMATE, "log_det", "before")
    )


def _least(found: DataFrame) -> DataFrame:
    """Of each cell the estimate with the least determinant."""
    rest = [c for c in found.columns if c not in ("cell", "log_det")]
    least = found.groupBy("cell").agg(F.min(F.struct("log_det", *rest)).alias("estimate"))
    return least.select("cell", "estimate.*")


def least_determinant(rows: DataFrame, params: OutlierParams, store: Store) -> DataFrame:
    """Centre, triangular scatter factor and ``log_det`` of each ``cell`` of rows with VECTOR, word_chars
    and n_lines.

    Cells with fewer than ``least_rows`` rows have medians and scales without correlation. Cells whose
    determinant has stopped falling take no further part.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = store.keep(rows.withColumn("salt", salt))
    scales = _scales(rows, params, store)
    starts = _starts(rows, scales).withColumn("log_det", F.lit(float("inf")))
    starts = store.keep(starts)
    enough = F.col("rows") >= params.least_rows
    few = starts.where(~enough & (F.col("start") == STARTS[0])).withColumn("before", F.col("log_det"))
    found = [few.select("cell", "start", "rows", *_FLOORS, *_ESTIMATE, "log_det", "before")]
    falling = starts.where(enough)
    for _ in range(params.first_steps):
        found.append(store.keep(concentrate(rows, falling, params)))
        falling = found[-1]
    falling = _least(falling)
    while not falling.isEmpty():
        found.append(store.keep(concentrate(rows, falling, params)))
        falling = found[-1].where(F.col("log_det") < F.col("before") - params.least_fall)
    return store.keep(_least(reduce(DataFrame.unionByName, found)).select("cell", *_ESTIMATE, "log_det"))


def _cells(passed: DataFrame, params: OutlierParams, store: Store) -> DataFrame:
    """Per language and source: ``cell`` and ``judged_by`` of its estimate, and all the cells ``fits``
    whose estimates its rows take part in."""
    groups = store.keep(passed.groupBy("lang", "source").agg(F.count("*").alias("n")))
    languages = store.keep(
        groups.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("smallest"))
    )
    # One row: whether any language is too small for an estimate of its own.
    rare = languages.agg(F.coalesce(F.min("of_lang") < params.least_rows, F.lit(False))).first()[0]

    def name(*parts) -> Column:
        return F.to_json(F.array(*parts))

    own, whole = F.col("n") >= params.least_rows, F.col("of_lang") >= params.least_rows
    group = F.when(own, name(F.lit("group"), "lang", "source"))
    language = F.when(whole, name(F.lit("language"), "lang"))
    everything = name(F.lit("all"))
    fits = F.array(
        group, F.when(F.col("smallest") < params.least_rows, language), F.when(F.lit(rare), everything)
    )
    return groups.join(languages, "lang").select(
        "lang",
        "source",
        F.coalesce(group, language, everything).alias("cell"),
        F.when(own, "group").when(whole, "language").otherwise("all").alias("judged_by"),
        F.array_compact(fits).alias("fits"),
    )


def reject_outliers(
    docs: DataFrame, params: OutlierParams | None = None, store: Store | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, the squared distance and judged_by."""
    params = params or OutlierParams()
    store = store or Store(docs.sparkSession, "outliers")
    stats = store.keep(base_statistics(docs, params))
    cells = _cells(stats.where("not base_failed"), params, store)
    celled = store.keep(stats.join(cells, ["lang", "source"], "left"))
    fitted = celled.where("not base_failed").select(
        F.explode("fits").alias("cell"), *_vector(), "word_chars", "n_lines"
    )
    estimate = least_determinant(fitted, params, store)
    cut = chi_square_quantile(1 - params.tail, D)
    judged = _with_distance(celled.select("*", *_vector()).join(estimate, "cell", "left"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"),
        "distance",
        F.when(~F.col("base_failed"), F.col("judged_by")).alias("judged_by"),
    )
