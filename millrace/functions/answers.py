"""Answers and scores: extraction, exact rationals, validation of raw values, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"
NUMBER = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"


def numeric(text: Column) -> Column:
    """A plain or thousands-grouped decimal, exactly; null for anything else."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), F.replace(t, F.lit(","), F.lit("")).try_cast(EXACT))


def final_answer(text: Column) -> Column:
    """The number after the last ####."""
    return F.when(F.contains(text, F.lit("####")), numeric(F.substring_index(text, "####", -1)))


def final_answer_matches(response: Column, reference: Column) -> Column:
    """1.0 or 0.0; null where the reference has no valid number (an error, not a zero)."""
    expected = numeric(F.substring_index(reference, "####", -1))
    return F.when(expected.isNotNull(), F.coalesce(final_answer(response) == expected, F.lit(False)).cast("double"))


def boxed(text: Column) -> Column:
    """What the last \\boxed{} holds."""
    found = F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]+)\}"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def rational(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a decimal or of a/b; null where it is neither or b is 0."""
    t = F.trim(text)
    part = F.when(t.rlike(r"^[+-]?\d+/\d+$"), F.split(t, "/"))
    a = F.when(part.isNotNull(), F.get(part, 0)).when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), t)
    b = F.when(part.isNotNull(), F.get(part, 1)).when(a.isNotNull(), F.lit("1"))
    b = b.try_cast("decimal(19,0)")
    return F.when(b != 0, a.try_cast("decimal(19,9)")), F.when(b != 0, b)


def rationals_equal(x: Column, y: Column) -> Column:
    """Compared by crosswise products, so that 1/3 is 2/6."""
    (a, b), (c, d) = rational(x), rational(y)
    return F.coalesce(a * d == c * b, F.lit(False))


def boxed_matches(response: Column, reference: Column) -> Column:
    return rationals_equal(boxed(response), reference).cast("double")


def raw_error(raw: Column, kind: Column) -> Column:
    """Why a raw score is no score: by the kind that it had (number, bool, null, object, ...)
    before it became a double; null where it is one."""
    return (
        F.when(kind == "bool", "COMPONENT_BOOL_REJECTED")
        .when(kind == "nonfinite", "COMPONENT_NON_FINITE")
        .when(kind != "number", "COMPONENT_RETURN_TYPE")
        .when(raw.isNull(), "COMPONENT_RETURN_TYPE")
        .when(F.isnan(raw) | (F.abs(raw) == float("inf")), "COMPONENT_NON_FINITE")
    )


def scaled(value: Column, low: Column, high: Column, clamp: bool = True) -> Column:
    """Linear; null where the range has no width or, unclamped, the result leaves [0, 1]."""
    x = F.try_divide(value - low, high - low)
    if clamp:
        return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return F.when(x.between(0.0, 1.0), x)


def as_is(value: Column) -> Column:
    """A value that is in [0, 1] already; null otherwise."""
    return F.when(value.between(0.0, 1.0), value)


def raw_kind(json: Column) -> Column:
    """The kind of a JSON value: number, bool, null, string, array, object or nonfinite."""
    t = F.trim(json)
    return (
        F.when(t.isNull() | (t == "null"), "null")
        .when(t.isin("true", "false"), "bool")
        .when(t.rlike(r'^\{\s*"__nonfinite__"') | t.isin("NaN", "Infinity", "-Infinity"), "nonfinite")
        .when(t.startswith("{"), "object")
        .when(t.startswith("["), "array")
        .when(t.startswith('"'), "string")
        .when(t.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "number")
        .otherwise("invalid")
    )
