"""Numbers and codes as papers print them, all native."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtally.functions import rules as R

_NUMERIC = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"
_ENDS = f"^[{R.SPACE}]+|[{R.SPACE}]+$"


def _double(text: Column) -> Column:
    return F.when(text.rlike(_NUMERIC), text).try_cast("double")


def printed_number(text: Column) -> Column:
    """The pipeline's reader: minus forms, a leading operator; null for anything else."""
    t = F.regexp_replace(text, _ENDS, "")
    t = F.regexp_replace(t, "[−–]", "-")
    t = F.regexp_replace(F.regexp_replace(t, "^[<>=]+", ""), _ENDS, "")
    return _double(t)


def _clean(text: Column) -> Column:
    minus = text.rlike("^[-−–]")
    t = F.when(minus, F.regexp_replace(F.regexp_replace(text, "^[-−–]", ""), _ENDS, "")).otherwise(text)
    t = F.regexp_replace(t, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
    value = _double(t)
    return F.when(minus, -value).otherwise(value)


def as_number(text: Column) -> Column:
    """The evaluation's reader: as above plus thousands commas, four decimals.

    A control character at either end is taken off only where the text does not read otherwise; the
    sign it stood for is lost, so the magnitude is given.
    """
    t = F.regexp_replace(text, _ENDS, "")
    bare = F.regexp_replace(F.regexp_replace(t, r"^[\x00-\x1f]|[\x00-\x1f]$", ""), _ENDS, "")
    return F.round(F.coalesce(_clean(t), F.when(bare != t, F.abs(_clean(bare)))), 4) + F.lit(0.0)  # no negative zero


_PLAIN = re.compile(_NUMERIC)


def _read(text: str) -> float | None:
    minus = text[:1] in ("-", "−", "–") and text != ""
    t = text[1:].strip() if minus else text
    t = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", t)
    if not _PLAIN.match(t):
        return None
    return -float(t) if minus else float(t)


def read_number(value) -> float | None:
    """``as_number`` for code that runs inside Arrow batches."""
    t = "" if value is None else str(value).strip()
    v = _read(t)
    if v is None and t:
        bare = re.sub(r"^[\x00-\x1f]|[\x00-\x1f]$", "", t).strip()
        v = _read(bare) if bare != t else None
        v = None if v is None else abs(v)
    return None if v is None else round(v, 4) + 0.0


def leading_operator_removed(text: Column) -> Column:
    return F.regexp_replace(text, "^[<>=]+", "")


def test_type(value: Column) -> Column:
    """t, F, r, z, chi2, Q, or null."""
    v = F.lower(F.regexp_replace(value, _ENDS, ""))
    return (
        F.when(v.isin("t", "r", "z"), v).when(v.isin("f", "q"), F.upper(v))
        .when(v.isin("chi2", "chi²", "chi-square", "x2", "χ2"), F.lit("chi2"))
    )


def operator(value: Column) -> Column:
    v = F.regexp_replace(value, _ENDS, "")
    return F.when(v.isin("≤", "le"), F.lit("<")).when(v.isin("≥", "ge"), F.lit(">")).when(v.isin("=", "<", ">"), v)


def part_label(name: Column, op: Column) -> Column:
    """Entity of a dataset part; POP takes the operator's."""
    pop = F.when(F.lit(False), F.lit(""))
    for sign, entity in R.OPERATOR_ENTITY.items():
        pop = pop.when(op == sign, F.lit(entity))
    return F.when(name == "POP", pop).when(name.isin(*R.ENTITIES), name)


def printed_decimals(raw: Column, value: Column) -> Column:
    """The first number in ``raw`` that equals ``value``, as printed; else the value's own text."""
    tokens = F.regexp_extract_all(F.regexp_replace(raw, "\n", " "), F.lit(r"\d*\.\d+|\d+"), F.lit(0))
    hit = F.try_element_at(F.filter(tokens, lambda x: x.try_cast("double") == value), F.lit(1))
    return F.coalesce(hit, value.cast("string"))


def checkable(statistic: Column, df1: Column, p_value: Column) -> Column:
    return F.coalesce((statistic != "") & (df1 != "") & (p_value != ""), F.lit(False))
