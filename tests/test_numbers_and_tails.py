from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtally.functions import numbers, tails

NAN = float("nan")


@pytest.mark.parametrize(
    "test,stat,df1,df2,p",
    [("t", 2.45, 34, NAN, 0.0195887), ("f", 5.1, 2, 30, 0.0124002), ("chi2", 8.69, 1, NAN, 0.0031996), ("z", 1.96, NAN, NAN, 0.0499958), ("r", 0.42, 30, NAN, 0.0167016)],
)
def test_known_p_values(test, stat, df1, df2, p):
    got = tails.p_values(np.array([test], dtype=object), np.array([stat]), np.array([df1], float), np.array([df2], float))[0]
    assert got == pytest.approx(p, rel=1e-4)


def test_no_p_value():
    t = np.array(["t", "f", "chi2", "r", "x", "t"], dtype=object)
    got = tails.p_values(t, np.array([1, 1, 1, 1.0, 1, NAN]), np.array([0, -1, 0, 30, 5, 5.0]), np.array([NAN, 3, NAN, NAN, NAN, NAN]))
    assert np.isnan(got).all()


def test_tails_fit_their_relations():
    """t squared is F with one numerator degree; Q halves the chi-square with two degrees in closed form."""
    df = np.array([1.0, 2, 7, 30, 1000])
    x = np.array([0.1, 1.3, 2.2, 5.0, 40.0])
    n = np.full(5, NAN)
    t = tails.p_values(np.array(["t"] * 5, dtype=object), x, df, n)
    f = tails.p_values(np.array(["f"] * 5, dtype=object), x * x, np.ones(5), df)
    assert t == pytest.approx(f, rel=1e-10)
    c = tails.p_values(np.array(["chi2"] * 5, dtype=object), x, np.full(5, 2.0), n)
    assert c == pytest.approx(np.exp(-x / 2), rel=1e-12)


CASES = [
    ("t", 2.45, 34, None, "=", 0.020, ".020", None, "consistent"), ("t", 2.45, 34, None, "=", 0.022, ".022", None, "inconsistent"),
    ("t", 1.8, 46, None, "=", 0.04, ".04", None, "decision_error"), ("r", 1.0, 30, None, "=", 0.001, ".001", None, "undecidable"),
    ("t", 1.48, 67, None, "=", 0.143, ".143", "1.48", "consistent"), ("t", 1.48, 67, None, "=", 0.143, ".143", "1.4800", "inconsistent"),
    ("t", 12.0, 30, None, "=", 0.0, ".000", None, "inconsistent"), ("t", 0.54, 178, None, "ns", None, None, None, "consistent"),
    ("t", 5.0, 178, None, "ns", None, None, None, "decision_error"), ("t", 2.70, 90, None, "<", 0.01, ".01", None, "consistent"),
    ("t", 2.70, 90, None, "<", 0.001, ".001", None, "inconsistent"), ("t", 0.88, 90, None, "<", 0.05, ".05", None, "decision_error"),
    (None, 7.42, 8, None, "=", 0.492, "0.492", None, "undecidable"), ("chi2", 7.42, 8, None, "=", 0.492, "0.492", None, "consistent"),
]


def test_verdicts(spark):
    schema = "test string, s double, df1 double, df2 double, op string, p double, pt string, st string, want string, i int"
    rows = [(t, s, None if a is None else float(a), b, o, p, pt, st, w, i) for i, (t, s, a, b, o, p, pt, st, w) in enumerate(CASES)]
    df = spark.createDataFrame(rows, schema)
    c = tails.check(*(F.col(x) for x in ("test", "s", "df1", "df2", "op", "p", "pt", "st")))
    got = df.select("i", "want", c.alias("c")).select("i", "want", "c.*").orderBy("i").collect()
    assert [r["verdict"] for r in got] == [r["want"] for r in got]
    assert got[12]["missing"][0] == "test_type"
    assert got[0]["computed_p"] == pytest.approx(0.0195887, rel=1e-5)


def test_check_of_nothing():
    assert tails.check_batch(pd.DataFrame(columns=["test", "statistic", "df1", "df2", "op", "p", "p_text", "stat_text"])).empty


def test_missing_sentence():
    assert tails.describe_missing(["df1", "p_value"]) == "no degrees of freedom and no p-value found beside this result"
    assert tails.describe_missing([]) == ""


def test_closed_form_matches(spark):
    df = spark.range(200).select((F.col("id") / 7 + 0.1).alias("x"), (2 * (1 + F.col("id") % 20)).cast("double").alias("d"))
    rows = df.select("x", "d", tails.chi2_even(F.col("x"), F.col("d")).alias("native"), tails.p_value(F.lit("chi2"), F.col("x"), F.col("d"), F.lit(None).cast("double")).alias("udf")).collect()
    assert all(r["native"] == pytest.approx(r["udf"], rel=1e-9) for r in rows)


def test_numbers(spark):
    texts = ["1,234.5", "2,45", "−0.35", "–.5", "-0.5", "\x030.45", "0.76\x0e", "\x03-0.95", "n.s.", "", None, " 7 ", "2.S4", "1e3"]
    want = [1234.5, None, -0.35, -0.5, -0.5, 0.45, 0.76, 0.95, None, None, None, 7.0, None, 1000.0]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(numbers.as_number(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == want
    assert [numbers.read_number(t) for t in texts] == want


def test_codes(spark):
    df = spark.createDataFrame([("Chi-square", "≤"), ("f", "ge"), ("q", "="), ("x2", "?"), (None, None)], "a string, b string")
    got = df.select(numbers.test_type(F.col("a")).alias("a"), numbers.operator(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("chi2", "<"), ("F", ">"), ("Q", "="), ("chi2", None), (None, None)]
