"""Distribution tails and the consistency check, vectorised over Arrow batches.

The p-value of a t, F, r, z, chi-square or Q statistic is a regularised incomplete beta or gamma
function or the normal tail. The check then asks whether the printed p-value can come from the
printed statistic, both being rounded. No model has a say here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import rules as R

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(np.float64)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < _TINY, _TINY, x)


#: Factors this close to 1 change no digit of a double any more.
_CLOSE = 3e-16


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz, all open rows at once."""
    out = np.empty_like(x)
    at = np.arange(len(x))
    c = np.ones_like(x)
    d = 1 / _away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 20_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = h
        for num in (even, odd):
            d = 1 / _away(1 + num * d)
            c = _away(1 + num / c)
            h = h * d * c
        done = np.abs(h - before) <= _CLOSE * np.abs(h)
        if done.any():  # rows that are done leave, so that a slow one does not hold them
            out[at[done]] = h[done]
            go = ~done
            at, a, b, x, c, d, h = (v[go] for v in (at, a, b, x, c, d, h))
            if not len(at):
                return out
    out[at] = h
    return out


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b); ``y`` is 1 - x, given apart so that neither loses digits."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (a, b, x, y)))
    out = np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, np.nan))
    todo = (x > 0) & (y > 0)
    if todo.any():
        a, b, x, y = a[todo], b[todo], x[todo], y[todo]
        swap = x > (a + 1) / (a + b + 2)
        p, q = np.where(swap, b, a), np.where(swap, a, b)
        u, v = np.where(swap, y, x), np.where(swap, x, y)
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + p * np.log(u) + q * np.log(v)) / p
        part = front * _beta_fraction(p, q, u)
        out[todo] = np.where(swap, 1 - part, part)
    return out


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=np.float64), np.asarray(x, dtype=np.float64))
    out = np.where(x <= 0, 1.0, np.nan)
    front = np.zeros_like(a)
    todo = x > 0
    front[todo] = np.exp(a[todo] * np.log(x[todo]) - x[todo] - _log_gamma(a[todo]))
    series = todo & (x < a + 1)
    if series.any():
        p, u = a[series], x[series]
        term = 1 / p
        total, k = term.copy(), p.copy()
        for _ in range(100_000):
            k = k + 1
            term = term * u / k
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-17).all():
                break
        out[series] = 1 - front[series] * total
    rest = todo & ~series
    if rest.any():
        p, u = a[rest], x[rest]
        b = u + 1 - p
        c = np.full_like(u, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            num = -i * (i - p)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if (np.abs(d * c - 1) < _CLOSE).all():
                break
        out[rest] = front[rest] * h
    return out


def p_values(test: np.ndarray, stat: np.ndarray, df1: np.ndarray, df2: np.ndarray, one_tailed: np.ndarray | None = None) -> np.ndarray:
    """Two-tailed p-values (halved where ``one_tailed``, for t, r and z); NaN where there is none."""
    n = len(stat)
    out = np.full(n, np.nan)
    bad = np.isnan(stat) | (df1 <= 0) | (df2 <= 0)
    with np.errstate(all="ignore"):
        s2 = stat * stat
        for name in ("t", "r"):
            k = (test == name) & ~bad & ~np.isnan(df1)
            if name == "r":
                k &= np.abs(stat) < 1
            if k.any():
                sq = s2[k] if name == "t" else s2[k] * df1[k] / (1 - s2[k])
                out[k] = beta_inc(df1[k] / 2, np.full(k.sum(), 0.5), df1[k] / (df1[k] + sq), sq / (df1[k] + sq))
        k = (test == "z") & ~bad
        if k.any():
            out[k] = _erfc(np.abs(stat[k]) / math.sqrt(2)).astype(np.float64)
        k = (test == "f") & ~bad & ~np.isnan(df1) & ~np.isnan(df2)
        if k.any():
            f = np.maximum(stat[k], 0)
            whole = df2[k] + df1[k] * f
            out[k] = beta_inc(df2[k] / 2, df1[k] / 2, df2[k] / whole, df1[k] * f / whole)
        k = np.isin(test, ("chi2", "q")) & ~bad & ~np.isnan(df1)
        if k.any():
            out[k] = gamma_upper(df1[k] / 2, np.maximum(stat[k], 0) / 2)
    if one_tailed is not None:
        half = one_tailed & np.isin(test, ("t", "r", "z"))
        out[half] /= 2
    return out


def decimals(text) -> int:
    """Digits after the point of a number as text."""
    return len(str(text).partition(".")[2])


def _printed(text, value: float) -> str:
    """The printed statistic if it reads back as the value, else the value's shortest text."""
    try:
        if text is not None and float(text) == value:
            return text
    except (TypeError, ValueError):
        pass
    return repr(float(value))


CHECK = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("computed_p", T.DoubleType()),
        T.StructField("reported_p", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
    ]
)


def describe_missing(parts: list[str]) -> str:
    names = [R.PART_NAMES.get(p, p) for p in parts]
    if not names:
        return ""
    head = " and ".join(filter(None, [", ".join(names[:-1]), names[-1]]))
    return f"{head} found beside this result"


def missing_parts(test: str | None, stat, df1, df2, op: str | None, p) -> list[str]:
    """Parts the check needs and the result lacks, in a fixed order."""
    name = (test or "").strip().lower()
    have = {"df1": df1, "df2": df2}
    out = [] if name else ["test_type"]
    out += ["statistic"] * (stat is None)
    out += [d for d in R.REQUIRED.get(name, ("df1",)) if have[d] is None]
    if p is None:
        out.append("p_value")
    elif op not in ("=", "<", ">"):
        out.append("p_operator")
    return out


def check_batch(frame: pd.DataFrame, alpha: float = R.ALPHA) -> pd.DataFrame:
    """Verdicts for test, statistic, df1, df2, op, p, p_text, stat_text (and one_tailed)."""
    n = len(frame)

    def number(c: str) -> np.ndarray:
        return pd.to_numeric(frame[c], errors="coerce").to_numpy(dtype=np.float64) if n else np.zeros(0)

    stat, df1, df2, p = map(number, ("statistic", "df1", "df2", "p"))
    names = np.array([(x or "").strip().lower() for x in frame["test"].where(frame["test"].notna(), None)], dtype=object)
    one = frame["one_tailed"].fillna(False).to_numpy(dtype=bool) if "one_tailed" in frame else np.zeros(n, dtype=bool)
    computed = p_values(names, stat, df1, df2, one)
    texts = [None if pd.isna(x) else x for x in frame["stat_text"]]
    half = np.array([0.5 / 10 ** decimals(_printed(t, s)) if not math.isnan(s) else math.nan for t, s in zip(texts, stat)])
    sign = np.where(stat >= 0, 1.0, -1.0)
    up = p_values(names, stat - sign * half, df1, df2, one)
    low = p_values(names, stat + sign * half, df1, df2, one)
    none = np.isnan(up) | np.isnan(low)
    up, low = np.where(none, computed, up), np.where(none, computed, low)
    ops = [None if pd.isna(x) else x for x in frame["op"]]
    p_texts = [None if pd.isna(x) else x for x in frame["p_text"]]
    rows = []
    for i in range(n):
        have = [None if math.isnan(v) else v for v in (stat[i], df1[i], df2[i], p[i])]
        lost = missing_parts(names[i], have[0], have[1], have[2], ops[i], have[3])
        rows.append(_verdict(computed[i], low[i], up[i], ops[i], have[3], p_texts[i], lost, alpha))
    return pd.DataFrame(rows, columns=CHECK.fieldNames())


def _verdict(computed: float, low: float, up: float, op: str | None, p: float | None, p_text: str | None, lost: list[str], alpha: float):
    """One verdict from the interval of possible p-values and the printed claim."""
    if math.isnan(computed):
        return "undecidable", None, p, describe_missing(lost) or R.NO_P, lost
    if op == "ns":  # a claim about alpha
        op, claim = ">", alpha
    elif p is None or op not in ("=", "<", ">"):
        return "undecidable", computed, p, describe_missing(lost) or R.NO_CLAIM, lost
    else:
        claim = p
    if claim <= 0:
        wrong = True
    elif op == "=":
        places = decimals(claim if p_text is None else p_text)
        wrong = not round(low, places) <= claim <= round(up, places)
    else:
        wrong = claim < low if op == "<" else claim > up
    if not wrong:
        return "consistent", computed, claim, "", []
    real = computed <= alpha
    flips = {"=": (claim <= alpha) != real, "<": claim <= alpha and not real, ">": claim >= alpha and real}[op]
    if flips:
        return "decision_error", computed, claim, R.DISAGREE_ALPHA, []
    return "inconsistent", computed, claim, R.DISAGREE, []


_INPUT = ("test", "statistic", "df1", "df2", "op", "p", "p_text", "stat_text")


def check(test: Column, statistic: Column, df1: Column, df2: Column, op: Column, p: Column, p_text: Column | None = None, stat_text: Column | None = None, alpha: float = R.ALPHA) -> Column:
    """Struct (verdict, computed_p, reported_p, reason, missing) of a result given as columns.

    Without its text a number's decimals are those of its shortest form.
    """

    @F.pandas_udf(CHECK)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield check_batch(pd.DataFrame(dict(zip(_INPUT, columns))), alpha)

    null = F.lit(None).cast("string")
    return run(test, statistic, df1, df2, op, p, p_text if p_text is not None else null, stat_text if stat_text is not None else null)


def p_value(test: Column, statistic: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(test: pd.Series, statistic: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        names = np.array([(x or "").strip().lower() for x in test.where(test.notna(), None)], dtype=object)
        out = pd.Series(p_values(names, *(s.to_numpy(dtype=np.float64, na_value=np.nan) for s in (statistic, df1, df2))))
        return out.where(out.notna(), None)

    return run(test, statistic, df1, df2)


def chi2_even(statistic: Column, df: Column) -> Column:
    """Native closed form of the chi-square tail for even degrees of freedom: a finite sum."""
    x = statistic / 2
    k = F.sequence(F.lit(1), F.greatest(F.lit(1), (df / 2).cast("int") - 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = F.aggregate(k, start, lambda a, i: F.struct((a["term"] * x / i).alias("term"), (a["sum"] + a["term"] * x / i).alias("sum")), lambda a: a["sum"])
    return F.exp(-x) * F.when(df <= 2, F.lit(1.0)).otherwise(step)
