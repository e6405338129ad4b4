from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomtally.functions import rules as R
from loomtally.functions import text

SPACES = [" ", "\t", "\x1c", "\x85", "\xa0", " "]
ALPHABET = list("abcXYZ 0123456789().,=<>-") + SPACES + ["é", "χ", "\x02", "\U0001d6d8"]


def _random_line(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def _reflowed(line):
    out = []
    while len(line) > R.REFLOW_TRIGGER:
        at = line.rfind(" ", R.TARGET_WIDTH // 2, R.TARGET_WIDTH)
        at = at if at > 0 else R.TARGET_WIDTH
        out.append(line[:at])
        line = line[at:].lstrip()
    return "\n".join([*out, line])


def test_reflow_against_a_loop(spark):
    rng = random.Random(3)
    lines = [_random_line(rng, rng.choice([0, 50, 179, 180, 181, 300, 700])) for _ in range(150)] + ["x" * 400, "", "a b" * 200]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", text.reflow(F.col("t")).alias("r")).orderBy("i").collect()
    for r, line in zip(got, lines):
        assert r["r"] == _reflowed(line), repr(line)


def test_line_ends(spark):
    got = spark.createDataFrame([("a\r\nb\rc",)], "t string").select(text.reflow(F.col("t"))).first()[0]
    assert got == "a\nb\nc"


def test_density_and_keeping(spark):
    rng = random.Random(5)
    lines = [_random_line(rng, rng.randint(0, 60)) for _ in range(200)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").select("i", text.density(F.col("t")).alias("d"), text.keeps_line(F.col("t")).alias("k")).orderBy("i").collect()
    for r, x in zip(got, lines):
        d = 1 - sum(c.isalpha() for c in x) / len(x) if x else 0.0
        assert abs(r["d"] - d) < 1e-12
        assert r["k"] == (len(x) >= 20 and any(c in "0123456789" for c in x) and d >= 0.2)


def _spans(lines, i):
    n = 2
    while True:
        lo, hi = max(0, i - n), min(len(lines), i + n + 1)
        if n >= 8 or sum(len(x) + 1 for x in lines[lo:hi]) >= 250:
            return lo, hi - 1
        n += 1


def test_grown_windows_against_a_loop(spark):
    rng = random.Random(8)
    docs = []
    for i in range(40):
        docs.append((i, "\n".join(_random_line(rng, rng.choice([0, 15, 25, 60, 120])) for _ in range(rng.randint(1, 30)))))
    w = text.with_grown_windows(spark.createDataFrame(docs, "i int, t string"), "t").orderBy("i").collect()
    for r, (_, t) in zip(w, docs):
        lines = t.split("\n")
        for x in r["windows"]:
            assert (x["start_line"], x["end_line"]) == _spans(lines, x["line"])
            assert x["text"] == "\n".join(lines[x["start_line"] : x["end_line"] + 1])


def test_references_are_blanked(spark):
    body = ["Some text of a body line here"] * 10
    doc = "\n".join([*body, "References", "Writer, A. (1999). Title. Journal, 3, 1-9.", "more"])
    r = text.with_stripped(spark.createDataFrame([(doc,)], "t string"), "t", "ls", "n").first()
    assert r["ls"][:10] == body and r["ls"][10:] == ["", "", ""] and r["n"] == 13
    one = "A column (1999) that is long " + "x" * 300
    assert text.with_stripped(spark.createDataFrame([(one,)], "t string"), "t", "ls", "n").first()["ls"] == [one]
    assert text.with_dropped(spark.createDataFrame([(doc,)], "t string"), "t", "ls").first()["ls"] == body


def test_renaming_damaged_operators(spark):
    def run(t):
        r = text.with_normalised(spark.createDataFrame([(t,)], "t string"), "t", "n").first()
        return r["n"], r["_renamed"]

    assert run("t(3) Ͼ 2 and p Ͽ .05, t(4) Ͼ 3") == ("t(3) \x01 2 and p \x02 .05, t(4) \x01 3", {"Ͼ": "\x01", "Ͽ": "\x02"})
    assert run("t(3) \x01 2 χ2 − 3")[1] == {}  # control characters and protected symbols stay
    full = "".join(map(chr, range(1, 9))) + " t(3) Ͼ 2"
    assert run(full) == (full, {})


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    got = text.with_grown_windows(text.with_normalised(df, "t", "n"), "n").collect()
    assert got[0]["n"] is None and got[0]["windows"] is None and got[1]["n"] == "" and got[1]["windows"] == []


def test_families_and_pools(spark):
    q = ["t(3) = 245, p = 003", "t(3) \x02 2", "t ¼ 3", "p \\ .05", ") b 3", "p N .3", "v2(3) = 4", "p ! .05", "plain", None]
    want = [f[0] for f in R.DAMAGE_FAMILIES] + ["other damage"] * 2
    got = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "i int, q string").select("i", text.damage_family(F.col("q")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == want
    lines = ["the t(23) = 2.45 result 12345", "the chi2(1, N = 22) = 2.45 result 99", "words and words without numbers", "M = 3.2 and SD = 1.1 (n = 12)", "1234567 12345678 (12345) 1234"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, q string").select("i", text.pool(F.col("q"), F.col("q")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == ["A", "AN", "C", "B2", None]
