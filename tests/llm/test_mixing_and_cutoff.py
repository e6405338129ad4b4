from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomtally.llm import cutoff, mixing, queries

DOCS = "doc_id long, source string, text string"
TARGETS = "source string, target_share double, max_repeats int"


def _docs(spark):
    rng = random.Random(1)
    rows = []
    for s, n in (("big", 300), ("mid", 60), ("tiny", 6), ("free", 40)):
        rows += [(len(rows) + i, s, " ".join(rng.choice(["stone", "river", "glass", "of", "running"]) for _ in range(rng.randint(5, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 4), ("tiny", 0.2, 3), ("none", 0.0, 5)], TARGETS)
    m = mixing.mix(docs, targets, tilts={"mid": 0.9, "big": -0.5}).cache()
    r = {x["source"]: x for x in mixing.report(m, targets).collect()}
    assert r["tiny"]["most_passes"] == 3 and r["tiny"]["actual_share"] < 0.2
    assert r["big"]["actual_share"] / r["mid"]["actual_share"] == pytest.approx(5 / 3, rel=0.05)
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1)
    total = mixing.sizes(docs).agg(F.sum("tokens")).first()[0]
    assert m.agg(F.sum("tokens")).first()[0] == pytest.approx(total, rel=0.02)
    lo, hi = m.agg(F.min("position"), F.max("position")).first()
    assert 0 <= lo and hi <= 1
    assert m.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pass").alias("p")).where("n <> p").count() == 0
    late = {x["source"]: x["a"] for x in m.groupBy("source").agg(F.avg("position").alias("a")).collect()}
    assert late["mid"] > 0.55 > 0.5 > late["big"]
    first = [x["position"] for x in m.limit(50).collect()]
    assert first == sorted(first)


def test_curriculum_follows_its_schedule(spark, small):
    docs = _docs(spark)
    targets = spark.createDataFrame([("big", 0.6, 3), ("mid", 0.3, 9), ("free", 0.1, 9)], TARGETS)
    rows = mixing.curriculum(mixing.positioned(docs, targets, {"mid": 1.0, "big": -0.6})).collect()
    assert len(rows) == 30
    for k in range(10):
        part = [r for r in rows if r["part"] == k]
        assert sum(r["scheduled"] for r in part) == pytest.approx(1) and sum(r["actual"] for r in part) == pytest.approx(1)
    assert max(abs(r["scheduled"] - r["actual"]) for r in rows) < 0.03
    mid = {r["part"]: r["actual"] for r in rows if r["source"] == "mid"}
    assert mid[9] > 2.5 * mid[0]
    real = queries.p7_curriculum(spark, small).groupBy("part").agg(F.sum("scheduled").alias("s"), F.sum("actual").alias("a")).collect()
    assert len(real) == 10 and all(r["s"] == pytest.approx(1) and r["a"] == pytest.approx(1) for r in real)
    assert mixing.curriculum(mixing.positioned(docs.limit(0), targets)).count() == 0


def test_schedules_are_balanced_and_checked():
    rows = [{"source": s, "give": g, "tokens": g} for s, g in (("a", 900.0), ("b", 100.0))]
    got = {r[0]: r[3] for r in mixing.schedule(rows, {"a": 1.0, "b": -1.0})}
    assert got["a"] * 900 + got["b"] * 100 == pytest.approx(0) and max(map(abs, got.values())) <= 1
    with pytest.raises(ValueError):
        mixing.schedule(rows, {"a": 1.5})


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    df = spark.createDataFrame([(f"s{i}", 0.3, 1, 5) for i in range(3)], "source string, target_share double, max_repeats int, tokens long")
    with pytest.raises(ValueError):
        mixing.plan(df, 10)


def test_found_is_the_definition(spark, small):
    docs, targets = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/mix_targets.parquet")
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    total = sum(size.values())
    want = {t["source"] for t in targets.collect() if size.get(t["source"], 0) / total * t["max_repeats"] < t["target_share"]}
    assert {r[0] for r in queries.p7_found(spark, small).collect()} == want


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "some text"), (4, "b", "x y z"), (4, "b", "x y z")], DOCS).withColumn("tokens", F.lit(7)).withColumn("give", F.lit(7))
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, None), ("c", None, 2), (None, 0.1, 1)], TARGETS)
    s = {r["source"]: r for r in mixing.shortfalls(mixing.sizes(docs), targets).collect()}
    assert s["a"]["tokens"] == 0 and s["a"]["short"] and s["b"]["short"] and not s["c"]["short"]
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.found(docs, targets.limit(0)).count() == 0


def test_water_filling(spark):
    rows = [{"tokens": 10, "max_repeats": 1, "target_share": 0.5}, {"tokens": 100, "max_repeats": 2, "target_share": 0.25}, {"tokens": 100, "max_repeats": 1, "target_share": 0.25}]
    df = spark.createDataFrame([(f"s{i}", r["target_share"], r["max_repeats"], r["tokens"]) for i, r in enumerate(rows)], "source string, target_share double, max_repeats int, tokens long")
    got = {r["source"]: r["give"] for r in mixing.plan(df, 110)}
    assert got == {"s0": 10, "s1": pytest.approx(50), "s2": pytest.approx(50)}
    assert sum(r["give"] for r in mixing.plan(df, 10_000)) == pytest.approx(310)


WHOLE = [
    "All is said here.", "Why would it not?", "It ended so.\n\nReceived 12 June 2004", "It ended.\n\nEND", "It ended.\n\n* * *", "It ended.\n\n– 343 –", "It ended.\n\n[end of record]",
    "It ended. (Continued tests were null.)", "It ended. The rest is open…", "And so it remains ...", "See.\n\nTable 2\nMeasure  M  SD\nmood  5.26  4.99\nword naming  8.23  8.09",
    "It was so.\n\nNote: F(4, 291)=0.79, p>.05", "So, p = .05.", "It ended.\n\nReferences\nWriter, K. (2004). Lakes and boats. Journal of Water, 31, 109–392.", "It ended.\n\nLiteratur\nA, K. (2004). Lakes of old. Journal of X, 1, 1–3.\n",
    "He said “yes.”", None, "", "  \n", "It held, t(3) = 2.1, p < .001.", "Une baisse de 94.5 % a été observée après 34 essais.",
]
CUT = [
    "All is said he", "It ended. The next one was", "Ratings ranged from 2.5", "It ended. They were related, F(1, 2", "See.\n\nTable 2\nMeasure  M  SD\nmood  5.26  4.99\nword nam", "See.\n\nTable 2\nMeasure  M  SD\nmood  5.26  4.99\nword naming  8.2",
    "It ended.\n\nReferences\nWriter, K. (2004). Lakes and boats. Journal of Water, 31, 109–392.\nOther, L. (2001).", "It ended.\n\nReferences\nWriter, K. (2004). Lakes and boats. Jour", "It was, p = 0.", "He said th&am", "It was of\\u20", "The sample had <b", "Words were�",
    "It ended and,", "It ended.\n\nReceived 12 Jun", "It ended [cut off]\n[truncated]", "It ended. Mean mood was ",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(text):
    assert cutoff.ending(text, False) is None


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert cutoff.ending(text, False) is not None


def test_marks_count_at_a_limit():
    assert cutoff.ending("They were in the…", True) == "mark" and cutoff.ending("In all, it fell by 89.", True) == "number"
    assert cutoff.ending("It ended.", True) is None


def _limited(spark, limit, measure, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = ". ".join("Ünder “x” & y " + " ".join(rng.choice(["alpha", "bétà", "gamma\ndelta", "<e>"]) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 60))) + "."
        while measure(t) > limit:
            t = t[:-1]
        rows.append((i, "s", t))
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(
    "way,measure",
    [
        ("chars", len), ("utf8", lambda t: len(t.encode())), ("html_chars", lambda t: len(t) + 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * (t.count('"') + t.count("'"))),
        ("crlf_chars", lambda t: len(t) + t.count("\n")), ("json_chars", lambda t: sum(6 if c > "\x7f" else 2 if c in '"\\\n' else 1 for c in t)),
    ],
)
def test_hidden_limits_are_found(spark, way, measure):
    got = cutoff.limits(_limited(spark, 900, measure)).first()
    assert got is not None and got["way"] == way and got["limit"] == 900


def test_no_limit_where_none_is(spark):
    assert cutoff.limits(_limited(spark, 10**6, len)).count() == 0


def test_lengths_against_python(spark):
    import html
    import json

    texts = ["a&b<c>\"d'é\n\t\\\U0001d6d8", "plain", "", "χ²\r\n"]
    w = cutoff.ways("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(c.alias(n) for n, c in w.items())).collect()
    for r in rows:
        t = r["t"]
        assert r["chars"] == len(t) and r["utf8"] == len(t.encode()) and r["utf16"] == len(t.encode("utf-16-le")) // 2
        assert r["html_chars"] == len(html.escape(t, quote=True)) and r["json_chars"] == len(json.dumps(t)) - 2
        assert r["json_utf8"] == len(json.dumps(t, ensure_ascii=False).encode()) - 2 and r["crlf_chars"] == len(t) + t.count("\n")


def test_inspection(spark, small):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "cut he"), (3, "a", "Whole."), (3, "a", "Whole."), (4, "b", "x" * 300_000)], DOCS).withColumn("way", F.lit("clash")).withColumn("limit", F.lit(1)).withColumn("reason", F.lit("clash")).withColumn("len", F.lit(0))
    got = {r["doc_id"]: r["reason"] for r in cutoff.inspect(docs).collect()}
    assert got[1] is None and got[2] == "word" and got[3] is None and got[4] == "word"
    assert cutoff.inspect(docs).count() == 5 and cutoff.inspect(docs.limit(0)).count() == 0
    r = {x["source"]: x["rate"] for x in cutoff.rates(cutoff.inspect(docs)).collect()}
    assert r["a"] == 0 and r["b"] == 1 and r[None] == 1
    assert queries.p8_found(spark, small).count() > 0


def test_the_tail_tells_what_the_text_tells(spark, small):
    texts = [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + WHOLE + CUT + ["a\n \nb\n\n\nc\n\n", "x\r\n\r\ny", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", cutoff.tail(F.col("text")).alias("tail")).collect():
        for at in (False, True):
            assert cutoff.ending(r["text"], at) == cutoff.ending(r["tail"], at), r["text"]


def test_the_limit_is_a_reason(spark):
    sentence = "So it is said in full here. "
    rows = [(i, "s", (sentence * 40)[:500]) for i in range(6)] + [(10 + i, "s", sentence * (3 + i % 9)) for i in range(40)]
    got = {r["doc_id"]: r["reason"] for r in cutoff.inspect(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] is not None for i in range(6)) and all(got[10 + i] is None for i in range(40))
    whole = "x" * 471 + " " + sentence.strip() + "!"
    rows = [(i, "s", whole) for i in range(6)] + [(10 + i, "s", sentence * (3 + i % 9)) for i in range(40)]
    got = {r["doc_id"]: r["reason"] for r in cutoff.inspect(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i] for i in range(6)} == {"limit"}
