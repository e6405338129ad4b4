from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomtally.llm import overlap, queries


def _frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "record_id long, text string, set string, journal string")
    if extra:
        for c in ("a", "b", "k", "id", "train", "class_id", "keys", "form1", "_salt"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def _pairs(df):
    return {tuple(r) for r in overlap.found(df).collect()}


def test_against_all_pairs(spark, small):
    h = spark.read.parquet(f"{small}/holdout.parquet")
    rows = h.select("record_id", "set", "text").collect()
    train = [(r["record_id"], overlap.words(r["text"])) for r in rows if r["set"] == "train"]
    rest = [(r["record_id"], overlap.words(r["text"])) for r in rows if r["set"] != "train"]
    brute = {
        (min(a, b), max(a, b)) for a, x in train for b, y in rest
        if x and y and overlap.lcs_words(x, y) / max(len(x), len(y)) >= overlap.SIMILAR
    }
    got = {tuple(r) for r in queries.p1_found(spark, small).collect()}
    assert brute and got == brute
    assert queries.p1_report(spark, small).agg(F.sum("pairs")).first()[0] == len(brute)


BASE = "The placebo group differed from the control group in motivation, r(82) = .16, p = .146. We excluded 93 students whose letters fell outside the window. Novice couples reported more word naming than competitive drivers."


def test_changes_that_are_still_the_same(spark):
    fold = BASE.replace(" ", "\n", 5).replace("couples", "cou-\nples")
    alike = BASE.replace("placebo", "рlасebо").replace("control", "con​trol").replace("=", "\x03")
    typo = BASE.replace("motivation", "motivtaion").replace("students", "studnets")
    ends = "in fact " + BASE + " and so on"
    rows = [(1, BASE, "train", "j")] + [(i, t, "dev" if i % 2 else "holdout", "j") for i, t in enumerate([fold, alike, typo, ends, BASE.upper(), BASE], 2)]
    assert _pairs(_frame(spark, rows, extra=True)) == {(1, i) for i in range(2, 8)}


def test_no_case(spark):
    other = "The placebo group differed from the control group in motivation, r(82) = .16, p = .146. " + "Quite another sentence follows with its own words about lakes, boats, wind and harbours in the north of some country."
    assert _pairs(_frame(spark, [(1, BASE, "train", None), (2, other, "dev", None)])) == set()


def test_nulls_empty_long_and_repeated(spark):
    long = " ".join(f"word{i % 977} item{i}" for i in range(60_000))
    rows = [(1, None, "train", None), (2, "", "dev", None), (3, " \n", "holdout", None), (4, long, "train", None), (5, long + " end", "dev", None), (6, long, "train", None), (7, "?!", "train", None), (8, "?!", "dev", None), (9, BASE, None, None)]
    assert _pairs(_frame(spark, rows)) == {(4, 5), (5, 6)}
    assert _pairs(_frame(spark, [])) == set()


def test_repeated_rows_count_each(spark):
    rows = [(i, BASE, "train" if i < 5 else "dev", None) for i in range(12)]
    assert len(_pairs(_frame(spark, rows))) == 5 * 7


def test_joins_do_not_depend_on_broadcast(spark, small, monkeypatch):
    want = {tuple(r) for r in queries.p1_found(spark, small).collect()}
    monkeypatch.setattr(overlap, "BROADCAST_PAIRS", 0)
    assert {tuple(r) for r in queries.p1_found(spark, small).collect()} == want


def _blocks(texts):
    """Every text's join keys, as the join makes them."""
    _, level, blocks, ends = overlap.codes(texts)
    per = overlap.SEGMENTS * len(overlap.PERMUTATIONS)
    return [{(int(level[i]) * per + j, int(b)) for j, b in enumerate(blocks[ends[i] : ends[i + 1]])} for i in range(len(texts))]


@pytest.mark.parametrize("n", [12, 15, 20, 30, 40, 50, 58, 62, 70, 80, 100, 115, 125, 200, 500])
def test_recall_by_length_and_changes(n):
    """At least nine in ten random texts that share 80 % of their words meet, nearly all with fewer changes."""
    rng = random.Random(n)
    vocabulary = [f"word{i:x}" for i in range(20_000)]
    for share, least in ((0.2, 0.9), (0.12, 0.97), (0.06, 0.99)):
        k, texts = max(1, int(n * share)), []
        for _ in range(250):
            a = rng.sample(vocabulary, n)
            b = list(a)
            for i in rng.sample(range(n), k):
                b[i] = "x" + b[i]
            texts += [a, b]
        keys, code = _blocks(texts), overlap.codes(texts)[0]
        near = lambda i: sum(((int(x) ^ int(y)) & 2**64 - 1).bit_count() for x, y in zip(code[i], code[i + 1])) <= overlap.RADIUS
        met = sum(bool(keys[i] & keys[i + 1]) and near(i) for i in range(0, len(keys), 2)) / 250
        assert met >= least, (n, k, met)


def test_words_more_at_the_ends_meet_across_levels():
    rng = random.Random(8)
    vocabulary = [f"word{i:x}" for i in range(20_000)]
    for n in (46, 59, 61, 119, 240):
        texts = []
        for _ in range(200):
            a = rng.sample(vocabulary, n)
            texts += [a, rng.sample(vocabulary, n // 8) + a + rng.sample(vocabulary, n // 8)]
        keys = _blocks(texts)
        assert sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(keys), 2)) >= 196, n


def test_hot_blocks_and_classes_are_dealt_out(spark, monkeypatch):
    rows = [(i, BASE + (f" end{i % 7}" if i % 3 else ""), "train" if i % 2 else "dev", None) for i in range(240)]
    want = _pairs(_frame(spark, rows))
    assert len(want) == 120 * 120
    monkeypatch.setattr(overlap, "_hot", lambda df: [r["k"] for r in df.groupBy("k").count().where("count > 3").collect()])
    monkeypatch.setattr(overlap, "hot_keys", lambda df, key: [r[key] for r in df.select(key).distinct().collect()])
    assert _pairs(_frame(spark, rows)) == want and overlap.found(_frame(spark, rows)).count() == len(want)


def test_the_sketch_finds_hot_keys(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 5 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    assert overlap._hot(df) == [7] and overlap._hot(df.limit(0)) == []


def test_report(spark):
    rows = [(1, BASE, "train", "A"), (2, BASE, "dev", " a "), (3, BASE + " indeed", "dev", "A"), (4, "quite another text", "dev", "a"), (5, BASE, "holdout", None), (6, None, "holdout", None)]
    got = {(r["set"], r["source"]): (r["all"], r["records"], r["exact"], r["pairs"], round(r["closest"], 3)) for r in overlap.report(_frame(spark, rows)).collect()}
    n = len(overlap.words(BASE))
    assert got == {("dev", "a"): (3, 2, 1, 2, round((1 + n / (n + 1)) / 2, 3)), ("holdout", None): (2, 1, 1, 1, 1.0)}


def test_lcs_against_a_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert overlap.lcs_words(a, b) == row[-1]
