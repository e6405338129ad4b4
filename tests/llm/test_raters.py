from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomtally.llm import queries, raters


def _labels(spark, skill, items=600, seed=3, share=0.6):
    rng = random.Random(seed)
    truth = [rng.random() < 0.55 for _ in range(items)]
    rows = []
    for r, q in skill.items():
        for i, t in enumerate(truth):
            if rng.random() < share:
                rows.append((i, r, t if rng.random() < (1 + q) / 2 else not t))
    return truth, spark.createDataFrame(rows, "item int, rater string, label boolean")


def test_reliability_and_votes(spark):
    skill = {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.5, "e": 0.0, "f": -0.6}
    truth, labels = _labels(spark, skill)
    scores = raters.reliability(labels, "item", "rater", "label").cache()
    got = {r["rater"]: r["reliability"] for r in scores.collect()}
    assert all(abs(got[r] - q) < 0.14 for r, q in skill.items()), got
    votes = raters.weighted_votes(labels, scores, "item", "rater", "label").collect()
    right = sum(v["consensus"] == truth[v["item"]] for v in votes) / len(votes)
    plain = sum((v["yes"] > v["no"]) == truth[v["item"]] for v in votes) / len(votes)
    assert right > 0.93 and right > plain
    assert all(0 <= v["agreement"] <= 1 for v in votes)


def test_by_shuffle_join_too(spark, monkeypatch):
    _, labels = _labels(spark, {"a": 0.9, "b": 0.7, "c": 0.5}, items=100)
    want = sorted((r["rater"], round(r["reliability"], 9)) for r in raters.reliability(labels, "item", "rater", "label").collect())
    monkeypatch.setattr(raters, "BROADCAST_RATERS", 0)
    assert want == sorted((r["rater"], round(r["reliability"], 9)) for r in raters.reliability(labels, "item", "rater", "label").collect())


def test_no_overlap_and_nothing(spark):
    one = spark.createDataFrame([(1, "a", True), (2, "b", False)], "item int, rater string, label boolean")
    assert {r["rater"]: r["reliability"] for r in raters.reliability(one, "item", "rater", "label").collect()} == {"a": 0.5, "b": 0.5}
    assert raters.reliability(one.limit(0), "item", "rater", "label").count() == 0
    same = spark.createDataFrame([(1, "a", True), (1, "b", True)], "item int, rater string, label boolean")
    assert raters.reliability(same, "item", "rater", "label").count() == 2


DISPUTE = "decision_id long, dispute_id string, candidates array<struct<statistic:string>>, decision struct<keep:boolean,provenance:struct<rater:string,collected_at:string>>"


def test_counting_decisions(spark):
    rows = [
        (1, "d", None, (True, ("Rater_01 ", "2025-01-01T10:00:00+09:00"))), (2, "d", None, (False, ("rater-1", "2025-01-01T02:00:00Z"))),
        (3, "d", None, (None, ("rater_2", "2025-01-01T02:00:00Z"))), (4, "d", None, None), (5, "d", None, (True, (None, None))), (6, None, None, (True, ("rater_3", None))),
        (7, "d", None, (True, ("rater_4", None))), (8, "d", None, (False, ("rater_4", None))), (9, "d", None, (True, ("rater_5", "no date"))),
    ]
    got = {r["rater"]: r["keep"] for r in raters.counting_decisions(spark.createDataFrame(rows, DISPUTE)).collect()}
    assert got == {"rater_1": False, "rater_4": False, "rater_5": True}


def test_statistics(spark):
    def one(i, d, values):
        return (i, d, None if values is None else [(v,) for v in values], None)

    rows = [
        one(1, "a", [" −0.50", "-.5", "0.5", "n.s."]), one(2, "a", ["-.5", "0.5", " −0.50", "n.s."]), one(3, "b", ["12.0", "12", "12.000"]), one(4, "c", ["1", "2"]),
        one(5, "e", ["1,857.00", "1857", "2.S4", None, "3"]), one(6, "f", None), one(7, "g", []), one(8, "h", ["\x031.10", "1.10\x0e", "– 1.10"]),
    ]
    df = spark.createDataFrame(rows, DISPUTE).withColumn("value", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["dispute_id"]: r["consensus"] for r in raters.found(df).where("item = 'statistic'").collect()}
    assert got == {"a": "-0.5", "e": "1857", "h": "1.1"}
    assert raters.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("v,want", [("0.00", "0"), ("-0.40", "-0.4"), ("100", "100"), (".05", "0.05"), ("1,234,567.50", "1234567.5")])
def test_plain_decimals(spark, v, want):
    d = spark.createDataFrame([(v,)], "v string").select(raters.plain_decimal(raters.readable_number(F.col("v"))).alias("p"))
    assert d.first()["p"] == want


def test_queries(spark, small):
    f = queries.p4_found(spark, small)
    assert f.columns == ["dispute_id", "item", "consensus"] and f.count() > 0
    assert set(r["consensus"] for r in f.where("item = 'keep'").collect()) <= {"true", "false"}
    a = queries.p4_agreement(spark, small).first()
    assert -1 <= a["alpha"] <= 1
