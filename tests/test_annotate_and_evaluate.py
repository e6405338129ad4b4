from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtally.operators import annotate, evaluate, sample


def _ratings(spark, rows):
    return spark.createDataFrame(rows, "item int, rater string, label string")


def test_cohen(spark):
    """Twenty and fifteen agreed, five and ten split: kappa .4 over fifty items."""
    pairs = [("y", "y")] * 20 + [("n", "n")] * 15 + [("y", "n")] * 5 + [("n", "y")] * 10
    r = _ratings(spark, [(i, n, x) for i, p in enumerate(pairs) for n, x in zip("ab", p)])
    k = annotate.cohen_kappa(r).first()
    assert k["n"] == 50 and k["kappa"] == pytest.approx(0.4)
    same = _ratings(spark, [(i, n, "y") for i in range(4) for n in "ab"])
    assert annotate.cohen_kappa(same).first()["kappa"] == 1.0


def test_fleiss(spark):
    """The published table of ten subjects, fourteen raters and five categories."""
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(i, f"r{k}-{j}", str(j)) for i, t in enumerate(table) for j, n in enumerate(t) for k in range(n)]
    assert annotate.fleiss_kappa(_ratings(spark, rows)).first()["kappa"] == pytest.approx(0.210, abs=5e-4)


def test_alpha_with_missing(spark):
    """Nominal alpha of the published four-observer example is .743."""
    data = {"A": "1 2 3 3 2 1 4 1 2 - - -", "B": "1 2 3 3 2 2 4 1 2 5 - 3", "C": "- 3 3 3 2 3 4 2 2 5 1 -", "D": "1 2 3 3 2 4 4 1 2 5 1 -"}
    rows = [(i, r, None if v == "-" else v) for r, s in data.items() for i, v in enumerate(s.split())]
    assert annotate.krippendorff_alpha(_ratings(spark, rows)).first()["alpha"] == pytest.approx(0.743, abs=5e-4)


def test_agreement_of_nothing(spark):
    e = _ratings(spark, [])
    assert annotate.cohen_kappa(e).count() == 0
    assert annotate.krippendorff_alpha(e).first()["alpha"] is None


def test_matching():
    a, b = [{"span": (0, 21)}], [{"span": (0, 20)}]
    assert annotate.match(a, b, strict=True) == [] and annotate.match(a, b) == [(0, 0)]
    assert annotate.match([{"span": None, "statistic": "-0.23"}], [{"span": (1, 2), "statistic": "0.23"}]) == [(0, 0)]


def _result(**kw):
    base = dict.fromkeys(("test_type", "statistic", "df1", "df2", "n", "p_operator", "p_value", "quote"), None)
    return base | {"test_type": "t", "statistic": "2.1", "df1": "20", "p_operator": "=", "p_value": ".05", "quote": "t(20) = 2.1, p = .05", "damaged": False, "confidence": "high", "span": (0, 20)} | kw


def test_consensus_tiers():
    r = _result()
    kept, open_ = annotate.consensus_window({"a": [r], "b": [r], "c": [dict(r)]})
    assert kept[0]["tier"] == "unanimous" and not open_
    kept, open_ = annotate.consensus_window({"a": [r], "b": [r], "c": [_result(df1="21")]})
    assert kept[0]["tier"] == "majority" and kept[0]["df1"] == "20" and not open_
    kept, open_ = annotate.consensus_window({"a": [r], "b": [], "c": []})
    assert not kept and open_[0]["kind"] == "singleton"
    kept, open_ = annotate.consensus_window({"a": [r], "b": [_result(df1="21")], "c": [_result(df1="22")]})
    assert kept[0]["pending_field"] == "df1" and kept[0]["df1"] is None and open_[0]["kind"] == "field_conflict"


def test_one_result_per_rater_in_a_cluster():
    raters = {"a": [_result(), _result(span=(1, 20))], "b": [_result()]}
    assert sorted(map(len, annotate.clusters(raters))) == [1, 2]


def test_consensus_over_frames(spark):
    schema = "window_id string, rater string, seq int, result struct<test_type:string,statistic:string,df1:string,df2:string,n:string,p_operator:string,p_value:string,quote:string,damaged:boolean,confidence:string,span:array<int>>"
    one = lambda **k: tuple(_result(span=[0, 20], **k).values())
    rows = [("w1", r, 0, one()) for r in "abc"] + [("w2", "a", 0, one())]
    c = annotate.consensus(spark.createDataFrame(rows, schema), ["a", "b", "c"])
    got = {r["window_id"]: r for r in c.collect()}
    assert got["w1"]["kept"][0]["tier"] == "unanimous" and got["w2"]["disputes"][0]["kind"] == "singleton"
    assert annotate.disputes(c, "train").first()["dispute_id"] == "train-w2-0"
    f = annotate.result_f1(spark.createDataFrame(rows, schema), ["a", "b", "c"]).collect()
    assert {(r["rater_a"], r["rater_b"]): r["f1"] for r in f}["b", "c"] == 1.0


def test_contract(spark):
    batch = spark.createDataFrame([(0, "w0"), (1, "w1"), (2, "w2")], "pos int, window_id string")
    s = "pos int, window_id string, contains_result boolean, results array<struct<test_type:string,p_operator:string,damaged:boolean,confidence:string,quote:string>>"
    out = spark.createDataFrame([(0, "w0", True, [("t", "=", True, "high", "q")]), (1, "zz", None, [("??", "~", None, "so", "")])], s)
    got = [r["problem"] for r in annotate.violations(batch, out).where("pos = 1").collect()]
    assert len(got) == 7 and annotate.violations(batch, out).where("pos = 0").count() == 0
    assert annotate.violations(batch, out).where("pos = 2").first()["problem"] == "record is missing"


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(8, 10, 5, 5), (0, 0, 0, 0), (10, 10, 10, 0)], "k int, n int, b int, c int")
    rows = df.select(*evaluate.wilson(F.col("k"), F.col("n")), evaluate.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert (rows[0]["low"], rows[0]["high"]) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    assert rows[0]["p"] == 1 and rows[1]["p"] == 1 and rows[1]["low"] == 0
    assert rows[2]["p"] == pytest.approx(2 * 0.5**10)


def test_resampling(spark):
    df = spark.createDataFrame([(f"d{i}", 2, 1, i % 3) for i in range(300)], "source_doc string, tp int, fp int, fn int")
    reps = evaluate.replicates(df, "source_doc", ["tp", "fp", "fn"], 400, 1)
    assert reps.count() == 400
    again = evaluate.replicates(df.repartition(7), "source_doc", ["tp", "fp", "fn"], 400, 1)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, again.collect()))
    d = evaluate.paired_difference(reps, F.col("tp"), F.col("tp")).first()
    assert d["mean"] == 0 and d["p"] == 1
    r = reps.agg(F.avg("tp"), F.stddev("tp")).first()
    assert r[0] == pytest.approx(600, rel=0.02) and r[1] == pytest.approx(2 * 300**0.5, rel=0.15)
    assert evaluate.replicates(df.limit(0), "source_doc", ["tp"], 10).count() == 0


def test_intervals_are_those_of_a_brute_bootstrap(spark):
    """Documents redrawn one by one give the same interval, few documents or many."""
    rng = np.random.default_rng(5)
    for n in (120, 9000):
        rows = [(f"doc{i}", int(rng.poisson(3)), int(rng.poisson(0.4)), int(rng.poisson(0.8))) for i in range(n)]
        df = spark.createDataFrame(rows, "source_doc string, tp int, fp int, fn int")
        reps = evaluate.replicates(df, "source_doc", ["tp", "fp", "fn"], 1000).select("rep", *evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn")))
        low, high = evaluate.percentile_interval(reps, F.col("f1")).first()
        m = np.array([r[1:] for r in rows])
        sums = np.array([m[rng.integers(0, n, n)].sum(axis=0) for _ in range(1000)])
        want = np.quantile(2 * sums[:, 0] / (2 * sums[:, 0] + sums[:, 1] + sums[:, 2]), [0.025, 0.975])
        assert high - low == pytest.approx(want[1] - want[0], rel=0.2)
        assert low == pytest.approx(want[0], abs=0.15 * (want[1] - want[0])) and high == pytest.approx(want[1], abs=0.15 * (want[1] - want[0]))


def test_false_alarms_belong_to_their_documents(spark):
    g = spark.createDataFrame([("w1", 1.0, "d1")], "window_id string, value double, source_doc string")
    f = spark.createDataFrame([("w1", 1.0), ("w1", 2.0), ("w2", 3.0), ("w9", 4.0)], "window_id string, value double")
    docs = spark.createDataFrame([("w1", "d1"), ("w2", "d2")], "window_id string, source_doc string")
    got = {r["source_doc"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.document_counts(evaluate.facts(g, f, docs)).collect()}
    assert got == {"d1": (1, 1, 0), "d2": (0, 1, 0), None: (0, 1, 0)}


def test_paired_scores(spark):
    docs = spark.createDataFrame([(f"w{i}", f"d{i}") for i in range(200)], "window_id string, source_doc string")
    g = docs.select("window_id", F.lit(1.0).alias("value"), "source_doc")
    all_, half = g.select("window_id", "value"), g.where("hash(window_id) % 2 = 0").select("window_id", "value")
    got = {r["metric"]: r for r in evaluate.paired_f1(evaluate.facts(g, all_, docs), evaluate.facts(g, half, docs), 300).collect()}
    assert got["r"]["low"] < 0.5 < got["r"]["high"] and got["f1"]["p"] == 0 and got["p"]["mean"] == 0


def test_samples_and_splits(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(100)] * 2, "source_doc string")
    s = sample.split_documents(docs)
    assert s.count() == 100 and s.where("split = 'dev'").count() == 15
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sample.split_documents(docs).collect()))
    with pytest.raises(Exception, match="no split"):
        sample.apply_splits(spark.createDataFrame([("zz",)], "source_doc string"), s).collect()
    w = spark.createDataFrame([(f"d{i % 50}", i, "A" if i % 2 else "C") for i in range(2000)], "doc string, line int, pool string")
    got = sample.stratified(w, 100, weights={"A": 0.3, "C": 0.5})
    assert {r["pool"]: r["count"] for r in got.groupBy("pool").count().collect()} == {"A": 30, "C": 50}
    assert got.groupBy("doc", "pool").count().agg(F.max("count")).first()[0] <= 3
    assert sample.holdout(w, w.where("doc = 'd1'"), 10).where("doc = 'd1'").count() == 0


def test_batches(spark):
    b = sample.batches(spark.range(1, 46).toDF("k"), "k").orderBy("k").collect()
    assert [(r["batch_id"], r["pos"]) for r in b] == [(i // 20, i % 20) for i in range(45)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_batches_lose_no_wide_row(spark, parts):
    n = 30_000
    wide = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("a"), F.repeat(F.md5(F.col("id").cast("string")), 6).alias("b"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sample.batches(wide, "k").select("k", (F.col("batch_id") * 20 + F.col("pos")).alias("n"), "a", "b")
        assert got.where("k = n AND length(a) = 256 AND length(b) = 192").select("k").distinct().count() == n == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(k,) for k in (None, 3, 3, 3, 1, None)], "k int")
    got = sample.batches(df, "k", 4).orderBy("batch_id", "pos").collect()
    assert [(r["k"], r["batch_id"], r["pos"]) for r in got] == [(None, 0, 0), (None, 0, 1), (1, 0, 2), (3, 0, 3), (3, 1, 0), (3, 1, 1)]
    assert sample.batches(df.limit(0), "k").count() == 0


def test_augmentation_keeps_labels_aligned(spark):
    text = "see t(23) = -2.45, p < .05 here, colour of 10 cl"
    spans = [(4, 5, "TEST"), (6, 8, "DF1"), (12, 17, "STAT"), (21, 22, "POP_LT"), (23, 26, "PVAL")]
    e = spark.createDataFrame([("w", text, spans)], "window_id string, text string, spans array<struct<start:int,end:int,entity:string>>")
    h = spark.createDataFrame([("n1", "means were M = 2.10 (SD = 0.4)", []), ("n2", "plain words", None), ("n3", "t(3) = 2, p = .04", ["x"])], "window_id string, text string, results array<string>")
    a = sample.augment(e, negatives=sample.hard_negatives(h))
    assert sample.misaligned(a).count() == 0
    got = {r["kind"]: r for r in a.collect()}
    assert set(got) == {*sample.KINDS, "negative"} and got["negative"]["window_id"] == "n1" and got["negative"]["spans"] == []
    for kind, signs in (("operator", sample.OPERATOR_DAMAGE["POP_LT"]), ("engine", sum(sample.ENGINE_ALPHABETS.values(), ()))):
        op = next(s for s in got[kind]["spans"] if s["entity"] == "POP_LT")
        assert got[kind]["text"][op["start"] : op["end"]] in signs
    import random

    noisy, moved = sample.perturbed(text, [tuple(x) for x in spans], "ocr", random.Random(1), 1.0)
    assert noisy.endswith("co1our of lO c1") and [noisy[a:b] for a, b, _ in moved] == [text[a:b] for a, b, _ in spans]
    again = sample.augment(e.repartition(3), negatives=sample.hard_negatives(h)).collect()
    assert sorted((r["kind"], r["text"]) for r in again) == sorted((r["kind"], r["text"]) for r in a.collect())


def test_weights_and_ledger(spark):
    c = spark.createDataFrame([("O", 1000), ("B-STAT", 10)], "tag string, n long")
    w = {r["tag"]: r["weight"] for r in sample.class_weights(c).collect()}
    assert w["O"] == 1 and w["S-N"] == 1 and w["B-STAT"] == pytest.approx((1010 / 370) ** 0.5)
    old = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "name string, started int, f1 double")
    new = spark.createDataFrame([("a", 2, 0.7)], "name string, started int, f1 double")
    assert sorted(map(tuple, sample.upserted(old, new).collect())) == [("a", 2, 0.7), ("b", 1, 0.6)]
    e = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 500.0), ("r", 3, 9000.0)], "run string, epoch int, loss double")
    assert sample.divergence(e).first()["epoch"] == 2


SCHEMA = "window_id string, rater string, seq int, result struct<test_type:string,statistic:string,df1:string,df2:string,n:string,p_operator:string,p_value:string,quote:string,damaged:boolean,confidence:string,span:array<int>>"


def test_field_agreement(spark):
    def row(w, r, **k):
        return (w, r, 0, tuple(_result(span=[0, 20], **k).values()))

    rows = [row(f"w{i}", r, statistic="2.10" if r == "b" else "2.1", test_type="t" if i % 2 else "F") for i in range(6) for r in "abc"] + [row("w9", "a")]
    rows += [row("w7", r, df1="3" if r == "c" else "20") for r in "abc"]
    got = {r["field"]: r for r in annotate.field_agreement(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"]).collect()}
    assert got["statistic"]["agreement"] == 1 and got["statistic"]["groups"] == 7
    assert got["df1"]["agreement"] == pytest.approx(6 / 7) and got["test_type"]["agreement"] == 1


def test_settled(spark):
    one = lambda **k: tuple(_result(span=[0, 20], **k).values())
    rows = [("w1", r, 0, one()) for r in "abc"] + [("w2", "a", 0, one()), ("w3", "b", 0, one())] + [("w4", r, 0, one(df1=str(i))) for i, r in enumerate("abc")]
    c = annotate.consensus(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"])
    res = "struct<test_type:string,statistic:string,df1:string,df2:string,n:string,p_operator:string,p_value:string,quote:string,damaged:boolean,confidence:string>"
    good = ("Chi-square", "2.1", "20", None, None, "≤", ".05", "q", False, "high")
    dec = spark.createDataFrame([("s-w2-0", (True, good)), ("s-w3-0", (False, None))], f"dispute_id string, decision struct<keep:boolean,result:{res}>")
    got = {r["window_id"]: r for r in annotate.settled(c, dec, "s").collect()}
    assert set(got) == {"w1", "w2"} and got["w1"]["tier"] == "unanimous"
    assert got["w2"]["tier"] == "adjudicated" and got["w2"]["result"]["test_type"] == "chi2" and got["w2"]["result"]["p_operator"] == "<"


def test_gate_and_parity(spark):
    held = spark.createDataFrame([("a", True, True, True)] * 9 + [("a", True, True, False)] + [("b", True, True, True)] * 4 + [("b", False, False, False)], "engine string, read boolean, in_text boolean, kept boolean")
    got = {r["engine"]: r for r in evaluate.engine_gate(held).collect()}
    assert got["a"]["rate"] == 0.9 and got["b"]["rate"] == 1 and got["a"]["spread"] == pytest.approx(0.1) and not got["a"]["passes"]
    f = spark.createDataFrame([(True, True, False), (True, False, True), (False, True, None)], "in_gold boolean, in_found boolean, damaged boolean")
    assert evaluate.parity(f).first()[:] == (1, 1, 1, 0.5, 1)


def test_mcnemar_on_whole_counts(spark):
    """Thousands of discordant pairs, against sums of whole numbers."""
    pairs = [(41, 90), (120, 80), (2000, 2150), (5000, 5000), (0, 3000), (1, 0)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", evaluate.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        whole = sum(math.comb(n, i) for i in range(k + 1)) * 2
        assert r["p"] == pytest.approx(min(1.0, float(Fraction(whole, 2**n))), rel=1e-9, abs=1e-300)


def test_fleiss_by_panel(spark):
    rows = [(i, f"r{k}", "ab"[(i + k) % 2 if i % 3 == 0 else 0]) for i in range(12) for k in range(2 + i % 2)] + [(99, "r0", "a")]
    got = {r["raters"]: r for r in annotate.fleiss_by_panel(_ratings(spark, rows)).collect()}
    for m in (2, 3):
        only = _ratings(spark, [r for r in rows if r[0] != 99 and 2 + r[0] % 2 == m])
        assert got[m]["kappa"] == pytest.approx(annotate.fleiss_kappa(only).first()["kappa"]) and got[m]["subjects"] == 6


def test_against_final(spark):
    r = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True), (1, "b", False), (9, "b", True)], "item int, rater string, label boolean")
    f = spark.createDataFrame([(1, True), (2, True), (3, False)], "item int, label boolean")
    got = {x["rater"]: (x["items"], x["same"], x["only_rater"], x["only_final"]) for x in annotate.against_final(r, f).collect()}
    assert got == {"a": (3, 1, 1, 1), "b": (1, 0, 0, 1)}


def test_consensus_of_more_than_three():
    r, x, y = _result(), _result(df1="21"), _result(df1="22")
    tier = lambda *rs: annotate.consensus_window({f"r{k}": [v] if v else [] for k, v in enumerate(rs)})[0][0]
    assert tier(r, r, r, r, r)["tier"] == "unanimous" and tier(r, r, r, None, None)["tier"] == "unanimous"
    assert tier(r, r, r, r, x)["tier"] == "majority" and tier(x, r, x, r, r)["df1"] == "20"
    assert tier(r, r, x, x)["pending_field"] == "df1" and tier(r, r, x, x, y)["pending_field"] == "df1" and tier(r, r, x, y)["df1"] == "20"
    assert tier(r, x)["pending_field"] is None and tier(r, x)["df1"] == "20"
