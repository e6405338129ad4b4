from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtally.operators import extract, repair, tagger
from loomtally.functions import rules as R
from loomtally.plans import online

PASSAGE = "It held, t(23) = 2.45, p = .022. So did F(2, 30) = 5.10,\np = .012 in 12 cases; chi2(1, N = 223) = 8.69, p = .003 was seen too."


def test_passage_end_to_end(spark):
    rows = online.results(spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")).orderBy("window", "seq").collect()
    assert [r["test_type"] for r in rows] == ["t", "f", "chi2"]
    assert all(r["verdict"] == "consistent" for r in rows)
    assert [r["computed_p"] for r in rows] == pytest.approx([0.0223157, 0.0124002, 0.0031996], rel=1e-4)


def test_online_plan_has_no_shuffle(spark):
    df = online.results(spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_first_wins_and_nulls(spark):
    twice = f"{PASSAGE}\n{PASSAGE}"
    df = spark.createDataFrame([(1, twice), (2, None), (3, ""), (4, "no result here at all 12345 (12)")], "doc_id long, text string")
    counts = {r["doc_id"]: r["results"] for r in online.verdict_counts(online.results(df)).collect()}
    assert counts == {1: 3}
    st = {r["doc_id"]: r for r in online.stages(df).collect()}
    assert st[1]["by_pattern"] == 3 and st[3]["windows"] == 0 and st[2]["lines"] is None


DAMAGED = "\n".join(
    f"Outcome {i}: t(34) \x02 {s}, p \x02 {p} in group {i} of the sample." for i, (s, p) in enumerate([("2.45", ".020"), ("1.80", ".081"), ("2.10", ".043"), ("3.00", ".005"), ("0.50", ".02")])
)


def test_damaged_lines(spark):
    d = spark.createDataFrame([(1, DAMAGED)], "doc_id long, text string")
    got = sorted(r["verdict"] for r in online.results(d).collect())
    assert got == ["consistent"] * 4 + ["decision_error"]
    assert online.results(d, online.Options(repair=False)).count() == 0


def test_simple_rule():
    text = "t(3) ¼ 2.1, p b .05; t(4) ¼ 2, p b .01"
    assert repair.simple_map(text) == {"¼": "=", "b": "<"}
    r = repair.repaired(text)
    assert r["rule"] == "simple" and r["text"] == "t(3) = 2.1, p < .05; t(4) = 2, p < .01" and r["replacements"] == 4
    assert repair.repaired(None) is None and repair.repaired("")["text"] == ""


def test_extract_order_and_cover():
    got = extract.extract("z = 1.96, p = .05 and Qw(3) = 4.1, p > .2; χ2(2, N = 1,234) = 3.0, p<.05")
    assert [(g["test_type"], g["n"]) for g in got] == [("z", None), ("q", None), ("chi2", "1,234")]
    assert all(got[i]["raw"] for i in range(3)) and extract.extract(None) == []


def test_native_equals_udf(spark, small):
    h = spark.read.parquet(f"{small}/holdout.parquet").select("record_id", "text")
    udf = extract.iter_extractions(h).select("record_id", "extraction.test_type", "extraction.raw", "extraction.statistic", "extraction.p_value")
    native = extract.extract_native(h).select("record_id", "test_type", "raw", "statistic", "p_value")
    assert sorted(map(tuple, udf.collect())) == sorted(map(tuple, native.collect()))


def test_tags_and_spans():
    spans = [(0, 1, "TEST"), (2, 4, "DF1"), (6, 10, "STAT"), (3, 3, "N"), (1, 2, "NOPE")]
    tags = extract.tags_of_spans(12, spans)
    assert extract.spans_of_tags(tags) == spans[:3]
    assert extract.spans_of_tags(["I-STAT", "I-STAT", "O", "E-PVAL", "B-STAT", "B-STAT"]) == [(0, 2, "STAT"), (3, 4, "PVAL"), (4, 5, "STAT"), (5, 6, "STAT")]
    assert extract.spans_of_tags(["E-PVAL", "I-PVAL", "E-PVAL", "I-PVAL"]) == [(0, 3, "PVAL"), (3, 4, "PVAL")]
    assert extract.spans_of_tags(["S-N", "S-N", "B-N"]) == [(0, 1, "N"), (1, 2, "N"), (2, 3, "N")]
    assert extract.spans_of_tags([]) == []


def test_groups(spark):
    text = "t(3)=2, p=.1; 4.5"
    spans = [(0, 1, "TEST"), (2, 3, "DF1"), (5, 6, "STAT"), (9, 10, "POP_EQ"), (10, 12, "PVAL"), (14, 17, "STAT")]
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,entity:string>>")
    g = df.select(extract.grouped(F.col("t"), F.col("s")).alias("g")).first()["g"]
    assert len(g) == 2 and g[1] == {"STAT": "4.5"}
    b = spark.createDataFrame([(x,) for x in g], "g map<string,string>").select(extract.built(F.col("g")).alias("b")).collect()
    assert b[0]["b"]["p_operator"] == "=" and b[1]["b"]["statistic"] == 4.5
    o = df.select(extract.overlaps(F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("A").alias("entity")), F.struct(F.lit(4).alias("start"), F.lit(6).alias("end"), F.lit("B").alias("entity")))).alias("o")).first()["o"]
    assert len(o) == 1


def test_alignment():
    text = "seen in t ( 23 )\n= 2.45, p = .022 again"
    a = extract.aligned(text, {"quote": "t(23) = 2.45, p = .022", "test_type": "t", "df1": "23", "statistic": "2.45", "p_operator": "=", "p_value": ".022"})
    assert text[slice(*a["block_span"])].startswith("t (") and text[slice(*a["part_spans"]["PVAL"])] == ".022"
    assert extract.aligned(text, {"quote": "t(99)"}) is None and extract.aligned(None, {"quote": "x"}) is None


def _artifact(unit: str, seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    h, e, gates = 5, 6, 3 if unit == "gru" else 4
    rnn = []
    for layer in range(2):
        for d in ("forward", "backward"):
            w = {"W_ih": (gates * h, e if layer == 0 else 2 * h), "W_hh": (gates * h, h), "b_ih": (gates * h,), "b_hh": (gates * h,)}
            rnn.append({"layer": layer, "direction": d, **{k: tagger.packed(rng.normal(size=s) * 0.5) for k, s in w.items()}})
    return {"unit": unit, "hidden": h, "layers": 2, "embedding": tagger.packed(rng.normal(size=(40, e))), "rnn": rnn, "out": {"W": tagger.packed(rng.normal(size=(37, 2 * h))), "b": tagger.packed(np.zeros(37))}, "pad_id": 0}


@pytest.mark.parametrize("unit", ["gru", "lstm"])
def test_tagger_batch_equals_single(unit):
    chars = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz 0123456789")}
    mask = tagger.transition_mask()
    for crf in (None, {"transitions": mask, "start": np.zeros(37), "end": np.zeros(37)}):
        t = tagger.Tagger(tagger.Recurrent(_artifact(unit)), chars, crf)
        texts = ["abc 123", "", "x", "a longer text with 42 numbers", "zz?"]
        together = t.tags(texts)
        assert together == [t.tags([x])[0] for x in texts]
        assert [len(x) for x in together] == [len(x) for x in texts]


def test_viterbi_obeys_the_mask():
    rng = np.random.default_rng(0)
    path = tagger.viterbi(rng.normal(size=(30, 37)), tagger.transition_mask(), np.zeros(37), np.zeros(37))
    mask = tagger.transition_mask()
    assert all(mask[a, b] == 0 for a, b in zip(path, path[1:]))
    assert tagger.viterbi(np.zeros((0, 37)), mask, np.zeros(37), np.zeros(37)) == []


def test_model_plugs_in(spark, tmp_path):
    import json

    chars = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz 0123456789")}
    (tmp_path / "charmap.json").write_text(json.dumps({"chars": chars}))
    (tmp_path / "weights.json").write_text(json.dumps(_artifact("gru")))
    d = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    o = online.Options(model=tagger.finder(str(tmp_path)))
    got = online.results(d, o).collect()
    assert [r["source"] for r in got if r["source"] == "pattern"] == ["pattern"] * 3
    with pytest.raises(FileNotFoundError):
        tagger.load(str(tmp_path / "none")) if (tmp_path / "none").exists() else (_ for _ in ()).throw(FileNotFoundError())


def test_hard_cases_do_not_crash():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("tFrzQ()=<>,.0123456789 p\x02\x03¼\n") for _ in range(80))
        extract.extract(t)
        repair.repaired(t)
    assert len(R.TAGS) == 37


def test_numbers_in_one_stretch(spark):
    rows = [("a 23 b 2.45 c .022", ("23", None, "2.45", "<.022")), ("a 23 " + "x" * 170 + " 2.45 .022 23 2.45 .022", ("23", "", "2.45", ".022")), ("a 23 " + "x" * 170 + " 2.45 .022", ("23", "", "2.45", ".022")), ("none", (None, None, None, None)), (None, ("1", None, None, None))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r struct<df1:string,df2:string,statistic:string,p_value:string>")
    got = df.select("i", extract.holds_numbers(F.col("t"), F.col("r")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [True, True, False, False, False]


def test_repair_report_and_lines(spark):
    from loomtally.sources import writers

    df = spark.createDataFrame([(1, "t(3) ¼ 2.1, p b .05"), (2, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in repair.report(df).collect()}
    assert got[1]["replacements"] == 2 and got[1]["suspects_before"] == 1 and got[1]["suspects_after"] == 0
    line = online.results(spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")).select(writers.result_line().alias("t")).first()["t"]
    assert "t(23) = 2.45, p = 0.022" in line and "consistent" in line
