from __future__ import annotations

import json
import os
import zipfile
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtally import cli, session
from loomtally.functions import text
from loomtally.operators import annotate, evaluate, sample, tagger
from loomtally.plans import online
from loomtally.sources import readers, writers

PAPER = "Methods and more text of the paper here.\nWe found an effect, t(23) = 2.45, p = .022, as expected.\nAnd another one, F(1, 28) = 1.91, p = .036, in the second group of people.\n"


# ---- session ------------------------------------------------------------------------------------

def _path(df):
    return df._loomtally_cut.replace("file:", "").replace("//", "/")


def test_cut_tables_are_released(spark):
    a = session.cut(spark.range(5))
    with session.scope(spark):
        b = session.cut(spark.range(7))
        assert b.count() == 7 and os.path.isdir(_path(b))
    assert not os.path.isdir(_path(b)) and os.path.isdir(_path(a)) and a.count() == 5
    session.release(a, None, spark.range(1))
    assert not os.path.isdir(_path(a))


def test_a_layout_saves_the_shuffle(spark):
    t = session.cut_by(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "k")
    sums = t.groupBy("k").agg(F.sum("id").alias("s"))
    back = t.join(sums.hint("merge"), "k")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 and back.count() == 1000
    with session.scope(spark):
        u = session.cut_by(spark.range(0).select("id"), "id")
        assert u.count() == 0
    assert not os.path.isdir(_path(u))
    session.release(t)


def test_without_a_catalog_the_rows_stay(spark, monkeypatch):
    from pyspark.errors import AnalysisException
    from pyspark.sql.readwriter import DataFrameWriter

    def refuse(self, name, *args, **kwargs):
        raise AnalysisException("no tables here")

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", refuse)
    t = session.cut_by(spark.range(30), "id")
    assert sorted(r["id"] for r in t.collect()) == list(range(30))
    session.release(t)


def test_a_cluster_needs_a_shared_folder():
    nothing = MagicMock(master="spark://host:7077")
    nothing.getConf.return_value.get.return_value = None
    nothing._jsc.sc.return_value.getCheckpointDir.return_value.isDefined.return_value = False
    remote = MagicMock(sparkContext=nothing)
    remote.conf.get.side_effect = lambda key, default=None: default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(remote)
    nothing.master = "local[2]"
    assert session.shared_folder(remote).startswith("file:///")


@pytest.mark.parametrize("hot", [[], [1], [1, 2, None]])
def test_joins_of_hot_keys_give_every_pair_once(spark, hot):
    a = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(60)], "k int, x int")
    b = spark.createDataFrame([(k % 4, k) for k in range(40)], "k int, y int")
    want = sorted((r["x"], r["y"]) for r in a.join(b, "k").collect())
    assert sorted((r["x"], r["y"]) for r in session.join_both_hot(a, b, "k", [h for h in hot if h is not None]).select("x", "y").collect()) == want
    one = b.groupBy("k").agg(F.min("y").alias("y"))
    got = session.join_hot(a, one, "k", [h for h in hot if h is not None], how="left").select("x", "y").collect()
    assert sorted(map(str, got)) == sorted(map(str, a.join(one, "k", "left").select("x", "y").collect()))


# ---- command line -------------------------------------------------------------------------------

def test_check_a_file_and_a_folder(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "paper.txt").write_text(PAPER, encoding="utf-8")
    (tmp_path / "a" / "empty.txt").write_text("", encoding="utf-8")
    assert cli.main(["check", str(tmp_path / "a" / "paper.txt")], spark) == 0
    out = capsys.readouterr().out
    assert "t(23) = 2.45, p = 0.022  0.0223  consistent  [pattern]" in out and "consistent=1, decision_error=1" in out
    assert cli.main(["check", str(tmp_path), "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["source"].endswith("a/paper.txt") and sorted(r["verdict"] for r in report["results"]) == ["consistent", "decision_error"]
    assert cli.main(["check", str(tmp_path), "--csv", str(tmp_path / "out")], spark) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "x.doc").write_text("x")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    for args in (["check", str(tmp_path / "none.txt")], ["check", str(tmp_path / "x.doc")], ["check", str(tmp_path / "x.pdf")], ["check"], ["check", str(tmp_path), "--model", "nowhere"]):
        assert cli.main(args, spark) == 2
    assert "no such file" in capsys.readouterr().err


# ---- text and cascade ---------------------------------------------------------------------------

def test_window_spans_point_into_the_text(spark):
    docs = spark.createDataFrame([("d", PAPER), ("e", ""), ("f", None)], "doc string, text string")
    rows = text.window_spans(docs, "doc", "text").collect()
    assert {r["line"] for r in rows} == {1, 2}
    for r in rows:
        assert PAPER[r["start"] : r["end"]] == "\n".join(PAPER.split("\n")[max(0, r["line"] - 8) : r["line"] + 9])


def test_cascade_and_its_counts(spark):
    s = "window_id string, value double, seq int"
    pattern = spark.createDataFrame([("w", 1.0, 0), ("w", 1.0002, 1), ("w", None, 2), ("w", None, 3), ("v", 5.0, 0)], s)
    model = spark.createDataFrame([("w", 1.0, 0), ("w", 2.0, 1), ("w", None, 2), ("u", 3.0, 0), ("u", 3.0, 1)], s)
    got = {r["window_id"]: (r["pattern"], r["model_added"], r["model_duplicate"]) for r in online.cascade_counts(online.cascade(pattern, model)).collect()}
    assert got == {"w": (2, 1, 2), "v": (1, 0, 0), "u": (0, 1, 1)}
    alone = online.cascade_counts(online.cascade(pattern.limit(0), model)).collect()
    assert {r["window_id"]: r["model_added"] for r in alone} == {"w": 2, "u": 1}


def test_guards_lose_nothing(spark, small):
    """Windows that the native guards keep in the JVM hold no result and no damaged operator."""
    from loomtally.operators import extract, repair

    h = spark.read.parquet(f"{small}/holdout.parquet").select("text", extract.may_hold(F.col("text")).alias("m"), repair.repair_udf("text").alias("r"))
    rows = repair.with_repaired(h, "text", "g").collect()
    for r in rows:
        assert r["m"] or not extract.extract(r["text"])
        assert (r["g"]["text"], r["g"]["mapping"], r["g"]["replacements"]) == (r["r"]["text"], r["r"]["mapping"], r["r"]["replacements"])


def test_best_maps_are_reported():
    from loomtally.operators import repair

    lines = ["t(20) \x03 2.09, p \x04 .050", "t(30) \x03 2.75, p \x04 .010", "F(1, 20) \x03 4.35, p \x04 .050", "t(25) \x03 1.00, p \x04 .900"]
    r = repair.repaired("\n".join(lines))
    assert r["mapping"] == {"\x03": "=", "\x04": "="} and r["testable"] == 4 and r["agreement"] == 0.75
    assert len(r["alternatives"]) == 3 and r["alternatives"][0]["mapping"] == r["mapping"]
    shares = [a["agreement"] for a in r["alternatives"]]
    assert shares == sorted(shares, reverse=True) and len({tuple(a["mapping"].items()) for a in r["alternatives"]}) == 3


# ---- annotation, evaluation, sampling ------------------------------------------------------------

def test_key_difference_and_union(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["x", "y", "y", None], ["y", "z"]))
    assert {(r["k"], r["side"]) for r in annotate.key_difference(a, b, "k").collect()} == {("x", "missing"), (None, "missing"), ("z", "extra")}
    f = spark.createDataFrame([("w", 1.0), ("w", 1.0)], "window_id string, value double")
    assert evaluate.union_of(f, f.limit(0), f).count() == 1


def test_run_tables(spark):
    runs = spark.createDataFrame([("a-s0", 0, 0.8), ("b-s0", 0, 0.9), ("a-s1", 1, 0.99), ("c-s0", 0, None)], "name string, seed int, f1 double")
    assert [r["name"] for r in sample.first_seeds(runs).collect()] == ["b-s0", "a-s0", "c-s0"] and sample.first_seeds(runs, k=1).count() == 1
    t = sample.run_table(runs, spark.createDataFrame([("a-s0", 7)], "name string, size int"), spark.createDataFrame([("b-s0", 0.5)], "name string, f1 double"))
    got = {r["name"]: (r["size"], r["score_f1"]) for r in t.collect()}
    assert got["a-s0"] == (7, None) and got["b-s0"] == (None, 0.5) and t.count() == 4


def test_blind_order_is_a_permutation(spark):
    d = spark.createDataFrame([(f"d{i}", list("abcdef")) for i in range(20)] + [("n", None), ("e", [])], "dispute_id string, candidates array<string>")
    got = {r["dispute_id"]: r["candidates"] for r in sample.blind_order(d, 3).collect()}
    assert all(sorted(v) == list("abcdef") for k, v in got.items() if k[0] == "d") and len({tuple(v) for k, v in got.items() if k[0] == "d"}) > 10
    assert got["n"] is None and got["e"] == []


# ---- files --------------------------------------------------------------------------------------

def test_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x\ty"}\n\n{"k": 2\nnot json\n{"k": "seven"}\n', encoding="utf-8")
    rows, bad = readers.json_quarantined(spark, str(tmp_path), schema="k long, t string")
    assert [(r["k"], r["t"]) for r in rows.collect()] == [(1, "x\ty")]
    assert sorted(r["line"] for r in bad.collect()) == ['not json', '{"k": "seven"}', '{"k": 2'] and bad.first()["file"].endswith("a.jsonl")


def test_report_values_and_tables(spark):
    one = spark.createDataFrame([(3, 0.5)], "n int, r double")
    many = spark.createDataFrame([("t", 2), ("f", 4)], "kind string, n int")
    v = writers.report_values({"all": one, "kinds": many})
    assert v["all.n"] == 3 and v["kinds.t.n"] == 2 and writers.render("{{all.r|pct}} of {{kinds.f.n}}", v) == "50.0 % of 4"
    with pytest.raises(ValueError):
        writers.table_markdown(many, most=1)
    with pytest.raises(ValueError):
        writers.report_values({"kinds": many}, most=1)


def test_pdf_readers_turn_failures_into_rows(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/y.pdf", b"no pdf")
        z.writestr("in/readme.txt", "x")
    f = readers.pdf_fonts(spark, str(tmp_path)).collect()
    assert [(r["pdf"], r["text"]) for r in f] == [("x.pdf", None)] and f[0]["error"]
    z = readers.zip_texts(spark, str(tmp_path / "z.zip")).collect()
    assert [(r["pdf"], r["ok"]) for r in z] == [("in/y.pdf", False)]


# ---- tagger -------------------------------------------------------------------------------------

def test_convolutions_against_plain_sums():
    rng = np.random.default_rng(3)
    e, hidden, n = 3, 4, 11
    embedding = rng.normal(size=(6, e)).astype("f4")
    layers, width = [], e
    for dilation in (1, 2, 4, 8):
        layers.append((rng.normal(size=(hidden, width, 5)).astype("f4"), rng.normal(size=hidden).astype("f4"), dilation))
        width = hidden
    out = rng.normal(size=(7, hidden)).astype("f4"), rng.normal(size=7).astype("f4")
    artifact = {"unit": "cnn", "embedding": tagger.packed(embedding), "convs": [{"W": tagger.packed(w), "b": tagger.packed(b), "dilation": d} for w, b, d in layers], "out": {"W": tagger.packed(out[0]), "b": tagger.packed(out[1])}}
    ids = rng.integers(0, 6, size=(2, n))
    x = embedding[ids].astype(float)
    for w, b, d in layers:
        y = np.zeros((2, n, hidden))
        for i in range(2):
            for t in range(n):
                for k in range(5):
                    at = t + (k - 2) * d
                    if 0 <= at < n:
                        y[i, t] += w[:, :, k] @ x[i, at]
                y[i, t] = np.maximum(0, y[i, t] + b)
        x = y
    assert np.allclose(tagger.Convolutional(artifact).logits(ids), x @ out[0].T + out[1])


def test_viterbi_of_many_texts_is_that_of_each():
    rng = np.random.default_rng(8)
    n = 9
    lengths = np.array([1, 5, 12, 12, 2])
    emissions, transitions, start, end = rng.integers(0, 3, (5, 12, n)).astype(float), rng.integers(-2, 2, (n, n)).astype(float), rng.normal(size=n), rng.normal(size=n)
    best = tagger.viterbi_batch(emissions, lengths, transitions, start, end)
    for k, length in enumerate(lengths):
        assert best[k, :length].tolist() == tagger.viterbi(emissions[k, :length], transitions, start, end)
