from __future__ import annotations

import json
import zipfile

import pytest

from loomtally.plans import online
from loomtally.sources import readers, writers
from loomtally.streaming import online as streaming

PASSAGE = "It held, t(23) = 2.45, p = .022 in the 12 cases of this sample."


def test_text_corpus(spark, tmp_path):
    (tmp_path / "Journal A").mkdir()
    (tmp_path / "Journal A" / "x.txt").write_bytes(b"caf\xe9 1\n2")
    (tmp_path / "Journal A" / "y.pdf").write_bytes(b"no pdf")
    r = readers.text_corpus(spark, str(tmp_path)).first()
    assert (r["doc"], r["journal"], r["text"]) == ("Journal A/x.txt", "Journal A", "caf� 1\n2")
    assert readers.whole_text(spark, str(tmp_path / "Journal A" / "x.txt")).count() == 1
    assert readers.pdf_index(spark, str(tmp_path)).first()["stem"] == "y"


def test_failed_pdf_is_a_row(spark, tmp_path):
    (tmp_path / "y.pdf").write_bytes(b"no pdf")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/z.pdf", b"none")
    r = readers.pdf_texts(spark, str(tmp_path)).first()
    assert r["ok"] is False and r["error"] and r["text"] is None
    assert readers.zip_texts(spark, str(tmp_path / "a.zip")).first()["pdf"] == "in/z.pdf"
    with pytest.raises(ValueError, match="unknown engine"):
        readers.pdf_texts(spark, str(tmp_path), "word")


def test_json_with_control_characters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"window_id": "w", "text": "t(3) \x02 2"}\n\n{"window_id": "v", "text": null}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema="window_id string, text string").collect()
    assert rows[0]["text"] == "t(3) \x02 2" and rows[1]["text"] is None and len(rows) == 2
    (tmp_path / "r1.json").write_text(json.dumps([{"window_id": "w"}]))
    assert readers.raters(spark, str(tmp_path), ["r1"], "window_id string").first()["rater"] == "r1"
    assert readers.optional(lambda: readers.json_array(spark, str(tmp_path / "no.json"), "a string")) is None


def test_checker_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('window_id,test_type,df1,df2,test_value,p_comp,reported_p,computed_p,error,decision_error,raw\nw,t,NA,34,2.45,=,0.02,0.0195887,FALSE,FALSE,"t(34) = 2.45,\np = .020"\n')
    r = readers.checker_csv(spark, str(tmp_path / "b.csv")).first()
    assert r["df1"] is None and r["raw"] == "t(34) = 2.45,\np = .020" and r["error"] is False


def test_sinks(spark, tmp_path):
    res = online.results(spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string"))
    writers.write_results_csv(res, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    assert json.loads(writers.report_json(res).first()["report"])[0]["test_type"] == "t"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "o int, t string")
    writers.write_json_lines(rows, str(tmp_path / "js"), "o")
    assert spark.read.json(str(tmp_path / "js")).count() == 9


def test_manifest(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    (d / "a.txt").write_bytes(b"x\r\ny")
    (d / "b.bin").write_bytes(b"x\r\ny")
    m = spark.createDataFrame(writers.manifest(spark, str(d)).collect())
    import hashlib

    got = {r["path"]: r["sha256"] for r in m.collect()}
    assert got == {"a.txt": hashlib.sha256(b"x\ny").hexdigest(), "b.bin": hashlib.sha256(b"x\r\ny").hexdigest()}
    (d / "a.txt").write_bytes(b"x\ny")
    (d / "b.bin").write_bytes(b"z")
    (d / "c.bin").write_bytes(b"z")
    diff = {r["path"]: r["problem"] for r in writers.manifest_differences(m, writers.manifest(spark, str(d))).collect()}
    assert diff == {"b.bin": "changed", "c.bin": "new"}


def test_templates(spark):
    t = spark.createDataFrame([("a", 0.5)], "k string, v double")
    out = writers.render("n = {{n}}, r = {{r|pct}} {{table:t}}", {"n": 3.0, "r": 0.25}, {"t": lambda: writers.table_markdown(t)})
    assert out.startswith("n = 3, r = 25.0 %") and "| a | 0.5 |" in out
    with pytest.raises(KeyError):
        writers.render("{{x}}", {})
    assert writers.number(None) == "-"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.sql(f"SELECT id AS doc_id, '{PASSAGE}' AS text, timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts FROM range(5)")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming.write_results(streaming.results_stream(streaming.document_stream(spark, str(tmp_path / "in"), files_per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = online.results(docs)
    cols = ["doc_id", "verdict", "computed_p"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_windowed_stream(spark, tmp_path):
    docs = spark.sql(f"SELECT id AS doc_id, '{PASSAGE}' AS text, timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts FROM range(5)")
    docs.write.parquet(str(tmp_path / "in"))
    v = streaming.verdicts_per_hour(streaming.document_stream(spark, str(tmp_path / "in")))
    q = v.writeStream.format("memory").queryName("per_hour").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("per_hour").collect()) == 5
