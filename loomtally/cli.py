"""Command line: check the results of a text, a PDF or a folder of them.

    python -m loomtally.cli check FILE_OR_FOLDER [--json | --csv OUT] [--model FOLDER] [--engine NAME]

Exit codes: 0 done, 2 for what was asked wrongly (no such file, unknown kind of file, no engine).
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.plans import online
from loomtally.sources import readers, writers

# The modules that read PDFs.
MODULES = {"pymupdf": "pymupdf", "pdfium": "pypdfium2"}


class Asked(Exception):
    """What was asked cannot be done."""


def documents(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """(doc_id, text) of a file or of every text and PDF below a folder."""
    if os.path.isdir(path):
        texts = readers.text_corpus(spark, path).select(F.col("doc").alias("doc_id"), "text")
        pdfs = any(f.lower().endswith(".pdf") for _, _, files in os.walk(path) for f in files)
        return texts.unionByName(_pdfs(spark, path, engine)) if pdfs else texts
    if not os.path.isfile(path):
        raise Asked(f"no such file: {path}")
    kind = os.path.splitext(path)[1].lower()
    if kind == ".txt":
        return readers.whole_text(spark, path).select(F.lit(path).alias("doc_id"), "text")
    if kind == ".pdf":
        return _pdfs(spark, path, engine)
    raise Asked(f"unsupported kind of file: {kind or path}; known are .txt and .pdf")


def _pdfs(spark: SparkSession, path: str, engine: str) -> DataFrame:
    if engine in MODULES and importlib.util.find_spec(MODULES[engine]) is None:
        raise Asked(f"reading a PDF needs the module {MODULES[engine]}")
    return readers.pdf_texts(spark, path, engine).where("ok").select(F.col("pdf").alias("doc_id"), "text")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomtally")
    check = parser.add_subparsers(dest="command", required=True).add_parser("check", help="find and check reported results")
    check.add_argument("path")
    check.add_argument("--json", action="store_true", help="one report in JSON a document")
    check.add_argument("--csv", metavar="OUT", help="write the results as CSV into a folder")
    check.add_argument("--model", metavar="FOLDER", help="a tagger's folder")
    check.add_argument("--engine", default="pymupdf", choices=sorted(readers.ENGINES))
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from loomtally.session import local_session

    spark = spark or local_session("*")
    try:
        docs = documents(spark, a.path, a.engine)
        options = online.Options()
        if a.model:
            from loomtally.operators import tagger

            if not os.path.isdir(a.model):
                raise Asked(f"no such folder: {a.model}")
            options = online.Options(model=tagger.finder(a.model))
    except Asked as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    found = online.results(docs, options)
    if a.csv:
        writers.write_results_csv(found, a.csv)
    elif a.json:
        for r in writers.report_json(found.drop("window", "rank", "seq")).orderBy("doc_id").toLocalIterator():
            print(json.dumps({"source": r["doc_id"], "results": json.loads(r["report"])}, ensure_ascii=False))
    else:
        for r in found.select("doc_id", "line", "window", "rank", "seq", writers.result_line().alias("text")).orderBy("doc_id", "window", "rank", "seq").toLocalIterator():
            print(r["text"])
        counts = found.groupBy("verdict").count().orderBy("verdict").collect()
        print(", ".join(f"{r['verdict']}={r['count']}" for r in counts) or "no results found")
    return 0


if __name__ == "__main__":
    sys.exit(main())
