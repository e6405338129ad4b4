"""Readers: text corpora, JSON lines and arrays, checker tables, PDFs, archives, rater files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKER = "window_id string, test_type string, df1 double, df2 double, test_value double, p_comp string, reported_p double, computed_p double, error boolean, decision_error boolean, raw string"
MANIFEST = "pdf string, txt string, journal string, pages int, chars int, non_ascii int, ok boolean, error string"


def relative(path: Column, root: str) -> Column:
    """Path of a file below ``root``, with forward slashes."""
    p = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "%20", " ")
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/+", "")


def text_corpus(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(doc, journal, text) of every text file below a folder; bytes that are no UTF-8 are replaced."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    d = f.select(relative(F.col("path"), root).alias("doc"), _decode("content").alias("text"))
    return d.select("doc", F.split_part("doc", F.lit("/"), F.lit(1)).alias("journal"), "text")


@F.pandas_udf(T.StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): one row per file, line ends kept."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, *paths: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with raw control characters inside strings; blank lines are skipped."""
    return spark.read.schema(schema).option("allowUnquotedControlChars", True).option("mode", "FAILFAST").json(list(paths))


def json_quarantined(spark: SparkSession, *paths: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON lines that can be read, and those that cannot as (file, line)."""
    options = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(list(paths)).where("trim(value) <> ''").select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    read = lines.withColumn("r", F.from_json("line", f"{schema}, _bad string", options))
    return read.where("r._bad IS NULL").select("r.*").drop("_bad"), read.where("r._bad IS NOT NULL").select("file", "line")


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON array per file, as rows."""
    return spark.read.schema(schema).option("allowUnquotedControlChars", True).option("multiLine", True).json(path)


def optional(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where the source is not there."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def checker_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the external checker: NA is null, quoted texts may run over lines."""
    return spark.read.schema(CHECKER).options(header=True, multiLine=True, escape='"', nullValue="NA").csv(path)


def checker_values(rows: DataFrame) -> DataFrame:
    """(window_id, values): the distinct readable statistics of a window."""
    return rows.groupBy("window_id").agg(F.array_sort(F.collect_set(F.round("test_value", 4))).alias("values"))


def raters(spark: SparkSession, folder: str, names: list[str], schema: T.StructType | str) -> DataFrame:
    """Files of several raters as one frame with a ``rater`` column."""
    parts = [json_array(spark, f"{folder}/{n}.json", schema).withColumn("rater", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pdf_index(spark: SparkSession, root: str) -> DataFrame:
    """(path, relpath, stem): PDFs below a folder; ``stem`` is null where another file has the same."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path")
    f = f.select("path", relative(F.col("path"), root).alias("relpath")).withColumn("_s", F.regexp_extract("relpath", r"([^/]+)\.pdf$", 1))
    once = f.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("_s", F.col("_s").alias("stem"))
    return f.join(once, "_s", "left").select("path", "relpath", "stem")


# ---- PDF engines, each optional -----------------------------------------------------------------

def _pymupdf(content: bytes) -> list[str]:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def _pdfium(content: bytes) -> list[str]:
    import pypdfium2

    doc = pypdfium2.PdfDocument(content)
    return [doc[i].get_textpage().get_text_range() for i in range(len(doc))]


def _poppler(content: bytes) -> list[str]:
    import subprocess

    return [subprocess.run(["pdftotext", "-", "-"], input=content, capture_output=True, check=True).stdout.decode("utf-8", "replace")]


ENGINES = {"pymupdf": _pymupdf, "pdfium": _pdfium, "poppler": _poppler}


def converted(content: bytes, engine: str = "pymupdf") -> dict:
    """Text and counts of one PDF; a failure is a row with ok = false and the error's first 200 characters."""
    try:
        pages = ENGINES[engine](content)
        text = "".join(pages)
        return {"text": text, "pages": len(pages), "chars": len(text), "non_ascii": sum(c > "\x7f" for c in text), "ok": True, "error": None}
    except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
        return {"text": None, "pages": None, "chars": None, "non_ascii": None, "ok": False, "error": f"{type(e).__name__}: {e}"[:200]}


_CONVERTED = T.StructType([T.StructField("pdf", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pages", T.IntegerType()), T.StructField("chars", T.IntegerType()), T.StructField("non_ascii", T.IntegerType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])


def pdf_texts(spark: SparkSession, root: str, engine: str = "pymupdf") -> DataFrame:
    """(pdf, text, pages, chars, non_ascii, ok, error) of every PDF below a folder."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}; known are {', '.join(ENGINES)}")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)

    def run(batches):
        for b in batches:
            yield pd.DataFrame([{"pdf": p, **converted(bytes(c), engine)} for p, c in zip(b["pdf"], b["content"])], columns=_CONVERTED.fieldNames())

    return f.select(relative(F.col("path"), root).alias("pdf"), "content").mapInPandas(run, _CONVERTED)


_FONTS = "pdf string, page int, font string, text string, error string"


def pdf_fonts(spark: SparkSession, root: str) -> DataFrame:
    """(pdf, page, font, text, error) of every span of every PDF below a folder; the engine is optional
    and a file that it cannot read is a row with its error."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)

    def spans(content: bytes):
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as doc:
            for n, page in enumerate(doc):
                for block in page.get_text("dict")["blocks"]:
                    for line in block.get("lines", ()):
                        yield from ((n, s["font"], s["text"]) for s in line["spans"])

    def run(batches):
        for b in batches:
            for path, content in zip(b["pdf"], b["content"]):
                try:
                    rows = [(path, *s, None) for s in spans(bytes(content))]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
                    rows = [(path, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["pdf", "page", "font", "text", "error"])

    return f.select(relative(F.col("path"), root).alias("pdf"), "content").mapInPandas(run, _FONTS)


def zip_texts(spark: SparkSession, path: str, engine: str = "pymupdf") -> DataFrame:
    """As ``pdf_texts`` for the PDFs inside zip archives."""

    def run(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".pdf")):
                        yield pd.DataFrame([{"pdf": name, **converted(z.read(name), engine)}], columns=_CONVERTED.fieldNames())

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _CONVERTED)


def conversion_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("non_ascii").alias("non_ascii"))
