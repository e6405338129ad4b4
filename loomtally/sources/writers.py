"""Sinks: results as JSON or CSV, ordered JSON lines, batch files, hash manifests, Markdown reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files whose line ends are folded before hashing.
TEXT_SUFFIXES = ("txt", "json", "jsonl", "csv", "md", "py", "tsv")


def report_json(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, report): the results of a document as one JSON text."""
    row = F.struct(*(c for c in results.columns if c != key))
    return results.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("report"))


def result_line(r: Column | None = None) -> Column:
    """A result as a line for people: place, test, p, recomputed p, verdict, source."""
    col = (lambda c: r[c]) if r is not None else F.col
    plain = lambda x: F.regexp_replace(F.format_string("%.12f", x), r"0+$", "")  # noqa: E731 - no exponents
    num = lambda c: F.coalesce(F.when(col(c) == F.floor(col(c)), col(c).cast("long").cast("string")).when(col(c).isNotNull(), plain(col(c))), F.lit("NA"))
    name = F.coalesce(col("test_type"), F.lit("?"))
    df = F.when(col("df1").isNull(), F.lit("")).when(col("df2").isNull(), F.concat(F.lit("("), num("df1"), F.lit(")"))).otherwise(F.concat(F.lit("("), num("df1"), F.lit(", "), num("df2"), F.lit(")")))
    p = F.when(col("computed_p").isNull(), F.lit("NA")).otherwise(F.format_string("%.4f", col("computed_p")))
    head = F.concat(F.lpad(col("line").cast("string"), 5, " "), F.lit("  "), name, df, F.lit(" = "), num("statistic"))
    return F.concat(head, F.lit(", p "), F.coalesce(col("p_operator"), F.lit("=")), F.lit(" "), num("p_value"), F.lit("  "), p, F.lit("  "), F.coalesce(col("verdict"), F.lit("NA")), F.lit("  ["), F.coalesce(col("source"), F.lit("?")), F.lit("]"))


def write_results_csv(results: DataFrame, path: str) -> None:
    """Results as CSV with a header, arrays joined, partitions left as they are."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    results.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines in the order of an ordinal, range-partitioned so that files sort too."""
    rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_batches(batched: DataFrame, path: str) -> None:
    """One folder per batch_id."""
    batched.repartition("batch_id").sortWithinPartitions("batch_id", "pos").write.mode("overwrite").partitionBy("batch_id").json(path)


def content_hash(path: Column, content: Column) -> Column:
    """SHA-256 of a file's bytes; CRLF counts as LF in text files."""
    text = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*TEXT_SUFFIXES)
    return F.when(text, F.sha2(F.encode(F.regexp_replace(F.decode(content, "ISO-8859-1"), "\r\n", "\n"), "ISO-8859-1"), 256)).otherwise(F.sha2(content, 256))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    from loomtally.sources.readers import relative

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(relative(F.col("path"), root).alias("path"), content_hash(F.col("path"), F.col("content")).alias("sha256"))


def manifest_differences(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, changed or new."""
    j = recorded.select("path", F.col("sha256").alias("was")).join(present.select("path", F.col("sha256").alias("now")), "path", "full")
    problem = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("was").isNull(), F.lit("new")).when(F.col("was") != F.col("now"), F.lit("changed"))
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


_SLOT = re.compile(r"\{\{\s*([^{}|]+?)\s*(?:\|\s*([^{}]*?)\s*)?\}\}")


def number(value, style: str | None = None) -> str:
    """A value for a report: '-' for none, whole numbers plain, 'pct', 'ci' or a format spec on request."""
    if value is None:
        return "-"
    if style == "pct":
        return f"{100 * value:.1f} %"
    if style == "ci":
        return f"[{value[0]:.3f}, {value[1]:.3f}]"
    if style:
        return format(value, style)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else f"{value:.4g}"
    return str(value)


def table_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; more than ``most`` rows are an error, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report's table has more than {most} rows")
    if not got:
        return "(no rows)"
    head = rows.columns
    return "\n".join([f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(number(r[c]) for c in head)} |" for r in got)])


def report_values(frames: dict[str, DataFrame], most: int = 10_000) -> dict:
    """Values for a template: name.column of a frame of one row, name.key.column of frames whose first
    column is a key. Frames are report tables; more rows than ``most`` are an error."""
    out: dict = {}
    for name, frame in frames.items():
        rows = frame.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        for r in rows:
            head = name if len(rows) == 1 else f"{name}.{r[0]}"
            out |= {f"{head}.{c}": r[c] for c in frame.columns}
    return out


def render(template: str, values: dict, tables: dict[str, Callable[[], str]] | None = None) -> str:
    """A template with {{key|format}} and {{table:name}} filled in; anything unknown is an error."""

    def put(m: re.Match) -> str:
        key, style = m.group(1), m.group(2)
        if key.startswith("table:"):
            name = key[6:]
            if name not in (tables or {}):
                raise KeyError(f"no table {name}")
            return tables[name]()
        if key not in values:
            raise KeyError(f"no value {key}")
        return number(values[key], style)

    return _SLOT.sub(put, template)
