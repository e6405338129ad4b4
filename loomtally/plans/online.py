"""The online path: normalise, repair, prefilter, find, check; one document stays one row.

Every stage is row-local, so a whole run is a scan and projections: no shuffle, and the same plan
serves batch and streaming frames. Finders are plug-ins (column of window texts -> array of arrays of
extractions); pattern rows come before a model's in every window, and the first result with a value
wins in its document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions import numbers, tails, text
from loomtally.operators.extract import extract_each_udf, may_hold
from loomtally.operators.repair import with_repaired


@dataclass(frozen=True)
class Options:
    normalise: bool = True
    repair: bool = True
    pattern: bool = True
    model: Callable[[Column], Column] | None = None
    alpha: float = 0.05


def _found(windows: Column, each: Column, source: str, rank: int) -> Column:
    """Flat array of findings with their order (window, source, place in the window)."""
    per = F.transform(windows, lambda w, i: F.struct(w.alias("w"), F.element_at(each, i + 1).alias("xs"), i.alias("i")))

    def one(p: Column) -> Column:
        return F.transform(
            p["xs"],
            lambda x, j: F.struct(
                p["i"].alias("window"), F.lit(rank).alias("rank"), j.alias("seq"), F.lit(source).alias("source"), p["w"]["line"].alias("line"),
                F.nullif(x["test_type"], F.lit("")).alias("test_type"), numbers.printed_number(x["statistic"]).alias("statistic"),
                numbers.printed_number(x["df1"]).alias("df1"), numbers.printed_number(x["df2"]).alias("df2"), x["p_operator"].alias("p_operator"),
                numbers.printed_number(x["p_value"]).alias("p_value"), x["statistic"].alias("statistic_text"), x["p_value"].alias("p_text"), x["raw"].alias("quote"),
            ),
        )

    return F.flatten(F.transform(per, one))


def with_first_wins(df: DataFrame, found: str) -> DataFrame:
    """The first finding per statistic (three decimals); without one, a pattern's first row stays."""
    key = lambda x: F.coalesce((F.round(x["statistic"], 3) + F.lit(0.0)).cast("string"), F.lit("none"))
    allowed = F.filter(found, lambda x: (x["source"] == "pattern") | x["statistic"].isNotNull())
    df = text.hold(df, **{found: F.array_sort(allowed)})
    df = text.hold(df, _keys=F.transform(found, key))
    return text.hold(df, **{found: F.filter(found, lambda x, i: F.array_position(F.col("_keys"), key(x)) == i + 1)}).drop("_keys")


def prepared(docs: DataFrame, options: Options = Options(), key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, text, windows, lines, renamed, repair): texts ready for the finders."""
    d = docs.select(F.col(key), F.col(body).alias("_body"))
    if options.normalise:
        d = text.with_normalised(d, "_body", "text", "renamed").drop("_body")
    else:
        d = d.withColumnRenamed("_body", "text").withColumn("renamed", F.lit(None).cast("map<string,string>"))
    if options.repair:
        d = with_repaired(d, "text").withColumn("text", F.col("repair.text"))
    else:
        d = d.withColumn("repair", F.lit(None).cast("struct<mapping:map<string,string>,replacements:int,rule:string>"))
    return text.with_grown_windows(d, "text")


def findings(docs: DataFrame, options: Options = Options(), key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, lines, windows, renamed, repair, found): one row per document, found in order, first wins."""
    d = prepared(docs, options, key, body)
    parts = []
    if options.pattern:  # windows without an ending that all families share never leave the JVM
        d = text.hold(d, _likely=F.transform("windows", lambda w: F.when(may_hold(w["text"]), w["text"])))
        d = text.hold(d, _pattern=extract_each_udf("_likely"))
        parts.append(_found(F.col("windows"), F.col("_pattern"), "pattern", 0))
    if options.model is not None:
        d = text.hold(d, _model=options.model(F.transform("windows", lambda w: w["text"])))
        parts.append(_found(F.col("windows"), F.col("_model"), "model", 1))
    if not parts:
        raise ValueError("at least one finder is needed")
    d = d.select(key, "lines", F.size("windows").alias("windows"), "renamed", "repair", F.concat(*parts).alias("found"))
    return with_first_wins(d, "found")


def results(docs: DataFrame, options: Options = Options(), key: str = "doc_id", body: str = "text") -> DataFrame:
    """One row per result with its verdict."""
    x = findings(docs, options, key, body).select(key, F.explode("found").alias("f")).select(key, "f.*")
    v = tails.check(*(F.col(c) for c in ("test_type", "statistic", "df1", "df2", "p_operator", "p_value", "p_text", "statistic_text")), alpha=options.alpha)
    return x.withColumn("check", v).select(
        key, "line", "source", "test_type", "statistic", "df1", "df2", "p_operator", "p_value", "statistic_text", "p_text", "quote",
        F.lit(False).alias("repaired"), "check.verdict", "check.computed_p", "check.reason", "check.missing", "window", "rank", "seq",
    )


def stages(docs: DataFrame, options: Options = Options(), key: str = "doc_id", body: str = "text") -> DataFrame:
    """Per document what each stage did: lines, windows, replacements, results by source."""
    f = findings(docs, options, key, body)
    by = lambda s: F.size(F.filter("found", lambda x: x["source"] == s))
    return f.select(key, "lines", "windows", F.coalesce("repair.replacements", F.lit(0)).alias("replacements"), F.col("repair.rule").alias("repair_rule"), by("pattern").alias("by_pattern"), by("model").alias("by_model"))


def cascade(pattern: DataFrame, model: DataFrame, passage: str = "window_id", value: str = "value", order: str = "seq") -> DataFrame:
    """(passage, value, source, added): findings of two systems put together per passage, the pattern's
    first. A finding counts once per value (three decimals of four); a pattern's finding without a value
    counts once, a model's never. ``added`` is false for a model's finding that adds nothing."""
    both = pattern.select(passage, value, order, F.lit("pattern").alias("source")).unionByName(model.select(passage, value, order, F.lit("model").alias("source")))
    both = both.withColumn("_k", F.round(F.round(F.col(value), 4), 3) + F.lit(0.0))
    rank = F.struct((F.col("source") == "model").alias("m"), F.col(order).alias("o"))
    first = F.row_number().over(Window.partitionBy(passage, "_k").orderBy(rank)) == 1
    out = both.withColumn("added", first & ((F.col("source") == "pattern") | F.col("_k").isNotNull()))
    return out.where((F.col("source") == "model") | F.col("added")).select(passage, value, "source", "added")


def cascade_counts(found: DataFrame, passage: str = "window_id") -> DataFrame:
    """(passage, pattern, model_added, model_duplicate) of a cascade."""
    model = F.col("source") == "model"
    return found.groupBy(passage).agg(F.count_if(~model).alias("pattern"), F.count_if(model & F.col("added")).alias("model_added"), F.count_if(model & ~F.col("added")).alias("model_duplicate"))


def verdict_counts(res: DataFrame, key: str = "doc_id") -> DataFrame:
    kinds = ("consistent", "inconsistent", "decision_error", "undecidable")
    return res.groupBy(key).agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in kinds), F.count(F.lit(1)).alias("results"))


def missing_counts(res: DataFrame) -> DataFrame:
    return res.select(F.explode("missing").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
