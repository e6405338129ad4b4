"""Every query of the core, by name; the SQL they are held against is in ``oracle``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtally.functions import numbers, tails, text
from loomtally.functions import rules as R
from loomtally.operators import annotate, evaluate, extract, repair, sample, tagger
from loomtally.plans import online
from loomtally.plans.oracle import SQL  # noqa: F401 - part of this module's interface
from loomtally.session import scratch, spread, table
from loomtally.sources import readers, writers

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- online path --------------------------------------------------------------------------------

@query
def online_results(spark: SparkSession, d: str) -> DataFrame:
    r = online.results(spread(table(spark, d, "documents")))
    return r.select("doc_id", "line", "source", "test_type", "statistic_text", "df1", "df2", "p_operator", "p_text", "verdict", F.round("computed_p", 8).alias("computed_p"), "reason", F.array_join("missing", ",").alias("missing"), "quote")


@query
def online_stages(spark: SparkSession, d: str) -> DataFrame:
    return online.stages(spread(table(spark, d, "documents")))


@query
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return online.verdict_counts(online.results(spread(table(spark, d, "documents"))))


@query
def missing_parts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", F.posexplode("results").alias("seq", "r"))
    v = tails.check(F.col("r.test_type"), *(numbers.as_number(F.col(f"r.{c}")) for c in ("statistic", "df1", "df2")), F.col("r.p_operator"), numbers.as_number(F.col("r.p_value")))
    return h.select("record_id", "seq", F.explode(v["missing"]).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---- text rules ---------------------------------------------------------------------------------

def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line", "value"))


@query
def line_density(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line", F.round(text.density(F.col("value")), 6).alias("density"))


@query
def prefilter_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(text.keeps_line(F.col("value"))).select("doc_id", "line")


@query
def reference_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(text.is_reference(F.col("value"))).select("doc_id", "line")


@query
def reference_strip(spark: SparkSession, d: str) -> DataFrame:
    s = text.with_stripped(table(spark, d, "documents").select("doc_id", "text"), "text", "ls", "lines")
    return s.select("doc_id", "lines", F.size(F.filter("ls", lambda x: x != "")).alias("kept"))


@query
def windows_grown(spark: SparkSession, d: str) -> DataFrame:
    w = text.with_grown_windows(spread(table(spark, d, "documents")).select("doc_id", "text"), "text")
    return w.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.line", "w.start_line", "w.end_line", F.length("w.text").alias("chars"))


@query
def windows_fixed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", text.fixed_windows(text.lines(F.col("text"))).alias("ws"))
    return df.select("doc_id", F.explode("ws").alias("w")).select("doc_id", "w.line", F.length("w.text").alias("chars"))


@query
def windows_by_frame(spark: SparkSession, d: str) -> DataFrame:
    """Characters around a line, by a frame over the line table instead of arrays."""
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(-2, 2)
    return _lines(spark, d).select("doc_id", "line", F.sum(F.length("value") + 1).over(w).alias("chars"))


@query
def normalised_texts(spark: SparkSession, d: str) -> DataFrame:
    n = text.with_normalised(spread(table(spark, d, "documents")).select("doc_id", "text"), "text", "fixed")
    return n.select("doc_id", F.sha2("fixed", 256).alias("sha256"), F.size(text.lines(F.col("fixed"))).alias("lines"), F.size("_renamed").alias("renamed"))


@query
def folded_spaces(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "holdout").select("record_id", F.sha2(text.fold_spaces(t), 256).alias("folded"), F.length(text.squeeze(t)).alias("squeezed"), F.sha2(text.flatten(t), 256).alias("flat"))


@query
def pool_counts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return sample.candidate_windows(h).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query
def damage_families(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "holdout").select(F.explode("results").alias("r"))
    return r.where("r.damaged").groupBy(text.damage_family(F.col("r.quote")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query
def character_ids(spark: SparkSession, d: str) -> DataFrame:
    known = F.map_from_arrays(F.split(F.lit("abcdefghijklmnopqrstuvwxyz "), ""), F.sequence(F.lit(2), F.lit(28)))
    ids = text.character_ids(F.col("text"), known)
    return table(spark, d, "holdout").select("record_id", F.aggregate(ids, F.lit(0), lambda a, x: a + x).alias("total"), F.size(F.filter(ids, lambda x: x == 1)).alias("unknown"))


# ---- repair -------------------------------------------------------------------------------------

@query
def repaired_documents(spark: SparkSession, d: str) -> DataFrame:
    """Windows, whose operators fonts have damaged, with the map that repaired each."""
    r = repair.with_repaired(spread(table(spark, d, "holdout")).select("record_id", "text"), "text", "r")
    return r.select("record_id", F.sha2("r.text", 256).alias("sha256"), "r.replacements", "r.rule", F.size("r.mapping").alias("mapped"), F.size("r.alternatives").alias("alternatives"))


@query
def operator_sites(spark: SparkSession, d: str) -> DataFrame:
    """Characters between closing brackets and numbers, and between p and numbers."""
    t = table(spark, d, "holdout").select("text")
    a = t.select(F.lit("after_df").alias("place"), F.explode(F.regexp_extract_all("text", F.lit(r"\)[ \n]*([\x00-\x08\x0b\x0c\x0e-\x1f¼\\!bNp])[ \n]*-?[0-9]*\.?[0-9]"), F.lit(1))).alias("ch"))
    b = t.select(F.lit("after_p").alias("place"), F.explode(F.regexp_extract_all("text", F.lit(r"[^A-Za-z]p[ \n]*([\x00-\x08\x0b\x0c\x0e-\x1f¼\\!bN])[ \n]*-?[0-9]*\.?[0-9]"), F.lit(1))).alias("ch"))
    return a.union(b).groupBy("place", F.hex("ch").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query
def glyph_table(spark: SparkSession, d: str) -> DataFrame:
    """What each damaged character of a journal stands for, by where it stands."""
    h = table(spark, d, "holdout").select(F.lower(F.trim("journal")).alias("font"), "text").where("font IS NOT NULL")
    a = h.select("font", F.lit("after_df").alias("place"), F.explode(F.regexp_extract_all("text", F.lit(r"\)[ \n]*([\x01-\x08\x0b\x0c\x0e-\x1f¼])[ \n]*-?[0-9]*\.?[0-9]"), F.lit(1))).alias("code"), F.lit(None).cast("double").alias("value"))
    m = h.select("font", F.explode(F.regexp_extract_all("text", F.lit(r"[^A-Za-z]p[ \n]*[\x01-\x08\x0b\x0c\x0e-\x1f¼][ \n]*[0-9]*\.?[0-9]+"), F.lit(0))).alias("m"))
    b = m.select("font", F.lit("after_p").alias("place"), F.regexp_extract("m", r"p[ \n]*([\x01-\x08\x0b\x0c\x0e-\x1f¼])", 1).alias("code"), F.regexp_extract("m", r"([0-9]*\.?[0-9]+)$", 1).try_cast("double").alias("value"))
    return repair.glyph_table(a.unionByName(b)).select("font", F.hex("code").alias("code"), "after_df", "after_p", "thresholds", "char")


# ---- extraction ---------------------------------------------------------------------------------

@query
def extract_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every family in windows, JVM-side (families apart, nothing dropped)."""
    return extract.extract_native(table(spark, d, "holdout").select("record_id", "text")).drop("text")


@query
def extract_spans(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", "text")
    return extract.iter_extractions(h).select("record_id", "seq", "extraction.test_type", "extraction.start", "extraction.end", "extraction.raw")


@query
def quote_found(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", "text", F.posexplode("results").alias("seq", "r"))
    return h.select("record_id", "seq", text.holds_quote(F.col("text"), F.col("r.quote")).alias("found"))


@query
def quote_alignment(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", "text", "results").withColumn("a", extract.align_udf("text", "results"))
    return h.select("record_id", F.posexplode("a").alias("seq", "a")).select("record_id", "seq", F.element_at("a.block_span", 1).alias("start"), F.element_at("a.block_span", 2).alias("end"), F.size("a.part_spans").alias("parts"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, seq, entity, start, end) of labelled parts; POP by the operator named."""
    h = table(spark, d, "holdout").select("record_id", F.posexplode("results").alias("seq", "r"))
    p = h.select("record_id", "seq", F.col("r.p_operator").alias("op"), F.explode("r.part_spans").alias("part", "span")).where("span IS NOT NULL")
    label = numbers.part_label(F.col("part"), F.col("op"))
    return p.select("record_id", "seq", label.alias("entity"), F.element_at("span", 1).alias("start"), F.element_at("span", 2).alias("end")).where("entity IS NOT NULL")


@query
def part_labels(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring parts of a window that overlap."""
    s = _spans(spark, d).groupBy("record_id").agg(F.collect_list(F.struct("start", "end", "entity")).alias("spans"))
    o = s.select("record_id", F.explode(extract.overlaps(F.col("spans"))).alias("p"))
    return o.select("record_id", "p.a.entity", "p.a.start", "p.a.end", F.col("p.b.start").alias("next"))


@query
def span_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts grouped into results again and built into typed rows."""
    s = _spans(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("spans"))
    j = s.join(table(spark, d, "holdout").select("record_id", "text"), "record_id")
    j = text.hold(j, groups=extract.grouped(F.col("text"), F.col("spans")))
    b = j.select("record_id", F.posexplode("groups").alias("k", "g")).withColumn("b", extract.built(F.col("g")))
    return b.where("b IS NOT NULL").select("record_id", "k", "b.test_type", "b.statistic", "b.df1", "b.df2", "b.p_operator", "b.p_value")


# ---- numbers and the check ----------------------------------------------------------------------

@query
def numbers_read(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "disputes").select("decision_id", F.posexplode("candidates").alias("seq", "c"))
    return c.select("decision_id", "seq", numbers.as_number(F.col("c.statistic")).alias("value"), numbers.printed_number(F.col("c.statistic")).alias("printed"))


@query
def codes_normalised(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "holdout").select(F.explode("results").alias("r"))
    return r.groupBy(numbers.test_type(F.col("r.test_type")).alias("test_type"), numbers.operator(F.col("r.p_operator")).alias("p_operator")).agg(F.count(F.lit(1)).alias("n"), F.count_if(numbers.checkable(F.col("r.statistic"), F.col("r.df1"), F.col("r.p_value"))).alias("checkable"))


@query
def p_values(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "statcheck_repaired")
    kind = F.lower(F.trim("test_type"))
    f = kind == "f"
    p = tails.p_value(kind, F.col("test_value"), F.when(f, F.col("df1")).otherwise(F.coalesce("df1", "df2")), F.when(f, F.col("df2")))
    return b.select("row_id", F.round(p, 9).alias("p"))


@query
def baseline_check(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.baseline_verdicts(spread(table(spark, d, "statcheck_repaired")))
    return c.select("row_id", "check.verdict", F.round("check.computed_p", 9).alias("p"), "error", "decision_error")


@query
def verdict_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.verdict_agreement(spread(table(spark, d, "statcheck_repaired")))


@query
def printed_tokens(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "statcheck_repaired")
    return b.where("raw IS NOT NULL AND test_value IS NOT NULL").select("row_id", F.length(numbers.printed_decimals(F.col("raw"), F.abs("test_value"))).alias("chars")).where("chars > 0")


def _chi(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square reports with even degrees of freedom, derived from whole numbers of line items."""
    x = spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", (2 * (1 + F.col("l_partkey") % 20)).cast("int").alias("df"), (50 + (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 2500).cast("int").alias("s100"), ((F.col("l_suppkey") * 13) % 1000).cast("int").alias("p1000"))
    return x.withColumn("stat", F.col("s100") / 100).withColumn("p", F.col("p1000") / 1000)


@query
def check_chi2(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of derived chi-square reports by the native closed form: no Python in the plan."""
    x = text.hold(_chi(spark, d), **{n: F.round(tails.chi2_even(F.col("stat") + e, F.col("df")), 3 if e else 9) for n, e in (("computed", 0.0), ("low", 0.005), ("up", -0.005))})
    wrong = (F.col("p") <= 0) | (F.col("p") < F.col("low")) | (F.col("p") > F.col("up"))
    flips = (F.col("p") <= R.ALPHA) != (F.col("computed") <= R.ALPHA)
    verdict = F.when(~wrong, F.lit("consistent")).when(flips, F.lit("decision_error")).otherwise(F.lit("inconsistent"))
    return x.select("l_orderkey", "l_linenumber", F.round("computed", 6).alias("computed_p"), verdict.alias("verdict"))


# ---- combine ------------------------------------------------------------------------------------

def _gold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gold(table(spark, d, "holdout"))[0]


def _found(spark: SparkSession, d: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    b = table(spark, d, "statcheck_repaired")
    if kinds:
        b = b.where(F.lower("test_type").isin(*kinds))
    return b.select("window_id", (F.round("test_value", 4) + F.lit(0.0)).alias("value"))


@query
def cascade_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Checker rows before gold rows, the first of equal values (three decimals) per window."""
    a = _found(spark, d).select("window_id", "value", F.lit(0).alias("rank"), F.lit("pattern").alias("source"))
    b = _gold(spark, d).select("window_id", "value", F.lit(1).alias("rank"), F.lit("model").alias("source"))
    first = a.unionByName(b).groupBy("window_id", (F.round("value", 3) + F.lit(0.0)).alias("key")).agg(F.min(F.struct("rank", "source")).alias("m"))
    return first.select("window_id", "key", "m.source")


@query
def common_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that both the checker and the gold rows know, and the documents behind them."""
    h = table(spark, d, "holdout").select("window_id", "source_doc").distinct()
    return h.join(_found(spark, d).select("window_id").distinct(), "window_id", "left_semi")


@query
def unused_documents(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversion_manifest").where("ok AND txt IS NOT NULL").select("txt").distinct()
    return m.join(table(spark, d, "holdout").select(F.col("source_doc").alias("txt")), "txt", "left_anti")


@query
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout")
    train = h.where("set = 'train'").select("source_doc").distinct()
    return h.where("set <> 'train'").select("source_doc", "set").distinct().join(train, "source_doc", "left_semi")


@query
def document_pdfs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversion_manifest").where("txt IS NOT NULL").groupBy("txt").agg(F.min("pdf").alias("pdf"), F.max("pages").alias("pages"))
    h = table(spark, d, "holdout").groupBy("source_doc").agg(F.count(F.lit(1)).alias("windows"))
    return h.join(m, h.source_doc == m.txt, "left").select("source_doc", "windows", "pdf", "pages")


@query
def span_match_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labelled blocks and extracted matches that overlap by half of the shorter."""
    h = table(spark, d, "holdout").select(F.col("record_id").alias("window_id"), F.posexplode("results").alias("seq", "r")).where("r.block_span IS NOT NULL")
    a = h.select("window_id", "seq", F.element_at("r.block_span", 1).alias("start"), F.element_at("r.block_span", 2).alias("end"))
    x = extract.iter_extractions(table(spark, d, "holdout").select(F.col("record_id").alias("window_id"), "text"))
    return annotate.lenient_candidates(a, x.select("window_id", "seq", "extraction.start", "extraction.end"))


# ---- annotation ---------------------------------------------------------------------------------

def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """(item, rater, label): a rater's latest decision on a dispute."""
    p = "decision.provenance"
    x = table(spark, d, "disputes").where(F.col("decision.keep").isNotNull())
    rater = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(f"{p}.rater"))), r"[^a-z0-9]+", ""), r"^([a-z]+)0*", "$1")
    x = x.select(F.col("dispute_id").alias("item"), rater.alias("rater"), F.col("decision.keep").alias("label"), F.struct(F.expr(f"try_to_timestamp({p}.collected_at)").alias("t"), F.col("decision_id").alias("i")).alias("v"))
    return x.groupBy("item", "rater").agg(F.max_by("label", "v").alias("label"))


@query
def raw_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = annotate.raw_agreement(_ratings(spark, d))
    return a.select("items", F.round("raw", 6).alias("raw"))


@query
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = annotate.cohen_kappa(_ratings(spark, d))
    return k.select("rater_a", "rater_b", "n", F.round("kappa", 6).alias("kappa"))


@query
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return annotate.fleiss_by_panel(_ratings(spark, d)).select("raters", "subjects", F.round("kappa", 6).alias("kappa"))


@query
def rater_against_final(spark: SparkSession, d: str) -> DataFrame:
    """Every rater's decisions against the dispute's last one."""
    x = table(spark, d, "disputes").where(F.col("decision.keep").isNotNull())
    last = F.struct(F.expr("try_to_timestamp(decision.provenance.collected_at)").alias("t"), F.col("decision_id").alias("i"))
    final = x.groupBy(F.col("dispute_id").alias("item")).agg(F.max_by(F.col("decision.keep"), last).alias("label"))
    a = annotate.against_final(_ratings(spark, d), final)
    return a.select("rater", "items", "same", F.round("agreement", 6).alias("agreement"), "only_rater", "only_final")


@query
def kripp_alpha(spark: SparkSession, d: str) -> DataFrame:
    return annotate.krippendorff_alpha(_ratings(spark, d)).select(F.col("values").alias("n"), F.round("alpha", 6).alias("alpha"))


def _decided(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, list[str]]:
    """Results that raters let stand, one per dispute and rater (by ``name`` in their provenance), the
    latest decision counting, and the raters: a handful of people or models."""
    p = "decision.provenance"
    rater = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(f"{p}.{name}"))), r"[^a-z0-9]+", ""), r"^([a-z]+)0*", "$1")
    x = table(spark, d, "disputes").where("decision IS NOT NULL").select("dispute_id", rater.alias("rater"), "decision", F.struct(F.expr(f"try_to_timestamp({p}.collected_at)").alias("t"), F.col("decision_id").alias("i")).alias("v")).where("rater IS NOT NULL")
    last = x.groupBy("dispute_id", "rater").agg(F.max_by("decision", "v").alias("decision")).where("decision.keep AND decision.result IS NOT NULL")
    fields = [F.col(f"decision.result.{f}").alias(f) for f in R.RESULT_FIELDS]
    rows = last.select(F.col("dispute_id").alias("window_id"), "rater", F.lit(0).alias("seq"), F.struct(*fields, F.lit(None).cast("array<int>").alias("span")).alias("result"))
    names = sorted(r[0] for r in x.select("rater").distinct().limit(1001).collect())
    if len(names) > 1000:
        raise ValueError("a panel of more than 1000 raters")
    return rows, names


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Labelled results by the raters who found them, with their spans."""
    h = table(spark, d, "holdout").select(F.col("record_id").alias("window_id"), F.posexplode("results").alias("seq", "r"))
    fields = [F.col(f"r.{f}").alias(f) for f in R.RESULT_FIELDS]
    rows = h.select("window_id", F.explode("r.raters").alias("rater"), "seq", F.struct(*fields, F.col("r.block_span").alias("span")).alias("result"))
    return rows, sorted(r[0] for r in rows.select("rater").distinct().limit(1000).collect())


@query
def consensus_windows(spark: SparkSession, d: str) -> DataFrame:
    c = annotate.consensus(*_decided(spark, d, "rater"))
    return c.select(
        "window_id", F.size("kept").alias("kept"), F.size("disputes").alias("disputes"), F.array_join(F.transform("kept", lambda k: k["tier"]), ",").alias("tiers"), F.array_join(F.transform("disputes", lambda x: F.concat_ws(":", x["kind"], x["field"])), ",").alias("open")
    )


@query
def rater_f1(spark: SparkSession, d: str) -> DataFrame:
    f = annotate.result_f1(*_marked(spark, d))
    return f.select("rater_a", "rater_b", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "disputes").groupBy("dispute_id").agg(F.min_by("candidates", "decision_id").alias("cs")).select(F.col("dispute_id").alias("cluster"), F.posexplode("cs").alias("rank", "c")).select("cluster", "rank", F.col("c.df1").alias("df1"))
    return annotate.field_votes(c, "df1")


@query
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Raters' rows as outputs, the windows of the data as the batch: undecided rows, candidates without a
    quote or with unknown codes, windows that are not there."""
    x = table(spark, d, "disputes")
    known = table(spark, d, "holdout").select("window_id").distinct()
    batch = x.select(F.col("decision_id").alias("pos"), "window_id").join(known, "window_id", "left_semi")
    out = x.select(F.col("decision_id").alias("pos"), "window_id", F.col("decision.keep").alias("contains_result"), F.col("candidates").alias("results"))
    return annotate.violations(batch, out).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def dispute_audit(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "disputes")
    return x.groupBy("kind", "field").agg(F.count_distinct("dispute_id").alias("disputes"), F.count("decision").alias("decided"), F.count(F.lit(1)).alias("rows"))


@query
def decision_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The latest ingested decision per dispute."""
    x = table(spark, d, "disputes")
    top = x.groupBy("dispute_id").agg(F.max_by("decision_id", F.struct("ingested_at", "decision_id")).alias("decision_id"), F.count(F.lit(1)).alias("n"))
    return top


# ---- evaluation ---------------------------------------------------------------------------------

@query
def gold_index(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("window_id", "value", "damaged", "test_type", "checkable", "family", "tier")


@query
def score_system(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.score(evaluate.facts(_gold(spark, d), _found(spark, d)))
    return s.select("bucket", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query
def score_spans(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", F.explode("results").alias("r")).where("r.block_span IS NOT NULL")
    g = h.select(F.col("record_id").alias("window_id"), F.element_at("r.block_span", 1).alias("start"), F.element_at("r.block_span", 2).alias("end"))
    parts = _spans(spark, d).groupBy(F.col("record_id").alias("window_id"), "seq").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = evaluate.span_score(g, parts)
    return s.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query
def score_entities(spark: SparkSession, d: str) -> DataFrame:
    """Scores per part of what one rater found against all labels."""
    s = _spans(spark, d).withColumnRenamed("record_id", "window_id")
    h = table(spark, d, "holdout").select(F.col("record_id").alias("window_id"), F.posexplode("results").alias("seq", "r")).where(F.array_contains("r.raters", "mx-small")).select("window_id", "seq")
    e = evaluate.entity_score(s, s.join(h, ["window_id", "seq"], "left_semi"))
    return e.select(F.coalesce("entity", F.lit("all")).alias("entity"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "support")


@query
def family_recall(spark: SparkSession, d: str) -> DataFrame:
    f = evaluate.family_recall(evaluate.facts(_gold(spark, d), _found(spark, d)))
    return f.select("family", "k", "n", *(F.round(c, 6).alias(c) for c in ("r", "low", "high")))


@query
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d)
    x = evaluate.discordant(evaluate.facts(g, _found(spark, d, ("t", "r", "z"))), evaluate.facts(g, _found(spark, d, ("f", "chi2", "q"))))
    return x.select("b", "c", F.round(evaluate.mcnemar(F.col("b"), F.col("c")), 9).alias("p"))


@query
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """(metric, low, high) of the checker's scores, 2,000 draws of whole documents."""
    b = evaluate.bootstrap_f1(evaluate.facts(_gold(spark, d), _found(spark, d), evaluate.window_documents(table(spark, d, "holdout"))))
    m = b.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("q")) for c in ("p", "r", "f1")))).alias("m"))
    return m.select("m.metric", *(F.round(F.element_at("m.q", k), 6).alias(n) for k, n in ((1, "low"), (2, "high"))))


@query
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """All of the checker's kinds of test against t and F alone."""
    g, docs = _gold(spark, d), evaluate.window_documents(table(spark, d, "holdout"))
    a, b = (evaluate.facts(g, _found(spark, d, kinds), docs) for kinds in (None, ("t", "f")))
    return evaluate.paired_f1(a, b).select("metric", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "p")))


# ---- sampling and dataset -----------------------------------------------------------------------

@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select(F.col("source_doc").alias("doc"), F.col("record_id").alias("line"), "pool")
    return sample.stratified(h, 1000).select("doc", "line", "pool")


@query
def holdout_sample(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select(F.col("source_doc").alias("doc"), F.col("record_id").alias("line"), "pool", "set")
    return sample.holdout(h.where("set <> 'train'"), h.where("set = 'train'"), 300).select("doc", "line", "pool")


@query
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return sample.split_documents(table(spark, d, "holdout"))


@query
def window_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "holdout").select("record_id", sample.window_id(F.col("source_doc"), F.col("source_line")).alias("wid"), sample.window_id(F.col("source_doc"), F.col("source_line"), "ho", 8).alias("hid"))


@query
def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of raters in batches of twenty."""
    b = sample.batches(table(spark, d, "disputes"), "decision_id")
    return b.select("decision_id", "dispute_id", F.size("candidates").alias("candidates"), "batch_id", "pos")


@query
def char_vocab(spark: SparkSession, d: str) -> DataFrame:
    v = sample.vocabulary(table(spark, d, "holdout"))
    return v.select(F.hex("char").alias("code"), "n", F.col("id").cast("long").alias("id"))


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("spans"))
    t = table(spark, d, "holdout").select("record_id", "text").join(s, "record_id", "left").select(sample.tags_udf("text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,entity:string>>"))).alias("tags"))
    return sample.class_weights(sample.tag_counts(t)).select("tag", F.round("weight", 6).alias("weight"))


@query
def augmented(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("spans"))
    e = table(spark, d, "holdout").select("record_id", "text").join(s, "record_id").select(F.col("record_id").cast("string").alias("window_id"), "text", "spans")
    return sample.augment(e, negatives=sample.hard_negatives(table(spark, d, "holdout"), "record_id").withColumnRenamed("record_id", "window_id")).select("window_id", "kind", F.sha2("text", 256).alias("sha256"), F.size("spans").alias("spans"))


@query
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample.dataset_counts(table(spark, d, "holdout"))


@query
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return sample.tier_counts(table(spark, d, "holdout"))


@query
def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    return readers.conversion_summary(table(spark, d, "conversion_manifest"))


@query
def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256).alias("sha256"))


@query
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Converted files whose recorded size is not what the other rows of the same file say."""
    m = table(spark, d, "conversion_manifest").where("ok")
    old = m.groupBy("pdf").agg(F.min(F.sha2(F.col("chars").cast("string"), 256)).alias("sha256")).select(F.col("pdf").alias("path"), "sha256")
    new = m.groupBy("pdf").agg(F.max(F.sha2(F.col("chars").cast("string"), 256)).alias("sha256")).select(F.col("pdf").alias("path"), "sha256")
    return writers.manifest_differences(old, new)


@query
def loss_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Runs are users, epochs their events in time order, losses the values scaled."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), (F.col("value") * 100).alias("loss"))
    return sample.divergence(e)


@query
def ranked_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("dev_f1"))
    return sample.ranked_configs(runs)


@query
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("event_type").alias("config"), F.col("value").alias("dev_f1"), F.col("value").alias("latency"))
    s = sample.seed_summary(runs)
    return s.select("config", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "latency")), "seeds")


@query
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    r = online.results(spread(table(spark, d, "documents"))).select("doc_id", "line", "test_type", "statistic", "verdict")
    return writers.report_json(r)


# ---- composites ---------------------------------------------------------------------------------

@query
def field_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the results that every model let stand."""
    a = annotate.field_agreement(*_decided(spark, d, "model_alias"))
    return a.select("field", "groups", F.round("agreement", 6).alias("agreement"))


@query
def settled_records(spark: SparkSession, d: str) -> DataFrame:
    """Records after decisions, per tier: the raters' consensus, the latest decisions on what it left open."""
    x = table(spark, d, "disputes").where("decision IS NOT NULL")
    latest = x.groupBy("dispute_id").agg(F.max_by("decision", F.struct("ingested_at", "decision_id")).alias("decision"))
    c = annotate.consensus(*_decided(spark, d, "rater"))
    named = latest.withColumn("dispute_id", F.concat(F.lit("x-"), "dispute_id", F.lit("-0")))
    return annotate.settled(c, named, "x").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("windows"))


@query
def checker_parity(spark: SparkSession, d: str) -> DataFrame:
    p = evaluate.parity(evaluate.facts(_gold(spark, d), _found(spark, d)))
    return p.select("both", "missed", "only", F.round("recall", 6).alias("recall"), "damaged_missed")


@query
def numbers_held(spark: SparkSession, d: str) -> DataFrame:
    """Results whose numbers all stand within one stretch of their window."""
    h = table(spark, d, "holdout").select("record_id", F.posexplode("results").alias("seq", "r"), text.flatten(F.col("text")).alias("flat"))
    return h.select("record_id", "seq", extract.holds_numbers(F.col("flat"), F.col("r")).alias("held"))


@query
def engine_gate(spark: SparkSession, d: str) -> DataFrame:
    """Sampling pools as engines: results in the text, and in a window the prefilter keeps."""
    h = table(spark, d, "holdout").select("record_id", F.col("pool").alias("engine"), "text", "results")
    w = text.with_grown_windows(h, "text").select("engine", "text", "windows", F.explode("results").alias("r"))
    w = text.hold(w, flats=F.transform("windows", lambda x: text.flatten(x["text"])), flat=text.flatten(F.col("text")))
    held = w.select("engine", F.lit(True).alias("read"), extract.holds_numbers(F.col("flat"), F.col("r")).alias("in_text"), F.exists("flats", lambda f: extract.holds_numbers(f, F.col("r"))).alias("kept"))
    return evaluate.engine_gate(held).select("engine", "results", "in_text", "kept", F.round("rate", 6).alias("rate"), F.round("spread", 6).alias("spread"), "passes")


@query
def repair_report(spark: SparkSession, d: str) -> DataFrame:
    r = repair.report(spread(table(spark, d, "holdout")), "record_id")
    return r.select("record_id", F.size("mapping").alias("mapped"), "replacements", "suspects_before", "suspects_after")


@query
def result_lines(spark: SparkSession, d: str) -> DataFrame:
    r = online.results(spread(table(spark, d, "documents")))
    return r.select("doc_id", "line", writers.result_line().alias("text"))


@query
def window_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where in its document every window stands."""
    return text.window_spans(spread(table(spark, d, "documents")).select("doc_id", "text"), "doc_id", "text")


@query
def cascade_counters(spark: SparkSession, d: str) -> DataFrame:
    """Checker rows before labelled results: per window, what each adds."""
    a = table(spark, d, "statcheck_repaired").select("window_id", F.col("test_value").alias("value"), F.col("row_id").alias("seq"))
    h = table(spark, d, "holdout").select("window_id", "record_id", F.posexplode("results").alias("k", "r"))
    b = h.select("window_id", numbers.as_number(F.col("r.statistic")).alias("value"), (F.col("record_id") * 1000 + F.col("k")).alias("seq"))
    return online.cascade_counts(online.cascade(a, b))


@query
def score_union(spark: SparkSession, d: str) -> DataFrame:
    """Three systems together, each for some kinds of test, over all windows any of them knows."""
    union = evaluate.union_of(*(_found(spark, d, kinds) for kinds in (("t", "r"), ("f",), ("z", "chi2"))))
    s = evaluate.score(evaluate.facts(_gold(spark, d), union))
    return s.select("bucket", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("p", "r", "f1")))


@query
def window_differences(spark: SparkSession, d: str) -> DataFrame:
    return annotate.key_difference(table(spark, d, "disputes"), table(spark, d, "statcheck_repaired"), "window_id")


@query
def open_disputes(spark: SparkSession, d: str) -> DataFrame:
    """Disputes that the raters' consensus leaves open, with the decisions known so far."""
    open_ = annotate.disputes(annotate.consensus(*_decided(spark, d, "rater")), "x")
    x = table(spark, d, "disputes").where("decision IS NOT NULL")
    latest = x.groupBy(F.concat(F.lit("x-"), "dispute_id", F.lit("-0")).alias("dispute_id")).agg(F.max_by("decision", F.struct("ingested_at", "decision_id")).alias("decision"))
    return annotate.audit(open_, latest).select("dispute_id", "kind", "field", F.size("candidates").alias("candidates"), F.array_join("raters", ",").alias("raters"), "resolved")


@query
def blind_candidates(spark: SparkSession, d: str) -> DataFrame:
    b = sample.blind_order(table(spark, d, "disputes"), 5, "decision_id")
    return b.select("decision_id", F.posexplode("candidates").alias("place", "c")).select("decision_id", "place", "c.statistic", "c.p_value")


@query
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "holdout").select("record_id", "source_doc")
    return sample.apply_splits(h, sample.split_documents(h)).select("record_id", "split")


@query
def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Decided rows as a ledger, all rows as its additions: the latest per dispute stays."""
    x = table(spark, d, "disputes").select(F.col("dispute_id").alias("name"), F.struct("ingested_at", "decision_id").alias("started"), "kind", F.col("decision.keep").alias("keep"))
    u = sample.upserted(x.where("keep IS NOT NULL"), x)
    return u.select("name", F.col("started.decision_id").alias("decision_id"), "kind", "keep")


@query
def misaligned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a labelled part that does not fit the text."""
    s = _spans(spark, d).groupBy("record_id").agg(F.collect_list(F.struct("start", "end", "entity")).alias("spans"))
    return sample.misaligned(table(spark, d, "holdout").select("record_id", "text").join(s, "record_id")).select("record_id")


@query
def collected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results as raters sent them, put into one form: quotes aligned, provenance stamped."""
    h = table(spark, d, "holdout")
    batch = h.select(F.col("record_id").alias("pos"), "window_id", "text")
    c = annotate.collected(batch, h.select(F.col("record_id").alias("pos"), "window_id", "results"), {"rater": "r1", "batch_id": "b7"})
    r = c.select("pos", F.col("provenance.batch_id").alias("batch"), F.posexplode("results").alias("k", "r"))
    return r.select("pos", "batch", "k", "r.test_type", "r.p_operator", "r.aligned")


@query
def tagged_digits(spark: SparkSession, d: str) -> DataFrame:
    """A convolutional tagger whose weights know digits only, through scoring, Viterbi and results."""
    n = len(R.TAGS)
    eye, weights = np.eye(2, dtype="f4"), np.zeros((n, 2), dtype="f4")
    weights[R.TAGS.index("S-STAT"), 1] = weights[0, 0] = 5
    keep = np.zeros((2, 2, 5), dtype="f4")
    keep[:, :, 2] = eye
    layers = [{"W": tagger.packed(keep), "b": tagger.packed(np.zeros(2)), "dilation": k} for k in (1, 2, 4, 8)]
    scorer = tagger.Convolutional({"embedding": tagger.packed(np.array([[0, 0], [1, 0], [0, 1]])), "convs": layers, "out": {"W": tagger.packed(weights), "b": tagger.packed(np.zeros(n))}})
    digits = tagger.Tagger(scorer, {c: 2 for c in "0123456789"}, {"transitions": tagger.transition_mask(), "start": np.zeros(n), "end": np.zeros(n)})
    t = spread(table(spark, d, "holdout")).select("record_id", tagger.tags_by(digits)("text").alias("tags"))
    return t.select("record_id", F.size("tags").alias("chars"), F.size(extract.spans_udf("tags")).alias("digits"), F.array_position("tags", "S-STAT").alias("first"))


@query
def tags_and_spans(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans written as character tags and read back."""
    s = _spans(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "entity"))).alias("spans"))
    t = table(spark, d, "holdout").select("record_id", "text").join(s, "record_id").select("record_id", extract.spans_udf(sample.tags_udf("text", "spans")).alias("spans"))
    return t.select("record_id", F.explode("spans").alias("s")).select("record_id", "s.start", "s.end", "s.entity")


# ---- files and streams: written to the shared folder and read back --------------------------------

@query
def jsonl_files(spark: SparkSession, d: str) -> DataFrame:
    """Windows as ordered JSON lines and back."""
    at = scratch(spark)
    writers.write_json_lines(table(spark, d, "holdout").select("record_id", "journal", "text", "source_line"), at, "record_id")
    r = readers.json_lines(spark, at, schema="record_id long, journal string, text string, source_line int")
    return r.select("record_id", "journal", F.sha2("text", 256).alias("sha256"), "source_line")


@query
def jsonl_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which those without a journal were cut in the middle: read rows and bad lines."""
    at = scratch(spark)
    line = F.to_json(F.struct("record_id", "journal", "text"))
    table(spark, d, "holdout").select(F.when(F.col("journal").isNull(), F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(at)
    rows, bad = readers.json_quarantined(spark, at, schema="record_id long, journal string, text string")
    return rows.select("journal").unionByName(bad.select(F.lit("(bad line)").alias("journal"))).groupBy("journal").agg(F.count(F.lit(1)).alias("n"))


@query
def checker_files(spark: SparkSession, d: str) -> DataFrame:
    """The external checker's rows as CSV and back, with the distinct values of every window."""
    at = scratch(spark)
    b = table(spark, d, "statcheck_repaired").drop("row_id")
    b.write.csv(at, header=True, escape='"', nullValue="NA", emptyValue="")
    v = readers.checker_values(readers.checker_csv(spark, at))
    return v.select("window_id", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Test passages as text files, one each, read as a corpus, hashed and checked against a manifest."""
    at = scratch(spark)
    items = table(spark, d, "eval_items").select("text", F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"))
    items.repartition("name").write.partitionBy("name").text(at)
    texts = readers.text_corpus(spark, at).select(F.regexp_extract("journal", "item-([0-9]+)$", 1).cast("long").alias("item_id"), F.length("text").alias("chars"))
    m = writers.manifest(spark, at).where("path LIKE '%.txt'").select(F.regexp_extract("path", "item-([0-9]+)", 1).cast("long").alias("item_id"), "sha256")
    return texts.join(m, "item_id")


@query
def streamed_results(spark: SparkSession, d: str) -> DataFrame:
    """The online path over the documents as a stream."""
    from loomtally.streaming import online as streaming

    at = scratch(spark)
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*").select("doc_id", "text")
    streaming.write_results(streaming.results_stream(docs), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    r = spark.read.parquet(f"{at}/out")
    return r.groupBy("test_type", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))
