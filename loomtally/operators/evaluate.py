"""Evaluation: gold facts, scores by subset, resampling and exact tests.

One fact table of (system, window_id, value, in_gold, in_found) and gold attributes feeds every score;
resampling works on sums per group of documents, so a replicate is a sum whatever the texts weigh.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import numbers, tails, text

Z95 = 1.959963984540054


def gold(rows: DataFrame, order: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(gold, unreadable) of dataset rows: gold is one row per window and value, the first one's
    attributes kept; unreadable holds results whose statistic is no number."""
    r = rows.select("window_id", "source_doc", F.col(order).alias("_o"), F.posexplode("results").alias("seq", "r"))
    r = r.withColumn("value", numbers.as_number(F.col("r.statistic")))
    lost = r.where("value IS NULL").select("window_id", F.col("r.statistic").alias("statistic"))
    damaged = F.coalesce(F.col("r.damaged"), F.lit(False))
    row = F.struct(
        "source_doc", damaged.alias("damaged"), F.lower(F.coalesce("r.test_type", F.lit(""))).alias("test_type"), F.coalesce("r.checkable", F.lit(False)).alias("checkable"),
        F.when(damaged, text.damage_family(F.col("r.quote"))).alias("family"), F.col("r.tier").alias("tier"), F.col("r.block_span").alias("block_span"),
    )
    g = r.where("value IS NOT NULL").groupBy("window_id", "value").agg(F.min_by(row, F.struct("_o", "seq")).alias("g"))
    return g.select("window_id", "value", "g.*"), lost


def window_documents(rows: DataFrame, order: str = "record_id") -> DataFrame:
    """(window_id, source_doc): the document of every window, that of its first row."""
    return rows.groupBy("window_id").agg(F.min_by("source_doc", F.col(order)).alias("source_doc"))


def facts(gold_rows: DataFrame, found: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Full outer join of gold and found values: (window_id, value, in_gold, in_found, gold attributes).

    With ``documents`` (window_id, source_doc) false alarms, too, have the document of their window.
    """
    f = found.select("window_id", "value").distinct().withColumn("in_found", F.lit(True))
    g = gold_rows.drop("source_doc") if documents is not None else gold_rows
    j = g.withColumn("in_gold", F.lit(True)).join(f, ["window_id", "value"], "full")
    if documents is not None:
        j = j.join(documents.select("window_id", "source_doc"), "window_id", "left")
    return j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_gold", "in_found")})


def union_of(*systems: DataFrame) -> DataFrame:
    """(window_id, value) that any of the systems found."""
    out = systems[0].select("window_id", "value")
    for s in systems[1:]:
        out = out.unionByName(s.select("window_id", "value"))
    return out.distinct()


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where undefined."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [safe(tp, tp + fp).alias("p"), safe(tp, tp + fn).alias("r"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")]


def score(fact: DataFrame) -> DataFrame:
    """(bucket, tp, fp, fn, p, r, f1): overall and per subset; false alarms only count overall."""
    g = F.col("in_gold")
    buckets = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(g, F.when(F.col("damaged"), F.lit("damaged")).otherwise(F.lit("undamaged"))),
            F.when(g, F.concat(F.lit("test:"), F.coalesce(F.nullif("test_type", F.lit("")), F.lit("unknown")))),
            F.when(g & F.col("family").isNotNull(), F.concat(F.lit("damage:"), "family")),
            F.when(g & F.col("checkable"), F.lit("checkable")),
        )
    )
    b = fact.select(F.explode(buckets).alias("bucket"), "in_gold", "in_found").groupBy("bucket").agg(
        F.count_if(F.col("in_gold") & F.col("in_found")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_found")).alias("fn")
    )
    return b.select("bucket", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def span_score(gold_spans: DataFrame, found_spans: DataFrame) -> DataFrame:
    """Scores on exactly equal spans of (window_id, start, end)."""
    key = ["window_id", "start", "end"]
    j = gold_spans.select(*key).distinct().withColumn("g", F.lit(1)).join(found_spans.select(*key).distinct().withColumn("f", F.lit(1)), key, "full")
    t = j.agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return t.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def entity_score(gold_spans: DataFrame, found_spans: DataFrame) -> DataFrame:
    """Scores per entity and over all (entity null), with support, by one rollup."""
    key = ["window_id", "start", "end", "entity"]
    j = gold_spans.select(*key).distinct().withColumn("g", F.lit(1)).join(found_spans.select(*key).distinct().withColumn("f", F.lit(1)), key, "full")
    t = j.rollup("entity").agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return t.select("entity", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def wilson(k: Column, n: Column, z: float = Z95) -> list[Column]:
    """Wilson interval of a share, as (low, high); 0 and 0 for nothing."""
    p = k / n
    middle, half = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    none = F.coalesce(n, F.lit(0)) == 0
    return [F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (middle - half) / whole)).alias("low"), F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (middle + half) / whole)).alias("high")]


def family_recall(fact: DataFrame) -> DataFrame:
    """(family, k, n, r, low, high) over damaged gold results."""
    f = fact.where("in_gold AND family IS NOT NULL").groupBy("family").agg(F.count_if("in_found").alias("k"), F.count(F.lit(1)).alias("n"))
    return f.select("family", "k", "n", (F.col("k") / F.col("n")).alias("r"), *wilson(F.col("k"), F.col("n")))


def discordant(fact_a: DataFrame, fact_b: DataFrame) -> DataFrame:
    """(b, c): gold results only the first, only the second system found."""
    key = ["window_id", "value"]
    j = fact_a.where("in_gold").select(*key, F.col("in_found").alias("x")).join(fact_b.where("in_gold").select(*key, F.col("in_found").alias("y")), key)
    return j.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(F.col("y") & ~F.col("x")).alias("c"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided binomial test on discordant pairs; 1 for none.

    P(X <= k) of a fair binomial is the incomplete beta function at one half, so counts of any size cost
    the same.
    """

    @F.pandas_udf(T.DoubleType())
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        n, k = (b + c).to_numpy(dtype=np.float64), np.minimum(b, c).to_numpy(dtype=np.float64)
        some = n > 0
        half = np.full(int(some.sum()), 0.5)
        out = np.ones(len(n))
        out[some] = np.minimum(1.0, 2 * tails.beta_inc(n[some] - k[some], k[some] + 1, half, half))
        return pd.Series(out)

    return run(b.cast("double"), c.cast("double"))


# ---- resampling ---------------------------------------------------------------------------------

#: Groups that units are dealt into by hash, of three hexadecimal digits.
GROUPS = 4096
#: Cumulative probabilities of a Poisson count of mean one, in 32 bits: a count is how many of them a draw reaches.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12))


def replicates(df: DataFrame, unit: str, columns: list[str], n: int = 2000, seed: int = 0) -> DataFrame:
    """(rep, columns): weighted sums over units, ``n`` times.

    Units are dealt into ``GROUPS`` groups by hash and each group draws a Poisson count of mean one per
    replicate, by hash too: a bootstrap of whole units while they are few, of random groups of whole
    units when they are many, at every size by the same rule and with the same draws in any engine.
    What is spread over the replicates are the groups' sums, never the units. A null unit is a unit.
    """
    name = F.coalesce(F.col(unit).cast("string"), F.lit(""))
    sums = df.groupBy(F.substring(F.md5(name), 1, 3).alias("_g")).agg(*(F.sum(c).cast("double").alias(c) for c in columns))
    d = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), "_g")), 1, 8), 16, 10).cast("long")
    d = d.withColumn("_u", draw)
    weight = sum((F.when(F.col("_u") >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    return d.withColumn("_w", weight).groupBy("rep").agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in columns))


def percentile_interval(reps: DataFrame, metric: Column, level: float = 0.95) -> DataFrame:
    """(low, high) of a metric over replicates, linear quantiles."""
    a = (1 - level) / 2
    q = F.percentile(metric, F.array(F.lit(a), F.lit(1 - a)))
    return reps.agg(q.alias("q")).select(F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


def document_counts(fact: DataFrame, suffix: str = "") -> DataFrame:
    """(source_doc, tp, fp, fn) of facts that know their documents."""
    hit = F.col("in_gold") & F.col("in_found")
    return fact.groupBy("source_doc").agg(F.count_if(hit).alias(f"tp{suffix}"), F.count_if(~F.col("in_gold")).alias(f"fp{suffix}"), F.count_if(~F.col("in_found")).alias(f"fn{suffix}"))


def bootstrap_f1(fact: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """95 % intervals of precision, recall and F1, whole documents resampled."""
    reps = replicates(document_counts(fact), "source_doc", ["tp", "fp", "fn"], n, seed).select("rep", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(*(q(c).alias(c) for c in ("p", "r", "f1")))


def paired_f1(fact_a: DataFrame, fact_b: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """(metric, mean, low, high, p) of the differences in precision, recall and F1 of two systems, the
    same documents drawn for both."""
    both = document_counts(fact_a, "_a").join(document_counts(fact_b, "_b"), "source_doc", "full")
    columns = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    reps = replicates(both.na.fill(0, columns), "source_doc", columns, n, seed)
    out = None
    for k, metric in enumerate(("p", "r", "f1")):
        a, b = (rates(F.col(f"tp_{s}"), F.col(f"fp_{s}"), F.col(f"fn_{s}"))[k] for s in "ab")
        part = paired_difference(reps, a, b).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return out


def paired_difference(reps: DataFrame, a: Column, b: Column) -> DataFrame:
    """(mean, low, high, p) of a - b over the same replicates; p is two-sided."""
    d = reps.select((a - b).alias("d"))
    low, high = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    t = d.agg(F.avg("d").alias("mean"), q.alias("q"), F.coalesce(F.least(F.lit(1.0), 2 * F.least(low, high)), F.lit(1.0)).alias("p"))
    return t.select("mean", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"), "p")


# ---- verdicts against an external checker -------------------------------------------------------

def baseline_verdicts(rows: DataFrame) -> DataFrame:
    """Rows of the external checker with this engine's verdict, decimals taken from the printed text."""
    kind = F.lower(F.trim("test_type"))
    df1 = F.when(kind == "f", F.col("df1")).otherwise(F.coalesce("df1", "df2"))
    df2 = F.when(kind == "f", F.col("df2"))
    stat, p = F.round("test_value", 4), F.round("reported_p", 4)
    v = tails.check(
        kind, stat, df1, df2, F.nullif(F.trim("p_comp"), F.lit("")), p,
        numbers.printed_decimals(F.col("raw"), F.col("reported_p")), numbers.printed_decimals(F.col("raw"), F.col("test_value")),
    )
    return rows.withColumn("check", v)


def verdict_agreement(rows: DataFrame) -> DataFrame:
    """(agree, disagree, undecidable): both flags must match."""
    c = baseline_verdicts(rows)
    verdict = F.col("check.verdict")
    undecidable = verdict == "undecidable"
    same = ((verdict != "consistent") == F.col("error")) & ((verdict == "decision_error") == F.col("decision_error"))
    return c.agg(F.count_if(~undecidable & same).alias("agree"), F.count_if(~undecidable & ~same).alias("disagree"), F.count_if(undecidable).alias("undecidable"))


def parity(fact: DataFrame) -> DataFrame:
    """(both, missed, only, recall, damaged_missed): a checker's results against annotations."""
    both, missed = F.col("in_gold") & F.col("in_found"), F.col("in_gold") & ~F.col("in_found")
    t = fact.agg(F.count_if(both).alias("both"), F.count_if(missed).alias("missed"), F.count_if(~F.col("in_gold")).alias("only"), F.count_if(missed & F.col("damaged")).alias("damaged_missed"))
    return t.select("both", "missed", "only", (F.col("both") / F.greatest(F.lit(1), F.col("both") + F.col("missed"))).alias("recall"), "damaged_missed")


def engine_gate(held: DataFrame, most: float = 0.06) -> DataFrame:
    """(engine, results, in_text, kept, rate, spread, passes) from (engine, read, in_text, kept) per
    result: the rate is over results whose document the engine read; the gate is on the rates' spread."""
    per = held.groupBy("engine").agg(F.count_if("read").alias("results"), F.count_if(F.col("read") & F.col("in_text")).alias("in_text"), F.count_if(F.col("read") & F.col("kept")).alias("kept"))
    per = per.withColumn("rate", F.when(F.col("results") > 0, F.col("kept") / F.col("results")).otherwise(F.lit(0.0)))
    all_ = Window.partitionBy()  # one row per engine
    per = per.withColumn("spread", F.max("rate").over(all_) - F.min("rate").over(all_))
    return per.withColumn("passes", F.col("spread") <= most)
