"""Queries of the training-data problems, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtally.llm import cutoff, encodings, forms, grouping, leakage, mixing, overlap, raters
from loomtally.session import cut, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(spread(table(spark, sf_dir, "holdout")))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(spread(table(spark, sf_dir, "holdout")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.broken(table(spark, sf_dir, "holdout"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and components per new split, and how far the present sets break the relation."""
    out = grouping.assign(table(spark, sf_dir, "holdout"))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("root").alias("components"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.found(spread(table(spark, sf_dir, "holdout")), table(spark, sf_dir, "disputes"))


def p3_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form of every window text and of every candidate's quote."""
    h = spread(table(spark, sf_dir, "holdout")).select(F.lit("holdout").alias("origin"), F.col("record_id").alias("row_key"), F.lit(0).alias("place"), "text")
    q = table(spark, sf_dir, "disputes").select(F.lit("disputes").alias("origin"), F.col("decision_id").alias("row_key"), F.posexplode("candidates.quote").alias("place", "text"))
    return h.unionByName(q).select("origin", "row_key", "place", forms.uniform_udf("text").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raters.found(table(spark, sf_dir, "disputes"))


def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cut(raters.counting_decisions(table(spark, sf_dir, "disputes")))
    return raters.reliability(labels, "dispute_id", "rater", "keep")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = raters.counting_decisions(table(spark, sf_dir, "disputes"))
    out = raters.agreement(labels, "dispute_id", "keep")
    return out.select("items", F.round("raw", 6).alias("raw"), F.round("alpha", 6).alias("alpha"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.found(spread(table(spark, sf_dir, "disputes")), table(spark, sf_dir, "statcheck_repaired"))


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.restored(table(spark, sf_dir, "disputes"), table(spark, sf_dir, "statcheck_repaired"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.mix(spread(table(spark, sf_dir, "documents")), targets), targets)


def p7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled and actual shares by tenths of training: small sources early, large ones late."""
    targets = table(spark, sf_dir, "mix_targets")
    shares = {r["source"]: r["target_share"] for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share")).collect()}  # a dimension table
    rank = {s: k for k, s in enumerate(sorted(shares, key=lambda s: (shares[s] or 0.0, s)))}
    tilts = {s: 1.8 * k / max(1, len(rank) - 1) - 0.9 for s, k in rank.items()}
    return mixing.curriculum(mixing.positioned(spread(table(spark, sf_dir, "documents")), targets, tilts))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.inspect(spread(table(spark, sf_dir, "documents"))).where("reason IS NOT NULL").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.rates(cutoff.inspect(spread(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_splits, p3_found, p3_uniform, p4_found, p4_raters, p4_agreement, p5_found, p5_restored, p6_found, p6_report, p7_found, p7_mix, p7_shares, p7_curriculum, p8_found, p8_rates)}



def _key_sql() -> str:
    """The file name a path leads to, in SQL."""
    x = "lower(trim(source_doc))"
    steps = (
        (r"[?#].*$", ""), (r"%20|\+", " "), ("%5f", "_"), (r"%2f|%5c|\\", "/"), (r"/+\s*$", ""), ("^.*/", ""),
        (r"(?:\.(?:txt|pdf|gz|zip|bz2|xz|zst|html?|xml|docx?|rtf|md|json|tei|bak|orig))+$", ""),
        (r"(?:\s*\(\s*\d+\s*\)|[\s_-]*\b(?:copy|kopie|copie|copia)(?:[\s_-]*\(?\d+\)?)?|_copy(?:[\s_-]*\(?\d+\)?)?|[\s_-]+copy)+\s*$", ""),
        (r"(?:\.(?:txt|pdf|gz|zip))+$", ""), (r"[\s_]+", "_"), ("^_+|_+$", ""),
    )
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_KEY = _key_sql()
SQL = {
    "p4_agreement": """
WITH named AS (
  SELECT decision_id, dispute_id, decision.keep AS keep,
    regexp_replace(regexp_replace(lower(trim(decision.provenance.rater)), '[\\s_.\\-]+', '_', 'g'), '_?0*(\\d+)$', '_\\1') AS rater,
    CAST(decision.provenance.collected_at AS TIMESTAMPTZ) AS ts
  FROM disputes),
last AS (
  SELECT dispute_id, rater, keep FROM named WHERE dispute_id IS NOT NULL AND rater IS NOT NULL AND keep IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dispute_id, rater ORDER BY ts DESC NULLS LAST, decision_id DESC) = 1),
c AS (SELECT dispute_id, keep, count(*) AS k FROM last GROUP BY ALL),
m AS (SELECT dispute_id, sum(k) AS m, sum(k*(k-1)) AS same FROM c GROUP BY 1 HAVING sum(k) > 1),
o AS (SELECT count(*) AS items, sum(m) AS n, sum(same/(m-1)) AS agree, sum(same) AS s, sum(m*(m-1)) AS p FROM m),
e AS (SELECT sum(t*(t-1)) AS e FROM (SELECT keep, sum(k) AS t FROM c JOIN m USING (dispute_id) GROUP BY keep))
SELECT items, round(s/p, 6) AS raw, round(1 - (1 - agree/n)/(1 - e/(n*(n-1))), 6) AS alpha FROM o, e
""",
    "p7_found": """
SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1) d USING (source)
WHERE coalesce(d.n, 0) * t.max_repeats / (SELECT sum(n_chars) FROM documents)::DOUBLE < t.target_share
""",
    "p2_found": f"""
WITH RECURSIVE r AS (
  SELECT record_id, "set", trim(window_id) AS w, {_KEY} AS f FROM holdout),
e AS (SELECT DISTINCT f, w FROM r WHERE w <> ''),
reach AS (SELECT DISTINCT f, f AS g FROM r UNION SELECT reach.f, b.f FROM reach JOIN e a ON a.f = reach.g JOIN e b ON a.w = b.w),
mixed AS (SELECT reach.f FROM reach JOIN r ON r.f = reach.g GROUP BY 1 HAVING count(DISTINCT r."set") > 1)
SELECT record_id FROM r WHERE f IN (SELECT f FROM mixed)
""",
}
