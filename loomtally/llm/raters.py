"""Consensus from several raters' labels (problem 4).

Labels are centred on chance (the share of each answer). With X the raters-by-items matrix of
centred labels, the agreement matrix is B = X W X' off its diagonal, W dividing each item by its
number of labels less one, so that crowded items do not count by the square. Its leading eigenvector
q over the pairs of raters that overlap, each pair counted by its overlap, gives the reliabilities:
q_i = sum_j B_ij q_j / sum_j O_ij q_j^2 with O the overlap counts. Neither matrix is formed and no
pairs of labels are emitted: one step of the power iteration is two joins and two sums over the
labels themselves, a rater's own share taken out of its items' sums.

A rater's vote weighs log((1+q)/(1-q)), q the reliability within (-1, 1). Rows without a rater, an
item or a label do not count. An empty table gives empty results. Ties of weighted votes go to the
answer with more votes, then to ``true``. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.session import beside, cut, cut_by, release, small_side

#: Up to so many raters are broadcast to the labels (a few MB); more are joined by shuffle.
BROADCAST_RATERS = 20_000


def rater_name(col: Column) -> Column:
    """One spelling per rater: no spaces around, lower case, separators and leading zeros alike."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"[\s_.\-]+", "_")
    return F.regexp_replace(name, r"_?0*(\d+)$", "_$1")


def counting_decisions(decisions: DataFrame) -> DataFrame:
    """(dispute_id, rater, keep): the latest decision of every rater, undecided ones left out.

    Latest by instant, whatever the offset; of the same instant the highest decision_id.
    """
    d = decisions.select(
        "dispute_id",
        rater_name(F.col("decision.provenance.rater")).alias("rater"),
        F.col("decision.keep").alias("keep"),
        F.expr("try_to_timestamp(decision.provenance.collected_at)").alias("at"),
        "decision_id",
    ).where("dispute_id IS NOT NULL AND rater IS NOT NULL AND keep IS NOT NULL")
    latest = d.groupBy("dispute_id", "rater").agg(F.max(F.struct("at", "decision_id", "keep")).alias("last"))
    return latest.select("dispute_id", "rater", F.col("last.keep").alias("keep"))


def readable_number(col: Column) -> Column:
    """A printed number as DECIMAL(38,10), or null: minus forms, thousands commas, a stray control
    character or spaces at either end; anything else is unreadable."""
    t = F.regexp_replace(col, r"^[\x00-\x20\x{a0}]+|[\x00-\x20\x{a0}]+$", "")
    t = F.regexp_replace(t, r"^[\x{2212}\x{2013}\x{2010}\x{2011}\x{2012}\x{ff0d}-]\s*", "-")
    ok = t.rlike(r"^[-+]?(?:\d{1,3}(?:,\d{3})+(?:\.\d*)?|\d+\.?\d*|\.\d+)$")
    return F.when(ok, F.regexp_replace(t, ",", "")).try_cast(T.DecimalType(38, 10))


def plain_decimal(col: Column) -> Column:
    """A decimal without trailing zeros, separators or exponent."""
    text = F.regexp_replace(F.format_string("%s", col.cast("string")), r"(\.\d*?)0+$", "$1")
    text = F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.$", ""))
    return text


def reliability(labels: DataFrame, item: str, rater: str, label: str, steps: int = 40, tolerance: float = 1e-3, bound: float = 0.98) -> DataFrame:
    """(rater, labels, reliability, weight, moved) from binary ``label``; one row per rater.

    ``reliability`` is 2 x accuracy - 1 as far as agreement tells, kept within ``bound``; raters who
    share no item with another get 0.5. ``moved`` is the largest change of the last step: below the
    tolerance the iteration has settled, else ``steps`` were too few.
    """
    base = labels.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(label).cast("double").alias("y"))
    share = base.agg(F.avg("y")).first()[0]
    if share is None:
        return base.select("rater", F.lit(0).cast("long").alias("labels"), "y", F.col("y").alias("weight")).withColumnRenamed("y", "reliability").withColumn("moved", F.lit(0.0))
    centre = 2 * share - 1
    x = base.select("item", "rater", (F.when(F.col("y") > 0, 1.0).otherwise(-1.0) - F.lit(centre)).alias("x"))
    n = x.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # laid out by item once: in every step only the raters' row of q moves, and sums per rater
    x = cut_by(x.join(n, "item", "left").select("item", "rater", "x", F.coalesce(1 / (F.col("n") - 1), F.lit(0.0)).alias("w")), "item")
    raters = cut(x.groupBy("rater").agg(F.count(F.lit(1)).alias("labels")))
    many = raters.count()
    spread = x.agg(F.avg(F.col("x") * F.col("x"))).first()[0] or 1.0  # variance of a centred label
    shared = x.where("w > 0")
    q, old, moved = raters.select("rater", F.lit(0.5).alias("q")), None, None
    for _ in range(steps):
        voted = shared.join(small_side(q, many, BROADCAST_RATERS), "rater")
        sums = voted.groupBy("item").agg(F.sum(F.col("x") * F.col("q")).alias("s"), F.sum(F.col("q") * F.col("q")).alias("qq"))
        others = voted.join(sums, "item").groupBy("rater").agg(
            F.sum(F.col("w") * F.col("x") * (F.col("s") - F.col("x") * F.col("q"))).alias("b"),
            F.sum(F.col("w") * (F.col("qq") - F.col("q") * F.col("q"))).alias("d"),
        )
        # half a step: the scale of q then settles as Newton's square root does
        step = F.when(F.col("d") > 0, (F.col("q") + F.col("b") / F.lit(spread) / F.col("d")) / 2).otherwise(F.col("q"))
        new = cut(q.join(others, "rater", "left").select("rater", F.greatest(F.lit(-bound), F.least(F.lit(bound), step)).alias("q"), F.col("q").alias("was")))
        moved = new.agg(F.max(F.abs(F.col("q") - F.col("was")))).first()[0]
        release(old)
        q, old = new.select("rater", "q"), new
        if moved is None or moved < tolerance:
            break
    return raters.join(q, "rater").select("rater", "labels", F.col("q").alias("reliability"), F.log((1 + F.col("q")) / (1 - F.col("q"))).alias("weight"), F.lit(float(moved or 0.0)).alias("moved"))


def weighted_votes(labels: DataFrame, scores: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(item, yes, no, margin, consensus, agreement) per item; agreement is the share of the winner."""
    many = scores.count()
    v = labels.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.col(label).alias("label")).join(small_side(scores.select("rater", "weight"), many, BROADCAST_RATERS), "rater")
    out = v.groupBy("item").agg(
        F.count_if("label").alias("yes"),
        F.count_if(~F.col("label")).alias("no"),
        F.sum(F.when(F.col("label"), F.col("weight")).otherwise(-F.col("weight"))).alias("margin"),
    )
    wins = F.when(F.abs("margin") > 1e-9, F.col("margin") > 0).otherwise(F.col("yes") >= F.col("no"))
    out = out.withColumn("consensus", wins)
    return out.withColumn("agreement", F.when(F.col("consensus"), F.col("yes")).otherwise(F.col("no")) / (F.col("yes") + F.col("no")))


def keep_consensus(decisions: DataFrame) -> DataFrame:
    """One row per dispute with a counting decision: votes, weighted margin, consensus, agreement."""
    labels = cut(counting_decisions(decisions))
    return weighted_votes(labels, reliability(labels, "dispute_id", "rater", "keep"), "dispute_id", "rater", "keep")


def statistic_consensus(decisions: DataFrame) -> DataFrame:
    """(dispute_id, readable, values, consensus, held): the value held by more than half, else null.

    The rows of a dispute hold the same candidates, so pooling them leaves the shares as they are.
    """
    c = decisions.where("dispute_id IS NOT NULL").select("dispute_id", F.explode("candidates.statistic").alias("s"))
    c = c.select("dispute_id", readable_number(F.col("s")).alias("value")).where("value IS NOT NULL")
    per = c.groupBy("dispute_id", "value").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("dispute_id").agg(
        F.sum("n").alias("readable"), F.count(F.lit(1)).alias("values"), F.max(F.struct("n", "value")).alias("top")
    )
    wins = F.col("top.n") * 2 > F.col("readable")
    return out.select("dispute_id", "readable", "values", F.when(wins, F.col("top.value")).alias("consensus"), (F.col("top.n") / F.col("readable")).alias("held"))


def agreement(labels: DataFrame, item: str, label: str) -> DataFrame:
    """One row: items with two labels or more, raw pair agreement, Krippendorff's alpha (nominal)."""
    counts = labels.groupBy(item, label).agg(F.count(F.lit(1)).alias("k"))
    m = counts.groupBy(item).agg(F.sum("k").alias("m"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")).where("m > 1")
    o = m.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("n"), F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"), F.sum("same").alias("s"), F.sum(F.col("m") * (F.col("m") - 1)).alias("p"))
    totals = counts.join(m.select(item), item).groupBy(label).agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("e"))
    both = beside(o, totals)
    do, de = 1 - F.col("agree") / F.col("n"), 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return both.select("items", (F.col("s") / F.nullif(F.col("p"), F.lit(0))).alias("raw"), F.when(de > 0, 1 - do / de).otherwise(F.lit(1.0)).alias("alpha"))


def found(decisions: DataFrame) -> DataFrame:
    """p4_found: disputed keeps with their consensus, disputed statistics with a majority value."""
    keep = keep_consensus(decisions).where("yes > 0 AND no > 0")
    stat = statistic_consensus(decisions).where("values > 1 AND consensus IS NOT NULL")
    return keep.select(F.col("item").alias("dispute_id"), F.lit("keep").alias("item"), F.col("consensus").cast("string").alias("consensus")).unionByName(
        stat.select("dispute_id", F.lit("statistic").alias("item"), plain_decimal(F.col("consensus")).alias("consensus"))
    )
