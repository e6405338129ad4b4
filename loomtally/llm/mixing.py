"""Mixing sources to target weights (problem 7).

Every source has a weight schedule over training time t in [0, 1]: its share times a straight tilt,
w(t) = share * (1 + tilt * (2 t - 1)), which integrates to the share. Tilts are taken relative to their
mean over the shares (and all made smaller alike where one would then leave [-1, 1]), so that the weights
of all sources sum to one at every t and training time is the share of the tokens seen. Cumulative
demand in tokens is M * share * (t + tilt * (t^2 - t)). A document's place in the running total of its
source, passes one after another, is inverted through that curve to a training position, and the mix is
range-sorted by position. A source whose documents, each used ``max_repeats`` times, hold less than its
share gives all it has; the rest goes to the other sources in proportion until all demand is met or none
can give.

Sizes are tokens of a public tokenizer (its vocabulary file is a parameter). Null and empty texts
have size 0 and never enter the mix; null sources and sources without a target only count towards the
total size. Null or non-positive shares and repeats ask for nothing. Repeated rows are documents of
their own. Targets are one row per source: a dimension table, collected to plan the shares.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.session import cut

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: how the vocabulary's byte pairs were split into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The most sources a plan takes in on the driver.
MOST_SOURCES = 1_000_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(col: Column, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Column:
    """Tokens of a text; 0 for null or empty ones."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts.where(texts.notna(), None)], dtype="int64")

    return count(col)


def sizes(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    return docs.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("tokens"))


def shortfalls(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, possible_share, short) per source with a target."""
    per = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    per = cut(per)
    total = per.agg(F.sum("tokens")).first()[0] or 0
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = F.coalesce("tokens", F.lit(0))
    possible = F.when(F.lit(total) > 0, own * F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))) / F.lit(max(total, 1))).otherwise(F.lit(0.0))
    out = t.join(per, "source", "left").select("source", "target_share", "max_repeats", own.alias("tokens"), possible.alias("possible_share"))
    return out.withColumn("short", F.coalesce(F.col("possible_share") < F.col("target_share"), F.lit(False)))


def plan(shorts: DataFrame, total: int | None = None) -> list[dict]:
    """Per source what it gives: demand is met by water-filling, no source beyond its capacity.

    Targets are a dimension table; more than ``MOST_SOURCES`` of them are an error.
    """
    rows = [r.asDict() for r in shorts.limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"targets name more than {MOST_SOURCES} sources")
    for r in rows:
        r["capacity"] = float(r["tokens"]) * max(0, r["max_repeats"] or 0)
        r["want"] = max(0.0, r["target_share"] or 0.0)
        r["give"] = 0.0
    left, open_ = float(total or 0), [r for r in rows if r["want"] > 0 and r["capacity"] > 0]
    while open_ and left > 0.5:
        scale = left / sum(r["want"] for r in open_)
        full = [r for r in open_ if r["capacity"] - r["give"] <= r["want"] * scale]
        for r in full or open_:
            add = (r["capacity"] - r["give"]) if full else r["want"] * scale
            r["give"] += add
            left -= add
        open_ = [r for r in open_ if r not in full] if full else []
    return rows


def schedule(rows: list[dict], tilts: dict[str, float] | None) -> list[tuple[str, float, float, float]]:
    """(source, tokens it gives, tokens it has, tilt) of the sources that give, their tilts balanced."""
    rows = [r for r in rows if r["give"] > 0]
    own = {r["source"]: float((tilts or {}).get(r["source"], 0.0)) for r in rows}
    if any(abs(t) > 1 for t in own.values()):
        raise ValueError("a tilt lies between -1 and 1")
    total = sum(r["give"] for r in rows)
    mean = sum(own[r["source"]] * r["give"] for r in rows) / total if total else 0.0
    most = max((abs(t - mean) for t in own.values()), default=0.0)
    return [(r["source"], r["give"], float(r["tokens"]), (own[r["source"]] - mean) / max(1.0, most)) for r in rows]


def mix(docs: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(position, source, doc_id, pass, tokens), range-sorted by position.

    ``tilts`` in [-1, 1] move a source towards the start or the end of training.
    """
    return positioned(docs, targets, tilts, vocabulary).drop("share", "tilt").orderBy("position", "source", "doc_id", "pass")


def positioned(docs: DataFrame, targets: DataFrame, tilts: dict[str, float] | None = None, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The mix before it is sorted, with each source's share and tilt. The running total of a source is
    summed in two steps (hash buckets, then within a bucket), so no source is one task."""
    sized = cut(sizes(docs, vocabulary).where("tokens > 0 AND source IS NOT NULL"))
    everything = sized.agg(F.sum("tokens")).first()[0] or 0
    shorts = shortfalls(sized, targets)
    spark = docs.sparkSession
    rows = schedule(plan(shorts, everything), tilts)
    shares = spark.createDataFrame(rows, "source string, give double, has double, tilt double")
    shares = F.broadcast(shares) if len(rows) <= 100_000 else shares
    d = sized.join(shares, "source").withColumn("h", F.xxhash64("doc_id", "source"))
    d = d.withColumn("bucket", F.pmod("h", F.lit(1024)))
    per = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(per.select("source", "bucket", before.alias("before")), ["source", "bucket"])
    running = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("start", F.col("before") + F.coalesce(running, F.lit(0)))
    # passes over the source while its tokens begin within what it gives
    passes = F.ceil((F.col("give") - F.col("start")) / F.col("has")).cast("int")
    d = d.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), passes)))
    u = ((F.col("pass") - 1) * F.col("has") + F.col("start") + F.col("tokens") / 2) / F.col("give")
    u = F.least(F.lit(1.0), u)
    # t + tilt (t^2 - t) = u
    a = F.col("tilt")
    root = (-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u)) / (2 * a)
    position = F.when(F.abs(a) < 1e-9, u).otherwise(root)
    share = F.col("give") / F.lit(float(sum(r[1] for r in rows)) or 1.0)
    return d.select(position.alias("position"), "source", "doc_id", "pass", "tokens", share.alias("share"), "tilt")


def curriculum(positions: DataFrame, parts: int = 10) -> DataFrame:
    """(part, source, scheduled, actual, tokens): each source's share of every part of training, by its
    schedule and as mixed; a source without a document in a part has a row with 0."""
    part = F.least(F.lit(parts - 1), F.floor(F.col("position") * parts).cast("int"))
    per = positions.groupBy("source", part.alias("part")).agg(F.sum("tokens").alias("tokens"))
    # one row per source and part from here on
    own = positions.groupBy("source").agg(F.any_value("share").alias("share"), F.any_value("tilt").alias("tilt"))
    every = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    j = every.join(per, ["source", "part"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("part"))
    # the schedule's mean over the part: its value in the middle, as it is straight
    scheduled = F.col("share") * (1 + F.col("tilt") * ((2 * F.col("part") + 1) / F.lit(parts) - 1))
    return j.select("part", "source", scheduled.alias("scheduled"), (F.col("tokens") / F.nullif(total, F.lit(0))).alias("actual"), "tokens")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_passes) of a mix."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.max("pass").alias("most_passes"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    # every mixed source has a target, so the joined rows hold the whole mix; one row per source
    out = t.join(per, "source", "left").withColumn("total", F.sum("tokens").over(Window.partitionBy()))
    return out.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"))


def found(docs: DataFrame, targets: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """p7_found: sources that fall short of their share even with all documents at the cap."""
    return shortfalls(sizes(docs, vocabulary), targets).where("short").select("source")
