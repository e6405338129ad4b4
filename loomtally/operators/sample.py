"""Sampling, splits, batches, vocabulary, class weights and seeded perturbation.

Orders that a sampler would shuffle follow a hash of (seed, row), so every draw is a ranking that runs
in parallel and comes out alike on every rerun. Rankings over a whole pool go through hash buckets.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import rules as R
from loomtally.functions import text as X
from loomtally.operators.extract import tags_of_spans
from loomtally.session import cut

#: Buckets of three hexadecimal digits.
BUCKETS = 4096


def window_id(doc: Column, line: Column, prefix: str = "", digits: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat(doc, line.cast("string"))), 1, digits))


def candidate_windows(docs: DataFrame, key: str = "doc", body: str = "text") -> DataFrame:
    """(doc, line, text, pool): fixed windows of every document with their pool, null pools dropped."""
    d = X.with_dropped(docs.select(F.col(key).alias("doc"), F.col(body).alias("_b")), "_b", "_ls")
    d = X.hold(d, _w=X.fixed_windows(F.col("_ls")))
    w = d.select("doc", F.explode("_w").alias("w")).select("doc", "w.line", "w.at", "w.text")
    return w.withColumn("pool", X.pool(F.col("at"), F.col("text"))).where("pool IS NOT NULL").drop("at")


def _shuffled(seed: int, *cols: str) -> Column:
    """A hash that orders rows at random, as 32 hexadecimal digits: any engine gives the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def _bucket(h: str) -> Column:
    """The first three digits of such a hash: equal-sized buckets in its order."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def stratified(windows: DataFrame, total: int, per_doc: int = 3, seed: int = 29, weights: dict[str, float] | None = None) -> DataFrame:
    """At most ``per_doc`` windows of a pool from one document, then each pool's share of ``total``.

    The second ranking keeps, per hash bucket, only as many rows as the pool may take at all, so what
    reaches the pool's final ranking is bounded by its target and never the whole pool.
    """
    weights = weights or R.POOL_WEIGHTS
    target = F.element_at(F.create_map(*(F.lit(x) for p, w in weights.items() for x in (p, max(1, int(total * w))))), F.col("pool"))
    w = windows.withColumn("_h", _shuffled(seed, "doc", "line"))
    w = w.withColumn("_n", F.row_number().over(Window.partitionBy("pool", "doc").orderBy("_h", "line"))).where(F.col("_n") <= per_doc)
    # the smallest hashes of a pool lie in its first buckets: those that hold the target in sum
    w = w.withColumn("_b", _bucket("_h"))
    per = w.groupBy("pool", "_b").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("pool").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = per.withColumn("_before", before).where(F.col("_before") < target).select("pool", "_b", "_before")
    w = w.join(need, ["pool", "_b"])
    w = w.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("pool", "_b").orderBy("_h", "doc", "line")))
    return w.where(F.col("_r") <= target).drop("_h", "_n", "_b", "_before", "_r")


def holdout(windows: DataFrame, used: DataFrame, total: int, seed: int = 101, weights: dict[str, float] | None = None) -> DataFrame:
    """One window per document and pool, from documents the training sample did not use."""
    fresh = windows.join(used.select("doc").distinct(), "doc", "left_anti")
    return stratified(fresh, total, 1, seed, weights)


def split_documents(docs: DataFrame, dev_share: float = 0.15, seed: int = 0, key: str = "source_doc") -> DataFrame:
    """(key, split): the round(n * share) documents of the smallest hashes are dev, exactly.

    The cut is a rank found by bucket counts, so no single task ever orders all documents.
    """
    d = docs.select(key).distinct().withColumn("_h", _shuffled(seed, key)).withColumn("_b", _bucket("_h"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("k"))  # at most BUCKETS rows
    n_dev = F.round(F.sum("k").over(Window.partitionBy()) * dev_share).cast("long")
    before = F.coalesce(F.sum("k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_b", before.alias("_before"), n_dev.alias("_dev"))
    d = d.join(F.broadcast(counts), "_b")  # BUCKETS rows at most
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return d.select(key, F.when(rank <= F.col("_dev"), F.lit("dev")).otherwise(F.lit("train")).alias("split"))


def apply_splits(rows: DataFrame, splits: DataFrame, key: str = "source_doc") -> DataFrame:
    """Rows with their split; a document without one is an error."""
    j = rows.join(splits.select(key, "split"), key, "left")
    return j.withColumn("split", F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("no split for "), F.col(key)))).otherwise(F.col("split")))


def batches(rows: DataFrame, order: str, size: int = 20) -> DataFrame:
    """Rows with batch_id and pos in the order of an ordinal column, batches of a fixed size.

    The rows are range-partitioned and sorted once and written with their partition and their place in
    it, so every later step sees the same partitions; the partitions' counts, one row each, give where
    each begins. Every row comes once whatever its width. Equal ordinals are neighbours in any order,
    nulls come first.
    """
    spot = F.monotonically_increasing_id()  # partition number above 33 bits of the place in it
    d = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    d = cut(d.withColumn("_p", F.shiftright(spot, 33)).withColumn("_i", spot.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = d.groupBy("_p").agg((F.max("_i") + 1).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_before"))  # one row per partition
    d = d.join(F.broadcast(starts), "_p").withColumn("_n", F.col("_before") + F.col("_i"))
    return d.withColumn("batch_id", F.floor(F.col("_n") / size).cast("long")).withColumn("pos", (F.col("_n") % size).cast("int")).drop("_p", "_i", "_before", "_n")


def blind_order(disputes: DataFrame, seed: int = 0, key: str = "dispute_id") -> DataFrame:
    """Candidates of every dispute in a seeded order, so that a rater cannot tell whose they are."""
    h = lambda i: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
    keyed = F.transform("candidates", lambda c, i: F.struct(h(i).alias("h"), i.alias("i"), c.alias("c")))
    return disputes.withColumn("candidates", F.transform(F.array_sort(keyed, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)), lambda x: x["c"]))


def run_table(runs: DataFrame, export: DataFrame, scores: DataFrame, name: str = "name") -> DataFrame:
    """Every run with its export record and its scores where it has them; columns met again take the
    table's prefix."""
    out = runs
    for prefix, other in (("export", export), ("score", scores)):
        out = out.join(other.select(name, *(F.col(c).alias(f"{prefix}_{c}" if c in out.columns else c) for c in other.columns if c != name)), name, "left")
    return out


def first_seeds(runs: DataFrame, score: str = "f1", k: int | None = None) -> DataFrame:
    """Runs of seed 0, the best score first and names in order; the best ``k`` for curves (a top-k report)."""
    out = runs.where("seed = 0").orderBy(F.desc_nulls_last(score), "name")
    return out if k is None else out.limit(k)


def vocabulary(texts: DataFrame, body: str = "text", least: int = 3) -> DataFrame:
    """(char, n, id): characters seen ``least`` times, by code point, ids from 2."""
    c = texts.where(F.col(body) != "").select(F.explode(F.split(body, "")).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return c.withColumn("id", F.row_number().over(Window.orderBy("char")) + 1)  # at most the code points of Unicode


def tag_counts(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    return tagged.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def class_weights(counts: DataFrame, cap: float = 40.0) -> DataFrame:
    """(tag, weight): square root of the inverse frequency up to a cap; O and unseen tags weigh 1."""
    spark = counts.sparkSession
    all_tags = spark.createDataFrame([(i, t) for i, t in enumerate(R.TAGS)], "tag_id int, tag string")
    j = all_tags.join(counts, "tag", "left").withColumn("total", F.sum("n").over(Window.partitionBy()))  # 37 rows
    w = F.least(F.lit(cap), F.sqrt(F.col("total") / (len(R.TAGS) * F.col("n"))))
    return j.select("tag_id", "tag", F.when((F.col("tag") == "O") | F.col("n").isNull(), F.lit(1.0)).otherwise(w).alias("weight"))


# ---- perturbation -------------------------------------------------------------------------------

# What scanners, writers and fonts make of characters, and other engines' signs for a lost operator.
OCR = {"l": "1", "1": "l", "O": "0", "0": "O", "I": "1", "5": "S", "S": "5", "8": "B", "rn": "m", "cl": "d"}
VARIANTS = {"-": ("\u2212", "\u2013", "\u2010"), " ": ("\u00a0", "\u2009", "\u202f"), "\u03c7": ("X", "x", "chi", "c", "v"), "\u00b2": ("2", "^2")}
OPERATOR_DAMAGE = {"POP_EQ": ("\u00bc", "\x01", "\x02", "\x03", "\x04", "\u0435", " "), "POP_LT": ("b", "\x03", "\x05", "\x07", "\\"), "POP_GT": ("N", "\x06", "\x08")}
NUMBER_DAMAGE = ("\x01", "\x02", "\x03", "\x05", "\x06", "\u2212", " ", "")
ENGINE_ALPHABETS = {"poppler": ("\u03ed", "\u03fd", "\u03ea", "\u2424", "\u2429", "\u00c0", "\u00c2"), "private_use": ("\uf020", "\uf03c", "\uf03d", "\uf03e")}


def moved(text: str, spans: list[tuple[int, int, str]], start: int, end: int, new: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text with a stretch replaced, and the spans that still hold: later ones move, covering ones grow."""
    shift = len(new) - (end - start)
    out = []
    for a, b, label in spans:
        if a >= end:
            a, b = a + shift, b + shift
        elif b > start:
            b = max(b + shift, start + len(new)) if b >= end else b
            if a > start:
                a = start + len(new)
        if b > a:
            out.append((a, b, label))
    return text[:start] + new + text[end:], out


#: For each kind, which labelled places it may change and what it puts there.
KINDS = ("operator", "engine", "number", "ocr", "unicode", "break")


def _sites(text: str, spans: list[tuple[int, int, str]], kind: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, choices) of every place a kind of change may fall on."""
    numbers = [(a, b) for a, b, label in spans if label in ("STAT", "PVAL")]
    if kind in ("operator", "engine"):
        every = tuple(c for alphabet in ENGINE_ALPHABETS.values() for c in alphabet)
        return [(a, b, OPERATOR_DAMAGE[label] if kind == "operator" else every) for a, b, label in spans if label in OPERATOR_DAMAGE]
    if kind == "number":
        return [(i, i + 1, NUMBER_DAMAGE) for a, b in numbers for i in range(a, b) if text[i] in "-.\u2212"]
    if kind == "unicode":
        return [(i, i + 1, VARIANTS[c]) for i, c in enumerate(text) if c in VARIANTS]
    if kind == "break":
        return [(i, i, ("\n",)) for pair in numbers for i in pair if 0 < i < len(text)]
    labelled = {i for a, b, _ in spans for i in range(a, b)}
    return [(i, i + len(k), (v,)) for k, v in OCR.items() for i in range(len(text)) if text.startswith(k, i) and not labelled & set(range(i, i + len(k)))]


def perturbed(text: str, spans: list[tuple[int, int, str]], kind: str, rng: random.Random, rate: float = 0.02) -> tuple[str, list[tuple[int, int, str]]]:
    """One seeded change of a kind, or scanner errors at a rate; labels stay aligned."""
    sites = _sites(text, spans, kind)
    chosen = [s for s in sites if rng.random() < rate] if kind == "ocr" else [rng.choice(sites)] if sites else []
    last = len(text) + 1
    for a, b, choices in sorted(chosen, reverse=True):  # from the end, so that earlier places stay
        if b <= last:
            text, spans = moved(text, spans, a, b, rng.choice(choices))
            last = a
    return text, spans


def hard_negatives(rows: DataFrame, key: str = "window_id", body: str = "text") -> DataFrame:
    """(key, text) of windows of the data itself that hold no result but look as if: numbers in brackets
    or after a test's letter, a p-value on its own, a reference."""
    t = F.col(body)
    looks = t.rlike(X.SAMPLE_TESTISH) | t.rlike(X.SAMPLE_P) | X.is_reference(t)
    return rows.where(F.coalesce(F.size("results"), F.lit(0)) < 1).where(looks).select(key, t.alias("text"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType())]))


def augment(examples: DataFrame, kinds: tuple[str, ...] = KINDS, seed: int = 0, negatives: DataFrame | None = None) -> DataFrame:
    """Perturbed copies of (window_id, text, spans), one per row and kind, with ``negatives`` (window_id,
    text) added as examples without spans.

    Randomness is seeded by (seed, window_id, kind): copies do not depend on partitions or order.
    """
    schema = T.StructType([T.StructField("window_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)])

    def run(batches):
        for batch in batches:
            out = []
            for w, text, spans in zip(batch["window_id"], batch["text"], batch["spans"]):
                for kind in kinds:
                    t, s = perturbed(text or "", [(x["start"], x["end"], x["entity"]) for x in (spans if spans is not None else [])], kind, random.Random(f"{seed}|{w}|{kind}"))
                    out.append((w, kind, t, [{"start": a, "end": b, "entity": e} for a, b, e in s]))
            yield pd.DataFrame(out, columns=["window_id", "kind", "text", "spans"])

    copies = examples.select("window_id", "text", "spans").mapInPandas(run, schema)
    if negatives is None:
        return copies
    return copies.unionByName(negatives.select(F.col("window_id").cast("string").alias("window_id"), F.lit("negative").alias("kind"), "text", F.array().cast(_SPANS).alias("spans")))


def misaligned(examples: DataFrame) -> DataFrame:
    """Examples whose tags or spans do not fit their text."""
    n = F.length("text")
    bad = F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] > n) | (s["end"] <= s["start"]))
    tags = F.size("tags") != n if "tags" in examples.columns else F.lit(False)
    return examples.where(bad | tags)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tags_udf(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else tags_of_spans(len(t), [(s["start"], s["end"], s["entity"]) for s in (x if x is not None else [])]) for t, x in zip(texts, spans)])


def dataset_counts(rows: DataFrame) -> DataFrame:
    """(set, windows, documents, results, with_result) of a dataset."""
    return rows.groupBy("set").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("source_doc").alias("documents"), F.sum(F.size("results")).alias("results"), F.count_if("contains_result").alias("with_result"))


def tier_counts(rows: DataFrame) -> DataFrame:
    """(set, tier, n) over results."""
    return rows.select("set", F.explode("results").alias("r")).groupBy("set", F.col("r.tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def divergence(epochs: DataFrame, loss: float = 100.0, times: float = 10.0) -> DataFrame:
    """(run, epoch): the first epoch of a run whose loss is high and many times the one before."""
    before = F.lag("loss").over(Window.partitionBy("run").orderBy("epoch"))
    return epochs.withColumn("_b", before).where((F.col("loss") > loss) & (F.col("loss") > times * F.col("_b"))).groupBy("run").agg(F.min("epoch").alias("epoch"))


def ranked_configs(runs: DataFrame, k: int = 3) -> DataFrame:
    """The best runs by dev F1, names in order on ties: a top-k report."""
    return runs.orderBy(F.desc_nulls_last("dev_f1"), "name").limit(k)


def seed_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("config").agg(F.avg("dev_f1").alias("mean"), F.stddev_pop("dev_f1").alias("sd"), F.count(F.lit(1)).alias("seeds"), F.percentile("latency", F.lit(0.5)).alias("latency"))


def upserted(ledger: DataFrame, new: DataFrame, key: str = "name", version: str = "started") -> DataFrame:
    """The latest row per key of a ledger and its additions."""
    both = ledger.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    top = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
    return top.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*both.columns)
