"""Annotation analytics: contracts, agreement, matching, clustering, consensus, disputes.

Long form throughout: ratings are (item, rater, label) rows and results (window_id, rater, seq, …)
rows, so counts are plain aggregations with a partial sum before each shuffle. Only the greedy
matching and clustering inside one window, where a handful of results meet, runs per group in Arrow.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import numbers
from loomtally.functions import rules as R
from loomtally.session import beside

NUMERIC = ("statistic", "df1", "df2", "n", "p_value")
CATEGORICAL = ("test_type", "p_operator", "damaged")
VOTED = (*R.RESULT_FIELDS[:9], "confidence")


# ---- chance-corrected agreement -----------------------------------------------------------------

def raw_agreement(ratings: DataFrame) -> DataFrame:
    """(items, raw): share of items on which all raters say the same."""
    per = ratings.groupBy("item").agg(F.min(F.struct("label")).alias("a"), F.max(F.struct("label")).alias("z"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.avg(F.when(F.col("a") == F.col("z"), 1.0).otherwise(0.0)).alias("raw"))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """(rater_a, rater_b, n, po, pe, kappa) for every pair of raters over the items both labelled.

    A pair of raters meets on an item through its label counts per rater pair: the self-join is on the
    item, where each rater stands once.
    """
    r = ratings.select("item", "rater", F.coalesce(F.col("label").cast("string"), F.lit("∅")).alias("label"))
    b = r.select("item", F.col("rater").alias("rater_b"), F.col("label").alias("label_b"))
    cells = (
        r.join(b, "item").where("rater < rater_b")
        .groupBy(F.col("rater").alias("rater_a"), "rater_b", F.col("label").alias("label_a"), "label_b").agg(F.count(F.lit(1)).alias("k"))
    )
    pair = ["rater_a", "rater_b"]
    total = cells.groupBy(*pair).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("k")).otherwise(0)).alias("same"))
    left = cells.groupBy(*pair, F.col("label_a").alias("label")).agg(F.sum("k").alias("ka"))
    right = cells.groupBy(*pair, F.col("label_b").alias("label")).agg(F.sum("k").alias("kb"))
    chance = left.join(right, [*pair, "label"]).groupBy(*pair).agg(F.sum(F.col("ka") * F.col("kb")).alias("c"))
    out = total.join(chance, pair, "left").select(*pair, "n", (F.col("same") / F.col("n")).alias("po"), (F.coalesce("c", F.lit(0)) / (F.col("n") * F.col("n"))).alias("pe"))
    return out.withColumn("kappa", F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """(subjects, raters, kappa); raises if subjects differ in how many raters they have."""
    cells = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    per = cells.groupBy("item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    top = per.agg(F.count(F.lit(1)).alias("subjects"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p"))
    share = cells.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("t").alias("all"))
    both = beside(top, share)
    pe = F.col("tt") / (F.col("all") * F.col("all"))
    uneven = F.assert_true(F.col("lo") == F.col("hi"), F.lit("every subject needs the same number of raters"))
    kappa = F.when(pe == 1, F.lit(1.0)).otherwise((F.col("p") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return both.select("subjects", F.col("hi").alias("raters"), F.when(uneven.isNull(), kappa).alias("kappa"))


def fleiss_by_panel(ratings: DataFrame) -> DataFrame:
    """(raters, subjects, kappa): Fleiss' kappa over the items of each panel size, two raters at least."""
    cells = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    per = cells.groupBy("item").agg(F.sum("k").alias("raters"), F.sum(F.col("k") * F.col("k")).alias("sq")).where("raters > 1")
    m = F.col("raters")
    top = per.groupBy("raters").agg(F.count(F.lit(1)).alias("subjects"), F.avg((F.col("sq") - m) / (m * (m - 1))).alias("p"))
    share = cells.join(per.select("item", "raters"), "item").groupBy("raters", "label").agg(F.sum("k").alias("t"))
    pe = share.groupBy("raters").agg((F.sum(F.col("t") * F.col("t")) / (F.sum("t") * F.sum("t"))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("p") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0)))
    return top.join(pe, "raters").select("raters", "subjects", kappa.alias("kappa"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """(values, alpha) for nominal labels; null labels are missing, units with one value do not count."""
    cells = ratings.where("label IS NOT NULL").groupBy("item", "label").agg(F.count(F.lit(1)).alias("k"))
    units = cells.groupBy("item").agg(F.sum("k").alias("m")).where("m > 1")
    cells = cells.join(units, "item")
    agree = cells.agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / (F.col("m") - 1)).alias("o"))
    chance = cells.groupBy("label").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("e"))
    both = beside(agree, chance)
    do = 1 - F.col("o") / F.col("n")
    de = 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return both.select(F.col("n").alias("values"), F.when(F.col("n") > 1, F.when(de == 0, F.lit(1.0)).otherwise(1 - do / F.nullif(de, F.lit(0.0)))).alias("alpha"))


def against_final(ratings: DataFrame, final: DataFrame) -> DataFrame:
    """(rater, items, same, agreement, only_rater, only_final): each rater's yes or no against the final
    one; the last two count what only the rater, only the final decision kept."""
    j = ratings.join(final.select("item", F.col("label").alias("final")), "item")
    t = j.groupBy("rater").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("label") == F.col("final")).alias("same"),
        F.count_if(F.col("label") & ~F.col("final")).alias("only_rater"), F.count_if(~F.col("label") & F.col("final")).alias("only_final"),
    )
    return t.withColumn("agreement", F.col("same") / F.col("items"))


# ---- matching inside one window -----------------------------------------------------------------

def _score(a: dict, b: dict, strict: bool) -> float | None:
    """How well two results match: their overlap, or 1 for equal magnitudes where a span lacks."""
    sa, sb = a.get("span"), b.get("span")
    if sa is None or sb is None:
        va, vb = numbers.read_number(a.get("statistic")), numbers.read_number(b.get("statistic"))
        return 1.0 if va is not None and vb is not None and abs(va) == abs(vb) else None
    sa, sb = tuple(sa), tuple(sb)
    if strict:
        return max(1.0, sa[1] - sa[0]) if sa == sb else None
    common = min(sa[1], sb[1]) - max(sa[0], sb[0])
    shorter = min(sa[1] - sa[0], sb[1] - sb[0])
    return float(common) if shorter > 0 and common >= 0.5 * shorter and common >= 0 else None


def match(a: list[dict], b: list[dict], strict: bool = False) -> list[tuple[int, int]]:
    """One-to-one pairs, the best score first, earlier ones first on ties."""
    scored = [(-s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := _score(x, y, strict)) is not None]
    used: tuple[set, set] = (set(), set())
    out = []
    for _, i, j in sorted(scored):
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j)
            out.append((i, j))
    return sorted(out)


def clusters(raters: dict[str, list[dict]], one_each: bool = True) -> list[list[tuple[str, int]]]:
    """Results linked through lenient matches; ``one_each`` refuses a link that would give a cluster
    two results of one rater."""
    nodes = [(name, i) for name, rs in raters.items() for i in range(len(rs))]
    home = {n: k for k, n in enumerate(nodes)}
    inside = {k: [n] for n, k in home.items()}
    for x, y in combinations(raters, 2):
        for i, j in match(raters[x], raters[y]):
            a, b = home[x, i], home[y, j]
            if a == b or one_each and {n for n, _ in inside[a]} & {n for n, _ in inside[b]}:
                continue
            for n in inside[b]:
                home[n] = a
            inside[a] += inside.pop(b)
    rank = {name: k for k, name in enumerate(raters)}
    groups = {home[n]: None for n in nodes}
    return [sorted(inside[g], key=lambda n: rank[n[0]]) for g in groups]


def _key(field: str, value):
    if field in NUMERIC:
        return numbers.read_number(value)
    return " ".join(str(value).split()) if field == "quote" and value is not None else value


def _vote(field: str, members: list[dict]) -> tuple[object, int, bool]:
    """(value, votes, whether of three raters or more no value has the most votes alone)."""
    keys = [_key(field, m.get(field)) for m in members]
    best = max(keys, key=keys.count)  # the first of the most frequent
    votes = keys.count(best)
    if len(members) > 2 and any(k != best and keys.count(k) == votes for k in keys):
        return None, votes, True
    return members[keys.index(best)].get(field), votes, False


def _span(members: list[dict]):
    spans = [tuple(m["span"]) for m in members if m.get("span") is not None]
    return list(max(spans, key=spans.count)) if spans else None


def consensus_window(raters: dict[str, list[dict]]) -> tuple[list[dict], list[dict]]:
    """(kept, disputes) of one window: what two raters or more found stays, the rest is disputed.

    Unanimous is what all raters with results in the window, three at least, wrote alike.
    """
    kept, disputes = [], []
    panel = max(3, sum(map(bool, raters.values())))
    for group in clusters(raters):
        members, names = [raters[n][i] for n, i in group], [n for n, _ in group]
        if len(members) == 1:
            disputes.append({"kind": "singleton", "field": None, "candidates": members, "raters": names})
            continue
        votes = {f: _vote(f, members) for f in VOTED}
        pending = next((f for f in VOTED[:9] if votes[f][2]), None)
        record = {f: v for f, (v, _, _) in votes.items()}
        record["span"] = _span(members)
        if pending != "quote":
            owner = next((m for m in members if (list(m["span"]) if m.get("span") is not None else None) == record["span"]), members[0])
            record["quote"] = owner.get("quote")
        record["votes"] = {f: n for f, (_, n, _) in votes.items()}
        full = pending is None and len(names) == panel and all(n == panel for n in record["votes"].values())
        record |= {"raters": names, "tier": "unanimous" if full else "majority", "pending_field": pending}
        kept.append(record)
        if pending is not None:
            disputes.append({"kind": "field_conflict", "field": pending, "candidates": members, "raters": names})
    return kept, disputes


RESULT = T.StructType([T.StructField(f, T.BooleanType() if f == "damaged" else T.StringType()) for f in R.RESULT_FIELDS] + [T.StructField("span", T.ArrayType(T.IntegerType()))])
KEPT = T.StructType(
    [*RESULT.fields, T.StructField("raters", T.ArrayType(T.StringType())), T.StructField("votes", T.MapType(T.StringType(), T.IntegerType())), T.StructField("tier", T.StringType()), T.StructField("pending_field", T.StringType())]
)
DISPUTE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("field", T.StringType()), T.StructField("candidates", T.ArrayType(RESULT)), T.StructField("raters", T.ArrayType(T.StringType()))])
CONSENSUS = T.StructType([T.StructField("kept", T.ArrayType(KEPT)), T.StructField("disputes", T.ArrayType(DISPUTE))])


def per_window(results: DataFrame, raters: list[str]) -> DataFrame:
    """(window_id, by_rater): each window's results as a struct of one array per rater.

    ``results`` is (window_id, rater, seq, result struct). A window holds few results by nature.
    """
    item = F.struct("seq", "result")
    cols = [F.transform(F.array_sort(F.collect_list(F.when(F.col("rater") == r, item))), lambda x: x["result"]) for r in raters]
    return results.groupBy("window_id").agg(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(cols))).alias("by_rater"))


def _rows(by_rater: pd.DataFrame, raters: list[str]):
    """Each window's results as rater -> list of dicts."""
    for row in by_rater.itertuples(index=False):
        yield {r: [_plain(x) for x in (xs if xs is not None else [])] for r, xs in zip(raters, row)}


def _plain(x: dict) -> dict:
    out = dict(x)
    if out.get("span") is not None:
        out["span"] = [int(v) for v in out["span"]]
    return out


def consensus(results: DataFrame, raters: list[str]) -> DataFrame:
    """(window_id, kept, disputes) by majority of the raters."""

    @F.pandas_udf(CONSENSUS)
    def run(by_rater: pd.DataFrame) -> pd.DataFrame:
        rows = [consensus_window(w) for w in _rows(by_rater, raters)]
        return pd.DataFrame({"kept": [k for k, _ in rows], "disputes": [d for _, d in rows]})

    w = per_window(results, raters).withColumn("c", run("by_rater"))
    return w.select("window_id", "c.kept", "c.disputes")


def disputes(agreed: DataFrame, part: str) -> DataFrame:
    """(dispute_id, window_id, kind, field, candidates, raters) of a set's open questions."""
    d = agreed.select("window_id", F.posexplode("disputes").alias("k", "d"))
    return d.select(F.concat_ws("-", F.lit(part), "window_id", F.col("k").cast("string")).alias("dispute_id"), "window_id", "d.*")


def audit(open_: DataFrame, decisions: DataFrame) -> DataFrame:
    """Disputes with their decision, null where none came in; counts by kind are a group away."""
    return open_.join(decisions.select("dispute_id", "decision"), "dispute_id", "left").withColumn("resolved", F.col("decision").isNotNull())


def result_f1(results: DataFrame, raters: list[str], strict: bool = False) -> DataFrame:
    """(rater_a, rater_b, tp, fp, fn, f1) pooled over windows; two raters who find nothing agree."""
    schema = T.ArrayType(T.StructType([T.StructField("rater_a", T.StringType()), T.StructField("rater_b", T.StringType()), T.StructField("tp", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("fn", T.LongType())]))

    @F.pandas_udf(schema)
    def run(by_rater: pd.DataFrame) -> pd.Series:
        def pairs(rs):
            out = []
            for a, b in combinations(raters, 2):
                n = len(match(rs[a], rs[b], strict))
                out.append({"rater_a": a, "rater_b": b, "tp": n, "fp": len(rs[a]) - n, "fn": len(rs[b]) - n})
            return out

        return pd.Series([pairs(w) for w in _rows(by_rater, raters)])

    t = per_window(results, raters).select(F.explode(run("by_rater")).alias("m")).select("m.*").groupBy("rater_a", "rater_b").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return t.withColumn("f1", F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, F.lit(1.0)).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def lenient_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of one window whose overlap covers half of the shorter; (window_id, i, j, overlap)."""
    j = a.join(b.select("window_id", F.col("seq").alias("j"), F.col("start").alias("sb"), F.col("end").alias("eb")), "window_id")
    common = F.least("end", "eb") - F.greatest("start", "sb")
    shorter = F.least(F.col("end") - F.col("start"), F.col("eb") - F.col("sb"))
    return j.where((shorter > 0) & (common >= 0.5 * shorter) & (common >= 0)).select("window_id", F.col("seq").alias("i"), "j", common.alias("overlap"))


def field_votes(candidates: DataFrame, field: str) -> DataFrame:
    """(cluster, value, votes) by majority, the earliest rater's value on ties; null on a three-way split."""
    value = numbers.as_number(F.col(field)).cast("string") if field in NUMERIC else F.col(field).cast("string")
    c = candidates.select("cluster", "rank", F.col(field).alias("raw"), value.alias("key"))
    per = c.groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("rank", "raw")).alias("first"))
    top = per.groupBy("cluster").agg(F.max(F.struct("votes", (-F.col("first.rank")).alias("r"), F.col("first.raw").alias("raw"))).alias("t"), F.sum("votes").alias("n"))
    return top.select("cluster", F.when((F.col("t.votes") > 1) | (F.col("n") != 3), F.col("t.raw")).alias("value"), F.col("t.votes").alias("votes"))


# ---- contracts ----------------------------------------------------------------------------------

def violations(batch: DataFrame, output: DataFrame) -> DataFrame:
    """(pos, problem): what breaks the contract between a batch (pos, window_id) and a rater's output
    (pos, window_id, contains_result, results); an output that keeps it gives no rows."""
    o = output.select("pos", F.col("window_id").alias("out_id"), "contains_result", "results", F.lit(True).alias("_there"))
    j = batch.select("pos", "window_id").join(o, "pos", "full")
    op, kind = numbers.operator(F.col("x.p_operator")), numbers.test_type(F.col("x.test_type"))
    record = F.array_compact(
        F.array(
            F.when(F.col("_there").isNull(), F.lit("record is missing")),
            F.when(F.col("window_id").isNull() & F.col("_there"), F.lit("record is not in the batch")),
            F.when(~F.col("window_id").eqNullSafe(F.col("out_id")) & F.col("_there"), F.lit("window_id differs")),
            F.when(F.col("contains_result").isNull() & F.col("_there"), F.lit("contains_result is not boolean")),
            F.when(F.col("results").isNull() & F.col("_there"), F.lit("results is not a list")),
        )
    )
    first = j.select("pos", F.explode(record).alias("problem"))
    each = j.select("pos", F.explode("results").alias("x"))
    inner = F.array_compact(
        F.array(
            F.when(F.col("x.p_operator").isNotNull() & op.isNull(), F.lit("p_operator is not known")),
            F.when(F.col("x.test_type").isNotNull() & kind.isNull(), F.lit("test_type is not known")),
            F.when(F.col("x.damaged").isNull(), F.lit("damaged is not boolean")),
            F.when(~F.coalesce(F.col("x.confidence").isin("high", "low"), F.lit(False)), F.lit("confidence is not high or low")),
            F.when(F.coalesce(F.col("x.quote"), F.lit("")) == "", F.lit("quote is empty")),
        )
    )
    return first.unionByName(each.select("pos", F.explode(inner).alias("problem")))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only the first ("missing" in the second) or only the second ("extra") has."""
    missing = a.select(key).distinct().join(b.select(key), key, "left_anti").select(key, F.lit("missing").alias("side"))
    return missing.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").select(key, F.lit("extra").alias("side")))


def collected(batch: DataFrame, output: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """Output rows with types and operators in one form, quotes aligned and provenance stamped."""
    from loomtally.operators.extract import align_udf

    j = batch.join(output.drop("window_id"), "pos").withColumn("_a", align_udf("text", "results"))
    stamp = F.struct(*(F.lit(v).alias(k) for k, v in provenance.items()))

    def one(x: Column, i: Column) -> Column:
        at = F.element_at("_a", i + 1)["block_span"]
        fixed = {"test_type": numbers.test_type(x["test_type"]), "p_operator": numbers.operator(x["p_operator"])}
        return F.struct(*(fixed.get(f, x[f]).alias(f) for f in R.RESULT_FIELDS), at.alias("span"), at.isNotNull().alias("aligned"))

    return j.withColumn("results", F.transform("results", one)).withColumn("provenance", stamp).drop("_a")


# ---- fields, final records ----------------------------------------------------------------------

def shared_groups(results: DataFrame, raters: list[str]) -> DataFrame:
    """(item, rater, result) of results that every rater found, linked through lenient matches."""
    schema = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("rater", T.StringType()), T.StructField("result", RESULT)]))

    @F.pandas_udf(schema)
    def run(by_rater: pd.DataFrame) -> pd.Series:
        def rows(rs: dict) -> list[dict]:
            full = [g for g in clusters(rs, one_each=False) if len(g) == len(raters) == len({n for n, _ in g})]
            return [{"k": k, "rater": n, "result": rs[n][i]} for k, g in enumerate(full) for n, i in g]

        return pd.Series([rows(w) for w in _rows(by_rater, raters)])

    g = per_window(results, raters).select("window_id", F.explode(run("by_rater")).alias("g"))
    return g.select(F.concat_ws("#", "window_id", F.col("g.k").cast("string")).alias("item"), "g.rater", "g.result")


def field_agreement(results: DataFrame, raters: list[str]) -> DataFrame:
    """(field, groups, agreement) over results every rater found: nominal alpha for categories, the
    share on which all say the same number for numbers."""
    g = shared_groups(results, raters)
    out = None
    for f in CATEGORICAL:
        a = krippendorff_alpha(g.select("item", "rater", F.col(f"result.{f}").cast("string").alias("label")))
        part = a.select(F.lit(f).alias("field"), F.lit(None).cast("long").alias("groups"), F.col("alpha").alias("agreement"))
        out = part if out is None else out.unionByName(part)
    for f in NUMERIC:
        same = raw_agreement(g.select("item", "rater", numbers.as_number(F.col(f"result.{f}")).alias("label")))
        out = out.unionByName(same.select(F.lit(f).alias("field"), F.col("items").alias("groups"), F.col("raw").alias("agreement")))
    return out


def settled(agreed: DataFrame, decisions: DataFrame, part: str) -> DataFrame:
    """(window_id, tier, result, raters): what was kept without a dispute, what a decision settled, and
    single findings that a decision kept; kept records whose dispute is open stay out."""
    d = disputes(agreed, part).join(decisions.select("dispute_id", "decision"), "dispute_id", "left")
    fields = [F.col(f"r.{f}").alias(f) for f in R.RESULT_FIELDS]
    kept = agreed.select("window_id", F.explode("kept").alias("r")).where("r.pending_field IS NULL")
    plain = kept.select("window_id", F.col("r.tier").alias("tier"), F.struct(*fields).alias("result"), "r.raters")
    ruled = d.where("decision.keep").select("window_id", F.lit("adjudicated").alias("tier"), F.col("decision.result").alias("r"), "raters").where("r IS NOT NULL")
    forms = {"test_type": numbers.test_type(F.col("r.test_type")), "p_operator": numbers.operator(F.col("r.p_operator"))}
    clean = [forms.get(f, F.col(f"r.{f}")).alias(f) for f in R.RESULT_FIELDS]
    return plain.unionByName(ruled.select("window_id", "tier", F.struct(*clean).alias("result"), "raters"))
