from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomtally.llm import grouping, queries


def _frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, source_doc string, window_id string, set string")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_file_keys(spark):
    name = "Journal A/Writer_Topic_2013_GF67U.txt"
    same = [
        name, name.lower(), name.upper(), "./" + name, "/data/corpus/" + name, name.replace("/", "\\"), name.replace("/", "//") + " ", name + ".gz", name.replace(".txt", ".pdf"),
        name.replace(".txt", "_copy.txt"), name.replace(".txt", " - Copy.txt"), name.replace(".txt", " (1).txt"), name.replace(".txt", "(2).txt"), "JOURNAL A/WRITER TOPIC 2013 GF67U.TXT",
        "Journal%20A/Writer_Topic_2013_GF67U.txt", "old/txt/" + name, "Writer_Topic_2013_GF67U.txt",
    ]
    keys = {r[0] for r in spark.createDataFrame([(x,) for x in same], "p string").select(grouping.file_key(F.col("p"))).collect()}
    assert len(keys) == 1
    other = ["Writer_Topic_2013_GF67V.txt", "Writer_Topic_2014_GF67U.txt"]
    assert not keys & {r[0] for r in spark.createDataFrame([(x,) for x in other], "p string").select(grouping.file_key(F.col("p"))).collect()}
    odd = spark.createDataFrame([(None,), ("",), ("  ",), (".txt",)], "p string").select(grouping.file_key(F.col("p"))).collect()
    assert [r[0] for r in odd] == [None] * 4


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)] + [("hub", f"s{i}") for i in range(200)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    rng.shuffle(edges)
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["root"] for r in grouping.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    groups = {}
    for n in {x for a, b in edges for x in (a, b) if a != b}:
        groups.setdefault(u.find(n), set()).add(n)
    for g in groups.values():
        if len(g) > 1:
            assert {got[n] for n in g} == {min(g)}


def test_broken_against_union_find(spark, small):
    h = spark.read.parquet(f"{small}/holdout.parquet").select("record_id", "set", "window_id", grouping.file_key(F.col("source_doc")).alias("f")).collect()
    u = Union()
    for r in h:
        u.join(("r", r["record_id"]), ("w", r["window_id"]))
        u.join(("r", r["record_id"]), ("f", r["f"]))
    sets = {}
    for r in h:
        sets.setdefault(u.find(("r", r["record_id"])), set()).add(r["set"])
    want = {r["record_id"] for r in h if len(sets[u.find(("r", r["record_id"]))]) > 1}
    assert {r[0] for r in queries.p2_found(spark, small).collect()} == want


def test_edges_of_the_relation(spark):
    rows = [(1, None, None, "train"), (2, None, None, "dev"), (3, "", "w", "train"), (4, None, "w", "dev"), (5, "a.txt", None, "train"), (6, "x/A.pdf", "v", "train"), (7, "b.txt", "v", "holdout"), (8, "c.txt", "z", None), (9, "c.txt", "z", "train")]
    df = _frame(spark, rows).withColumn("node", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("n", F.lit(2))
    assert {r[0] for r in grouping.broken(df).collect()} == {3, 4, 5, 6, 7}
    assert grouping.broken(_frame(spark, [])).count() == 0


def test_hot_documents_are_salted(spark):
    rows = [(i, "hot.txt" if i % 2 else f"d{i}.txt", f"w{i}", "train") for i in range(6000)] + [(9999, "hot.txt", "q", "dev")]
    assert grouping.broken(_frame(spark, rows)).count() == 3001


@pytest.mark.parametrize("seed", range(8))
def test_pick_is_closest(seed):
    rng = random.Random(seed)
    sizes = [(rng.randint(1, 40), rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
    sizes = sorted({s: m for s, m in sizes}.items())
    target = rng.randint(0, sum(s * m for s, m in sizes))
    totals = {0}
    for s, m in sizes:
        totals = {t + s * k for t in totals for k in range(m + 1)}
    got = grouping.pick(sizes, target)
    assert all(k <= dict(sizes)[s] for s, k in got.items())
    assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(t - target) for t in totals)
    near = grouping.pick(sizes, target, most=16)
    best = min(abs(t - target) for t in totals)
    assert all(k <= dict(sizes)[s] for s, k in near.items())
    assert abs(sum(s * k for s, k in near.items()) - target) <= best + len(sizes) * 8 * (target + 40) / 16


@pytest.mark.parametrize("sizes,target,total", [
    ([(3_000_000, 3), (2_000_000, 3), (1, 10)], 6_000_000, 6_000_000), ([(4_000_000, 1), (3_000_000, 2)], 6_000_000, 6_000_000),
    ([(10**9, 1), (10**6, 2_000), (7, 900), (1, 100_000)], 1_234_067_891, 1_234_067_891), ([(5, 1)], 2, 0), ([], 9, 0), ([(3, 2)], 0, 0), ([(2, 10**7), (1, 1)], 10**7 + 1, 10**7 + 1),
])
def test_pick_at_any_size(sizes, target, total):
    assert sum(s * k for s, k in grouping.pick(sizes, target).items()) == total


def test_pick_with_many_sizes_stays_small():
    rng = random.Random(3)
    sizes = [(s, rng.randint(1, 1000)) for s in range(1, 301)]
    target = sum(s * m for s, m in sizes) // 10
    got = grouping.pick(sizes, target)
    assert sum(s * k for s, k in got.items()) == target and all(k <= dict(sizes)[s] for s, k in got.items())


def test_pick_is_exact_whatever_is_kept():
    for seed in range(300):
        rng = random.Random(seed)
        by, most = rng.choice([1, 2, 6]), rng.choice([1, 16])
        sizes = sorted({rng.randint(1, 300) * by: rng.randint(0, 5) for _ in range(rng.randint(0, 9))}.items())
        totals = {0}
        for s, m in sizes:
            totals = {t + s * k for t in totals for k in range(m + 1)}
        target = rng.randint(0, max(totals) + 5)
        got = grouping.pick(sizes, target, most=most)
        assert all(0 < k <= dict(sizes)[s] for s, k in got.items())
        assert sum(s * k for s, k in got.items()) == min(totals, key=lambda t: (abs(t - target), t)), seed


@pytest.mark.parametrize("seed", range(1, 4))
def test_pick_meets_a_target_among_millions_of_totals(seed):
    rng = random.Random(seed)
    sizes = [(s, 1) for s in sorted(rng.sample(range(10**6, 10**7), 24))]
    target = sum(s for s, _ in rng.sample(sizes, 10))
    got = grouping.pick(sizes, target)
    assert sum(s * k for s, k in got.items()) == target and all(k == 1 for k in got.values())


def test_pick_finds_the_one_odd_size_among_thousands():
    sizes = [(2 * s, 3) for s in range(100, 400)] + [(801, 1)]
    target = 801 + 2 * 60_003
    got = grouping.pick(sizes, target)
    assert sum(s * k for s, k in got.items()) == target and all(k <= dict(sizes)[s] for s, k in got.items())


def test_splits(spark, small):
    h = spark.read.parquet(f"{small}/holdout.parquet")
    a = grouping.assign(h, {"train": 0.7, "validation": 0.2, "test": 0.1})
    assert a.count() == h.count() and a.select("record_id").distinct().count() == h.count()
    assert a.groupBy("root").agg(F.count_distinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    n = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert abs(n["test"] - 24) <= 1 and abs(n["validation"] - 48) <= 1
    again = grouping.assign(h, {"train": 0.7, "validation": 0.2, "test": 0.1})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, again.collect()))
    assert grouping.assign(_frame(spark, [])).count() == 0
