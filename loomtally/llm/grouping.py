"""Splits that keep related records together (problem 2).

Records are related when their document leads to the same file name or their window is the same; the
relation passes on. Documents are the nodes, windows seen in several documents link them. Components
come from hooking and shortcutting over a parent table: every round the larger root of a link hooks
onto the smallest root beside it, parents are shortcut to their parents, links are rewritten to roots
and those inside one component leave. Each round is cut with a checkpoint; only links across
documents take part, never all records.

Components then get splits: sizes with their multiplicities (at most sqrt(2 n) distinct sizes) go to
a subset sum over the sets of totals that each size and its multiplicity make reachable; it picks how
many components of each size bring the split's total closest to its target, exactly at every size.

Null or empty documents or windows relate to nothing; a record with neither is its own component.
Empty tables give empty results. Repeated rows count as rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtally.session import cut, hot_keys, join_hot, release, small_side


def file_key(path: Column) -> Column:
    """The file name a path leads to: without folder, extensions, copy marks, case or separators."""
    p = F.lower(F.trim(path))
    p = F.regexp_replace(p, r"[?#].*$", "")
    p = F.regexp_replace(p, r"%20|\+", " ")
    p = F.regexp_replace(p, r"%5f", "_")
    p = F.regexp_replace(p, r"%2f|%5c|\\", "/")
    p = F.regexp_replace(p, r"/+\s*$", "")
    p = F.regexp_replace(p, r"^.*/", "")
    p = F.regexp_replace(p, r"(?:\.(?:txt|pdf|gz|zip|bz2|xz|zst|html?|xml|docx?|rtf|md|json|tei|bak|orig))+$", "")
    mark = r"(?:\s*\(\s*\d+\s*\)|[\s_-]*\b(?:copy|kopie|copie|copia)(?:[\s_-]*\(?\d+\)?)?|_copy(?:[\s_-]*\(?\d+\)?)?|[\s_-]+copy)+\s*$"
    p = F.regexp_replace(p, mark, "")
    p = F.regexp_replace(p, r"(?:\.(?:txt|pdf|gz|zip))+$", "")
    p = F.regexp_replace(p, r"^(?:copy of|kopie von)\s+", "")
    p = F.regexp_replace(F.regexp_replace(p, r"[\s_]+", "_"), r"^_+|_+$", "")
    return F.when(p != "", p)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``; the root is the smallest node of its component."""
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parents = cut(e.select("a").union(e.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("parent")))
    for _ in range(rounds):
        if e.isEmpty():
            release(e)
            return parents.select("node", F.col("parent").alias("root"))
        # hook: every larger root takes the smallest root beside it
        hooks = cut(e.groupBy("b").agg(F.min("a").alias("up")))
        while True:  # shortcut: parents of parents until all hooks lead to roots; chains halve each time
            h, g = hooks.alias("h"), hooks.alias("g")
            jump = h.join(g, F.col("h.up") == F.col("g.b"), "left")
            old, hooks = hooks, cut(jump.select(F.col("h.b").alias("b"), F.coalesce("g.up", "h.up").alias("up"), F.col("g.up").isNotNull().alias("moved")))
            release(old)
            if hooks.where("moved").isEmpty():
                break
        # a giant component's root is a hot key here; hooks hold it once, so its rows can be dealt out
        hot = hot_keys(parents, "parent")
        up = hooks.select(F.col("b").alias("parent"), "up")
        old, parents = parents, cut(join_hot(parents, up, "parent", hot, how="left").select("node", F.coalesce("up", "parent").alias("parent")))
        release(old)
        moved = join_hot(e, hooks.select("b", F.col("up").alias("ub")), "b", hot_keys(e, "b"), how="left")
        moved = join_hot(moved, hooks.select(F.col("b").alias("a"), F.col("up").alias("ua")), "a", hot_keys(e, "a"), how="left")
        moved = moved.select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).where("x <> y")
        old, e = e, cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(old, hooks)
    raise RuntimeError("components did not settle")


def related(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records as (record_id, set, window, node), and nodes with sets as (node, set, n, root)."""
    doc = file_key(F.col("source_doc"))
    win = F.when(F.trim("window_id") != "", F.trim("window_id"))
    r = records.select(
        "record_id", "set", win.alias("window"),
        F.coalesce(F.concat(F.lit("d:"), doc), F.concat(F.lit("w:"), win), F.concat(F.lit("r:"), F.col("record_id").cast("string"))).alias("node"),
    )
    r = cut(r)
    seen = r.where("window IS NOT NULL").groupBy("window", "node").agg(F.count(F.lit(1)).alias("n")).select("window", "node")
    first = seen.groupBy("window").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("window", "a")
    links = seen.join(first, "window").select("a", F.col("node").alias("b"))
    roots = components(links)
    nodes = r.groupBy("node", "set").agg(F.count(F.lit(1)).alias("n"))
    return r, nodes.join(roots, "node", "left").select("node", "set", "n", F.coalesce("root", "node").alias("root"))


def broken(records: DataFrame) -> DataFrame:
    """p2_found: records of a component that holds more than one value of ``set``."""
    r, nodes = related(records)
    nodes = cut(nodes)
    mixed = nodes.groupBy("root").agg(F.count_distinct("set").alias("k")).where("k > 1").select("root")
    bad = join_hot(nodes, mixed, "root", hot_keys(nodes, "root"), how="left_semi").select("node").distinct()
    return join_hot(r.select("record_id", "node"), bad, "node", hot_keys(r, "node")).select("record_id")


#: Totals kept as a sorted array; from there on the smaller of array and bit set is kept, with the same totals.
TOTALS = 1 << 16


def _greedy(parts: list[int], target: int) -> list[int]:
    """Places of the parts that still fit, in their order."""
    taken = []
    for i, v in enumerate(parts):
        if v <= target:
            taken.append(i)
            target -= v
    return taken


def _bits(at: np.ndarray) -> int:
    """The bit set of a sorted array; memory goes with its largest element / 8."""
    held = np.zeros(int(at[-1]) // 8 + 1 if len(at) else 1, dtype=np.uint8)
    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return int.from_bytes(held.tobytes(), "little")


def _sums(parts: list[int], low: int, high: int, most: int) -> np.ndarray | int:
    """All sums of ``parts`` from ``low`` to ``high``, less ``low``: a sorted array or, where denser, a bit set.

    Only sums too small for the rest to bring them to ``low``, and those beyond ``high``, are left out on the way.
    """
    rest, start = sum(parts), 0
    totals: np.ndarray | int = np.zeros(1, dtype=np.int64)
    for v in parts:
        rest -= v
        begin = max(0, low - rest)
        if isinstance(totals, int):
            totals = (totals | totals << v) >> begin - start
            if totals.bit_length() > high - begin + 1:
                totals &= (1 << high - begin + 1) - 1
        else:
            totals = np.union1d(totals, totals + v)
            totals = totals[np.searchsorted(totals, begin) : np.searchsorted(totals, high, "right")]
            if len(totals) > most and 64 * len(totals) > high - begin:
                totals = _bits(totals - begin)
        start = begin
    return totals if isinstance(totals, int) else totals - low


def _exactly(parts: list[int], target: int, most: int) -> list[int]:
    """Places of parts whose sum is ``target``, which they reach: by halves, so no sums of earlier steps are kept."""
    taken = _greedy(parts, target)
    if sum(parts[i] for i in taken) == target:
        return taken
    half = len(parts) // 2
    front, back = parts[:half], parts[half:]
    # f of the front and target - f of the back; sums of the back lie as its total less they do
    shift = target - sum(back)
    low, high = max(0, shift), min(target, sum(front))
    a, b = _sums(front, low, high, most), _sums(back, low - shift, high - shift, most)
    if isinstance(a, int) or isinstance(b, int):
        f = low + ((a if isinstance(a, int) else _bits(a)) & (b if isinstance(b, int) else _bits(b))).bit_length() - 1
    else:
        f = low + int(np.intersect1d(a, b, assume_unique=True)[-1])
    del a, b
    return _exactly(front, f, most) + [half + i for i in _exactly(back, target - f, most)]


def _closest(parts: list[int], target: int, off: int, most: int) -> int | None:
    """The sum of parts closest to ``target``, none if all are further from it than ``off``."""
    low = max(0, target - off)
    totals = _sums(parts, low, target + off, most)
    if isinstance(totals, int):  # the highest bit up to the target, the lowest beyond
        up_to, beyond = totals & (1 << target - low + 1) - 1, totals >> target - low + 1
        ends = ([low + up_to.bit_length() - 1] if up_to else []) + ([target + (beyond & -beyond).bit_length()] if beyond else [])
    else:
        at = int(np.searchsorted(totals, target - low, "right"))
        ends = [low + int(t) for t in totals[max(0, at - 1) : at + 1]]
    return min(ends, key=lambda t: (abs(t - target), t), default=None)


def pick(sizes: list[tuple[int, int]], target: int, most: int = TOTALS) -> dict[int, int]:
    """How many components of each size come closest to ``target`` in total; of two totals equally close the smaller.

    ``sizes`` are (size, multiplicity), taken from the largest down, multiplicities in powers of two. Parts taken
    as they fit settle it where they meet the closest total that the sizes' common divisor allows, as nothing is
    closer. Else the last parts, of the smallest sizes, are picked anew beside the rest, more each time and all at
    last: of those, every total no further from the target than the best known is found, and the closest traced
    by halves. Always exact: ``most`` only says from when on totals may be kept as a bit set, which takes
    (target + distance) / 8 bytes at most.
    """
    parts = []
    for s, m in sizes:
        k = 1
        while s > 0 and m > 0:
            parts.append((s, min(k, m)))
            m, k = m - k, k * 2
    parts.sort(reverse=True)
    values = [s * k for s, k in parts]
    target = min(max(0, target), sum(values))
    step = math.gcd(*values) or 1

    def far(total: int) -> tuple[int, int]:
        return abs(total - target), total

    def sum_of(places: list[int]) -> int:
        return sum(values[i] for i in places)

    near = sorted({target // step * step, -(-target // step) * step}, key=far)
    taken = min((_greedy(values, t) for t in near), key=lambda p: far(sum_of(p)))
    free = 64
    while sum_of(taken) != near[0]:
        at = max(0, len(values) - free)
        fixed = _greedy(values[:at], target - sum(values[at:]) // 2)
        beside = sum_of(fixed)
        t = _closest(values[at:], target - beside, far(sum_of(taken))[0], most)
        if t is not None and far(beside + t) < far(sum_of(taken)):
            taken = fixed + [at + i for i in _exactly(values[at:], t, most)]
        if at == 0:
            break
        free *= 8
    counts: dict[int, int] = {}
    for s, k in map(parts.__getitem__, taken):
        counts[s] = counts.get(s, 0) + k
    return counts


def assign(records: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(record_id, set, root, split): splits in the given proportions, components kept whole.

    Which components of a size go where follows a hash of the root, so a rerun gives the same.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    r, nodes = related(records)
    nodes = cut(nodes)
    comps = nodes.groupBy("root").agg(F.sum("n").alias("size"))
    comps = cut(comps.withColumn("h", F.xxhash64("root")).withColumn("bucket", F.pmod("h", F.lit(4096))))
    sizes = [(int(s), int(m)) for s, m in comps.groupBy("size").count().collect()]  # at most sqrt(2 n) rows
    total = sum(s * m for s, m in sizes)
    names = sorted(proportions, key=lambda k: (proportions[k], k))
    left, ends, start = dict(sizes), [], dict.fromkeys((s for s, _ in sizes), 0)
    for name in names[:-1]:
        took = pick(sorted((s, m) for s, m in left.items() if m), round(total * proportions[name]))
        for s, k in took.items():
            ends.append((s, start[s], start[s] + k, name))
            start[s] += k
            left[s] -= k
    spark = records.sparkSession
    ranges = spark.createDataFrame(ends or [(0, 0, 0, "")], "size long, lo long, hi long, split string")
    # rank of a component within its size: whole buckets before it, then its place in the bucket
    from pyspark.sql import Window

    per = comps.groupBy("size", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("size", "bucket", before.alias("before"))
    ranked = comps.join(per, ["size", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("h", "root")) - 1)
    ranges = small_side(ranges, len(ends), 100_000)  # at most two a distinct size
    chosen = ranked.join(ranges, (ranked["size"] == ranges["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    chosen = chosen.select("root", F.coalesce("split", F.lit(names[-1])).alias("split"))
    by_node = join_hot(nodes.select("node", "root").distinct(), chosen, "root", hot_keys(nodes, "root"))
    return join_hot(r.select("record_id", "set", "node"), by_node, "node", hot_keys(r, "node")).select("record_id", "set", "root", "split")
