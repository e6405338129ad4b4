"""Same or near-same records across splits (problem 1).

A text is brought to one form (look-alikes, case, layout, words split over lines) and cut into
words. Its similarity hash is the majority, bit by bit, of the hashes of its distinct words, short ones
left out (nearly all texts have those). For the join the code is segmented: a permutation deals the
words into segments by their hash, and a segment's block is the majority of its own words' bits, so a
changed word touches at most two segments. A segment of fewer than four words takes in the next ones,
so that no block stands for a few common words. Two permutations are used. Long texts would have more
segments than are needed: of texts above 60 words only every second, fourth, ... word by hash takes
part, so that a segment keeps its words; a text of fewer than eight longer words gives blocks of all its
words. A text near such a step gives the blocks of both sides, as its partner may lie beyond.

Of random texts that share 80 % of their words in order, which is what counts as near, at least nine
in ten meet on a block within the radius, at any length (a test holds the figures by length and number
of changes: 0.91 at the worst length, 0.97 and more with 12 % of the words changed).

Texts of one form are one class. Blocks of the classes are joined across splits, pairs within the
Hamming radius over the whole code are kept, and their texts are compared word by word (longest
common subsequence, bit-parallel). Class pairs are then expanded to record pairs. Blocks and classes
that hold many rows are dealt over several tasks on both sides.

Null texts and texts without a word match nothing. Texts of any length are hashed whole. Repeated
rows count like any others. Extra columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm.forms import uniform
from loomtally.session import cut, hot_keys, join_both_hot, join_hot, release, small_side

SEGMENTS, BITS, LEAST_WORDS = 14, 32, 4
#: One odd multiplier for each permutation of words to segments.
PERMUTATIONS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of fewer letters do not take part where a text has enough others.
LONG, ENOUGH = 4, 8
#: Distinct longer words up to which every one takes part.
FULL = 60
#: Unrelated texts differ in about 64 of the 128 bits, those that share 80 % of their words in about 26.
RADIUS = 38
#: Share of the longer text's words that must come in the same order.
SIMILAR = 0.8
#: Class pairs up to this many are broadcast to the texts (16 bytes each).
BROADCAST_PAIRS = 100_000

BROKEN = re.compile(r"([^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]{2,}|[1-9]")


def words(text: str | None) -> list[str]:
    """Words and numbers of a text in its one form; single letters are left out as font damage makes them."""
    if not text:
        return []
    if not text.isascii():
        text = uniform(text)
    if "-" in text:
        text = BROKEN.sub(r"\1", text)
    return WORD.findall(text.lower())


def _level(n: np.ndarray) -> np.ndarray:
    """0 for texts of few longer words, 1 up to FULL of them, one more for each halving beyond."""
    halved = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / FULL))).astype(np.int64)
    return np.where(n < ENOUGH, 0, 1 + halved)


def _sums(bits: np.ndarray, ids: np.ndarray, place: np.ndarray, n: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signed sums [n, bits] of the bits (bytes of 0 and 1) of words put into places, and word counts [n].

    Eight bits are summed at a time in the bytes of one integer where no place holds more words than a
    byte counts; longer ones are summed bit by bit.
    """
    counts = np.bincount(place, minlength=n)
    if not ordered:
        order = np.argsort(place, kind="stable")
        ids, place = ids[order], place[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    small = not len(counts) or counts.max() < 256
    lanes, kind = (bits.view(np.uint64), np.uint64) if small else (bits, np.int32)
    ones = np.zeros((n, lanes.shape[1]), dtype=kind)
    if len(place):
        ones[place[starts]] = np.add.reduceat(lanes[ids], starts, axis=0, dtype=kind)
    wide = np.int16 if small else np.int32
    return 2 * ones.view(np.uint8 if small else np.int32).astype(wide) - counts[:, None].astype(wide), counts


def codes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code as int64 [n, 2], level as int8 [n], blocks as int32, where each text's blocks begin [n + 1]).

    A text has 28 blocks, 14 for each permutation, or 56: the second half is that of the next level.
    Texts are given as words and have one at least.
    """
    n, per = len(texts), SEGMENTS * len(PERMUTATIONS)
    distinct = [list(dict.fromkeys(w)) for w in texts]
    sizes = np.array([len(w) for w in distinct], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in distinct for w in ws]
    ids, uniques = pd.factorize(flat)
    is_long = np.array([len(w) >= LONG or w[0].isdigit() for w in uniques], dtype=bool)
    h, more = (pd.util.hash_array(uniques, hash_key=k, categorize=False) for k in ("similarity-word1", "similarity-word2"))
    places = np.arange(64, dtype=np.uint64)
    bits = np.concatenate([(x[:, None] >> places & np.uint64(1)).astype(np.uint8) for x in (h, more)], axis=1)
    owner = np.repeat(np.arange(n), sizes)
    content = np.bincount(owner, weights=is_long[ids], minlength=n).astype(np.int64)
    level, beyond = _level(content), _level(content / SIMILAR)
    used = is_long[ids] | (content < ENOUGH)[owner]
    own, _ = _sums(bits, ids[used], owner[used], n, True)
    code = np.packbits(own > 0, axis=1, bitorder="little").view(np.int64)
    views = 1 + (beyond > level)
    of = np.repeat(np.arange(n), views)  # the text of every view
    at = level[of] + (np.arange(len(of)) - np.repeat(np.cumsum(views) - views, views))
    starts, long = np.cumsum(sizes) - sizes, sizes[of]
    words = ids[np.repeat(starts[of] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))]
    view = np.repeat(np.arange(len(of)), long)
    keep = is_long[words] | (at == 0)[view]
    words, view = words[keep], view[keep]
    mask = (np.uint64(1) << np.maximum(at - 1, 0)[view].astype(np.uint64)) - np.uint64(1)
    bits, blocks = np.ascontiguousarray(bits[:, :BITS]), np.empty((len(of), per), dtype=np.int32)
    for family, odd in enumerate(PERMUTATIONS):
        mixed = h * np.uint64(odd)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        segment = ((mixed >> np.uint64(40)) % np.uint64(SEGMENTS)).astype(np.int64)
        part = (mixed[words] & mask) == 0
        sums, held = _sums(bits, words[part], view[part] * SEGMENTS + segment[words[part]], len(of) * SEGMENTS)
        sums, held = sums.reshape(-1, SEGMENTS, BITS), held.reshape(-1, SEGMENTS)
        joined, have, taken = sums, held, np.zeros_like(held)
        for step in range(1, SEGMENTS):
            weak = have < LEAST_WORDS
            if not weak.any():
                break
            joined = joined + np.roll(sums, -step, axis=1) * weak[:, :, None]
            have, taken = have + np.roll(held, -step, axis=1) * weak, taken + weak
        block = np.packbits(joined > 0, axis=2, bitorder="little").view(np.uint32)[:, :, 0] ^ (taken * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32)
        # a view none of whose words takes part meets nothing but its own copies
        blocks[:, family * SEGMENTS : (family + 1) * SEGMENTS] = np.where(have > 0, block, (code[of, :1] & 0xFFFFFFFF).astype(np.uint32)).view(np.int32)
    return code, level.astype(np.int8), blocks.reshape(-1), np.r_[0, np.cumsum(views * per)].astype(np.int32)


def fingerprints(records: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(id, train, form1, form2, c0, c1, level, blocks): one row per record that has a word."""
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("train", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("form1", "form2", "c0", "c1")]
        + [T.StructField("level", T.ByteType()), T.StructField("blocks", T.ArrayType(T.IntegerType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words(t) for t in batch.column(2).to_pylist()]
            keep = np.array([bool(w) for w in texts], dtype=bool)
            if not keep.any():
                continue
            texts = [w for w in texts if w]
            code, level, blocks, ends = codes(texts)
            forms = np.array([" ".join(w) for w in texts], dtype=object)
            mask = pa.array(keep)
            hashes = [pd.util.hash_array(forms, hash_key=k, categorize=False).view(np.int64) for k in ("similarity-hash1", "similarity-hash2")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), *map(pa.array, (*hashes, np.ascontiguousarray(code[:, 0]), np.ascontiguousarray(code[:, 1]), level)), pa.ListArray.from_arrays(pa.array(ends), pa.array(blocks))],
                names=[f.name for f in schema.fields],
            )

    slim = records.select(F.col(key).cast("long").alias("id"), train.alias("train"), F.col(text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL AND train IS NOT NULL")
    return slim.mapInArrow(run, schema)


def lcs_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def similarity(a: str | None, b: str | None) -> float:
    """Common words in order as a share of the longer text's words; 0 for texts without words."""
    x, y = words(a), words(b)
    return lcs_words(x, y) / max(len(x), len(y)) if x and y else 0.0


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def _hot(df: DataFrame, share: float = 0.002) -> list[int]:
    """Keys ``k`` that hold more than a share of the rows, by a mergeable sketch: no shuffle of the rows,
    and at most a few hundred keys. A rough count is enough, as it only decides which keys are dealt out."""
    top, rows = df.agg(F.expr("approx_top_k(k, 500, 8192)"), F.count(F.lit(1))).first()
    return [t[0] for t in top or [] if t[0] is not None and t[1] > max(2000, share * rows)]


def across(records: DataFrame, key: str, text: str, train: Column, radius: int = RADIUS, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(class pairs, members): pairs (a, b, similarity) of class ids, a with a training record and b
    with an evaluation record (a = b for one form on both sides); members (class_id, id, train)."""
    prints = cut(fingerprints(records, key, text, train))
    classes = cut(
        prints.groupBy("form1", "form2").agg(
            F.min("id").alias("class_id"), F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e"),
            *(F.any_value(c).alias(c) for c in ("c0", "c1", "level", "blocks")),
        )
    )
    per = SEGMENTS * len(PERMUTATIONS)

    # the code travels with the blocks (16 bytes), so that pairs beyond the radius end in the join itself:
    # what is shuffled grows with the records, not with the pairs that chance brings together
    def side(flag: str, n: str) -> DataFrame:
        x = classes.where(flag).select(F.col("class_id").alias(n), F.col("c0").alias("c0" + n), F.col("c1").alias("c1" + n), "level", F.posexplode("blocks").alias("at", "block"))
        place = (F.col("level") * per + F.col("at")).cast("long")  # level, permutation and segment; the second half is the next level
        return x.select(n, "c0" + n, "c1" + n, F.shiftleft(place, 32).bitwiseOR(F.col("block").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("k"))

    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in ("c0", "c1")), F.lit(0))
    t, e = side("t", "a"), side("e", "b")
    hot = sorted({*_hot(t), *_hot(e)})
    near = cut(join_both_hot(t, e, "k", hot).where(apart <= radius).select("a", "b").distinct())
    many = near.count()
    slim = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    other = small_side(near.where("a <> b"), many, BROADCAST_PAIRS)
    texts_a = slim.join(other, slim.id == other.a).select("a", "b", F.col("text").alias("text_a"))
    both = slim.join(texts_a, slim.id == F.col("b")).select("a", "b", "text_a", "text")
    scored = both.select("a", "b", similarity_udf("text_a", "text").alias("similarity")).where(F.col("similarity") >= similar)
    same = near.where("a = b").select("a", "b", F.lit(1.0).alias("similarity"))
    pairs = cut(scored.unionByName(same))
    release(near)
    used = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct()
    forms = classes.join(used, "class_id").select("class_id", "form1", "form2")
    members = prints.select("id", "train", "form1", "form2").join(forms, ["form1", "form2"]).select("class_id", "id", "train")
    return pairs, members


def record_pairs(holdout: DataFrame) -> DataFrame:
    """(x, y, similarity): every training record x with every evaluation record y like it."""
    pairs, members = across(holdout, "record_id", "text", F.col("set") == "train")
    members = cut(members)
    hot = hot_keys(members, "class_id")
    a = members.where("train").select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    b = members.where("NOT train").select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    left = join_hot(a, pairs, "a", hot).select("b", "x", "similarity")
    return join_both_hot(left, b, "b", hot).select("x", "y", "similarity")


def found(holdout: DataFrame) -> DataFrame:
    """p1_found: (record_a, record_b) of every cross-split pair, the smaller id first."""
    return record_pairs(holdout).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def report(holdout: DataFrame, source: str = "journal") -> DataFrame:
    """(set, source, all, records, exact, pairs, closest) per evaluation set and source: its records, those
    with an overlap, those of them whose form stands in training as it is, their pairs, and the mean
    similarity of an overlapping record to the training record closest to it."""
    per = record_pairs(holdout).groupBy(F.col("y").alias("record_id")).agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    h = holdout.where("set <> 'train'").select("record_id", "set", F.lower(F.trim(source)).alias("source"))
    return h.join(per, "record_id", "left").groupBy("set", "source").agg(
        F.count(F.lit(1)).alias("all"), F.count("n").alias("records"), F.count_if(F.col("best") == 1).alias("exact"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.avg("best").alias("closest"),
    )
