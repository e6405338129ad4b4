from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomtally.llm import leakage, queries

RNG = random.Random(11)
VOCAB = [f"{a}{b}" for a in ("flan", "trid", "moks", "gelv", "hart", "prun", "osk", "bend") for b in ("er", "ing", "ly", "ous", "age", "dom", "it", "an", "um", "ard")]


def _text(n, rng):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEM = _text(60, random.Random(1)).split()


def _docs():
    rng = random.Random(2)
    fill = lambda n: _text(n, rng).split()
    half = ITEM[10:45]
    edited = list(half)
    edited[7], edited[20] = "changed", edited[20][:-1] + "x"
    cut = half[:18] + fill(30) + half[18:]
    return {
        1: fill(80) + ITEM + fill(80), 2: fill(50) + half + fill(90), 3: fill(50) + edited + fill(40), 4: fill(20) + cut + fill(20),
        5: fill(100) + ITEM[5:20] + fill(100), 6: fill(200), 7: ITEM[:35],
    }


def _frames(spark, docs):
    d = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    i = spark.createDataFrame([(100, "holdout", " ".join(ITEM))], "item_id long, item_set string, text string")
    return d, i


def test_planted_passages(spark):
    d, i = _frames(spark, _docs())
    got = {tuple(r) for r in leakage.found(d.withColumn("words", F.lit(1)).withColumn("item_id", F.lit(3)).withColumn("_text", F.lit("")), i).collect()}
    assert got == {(k, 100) for k in (1, 2, 3, 4, 7)}


def test_layout_case_and_characters(spark):
    text = " ".join(ITEM)
    odd = text.upper().replace(" ", "\n", 20).replace("E", "Е", 3)
    hyphen = text[:11] + "-\n" + text[11:]
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalpha() and k % 9 == 0 else c for k, c in enumerate(text))
    d, i = _frames(spark, {1: odd, 2: hyphen, 3: wide})
    assert leakage.found(d, i).count() == 3


def test_nulls_empty_and_long(spark):
    rng = random.Random(7)
    d, i = _frames(spark, {1: None, 2: "", 3: "?!", 4: _text(40_000, rng) + " " + " ".join(ITEM) + " " + _text(40_000, rng), 5: "short"})
    assert {r[0] for r in leakage.found(d, i).collect()} == {4}
    assert leakage.found(d.limit(0), i).count() == 0 and leakage.found(d, i.limit(0)).count() == 0
    none = i.withColumn("text", F.lit(None).cast("string"))
    assert leakage.found(d, none).count() == 0
    r = leakage.report(d, i).first()
    assert (r["documents"], r["most"]) == (1, 1.0)


def test_repeated_documents_and_blocks(spark):
    docs = _docs()
    d, i = _frames(spark, docs)
    twice = d.union(d.withColumn("doc_id", F.col("doc_id") + 100))
    items = i.union(i.withColumn("item_id", F.lit(101)))
    want = {(k + p, n) for k in (1, 2, 3, 4, 7) for p in (0, 100) for n in (100, 101)}
    assert {tuple(r) for r in leakage.found(twice, items).collect()} == want
    assert {tuple(r)[:2] for r in leakage.leaks(twice, items, block=1).collect()} == want


def _longest(a, b):
    """Most of a's words in b as one run or two, by plain tables."""
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_against_brute_force(spark, small):
    docs = [(r[0], leakage.WORD.findall(leakage.plain(r[1]))) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], leakage.WORD.findall(leakage.plain(r[1]))) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "text").collect()]
    got = {tuple(r) for r in queries.p6_found(spark, small).collect()}
    sure = set()
    grams = {}
    for k, w in items:
        for g in zip(*(w[j:] for j in range(6))):
            grams.setdefault(g, set()).add(k)
    words = dict(items)
    for k, w in docs:
        near = {i for g in zip(*(w[j:] for j in range(6))) for i in grams.get(g, ())}
        sure |= {(k, i) for i in near if _longest(words[i], w) >= 0.5 * len(words[i])}
    assert sure and sure <= got
    assert queries.p6_report(spark, small).count() == 360


def test_long_documents_in_pieces():
    rng = random.Random(9)
    index = leakage.Index([(100, " ".join(ITEM))])
    doc = " ".join([_text(3000, rng), " ".join(ITEM), _text(3000, rng), "x" * 9000, _text(500, rng), " ".join(ITEM[:40])])
    whole = leakage.search(index, [doc, None, "", " ".join(ITEM)])
    assert whole == [(0, 0, 60), (3, 0, 60)]
    for chunk in (4000, 5000, 7777):
        assert sorted(leakage.search(index, [doc, None, "", " ".join(ITEM)], chunk, 1500)) == whole
    assert "".join(leakage._pieces("ab " * 50, 40, 0)) == "ab " * 50


def test_interrupted_by_a_few_words():
    """Every short interruption at every place: each piece counts, whatever lies between."""
    for n, first, second in ((48, 10, 15), (54, 13, 14), (44, 11, 11)):
        item = _text(n, random.Random(n)).split()
        for k in range(1, 13):
            for before in range(40, 44):
                rng = random.Random(100 * before + k)
                doc = _text(before, rng).split() + item[:first] + [f"page{j}" for j in range(k)] + item[first : first + second] + _text(40, rng).split()
                got = leakage.held(item, doc, [-before - 2, before, before + k])
                assert got >= first + second, (n, k, before)
    item = _text(48, random.Random(5)).split()
    index = leakage.Index([(1, " ".join(item))])
    for k in range(4, 8):
        for before in range(40, 44):
            rng = random.Random(before)
            doc = _text(before, rng).split() + item[:10] + [f"page{j}" for j in range(k)] + item[10:25] + _text(40, rng).split()
            assert leakage.search(index, [" ".join(doc)]), (k, before)


def test_first_piece_repeated_elsewhere():
    """Copies of one piece, however many and on whichever side, do not hide the other."""
    item = _text(48, random.Random(21)).split()
    index = leakage.Index([(1, " ".join(item))])
    a, b = item[:15], item[15:30]
    for copies in (1, 2, 5):
        for after in (False, True):
            rng = random.Random(copies)
            fill = lambda: _text(60, rng).split()
            more = [w for _ in range(copies) for w in (*a, *fill())]
            doc = ([] if after else more) + fill() + a + fill() + b + fill() + (more if after else [])
            assert leakage.search(index, [" ".join(doc)]) == [(0, 0, 30)], (copies, after)
    # the first piece as a whole after the second one does not count
    assert leakage.search(index, [" ".join(b + _text(60, random.Random(3)).split() + a)]) == []


def test_recall_by_share_and_edits():
    """Nearly nothing is lost up to a tenth of edited words, in one piece or two; where barely half is
    held, an edited word near a piece's end can take the piece below it."""
    rng = random.Random(31)
    vocabulary = [f"{a}{b}{c}" for a in ("flan", "tri", "mo", "gelvin", "a", "prun") for b in ("er", "ing", "ly", "o", "age") for c in ("s", "", "ton", "i")]
    for n in (45, 60, 100):
        for share in (0.52, 0.6, 0.7, 1.0):
            for edits, least in ((0.0, 1.0), (0.06, 0.95), (0.1, 0.9)):
                for cut in (False, True):
                    met = 0
                    for _ in range(40):
                        item = [rng.choice(vocabulary) for _ in range(n)]
                        index = leakage.Index([(1, " ".join(item))])
                        w = max(int(index.need[0]), int(share * n))
                        at = rng.randint(0, n - w)
                        part = item[at : at + w]
                        for i in rng.sample(range(1, w - 1), int(edits * index.need[0])):
                            part[i] = f"edit{i}"
                        k = rng.randint(w // 3, w - w // 3)
                        fill = lambda m: [rng.choice(vocabulary) for _ in range(m)]
                        doc = fill(80) + (part[:k] + fill(rng.randint(4, 40)) + part[k:] if cut else part) + fill(80)
                        met += bool(leakage.search(index, [" ".join(doc)]))
                    if share > 0.55 or not edits:
                        assert met / 40 >= least - (0.05 if cut and edits == 0.1 and share < 0.7 else 0), (n, share, edits, cut, met)


def test_the_bound_is_one():
    """Brute force: no choice of edits and of a cut leaves fewer q-grams than the bound."""
    rng = random.Random(6)
    for _ in range(300):
        words = ["x" * 0 + "".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(9, 40))]
        need = leakage.passage(len(words))
        at = rng.randint(0, len(words) - need)
        cut = rng.randint(1, need - 1)
        bad = set(rng.sample(range(at, at + need), int(leakage.EDITS * need + 1e-9)))
        left = 0
        for lo, hi in ((at, at + cut), (at + cut, at + need)):
            for i in range(lo, hi):
                j, size = i, 0
                while j < hi and size < leakage.Q:
                    size += len(words[j])
                    j += 1
                left += size >= leakage.Q and not bad & set(range(i, j))
        assert left >= leakage.bound(words, need) or leakage.bound(words, need) == 1


def test_short_and_unspaced_items():
    rng = random.Random(12)
    five = "gelving proster mandual okrit benders"
    chinese = "我们在训练文本中寻找测试材料的段落并报告泄漏"
    index = leakage.Index([(1, five), (2, chinese), (3, "two words"), (4, "abc"), (5, "")])
    docs = [_text(50, rng) + " " + x + " " + _text(50, rng) for x in (five, "前言。" + chinese + "。后记", "two words", "gelving proster mandual", chinese[:6])]
    assert sorted(leakage.search(index, docs))[:3] == [(0, 0, 5), (1, 1, len(chinese)), (2, 2, 2)] and len(leakage.search(index, docs)) == 3


def test_items_take_turns(monkeypatch):
    """Hot q-grams, more of them than are spread out at once, give the same pairs."""
    rng = random.Random(14)
    texts = [_text(60, rng) for _ in range(30)]
    index = leakage.Index(list(enumerate(texts)))
    docs = [_text(40, rng) + " " + t + " " + _text(40, rng) for t in texts]
    want = leakage.search(index, docs)
    assert {(k, k) for k in range(30)} <= {(d, i) for d, i, _ in want}
    monkeypatch.setattr(leakage, "SPREAD", 500)
    assert sorted(leakage.search(index, docs)) == sorted(want)
