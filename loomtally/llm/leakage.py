"""Evaluation texts leaking into training text (problem 6).

Texts are reduced to a stream of lower-case letters and digits of their one form, so layout, case and
punctuation do not matter. Character q-grams are read at word starts (characters of scripts that write
no blanks are words of their own). A document's q-grams that an evaluation item also has are counted per
pair and, for pairs with enough, in overlapping diagonal bands (word number in the document less word
number in the item).

The bound is the q-gram lemma's, from each item's own words: a passage of w words that is cut in two
and has e edited words keeps at least w - c - k of its q-grams, c the most that reach over two cuts, k the
most that e words can lie in. w is the passage that counts as a leak, e a tenth of it. Long q-grams, of
three whole words, are counted first, as they meet by chance least (the same bound with two lost a cut and
three an edit); then those of six characters. Pairs of which no two bands reach
the bound are dropped. The others are verified by local alignment of words around
every band that reaches it together with the best (a passage interrupted once, by any number of words;
each piece is judged by itself), and count if the pieces cover the passage.

A leak is half of the item's words, and eight words at least or the whole item; pieces may hold a tenth
of edited words, or one. Recall on random texts (a test holds the figures): 1.00 for a passage of 60 % with
6 % of edited words, cut in two or not; with 10 % 1.00 in one piece and 0.87 to 0.90 in two. A passage of
52 %, which an edited word near an end takes below the half, 0.80 to 0.97 in one piece.

The items are a stated query set: their index is broadcast in blocks of bounded size, a few blocks a pass
over the documents; nothing else leaves the rows, so there is no shuffle. Only a block's texts are on the
driver at once. Null and empty texts hold nothing; items of fewer than six letters and digits match
nothing; documents of any length are searched whole, in pieces of bounded memory. Repeated rows count as
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm.forms import uniform

Q = 6
#: Share of an item's words that must stand in a document, and the fewest words of a passage.
SHARE, PASSAGE = 0.5, 8
#: Edited words per word of a passage that the filter allows for.
EDITS = 0.1
#: Diagonals (in words) are counted in parts of so many; a band is four parts, or more for long items,
#: and begins at any part.
PART = 4
#: Items and characters of items per broadcast block (about 8 bytes of index a character), blocks a pass
#: over the documents, and characters of documents searched at a time.
BLOCK_ITEMS, BLOCK_CHARS, PASS_BLOCKS, CHUNK = 20_000, 8_000_000, 4, 2_000_000
#: Shared q-grams that are spread out at a time.
SPREAD = 20_000_000
#: Characters that pieces of a longer document share; longer than any passage with its interruption.
OVERLAP = 100_000
#: Words to either side of a diagonal that are aligned (a band and a part on both sides), and what an
#: edited word costs there.
SIDE, EDIT_COST = 12, 1.4
#: Share of a piece's words that must be the item's, or the pieces are only phrased alike.
DENSE = 0.9

_PRIME = np.uint64(0x9E3779B97F4A7C15)
# Scripts written without blanks, each of whose characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
WORD = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
BROKEN = re.compile(r"([^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_KEEP = np.array([chr(o).isalnum() for o in range(0x110000)], dtype=bool)
_SINGLE = np.zeros(0x110000, dtype=bool)
for _m in re.finditer("(.)-(.)", UNSPACED):
    _SINGLE[ord(_m.group(1)) : ord(_m.group(2)) + 1] = True
_SINGLE &= _KEEP


def plain(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = uniform(text)
    if "-\n" in text or "-\r" in text:
        text = BROKEN.sub(r"\1", text)
    return text.lower()


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _PRIME, dtype=np.uint64))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of plain texts: (text number, word number in it, whether a q-gram begins there, its
    hash, the hash of the word and the next two, 0 for a text's last two words)."""
    joined = "\0".join(texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keep, single = _KEEP[raw], _SINGLE[raw]
    ends = np.flatnonzero(raw == 0)
    before = np.cumsum(keep) - keep  # kept characters before each place
    stream = raw[keep].astype(np.uint64)
    first = keep.copy()
    first[1:] &= ~keep[:-1] | single[1:] | single[:-1]
    at = np.flatnonzero(first)
    number = np.searchsorted(ends, at)
    place = before[at]
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool), none.astype(np.uint64), none.astype(np.uint64)
    word = np.arange(len(at)) - np.searchsorted(at, np.r_[0, ends[:-1]])[number]
    ok = place + Q <= before[ends][number]
    h = np.zeros(len(place), dtype=np.uint64)
    for k in range(Q):
        h[ok] = (h[ok] ^ stream[place[ok] + k]) * _PRIME
        h[ok] ^= h[ok] >> np.uint64(29)
    sizes = np.diff(np.r_[place, len(stream)])
    inside = np.arange(len(stream)) - np.repeat(place, sizes)
    mixed = (stream * np.uint64(0xBF58476D1CE4E5B9)) ^ (stream << np.uint64(40))
    whole = np.add.reduceat(mixed * _powers(int(sizes.max()))[inside], place)
    long = np.zeros(len(at), dtype=np.uint64)
    if len(at) > 2:
        two = (whole[:-1] * _PRIME ^ whole[:-1] >> np.uint64(31)) + whole[1:]
        three = (two[:-1] * _PRIME ^ two[:-1] >> np.uint64(31)) + whole[2:]
        long[:-2] = np.where(number[:-2] == number[2:], three | np.uint64(1), np.uint64(0))
    return number, word, ok, h, long


class Grams:
    """Items' q-grams of one kind sorted by hash, with where they stand."""

    def __init__(self, number: np.ndarray, place: np.ndarray, h: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.hashes, starts = np.unique(h[order], return_index=True)
        self.starts = np.r_[starts, len(h)].astype(np.int64)
        self.items, self.places = number[order].astype(np.int64), place[order].astype(np.int64)

    def shared(self, h: np.ndarray, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``h``, entries) of equal hashes. Items take turns where more than SPREAD are equal."""
        if not len(h) or not len(self.hashes):
            return
        found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[found] == h)
        found = found[rows]
        first, many = self.starts[found], self.starts[found + 1] - self.starts[found]
        if int(many.sum()) <= SPREAD:
            yield _expanded(rows, first, many)
            return
        seen = np.bincount(found, minlength=len(self.hashes))
        weight = np.bincount(self.items, weights=np.repeat(seen, np.diff(self.starts)), minlength=n_items)
        turn = (np.cumsum(weight) // SPREAD)[self.items].astype(np.int64)  # of every entry
        for t in np.unique(turn):
            mine = np.flatnonzero(turn == t)
            starts = np.searchsorted(mine, self.starts)
            n = starts[found + 1] - starts[found]
            r, e = _expanded(rows, starts[found], n)
            yield r, mine[e]


def _expanded(rows: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(rows, many), np.repeat(first, many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))


def passage(words: int) -> int:
    """Words of an item that a document must hold."""
    return min(words, max(int(np.ceil(SHARE * words - 0.5)), PASSAGE))


def bound(words: list[str], need: int) -> int:
    """Fewest q-grams at word starts that ``need`` of the words keep, in two pieces and with a tenth edited."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    whole = np.flatnonzero(begin + Q <= sizes.sum())  # words at which a q-gram begins
    last = np.searchsorted(begin, begin[whole] + Q, "left") - 1  # and the last word it reaches
    held = np.zeros(len(words) + 1, dtype=np.int64)  # q-grams that a word lies in
    np.add.at(held, whole, 1)
    np.add.at(held, last + 1, -1)
    held = np.cumsum(held)[:-1]
    over = np.zeros(len(words) + 1, dtype=np.int64)  # q-grams that reach from a word to the next
    np.add.at(over, whole, 1)
    np.add.at(over, last, -1)
    over = np.cumsum(over)
    edits = int(EDITS * need + 1e-9)
    end = len(words) - len(whole)  # words at the item's end have none, which is a cut's loss at most
    lost = np.sort(np.r_[over, end])[::-1][:2].sum()
    return max(1, int(need - lost - np.sort(held)[::-1][:edits].sum()))


class Index:
    """Items as words, their q-grams of both kinds and the bounds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        texts = [plain(t) for _, t in items]
        self.words = [WORD.findall(t) for t in texts]
        number, place, ok, h, long = grams(texts)
        self.short, self.long = Grams(number[ok], place[ok], h[ok]), Grams(number[long > 0], place[long > 0], long[long > 0])
        self.need = np.array([passage(len(w)) for w in self.words], dtype=np.int64)
        # words that a passage may gain or lose, each moving the diagonal by one
        moved = (self.need * (1 / DENSE - 1)).astype(np.int64)
        self.width = np.maximum(4, moved // PART + 2)
        self.least = np.array([bound(w, n) if w else 1 for w, n in zip(self.words, self.need.tolist())], dtype=np.int64)
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.coded = [np.array([self.number[w] for w in ws], dtype=np.int64) for ws in self.words]
        self.least_long = self.need - 4 - 3 * (EDITS * self.need + 1e-9).astype(np.int64)


def candidates(index: Index, texts: list[str]) -> list[tuple[int, int, list[int]]]:
    """(text number, item number, diagonals) of pairs that meet both bounds, that of the short q-grams in
    two bands: the diagonals of every band that meets it together with the best one."""
    number, place, ok, h, long = grams(texts)
    n_items = len(index.ids)
    alive = []
    for rows, entries in index.long.shared(long, n_items):
        pair, diagonal = number[rows] * n_items + index.long.items[entries], place[rows] - index.long.places[entries]
        alive += [d * n_items + i for d, i, _ in _banded(index, pair, diagonal, np.maximum(1, index.least_long))]
    alive = np.sort(np.array(alive, dtype=np.int64))
    tiny = index.least_long < 1  # items of a few words have no bound
    if not tiny.any():
        near = np.zeros(len(texts), dtype=bool)
        near[alive // max(1, n_items)] = True
        ok = ok & near[number]
    if not ok.any() or not len(alive) and not tiny.any():
        return []
    out = []
    some = np.flatnonzero(ok)
    for rows, entries in index.short.shared(h[some], n_items):
        rows = some[rows]
        item = index.short.items[entries]
        pair = number[rows] * n_items + item
        keep = tiny[item]
        if len(alive):
            keep = keep | (alive[np.minimum(np.searchsorted(alive, pair), len(alive) - 1)] == pair)
        if keep.any():
            out += _banded(index, pair[keep], place[rows[keep]] - index.short.places[entries[keep]], index.least)
    return sorted(out, key=lambda x: x[:2])


def _banded(index: Index, pair: np.ndarray, diagonal: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(text number, item number, diagonals) of pairs that meet their bound in two bands, from the pair
    and diagonal of every shared q-gram."""
    n_items = len(index.ids)
    if not len(pair):
        return []
    most = int(pair.max()) + 1
    if most <= 50_000_000:
        enough = np.bincount(pair, minlength=most)[pair] >= bounds[pair % n_items]  # no band holds more than the pair
    else:
        values, inverse, size = np.unique(pair, return_inverse=True, return_counts=True)
        enough = (size >= bounds[values % n_items])[inverse]
    pair, diagonal = pair[enough], diagonal[enough]
    if not len(pair):
        return []
    part = np.floor_divide(diagonal, PART)
    low = int(part.min())
    widest = int(index.width.max())
    span = int(part.max()) - low + 1 + 2 * widest  # bands of one pair end before the next pair's parts
    cell, count = np.unique(pair * span + (part - low), return_counts=True)
    owner, where = cell // span, cell % span
    width, least = index.width[owner % n_items], bounds[owner % n_items]
    held_before = np.r_[0, np.cumsum(count)]
    band = held_before[np.searchsorted(cell, cell + width)] - held_before[: len(cell)]
    double = held_before[np.searchsorted(cell, cell + 2 * width)] - held_before[: len(cell)]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    best, most = np.maximum.reduceat(band, begins), np.maximum.reduceat(double, begins)
    out = []
    ends = np.r_[begins[1:], len(owner)]
    for k in np.flatnonzero(2 * best >= least[begins]).tolist():
        b, e, top = int(begins[k]), int(ends[k]), int(best[k])
        o, limit, wide = int(owner[b]), int(least[b]), int(width[b])
        places, counts = where[b:e].tolist(), band[b:e].tolist()
        if top < limit and int(most[k]) < limit and _apart(places, counts, wide) < limit:
            continue
        shifts = [m for w, n in zip(places, counts) if n + top >= limit for m in (*range(w + 2, w + wide - 2, 6), w + wide - 2)]
        out.append((o // n_items, o % n_items, [(m + low) * PART for m in dict.fromkeys(shifts)]))
    return out


def holds_enough(item: np.ndarray, doc: np.ndarray, shifts: list[int], least: int) -> bool:
    """Whether as many different long q-grams of the item as its bound stand within SIDE of a shift."""
    same = item[:, None] == doc[None, :]
    i, j = np.nonzero(same[:-2, :-2] & same[1:-1, 1:-1] & same[2:, 2:])
    if len(i) < least:
        return False
    return len(np.unique(i[_near(j - i, shifts)])) >= least


def _near(d: np.ndarray, shifts: list[int]) -> np.ndarray:
    """Which diagonals lie within SIDE of a shift."""
    at = np.sort(np.array(shifts, dtype=np.int64))
    k = np.searchsorted(at, d)
    return np.minimum(np.abs(d - at[np.minimum(k, len(at) - 1)]), np.abs(d - at[np.maximum(k - 1, 0)])) <= SIDE


def _apart(places: list[int], counts: list[int], wide: int) -> int:
    """Most q-grams in two bands that do not overlap."""
    most = later = 0
    far = len(places) - 1
    for w, n in zip(reversed(places), reversed(counts)):
        while places[far] >= w + wide:
            later = max(later, counts[far])
            far -= 1
        most = max(most, n + later)
    return most


def _alike(a: str, b: str) -> bool:
    """Words that are the same but for one letter or two letters swapped."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if la < 4 or lb < 4 or abs(la - lb) > 1 or a.isdigit():
        return False
    if la == lb:
        d = [i for i in range(la) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if la > lb:
        a, b, la = b, a, lb
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def _runs(item: list[str], doc: list[str], shifts: list[int], coded: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(item from, document from, words) of the longest runs of the same words within SIDE of a shift;
    words that are alike join the runs they touch."""
    if coded is None:
        number = {w: k for k, w in enumerate(dict.fromkeys(item))}
        coded = np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in doc])
    i, j = np.nonzero(coded[0][:, None] == coded[1][None, :])
    near = _near(j - i, shifts)
    i, d = i[near], (j - i)[near]
    order = np.lexsort((i, d))
    i, d = i[order], d[order]
    if not len(i):
        return []
    begins = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    long = np.diff(np.r_[begins, len(i)])
    n, m = len(item), len(doc)
    out: list[tuple[int, int, int]] = []
    for a, s, w in zip(i[begins].tolist(), d[begins].tolist(), long.tolist()):
        z = a + w
        if out and out[-1][1] - out[-1][0] == s and out[-1][0] + out[-1][2] >= a - 1:  # alike words led here
            x, y, v = out[-1]
            gap = a - (x + v)
            if gap <= 0 or _alike(item[a - 1], doc[a - 1 + s]):
                out.pop()
                a = x
        while a > 0 and a + s > 0 and (not out or out[-1][1] - out[-1][0] != s or out[-1][0] + out[-1][2] < a) and _alike(item[a - 1], doc[a - 1 + s]):
            a -= 1
        while z < n and z + s < m and _alike(item[z], doc[z + s]):
            z += 1
        out.append((a, a + s, z - a))
    return sorted(out, key=lambda r: (r[1], r[0]))


def _local(runs: list[tuple[int, int, int]]) -> set[tuple[float, int, int, int, int]]:
    """Dense local alignments made of runs: (score, item from, to, document from, to), for each first
    and last run the best one. A word in between costs EDIT_COST, and no end of a piece costs more
    than it brings, so a piece with an interruption is there as a whole and as its two parts."""
    out = set()
    for f, (fi, fj, fw) in enumerate(runs):
        # (score, best score so far, matches, item to, document to); a shorter run never pays for a gap
        live = [(float(fw), float(fw), fw, fi + fw, fj + fw)]
        out.add((float(fw), fi, fi + fw, fj, fj + fw))
        if fw <= EDIT_COST:
            continue
        reach = fj + fw + fw / EDIT_COST  # no gap beyond it pays
        for i, j, w in runs[f + 1 :]:
            if j > reach:
                break
            best = None
            for score, top, m, it, jt in live:
                cut = max(0, it - i, jt - j)  # words of the run that the piece has already
                if cut >= w:
                    continue
                left = score - EDIT_COST * max(i + cut - it, j + cut - jt)
                if left > 0 and (best is None or left + w - cut > best[0]):
                    best = (left + w - cut, max(top, left + w - cut), m + w - cut, i + w, j + w)
            if best is not None:
                live.append(best)
                reach = max(reach, best[4] + best[0] / EDIT_COST)
                whole = max(best[3] - fi, best[4] - fj)
                if best[0] >= best[1] and whole - best[2] <= max(1, (1 - DENSE) * whole + 1e-9):
                    out.add((best[0], fi, best[3], fj, best[4]))
    return out


def held(item: list[str], doc: list[str], shifts: list[int], coded: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """How many of the item's words the document holds as one passage, interrupted at most once."""
    if not item or not doc:
        return 0
    pieces = _local(_runs(item, doc, shifts, coded))
    most = max((b - a for _, a, b, _, _ in pieces), default=0)
    # of the places that hold the same part of the item, the earliest and the last
    early: dict[tuple[int, int], tuple[int, int]] = {}
    late: dict[tuple[int, int], tuple[int, int]] = {}
    for score, a, b, c, d in pieces:
        if score >= 3:
            early[a, b] = min(early.get((a, b), (d, c)), (d, c))
            late[a, b] = max(late.get((a, b), (d, c)), (d, c))
    for (a, b), (d, c) in early.items():
        for (e, f), (h, g) in late.items():
            # a second piece after the first in both texts
            if e > a and f > b and g > c and h > d:
                most = max(most, b - a + f - max(e, b))
    return most


def _pieces(text: str, chunk: int, overlap: int) -> list[str]:
    """A text as it is, or in overlapping pieces cut at blanks where it is longer than a chunk."""
    if len(text) <= chunk:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + chunk)
        if end < len(text):
            end = max(text.rfind(" ", at + chunk // 2, end), at + chunk // 2 + 1)
        out.append(text[at:end])
        if end == len(text):
            return out
        back = text.find(" ", max(at + 1, end - overlap), end)
        at = back if back > at else end
    return out


def search(index: Index, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(text number, item number, words held) of the pairs that hold the share.

    Memory is bounded by ``chunk``: short texts are searched together, longer ones in pieces that share
    ``overlap`` characters, which is then the most that an interruption may take.
    """
    owner, clean = [], []
    for n, t in enumerate(texts):
        for piece in _pieces(plain(t), chunk, overlap):
            owner.append(n)
            clean.append(piece)
    best: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(clean):
        end, size = at, 0
        while end < len(clean) and (end == at or size + len(clean[end]) < chunk):
            size += len(clean[end])
            end += 1
        last, words, coded = -1, [], None
        for d, i, diagonals in candidates(index, clean[at:end]):
            if d != last:
                words, last = WORD.findall(clean[at + d]), d
                coded = np.array([index.number.get(w, -1) for w in words], dtype=np.int64)
            if not holds_enough(index.coded[i], coded, diagonals, int(index.least_long[i])):
                continue
            n = held(index.words[i], words, diagonals, (index.coded[i], coded))
            if n >= index.need[i]:
                key = (owner[at + d], i)
                best[key] = max(best.get(key, 0), n)
        at = end
    return [(d, i, n) for (d, i), n in best.items()]


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, words, item_words): every document with every item that leaked into it."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    schema = T.StructType([T.StructField(doc_key, T.LongType()), T.StructField(item_key, T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("item_words", T.IntegerType())])
    slim = docs.select(F.col(doc_key).cast("long").alias(doc_key), F.col(text).alias("_text")).where(f"_text IS NOT NULL AND {doc_key} IS NOT NULL")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["chars"] // BLOCK_CHARS))
    asked = asked.withColumn("_b", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    out = None
    for first in range(0, blocks, PASS_BLOCKS):
        indexes = []
        for b in range(first, min(first + PASS_BLOCKS, blocks)):
            rows = asked.where(F.col("_b") == b).select("id", "text").collect()  # one block's texts
            indexes.append(spark.sparkContext.broadcast(Index(sorted((r["id"], r["text"]) for r in rows))))

        def run(batches: Iterator[pa.RecordBatch], indexes=tuple(indexes)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for shared in indexes:
                    index = shared.value
                    got = search(index, texts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[d] for d, _, _ in got], pa.int64()),
                            pa.array([int(index.ids[i]) for _, i, _ in got], pa.int64()),
                            pa.array([n for _, _, n in got], pa.int32()),
                            pa.array([len(index.words[i]) for _, i, _ in got], pa.int32()),
                        ],
                        names=[f.name for f in schema.fields],
                    )

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """p6_found: documents with the items they hold at least half of."""
    return leaks(docs, items).select("doc_id", "item_id")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_set, documents, most): every item, with how many documents hold it."""
    per = leaks(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.col("words") / F.col("item_words")).alias("most"))
    return items.select("item_id", "item_set").join(per, "item_id", "left").select("item_id", "item_set", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0.0)).alias("most"))
