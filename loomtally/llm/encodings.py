"""Garbled text from a wrong character decoding (problem 5).

A text is the start of a best-first search. An operation re-encodes the text's runs in one legacy
code page and decodes them as UTF-8, or re-encodes runs beyond ASCII in one page and decodes them in
another (Cyrillic, Greek and East Asian pages), takes out the zero bytes of UTF-16, or unescapes
character references, percent and backslash-u escapes; what it leads to is a further state. States are
kept by hash so that none is expanded twice, and a character-plausibility cost chooses the next one. The
cheapest state reached is the restored text. A step costs something, so a state that even a text of cost
nothing behind it would not bring below the best is left: that ends the search and loses nothing.

A decoded character next to bytes that stay garbled is refused, as it would be new damage. Escapes alone
are undone, but are no wrong decoding.

Nulls give (False, None, []), empty texts (False, "", []); a text of any length is searched whole.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code pages that UTF-8 bytes are commonly decoded in by mistake.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "cp1254", "cp1257", "iso8859-15", "koi8-r")

# Pages a run may have been read in, and those it may have been written in.
READ_IN = ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8-r", "cp866")
WRITTEN_IN = ("cp1251", "koi8-r", "cp866", "cp1253", "shift_jis", "euc_jp", "euc_kr", "gbk", "big5")
#: Words that may be text of another page: no ASCII letter in or at them, four characters beyond ASCII.
FOREIGN = re.compile("(?<![A-Za-z])[^\x00-\x7f]{2}(?:[\x20-\x7e]?[^\x00-\x7f]+)+(?![A-Za-z])")
#: Accented Latin letters in a row that no language writes.
CLUSTER = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{3,}")
#: Cyrillic words in turned case, as one page read as another gives.
TURNED = re.compile("(?<![^\\W\\d_])[\u0430-\u044f][\u0410-\u042f]{2,}|(?<![^\\W\\d_])[\u0410-\u042f][\u0430-\u044f]*[\u0410-\u042f][\u0430-\u044f][^\\W\\d_]*")
#: More vowels in a row than Russian writes.
VOWELS = re.compile("[\u0430\u0435\u0438\u043e\u0443\u044b\u044d\u044e\u044f]{3,}")
SCRIPT = re.compile("[\u0386-\u03ce]{4,}|[\u0410-\u044f]{4,}")
EAST = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]{2,}")
# The letters that Russian and Greek text is mostly made of.
COMMON = set("оеаинтсрвлкмдпуОЕАИНТСРВЛКМДПУαοιετσνηυρπκμλςωάέήίόύώΑΟΙΕΤΣΝΗΥΡΠΚΜΛ")
#: A reading in another page costs this much, as it must make words of what was none.
READING = 2.0
#: A step costs this much, so that a change must make the text clearly more plausible.
STEP = 0.4
SEQUENCE = re.compile("[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2}|[ð-ô][\u0080-¿]{3}")
PERCENT = re.compile("(?:%[89A-Fa-f][0-9A-Fa-f]){2,}")
BACKSLASH = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
ESCAPE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
# A lead byte's letter whose continuation got lost or became a plain space: not restorable.
WIDOW = re.compile("(?<![A-ZÀ-Þ])[ÃÂ](?![A-Za-zÀ-ɏ])|(?<=[a-zß-ÿ])[ÃÂ]|â€|ï¿½")
SUSPECT = re.compile("[^\x01-\x7f]|&[#A-Za-z]|%[89A-Fa-f][0-9A-Fa-f]|\\\\u[0-9a-fA-F]{4}")


def _page_bytes(page: str) -> dict[int, str]:
    """Characters of a code page to the byte each came from (as a Latin-1 character)."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(page))] = chr(b)
        except UnicodeDecodeError:
            pass
        if b < 0xA0:
            out.setdefault(b, chr(b))  # decoders that let undefined bytes through
    return out


TABLES = {page: _page_bytes(page) for page in PAGES}
_KNOWN = {o for t in TABLES.values() for o in t}  # an inner layer may hold any of these
_OTHER = "Ā"


class _Bytes(dict):
    """str.translate table: what the page lacks, beyond ASCII, becomes a character no pattern matches."""

    def __missing__(self, key: int) -> str:
        self[key] = chr(key) if key < 0x80 else _OTHER
        return self[key]


_TO_BYTES = {page: _Bytes(t) for page, t in TABLES.items()}


@lru_cache(maxsize=65536)
def char_cost(ch: str) -> float:
    """How unlikely a character is in article text: 0 for ASCII up to 6 for what no writer types."""
    o = ord(ch)
    if o < 0x80:
        return 0.0
    if o < 0xA0 or o == 0xFFFD:
        return 4.0
    name, cat = unicodedata.name(ch, ""), unicodedata.category(ch)
    if cat in ("Cn", "Co", "Cs"):
        return 6.0
    if o in (0xB2, 0xB3, 0xB9, 0xB1, 0xD7, 0xA7, 0xB5, 0xB0, 0xAB, 0xBB, 0xBC, 0xA0, 0xBD, 0xBE, 0xB7):
        return 0.6
    if o in (0x2212, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2026, 0x2264, 0x2265, 0x2260, 0x2248, 0x20AC):
        return 0.6
    if o < 0x100:
        return 0.7 if cat in ("Ll", "Lu") else 1.6
    if o < 0x180:
        return 0.9
    if name.startswith("GREEK") and cat in ("Ll", "Lu"):
        return 0.6 if "WITH" not in name else 2.0
    if cat in ("Mn", "Zs", "Cf") or 0xFF00 <= o < 0xFFF0 or 0x1D400 <= o < 0x1D800:
        return 1.0
    if name.startswith("CYRILLIC"):
        return 1.3
    if 0x2500 <= o < 0x2600:
        return 3.0
    if cat == "Sm" or 0x2000 <= o < 0x2070:
        return 1.5
    return 2.5


def cost(text: str) -> float:
    """Plausibility cost: rare characters, capitals inside words, escapes that no writer leaves."""
    total = 0.0
    before = " "
    for ch in text:
        if ch > "\x7f":
            total += char_cost(ch)
            if before.islower() and ch.isupper():
                total += 1.0
        before = ch
    if total > 2:
        total += sum(len(m.group()) - 2 for m in CLUSTER.finditer(text)) + 3.0 * len(TURNED.findall(text)) + 1.5 * len(VOWELS.findall(text))
        total -= 2.2 * sum(len(m.group()) for m in EAST.finditer(text))  # a script by itself is plausible
        for m in SCRIPT.finditer(text):
            total -= sum(char_cost(c) - (0.3 if c in COMMON else char_cost(c)) for c in m.group())
    if "&" in text:
        total += len(ESCAPE.findall(text))
    if "%" in text:
        total += sum(len(m.group()) / 3 for m in PERCENT.finditer(text))
    if "\\u" in text:
        total += sum(len(m.group()) / 3 for m in BACKSLASH.finditer(text))
    return total + text.count("\0")


#: Bytes that stand beside letters in regular text; others beside a decoded character mean damage.
_BESIDE = set("\u00b0\u00b2\u00b3\u00b9\u00b7\u00ab\u00bb\u00a7\u00b1\u00bc\u00bd\u00a0")


def _decoded(text: str, page: str) -> str | None:
    """``text`` with every run that is UTF-8 in ``page`` decoded; None if there is none."""
    raw = text.translate(_TO_BYTES[page])
    out, last, end = [], 0, -1
    for m in SEQUENCE.finditer(raw):
        try:
            ch = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if char_cost(ch) >= 2.5 and ord(ch) not in _KNOWN:
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if "\u00a1" <= before < "\u00c0" and before not in _BESIDE and m.start() != end and "\u00a1" <= after < "\u00c0" and after not in _BESIDE:
            continue
        out += [text[last : m.start()], ch]
        last = end = m.end()
    return "".join([*out, text[last:]]) if out else None


def _read_again(text: str, read: str, written: str) -> str | None:
    """``text`` with its foreign runs encoded in ``read`` and decoded in ``written``; None if that fails or
    leaves other than letters of one script."""

    def put(m: re.Match) -> str:
        if len(set(m.group())) < 3:
            return m.group()
        try:
            new = m.group().encode(read).decode(written)
        except UnicodeError:
            return m.group()
        letters = [c for c in new if ord(c) > 0x7F and c.isalpha()]
        if len(letters) + sum(new.count(c) for c in "\u3001\u3002\u30fc\u300c\u300d") < sum(ord(c) > 0x7F for c in new):
            return m.group()
        scripts = {unicodedata.name(c, "").partition(" ")[0] for c in letters}
        if written in ("cp1251", "koi8-r", "cp866"):
            ok = scripts == {"CYRILLIC"}
        elif written == "cp1253":
            ok = scripts == {"GREEK"}
        elif written == "euc_kr":
            ok = scripts == {"HANGUL"}
        elif written in ("shift_jis", "euc_jp"):  # Japanese is told by its kana
            ok = bool(scripts & {"HIRAGANA", "KATAKANA"}) and scripts <= {"HIRAGANA", "KATAKANA", "CJK"}
        else:  # and Chinese by the first level of its character set
            usual = sum(0xB0 <= x[0] <= 0xD7 if written == "gbk" else 0xA4 <= x[0] <= 0xC6 for c in letters if len(x := c.encode(written)) == 2)
            ok = scripts == {"CJK"} and usual >= 0.8 * len(letters)
        return new if ok else m.group()

    to = FOREIGN.sub(put, text)
    return to if to != text else None


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m.group().replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def _backslash(m: re.Match) -> str:
    units = b"".join(int(x, 16).to_bytes(2, "big") for x in m.group().split("\\u")[1:])
    return units.decode("utf-16-be", "replace") if all(int(x, 16) >= 0x80 for x in m.group().split("\\u")[1:]) else m.group()


def successors(text: str, readings: bool = True):
    """(operation, text) for every operation that changes ``text``."""
    for page in PAGES:
        if (t := _decoded(text, page)) is not None:
            yield f"{page}>utf-8", t
    if readings and FOREIGN.search(text):
        for read in READ_IN:
            for written in WRITTEN_IN:
                if read != written and (t := _read_again(text, read, written)) is not None:
                    yield f"{read}>{written}", t
    if text.count("\0") * 3 > len(text) and (t := text.replace("\0", "")):
        yield "utf-16", t
    if ESCAPE.search(text) and (t := html.unescape(text)) != text:
        yield "unescape", t
    if "%" in text and (t := PERCENT.sub(_percent, text)) != text:
        yield "unescape percent", t
    if "\\u" in text and (t := BACKSLASH.sub(_backslash, text)) != text:
        yield "unescape backslash", t


def restore(text: str) -> tuple[str, list[str]]:
    """The cheapest text reachable and the operations that lead there; a path holds one reading in
    another page at most."""
    start = cost(text)
    best, heap, seen, order = (start, text, ()), [(start, 0.0, 0, text, ())], {hash(text)}, 0
    while heap:
        total, spent, _, at, path = heapq.heappop(heap)
        if total < best[0] - 1e-9:
            best = (total, at, path)
        if spent + STEP >= best[0]:  # no text costs less than nothing
            continue
        for op, to in successors(at, not any(_is_reading(x) for x in path)):
            if hash(to) not in seen:
                seen.add(hash(to))
                order += 1
                paid = spent + (READING if _is_reading(op) else STEP)
                heapq.heappush(heap, (cost(to) + paid, paid, order, to, (*path, op)))
    return best[1], list(best[2])


def _is_reading(op: str) -> bool:
    return ">" in op and not op.endswith(">utf-8")


#: Texts up to this length are kept between rows, so what a worker keeps is bounded.
KEPT = 200


def diagnose(text: str | None) -> tuple[bool, str | None, tuple[str, ...]]:
    """(garbled, restored text, operations). Garbled but not restorable: the text stays, no operations."""
    if text is None or not SUSPECT.search(text):
        return False, text, ()
    return _kept(text) if len(text) <= KEPT else _diagnosed(text)


@lru_cache(maxsize=50_000)
def _kept(text: str) -> tuple[bool, str, tuple[str, ...]]:
    return _diagnosed(text)


def _diagnosed(text: str) -> tuple[bool, str, tuple[str, ...]]:
    fixed, ops = restore(text)
    ops = tuple(ops)
    decoded = any(not o.startswith("unescape") for o in ops)
    lost = "�" in fixed or any("\x80" <= c < "\xa0" for c in fixed) or WIDOW.search(fixed) is not None
    return decoded or lost, fixed, ops


def garbled_mask(text: str) -> list[bool]:
    """For every character, whether it is part of a run that some code page turns into UTF-8."""
    mask = [False] * len(text)
    fixed, ops = restore(text)
    at = text
    if ops and ops[0].endswith(">utf-8"):
        raw = at.translate(_TO_BYTES[ops[0].split(">")[0]])
        for m in SEQUENCE.finditer(raw):
            mask[m.start() : m.end()] = [True] * (m.end() - m.start())
    return mask


SCHEMA = T.StructType(
    [
        T.StructField("garbled", T.BooleanType()),
        T.StructField("restored", T.StringType()),
        T.StructField("operations", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(SCHEMA)
def diagnose_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [diagnose(t) for t in texts.where(texts.notna(), None)]
    return pd.DataFrame({"garbled": [r[0] for r in rows], "restored": [r[1] for r in rows], "operations": [list(r[2]) for r in rows]})


def may_be_garbled(col: Column) -> Column:
    """Native guard: only texts with characters beyond ASCII, zero bytes or an escape can be garbled."""
    return col.rlike(r"[^\x01-\x7f]|&[#A-Za-z]|%[89A-Fa-f][0-9A-Fa-f]|\\u[0-9a-fA-F]{4}")


def _strings(disputes: DataFrame, raws: DataFrame) -> DataFrame:
    """(origin, row_key, text) of every value that may be garbled."""
    quotes = disputes.select(F.lit("disputes").alias("origin"), F.col("decision_id").alias("row_key"), F.explode(F.expr("array_distinct(candidates.quote)")).alias("text"))
    raw = raws.select(F.lit("statcheck_repaired").alias("origin"), F.col("row_id").alias("row_key"), F.col("raw").alias("text"))
    both = quotes.unionByName(raw)
    return both.where(F.col("text").isNotNull() & may_be_garbled(F.col("text")))


def restored(disputes: DataFrame, raws: DataFrame) -> DataFrame:
    """(origin, row_key, text, restored, operations) of every garbled value."""
    d = _strings(disputes, raws).withColumn("d", diagnose_udf("text"))
    return d.where("d.garbled").select("origin", "row_key", "text", F.col("d.restored").alias("restored"), F.col("d.operations").alias("operations"))


def found(disputes: DataFrame, raws: DataFrame) -> DataFrame:
    """p5_found: rows with a garbled value, restorable or not."""
    return restored(disputes, raws).select("origin", "row_key").distinct()
