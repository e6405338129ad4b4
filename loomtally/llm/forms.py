"""One form for text that looks alike but differs in its characters (problem 3).

A transducer is compiled once. Its alphabet takes every character to a symbol: compatibility forms
that look like the plain character (widths, styles, ligatures, Roman numerals), spaces, invisible
characters, and letters that look like Latin ones. Its states are a trie over symbols that holds every
canonical sequence of a base letter and accents. Building checks that no key has two values and that
no value holds a key, so one pass gives a fixed point. A text is cut into words and marks; each is
walked once, cluster by cluster, a cluster giving the longest sequence the trie holds. Which letters of
other scripts take part depends on the word, so there is one alphabet for each kind of word, over the
same trie.

Letters of other scripts are look-alikes in a word that holds a Latin letter; a word of Cyrillic
look-alikes alone, and a single Greek letter of Latin shape, too. A dotless i is one in words without a
capital (names keep it).

Left as they are: line breaks, composed accents, Greek letters used as symbols, superscript digits,
dashes, minus signs, typographic quotes, and damage of fonts (control characters, fractions).
Nulls stay null, empty texts stay empty, texts of any length are treated whole; only short words are
kept in memory between texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm.encodings import PAGES, SEQUENCE, _TO_BYTES, char_cost

# Letters of other scripts and the Latin letters they look like, after Unicode's table of confusables.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮҺӀԌԚԜѴаеѕіјорсухүһԁԛԝӏѵѡ", "ABESIJKMHOPCTYXYhIGQWVaesijopcyxyhdqwlvw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικυχγϲϳ", "ABEZHIKMNOPTYXoavpikuxycj"))
ARMENIAN = dict(zip("ՀԼՍՏՕագզհյոռսցօ", "HLUSOwqqhjnnugo"))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥ", "HIKMNOPCTYXoc"))
LATIN_FORMS = dict(zip("ɑɡɩʋ℮", "agive"))
DOTLESS = {"ı": "i"}
# Greek letters that stand for a Latin one even where they are alone.
GREEK_ALONE = set("ΑΒΕΖΗΙΚΜΝΟΡΤΥοϲϳ")
# Tags of compatibility decompositions that look like the plain characters.
TAGS = ("<wide>", "<narrow>", "<font>")
# Blank fillers that no general category tells from letters or symbols.
BLANKS = {0x115F: "", 0x1160: "", 0x3164: "", 0xFFA0: "", 0x2800: " "}


def _put(table: dict[str, str], key: str, value: str) -> None:
    if key != value and table.setdefault(key, value) != value:
        raise ValueError(f"two values for {key!r}: {table[key]!r} and {value!r}")


def _scalars():
    return (chr(o) for o in range(0x80, sys.maxunicode + 1) if not 0xD800 <= o < 0xE000)


def build_singles() -> dict[str, str]:
    """Characters that always stand for another one, an ASCII sequence or nothing."""
    table: dict[str, str] = {}
    for ch in _scalars():
        o, cat = ord(ch), unicodedata.category(ch)
        if o in BLANKS:
            _put(table, ch, BLANKS[o])
        elif cat == "Zs":
            _put(table, ch, " ")
        elif cat == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o == 0x034F:
            _put(table, ch, "")
        elif d := unicodedata.decomposition(ch):
            tag, _, rest = d.partition(" ")
            if tag in TAGS or 0xFB00 <= o <= 0xFB06 or (tag == "<compat>" and 0x2160 <= o < 0x2180):
                _put(table, ch, unicodedata.normalize("NFKC", ch))
            elif tag[0] != "<":  # singletons: Kelvin, Angstrom and the like
                _put(table, ch, unicodedata.normalize("NFC", ch))
    return _closed(table)


def _closed(table: dict[str, str]) -> dict[str, str]:
    """Every value followed to its end; raises where that leads in circles."""
    out = {}
    for key, end in table.items():
        for _ in range(4):
            end = "".join(table.get(c, c) for c in end)
        if any(c in table for c in end):
            raise ValueError(f"{key!r} leads in circles")
        out[key] = end
    return out


def build_sequences() -> dict[str, str]:
    """Canonical sequences of a base character and its accents, to the composed character."""
    table: dict[str, str] = {}
    for ch in _scalars():
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            _put(table, unicodedata.normalize("NFD", ch), ch)
    return table


def _with_accents(letters: dict[str, str]) -> dict[str, str]:
    """Look-alikes and the composed characters built on them that Latin has too."""
    table = dict(letters)
    for full, ch in SEQUENCES.items():
        if full[0] in letters and len(to := unicodedata.normalize("NFC", letters[full[0]] + full[1:])) == 1:
            _put(table, ch, to)
    return table


def _small_capitals() -> dict[str, str]:
    names = ((ch, re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(ch, ""))) for ch in map(chr, range(0x250, 0xABFF)))
    return {ch: m.group(1).lower() for ch, m in names if m}


SINGLE = build_singles()
SEQUENCES = build_sequences()
CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC = map(_with_accents, (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC))
SMALL_CAPITALS = _small_capitals()
#: Look-alikes in a word that holds a Latin letter.
IN_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **LISU, **COPTIC, **LATIN_FORMS, **SMALL_CAPITALS}
MARK = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"


class Transducer:
    """Longest-match transducer over grapheme clusters: an alphabet and a trie of sequences."""

    #: States of the trie, shared: edges by symbol, and the output where a sequence ends.
    edges: list[dict[str, int]] = [{}]
    final: list[str | None] = [None]
    #: Composed characters as the symbols they are made of.
    parts: dict[str, str] = {}

    @classmethod
    def compile(cls, sequences: dict[str, str]) -> None:
        for key, value in sequences.items():
            at = 0
            for symbol in key:
                if symbol not in cls.edges[at]:
                    cls.edges[at][symbol] = len(cls.edges)
                    cls.edges.append({})
                    cls.final.append(None)
                at = cls.edges[at][symbol]
            if cls.final[at] not in (None, value):
                raise ValueError(f"two values for {key!r}")
            cls.final[at] = value
            _put(cls.parts, value, key)

    def __init__(self, alike: dict[str, str]):
        table = dict(SINGLE)
        for key, value in alike.items():
            _put(table, key, value)
        self.symbols = _closed(table)

    def __call__(self, run: str) -> str:
        symbols, out, i, n = self.symbols, [], 0, len(run)
        while i < n:
            symbol = symbols.get(run[i], run[i])
            i += 1
            marks = []
            while i < n and (unicodedata.combining(run[i]) or symbols.get(run[i]) == ""):
                marks.append(symbols.get(run[i], run[i]))
                i += 1
            out.append(self._cluster(symbol, "".join(marks)) if marks else symbol)
        return "".join(out)

    def _cluster(self, base: str, marks: str) -> str:
        """The longest sequence of a base and its accents; accents it lacks stay behind it."""
        head, last = base[:-1], base[-1:]
        line = self.parts.get(last, last)
        accents = sorted("".join(line[1:]) + marks, key=unicodedata.combining)
        at = self.edges[0].get(line[:1])
        got, left, level = line[:1], [], -1
        for m in accents:
            c = unicodedata.combining(m)
            to = self.edges[at].get(m) if at is not None and c > level else None
            if to is not None and self.final[to] is not None:
                at, got = to, self.final[to]
            else:  # accents of the same place behind it are blocked by it
                left.append(m)
                level = c
        return head + got + "".join(left)


Transducer.compile(SEQUENCES)
PLAIN, LATIN, LATIN_LOWER = Transducer({}), Transducer(IN_LATIN), Transducer({**IN_LATIN, **DOTLESS})
CYRILLIC_ALONE, GREEK_LETTER = Transducer(CYRILLIC), Transducer({k: v for k, v in GREEK.items() if k in GREEK_ALONE})


def _ranges(chars) -> str:
    """Characters as the inside of a character class."""
    out, codes = [], sorted(map(ord, chars))
    start = prev = codes[0]
    for o in [*codes[1:], -1]:
        if o != prev + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(prev))}")
            start = o
        prev = o
    return "".join(out)


_ALIKE = "".join([*IN_LATIN, *DOTLESS])
_TRIGGERS = _ranges(SINGLE) + MARK + _ranges(_ALIKE)
#: A word or symbol group that holds a trigger, with the letters and marks around it.
RUN = re.compile(f"[^\\W\\d_{_TRIGGERS}]*[{_TRIGGERS}](?:[{_TRIGGERS}]|[^\\W\\d_])*")


@lru_cache(maxsize=4096)
def _is_latin(ch: str) -> bool:
    return "a" <= ch.lower() <= "z" or (ch > "\x7f" and unicodedata.name(ch, "").startswith("LATIN"))


def _walk(run: str) -> str:
    """One word through the transducer of its kind."""
    seen = [x for c in run for x in SINGLE.get(c, c)]
    if any(map(_is_latin, seen)):
        return (LATIN_LOWER if "ı" in run and not any(c.isupper() for c in seen) else LATIN)(run)
    letters = [c for c in run if c.isalpha()]
    if letters and all(c in CYRILLIC or SINGLE.get(c, c) != c for c in letters):
        return CYRILLIC_ALONE(run)
    return (GREEK_LETTER if len(letters) == 1 else PLAIN)(run)


#: Words up to this length are kept between texts, so what a worker keeps is bounded.
KEPT = 64


@lru_cache(maxsize=100_000)
def _kept(run: str) -> str:
    return _walk(run)


def _walked(run: str) -> str:
    return _kept(run) if len(run) <= KEPT else _walk(run)


_PAGE_SUSPECT = re.compile("[À-ôĂĎÎĹŇÂâВГПОРСв√œŒ‚¬├┬╧╬Γπ╓╗]")


def _garbled(text: str) -> list[tuple[int, int]]:
    """Places that a code page turns into UTF-8: these belong to wrong decoding, not to look-alikes."""
    if not _PAGE_SUSPECT.search(text):
        return []
    spans = []
    for page in PAGES:
        raw = text.translate(_TO_BYTES[page])
        for m in SEQUENCE.finditer(raw):
            try:
                ch = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            if char_cost(ch) < 2.5 or page != "latin-1" and ch < "\u2100":
                spans.append(m.span())
    return spans


# Regular characters beyond ASCII that need no look (keys and look-alikes are not here).
REGULAR = "".join(chr(o) for o in (*range(0xA1, 0xAD), *range(0xAE, 0x180), *range(0x2010, 0x2028)) if chr(o) not in SINGLE and chr(o) not in _ALIKE) + "−≤≥≠≈√∞βδεζηθλμξπστφψωΓΔΘΛΠΣΦΨΩ"
#: Greek symbols that are regular unless they touch a Latin letter.
SYMBOLS = "χα"


#: What makes a text worth walking: a trigger other than those symbols, or one of them at a Latin letter.
LOOK = re.compile(f"[{_ranges([*SINGLE, *(c for c in _ALIKE if c not in SYMBOLS)])}{MARK}]|[A-Za-z\u00c0-\u024f][{SYMBOLS}]|[{SYMBOLS}][A-Za-z\u00c0-\u024f]")


def uniform(text: str | None) -> str | None:
    """``text`` in its one form; runs of a wrong decoding stay as they are."""
    if text is None or text.isascii() or not LOOK.search(text):
        return text
    spans = _garbled(text)

    def put(m: re.Match) -> str:
        if spans and any(a < m.end() and m.start() < b for a, b in spans):
            a = m.start()
            return "".join(c if any(x <= a + k < y for x, y in spans) else SINGLE.get(c, c) for k, c in enumerate(m.group()))
        return _walked(m.group())

    return RUN.sub(put, text)


@F.pandas_udf(T.StringType())
def uniform_udf(texts: pd.Series) -> pd.Series:
    return texts.map(uniform, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def differs_udf(texts: pd.Series) -> pd.Series:
    """True where the one form differs from the text; null texts give false."""
    return pd.Series([t is not None and uniform(t) != t for t in texts.where(texts.notna(), None)], dtype=bool)


def may_differ(col: Column) -> Column:
    """Native guard: false only for texts that are in their one form already.

    ASCII texts are told by their length in bytes; of the others the regular characters are taken out
    before the lengths are compared again, which is far cheaper than a class of all triggers.
    """
    rest = F.translate(col, REGULAR + SYMBOLS, "")
    touch = col.rlike(f"[A-Za-z\\x{{c0}}-\\x{{24f}}][{SYMBOLS}]|[{SYMBOLS}][A-Za-z\\x{{c0}}-\\x{{24f}}]")
    odd = (F.octet_length(rest) != F.length(rest)) | touch
    return F.coalesce(F.when(F.octet_length(col) == F.length(col), F.lit(False)).otherwise(odd), F.lit(False))


def found(holdout: DataFrame, disputes: DataFrame) -> DataFrame:
    """p3_found: rows whose text, or any candidate's quote, is not in its one form."""
    h = holdout.select(F.lit("holdout").alias("origin"), F.col("record_id").alias("row_key"), "text")
    q = disputes.select(F.lit("disputes").alias("origin"), F.col("decision_id").alias("row_key"), F.explode(F.expr("array_distinct(candidates.quote)")).alias("text"))
    both = h.unionByName(q).where(may_differ(F.col("text")))
    return both.where(differs_udf("text")).select("origin", "row_key").distinct()
