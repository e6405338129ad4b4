"""Text cut off by field limits or in transfer (problem 8).

Lengths are recomputed as other systems would have counted them: characters, UTF-8 and UTF-16, with
HTML escaping, JSON escaping and CRLF line ends. Grouped by source and way of counting, a hidden
storage limit shows as a pile of rows at the very largest length. Endings are then inspected: a text
is cut if its last unit (sentence, table row, reference, note, mark) is not a whole one, and at a
limit also where the ending alone would leave it open (an ellipsis, a whole number before the stop).

A text of exactly the limit's length whose end tells nothing is cut by the limit alone.

Null texts and texts of white space only are not cut. Texts of any length are measured whole; the
ending is what follows the last blank line, or the last heading of a reference list. Ties between
ways of counting go to the plainer one. Repeated rows count as rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.session import cut, small_side

# The ways of counting, plainest first; equal piles go to the first.
WAYS = ("chars", "utf8", "utf16", "html_chars", "html_utf8", "json_chars", "json_utf8", "crlf_chars", "crlf_utf8")
#: Rows this much below the limit count as at it: a trimmed blank, or a character that would not fit.
SLACK = {"chars": 1, "utf8": 4, "utf16": 1, "html_chars": 6, "html_utf8": 8, "json_chars": 6, "json_utf8": 6, "crlf_chars": 2, "crlf_utf8": 4}
LEAST_PILE = 4
BROADCAST_SOURCES = 100_000
#: A pile must be this many times what the lengths below it would give in the same room.
STEEP = 8.0


def ways(text: str = "text") -> dict[str, Column]:
    """The length of a text in every way of counting, as native expressions."""
    t = F.col(text)
    chars, utf8 = F.length(t), F.octet_length(t)
    ascii_only = utf8 == chars

    def times(of: str) -> Column:
        return F.regexp_count(t, F.lit(of))

    astral = F.when(ascii_only, F.lit(0)).otherwise(times(r"[\x{10000}-\x{10FFFF}]"))
    html = F.when(t.rlike("[&<>\"']"), 4 * times("&") + 3 * times("[<>]") + 5 * times("[\"']")).otherwise(F.lit(0))
    lines = times("\n")
    json = lines + times(r'["\\\r\t\x08\f]')
    # outside ASCII, JSON may write six characters for each UTF-16 unit
    escaped = F.when(ascii_only, F.lit(0)).otherwise(5 * times(r"[^\x00-\x7f]") + 6 * astral)
    return {
        "chars": chars, "utf8": utf8, "utf16": chars + astral, "html_chars": chars + html, "html_utf8": utf8 + html,
        "json_chars": chars + json + escaped, "json_utf8": utf8 + json, "crlf_chars": chars + lines, "crlf_utf8": utf8 + lines,
    }


def lengths(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, one column for each way of counting) of every text that is not empty."""
    return docs.where(f"{text} IS NOT NULL AND {text} <> ''").select(F.col(source).alias("source"), *(c.cast("long").alias(n) for n, c in ways(text).items()))


def limits(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, way, limit, slack, at_limit): each source's hidden limit, for sources that show one.

    The lengths are counted once and written; the largest of each way per source come from one sum, the
    rows at them and below from a second one. No more than a row per source is ever shuffled by a task.
    """
    per = cut(lengths(docs, source, text))
    top = cut(per.groupBy("source").agg(*(F.max(n).alias(f"{n}_top") for n in WAYS)))
    near = per.join(small_side(top.withColumnRenamed("source", "_s"), top.count(), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_s")))
    at, below = {}, {}
    for n in WAYS:
        edge = F.col(f"{n}_top") - SLACK[n]
        at[n] = F.count_if(F.col(n) >= edge)
        # room below the pile, a tenth of the limit wide, says how many rows chance would put there
        below[n] = F.count_if((F.col(n) < edge) & (F.col(n) >= 0.9 * F.col(f"{n}_top")))
    sums = near.groupBy("source").agg(*(F.max(f"{n}_top").alias(f"{n}_top") for n in WAYS), *(c.alias(f"{n}_at") for n, c in at.items()), *(c.alias(f"{n}_below") for n, c in below.items()))
    each = F.array(*(
        F.struct(
            F.col(f"{n}_at").alias("at_limit"), F.lit(-i).alias("_r"), F.col(f"{n}_top").alias("limit"), F.lit(SLACK[n]).alias("slack"), F.lit(n).alias("way"),
            (F.col(f"{n}_below") * (SLACK[n] + 1) / F.greatest(F.lit(1.0), 0.1 * F.col(f"{n}_top"))).alias("usual"),
        )
        for i, n in enumerate(WAYS)
    ))
    kept = F.filter(each, lambda w: (w["at_limit"] >= LEAST_PILE) & (w["at_limit"] >= STEEP * w["usual"]))
    best = sums.select("source", F.array_max(kept).alias("b")).where("b IS NOT NULL")
    return best.select("source", "b.way", "b.limit", "b.slack", "b.at_limit")


CLOSERS = "\"'”’»)]›"
# Headings of reference lists.
REFERENCES = re.compile(r"^\W*(?:references?|bibliography|literature(?: cited)?|works cited|literatur(?:verzeichnis)?|références(?: bibliographiques)?|bibliographie|referencias(?: bibliográficas)?|bibliografía)\W*$", re.I)
MONTHS = r"[^\W\d_]{3,10}\.?"
DATE_LINE = re.compile(rf"(?:received|accepted|revised|published|submitted|eingegangen|reçu|recibido)\b[^.]*?(?:\d{{1,2}}\.? (?:de )?{MONTHS} (?:de )?|{MONTHS} \d{{1,2}},? )(?:1[89]|20)\d\d", re.I)
PAGE_MARK = re.compile(r"(?:[–—-]\s*\d+\s*[–—-]|\[?\s*(?:page|seite|p\.|s\.)\s*\d+(?:\s*(?:of|/|von)\s*\d+)?\s*\]?|\d{1,4})", re.I)
RULE_MARK = re.compile(r"(?:[*#=_~·•—–-]\s*){3,}|\*|§")
END_MARK = re.compile(r"\W*(?:the )?(?:end|fin|ende|final)\W*(?:of (?:the )?(?:record|document|text|article|file))?\W*", re.I)
BRACKETED = re.compile(r"[\[(<{][^\[\](){}<>]{2,60}[\])>}]")
CUT_WORDS = re.compile(r"trunc|cut off|cut\b|more\b|continu|snip|abgeschnitten|gekürzt|weiter|tronqu|suite|cortad|truncad|sigue|…|\.\.\.", re.I)
ELLIPSIS = re.compile(r"(?:…|\.{3,}|(?:\. ){2}\.)[\"'”’»)\]]*$")
REFERENCE_END = re.compile(r"(?:\d+\s*[–—-]\s*\d+|\bpp?\. \d+|doi\S+\d|https?://\S+|\d{4})\.?$")
REFERENCE_SHAPE = re.compile(r"\d\s*[–—-]\s*\d+\.$")
ROW = re.compile(r"^(.*?\S)((?:(?: {2,}|\t+| \| )[-−+]?[\d.,]+%?\*{0,3})+)$")
NOTE = re.compile(r"^(?:note|notes|anmerkung|remarque|nota)\b", re.I)
RESULT_END = re.compile(r"(?:\bp\s*[=<>≤≥]\s*\.?\d*\.?\d+|\bns|[=<>]\s*[-−]?\d*\.\d{2,})$")
HALF_NUMBER = re.compile(r"(?:(?<![\d.])0\.|[=<>≤≥]\s*[-−]?\.?|[(=<>,]\s*[-−]?\d+\.)$")


def _numbers(row: str) -> list[int]:
    """Decimals of the numbers of a table row."""
    return [len(x.partition(".")[2]) for x in re.findall(r"\d+(?:\.\d*)?", row)]


def _whole_table(lines: list[str]) -> bool:
    """Whether the last of the lines is a whole row like those before it."""
    rows = [(i, m) for i, line in enumerate(lines) if (m := ROW.match(line))]
    if not rows or rows[-1][0] != len(lines) - 1:
        return False
    last = _numbers(rows[-1][1].group(2))
    if len(rows) > 1:
        before = _numbers(rows[-2][1].group(2))
        return len(last) == len(before) and (last == before or set(before) != {max(before)} or all(a >= max(before) for a in last))
    head = lines[-2] if len(lines) > 1 else ""
    columns = len(re.split(r" {2,}|\t+| \| ", head.strip())) - 1
    return (columns < 1 or len(last) == columns) and len(set(last)) == 1 and last[0] != 0 and (len(last) > 1 or last[0] > 1)


def ending(text: str | None, at_limit: bool) -> str | None:
    """Why ``text`` is cut, or None if its end is its own."""
    if text is None or not text.strip():
        return None
    body = text.rstrip()
    blocks = re.split(r"\n[ \t\r]*\n", body)
    para = blocks[-1].strip()
    lines = [x.rstrip("\r") for x in para.split("\n")]
    last = lines[-1].strip()
    if ELLIPSIS.search(body):
        return "mark" if at_limit else None
    if DATE_LINE.fullmatch(para) or PAGE_MARK.fullmatch(para) or RULE_MARK.fullmatch(para):
        return None
    if END_MARK.fullmatch(para):
        return None
    if BRACKETED.fullmatch(last) and (len(lines) > 1 or len(blocks) > 1):
        return "mark" if CUT_WORDS.search(last) and not re.search(r"[.!?][)\]]$", last) else None
    for k in range(len(lines) - 1, -1, -1):  # a reference list that runs to the end
        if REFERENCES.match(lines[k]):
            return _reference_cut(lines[k + 1 :])
    if len(blocks) > 1 and REFERENCES.match(blocks[-2].strip().split("\n")[-1]):
        return _reference_cut(lines)
    if _whole_table(lines):
        return None
    bare = body.rstrip(CLOSERS)
    if NOTE.match(para) and RESULT_END.search(bare) and para.count("(") == para.count(")"):
        return "number" if re.search(r"(?:^|[^\d])(?:0?\.0*)$|[=<>]\s*$", bare) or at_limit and re.search(r"\.0+$", bare) else None
    if bare and bare[-1] in ".!?。":
        if bare[-1] == "." and HALF_NUMBER.search(bare):
            return "number"
        if at_limit and re.search(r"(?<![\d.,])\d+\.$", bare):
            return "number"
        if at_limit and re.search(r"(?:^|[\s(])[A-ZÀ-Þ]\.$", bare):
            return "sentence"
        inner = para[para.rfind("(") :] if "(" in para else ""
        if inner and ")" not in inner and len(inner) < 100 and not re.search(r"[.!?]\s", inner):
            return "sentence"
        return None
    if re.search(r"[�]$|&#?\w{0,8};?$|\\u?[0-9a-fA-F]{0,4}$|<[^<>]{0,12}$", body):
        return "remnant"
    if re.search(r"\d$", bare):
        return "number"
    return "word" if text[-1].isalnum() else "sentence"


def _reference_cut(entries: list[str]) -> str | None:
    """Whether the last reference ends as references do."""
    entries = [e.strip() for e in entries if e.strip()]
    if not entries:
        return "sentence"
    last = entries[-1]
    shaped = [bool(REFERENCE_SHAPE.search(e)) for e in entries[:-1]]
    if REFERENCE_SHAPE.search(last):
        return None
    if any(shaped) or not last.endswith(".") or re.search(r"(?:\b[A-ZÀ-Þ]\.|\(\d{4}\)\.)$", last) or len(last) < 40:
        return "reference"
    return None if REFERENCE_END.search(last) else "reference"


def tail(text: Column) -> Column:
    """The last two blocks of a text, which is what an ending is told by; blank lines part blocks."""
    body = F.regexp_replace(text, r"\s+$", "")
    blocks = F.split(body, r"\n[ \t\r]*\n", -1)
    last = F.array_join(F.slice(blocks, F.greatest(F.lit(1), F.size(blocks) - 1), F.lit(2)), "\n\n")
    return F.concat(last, F.substring(text, F.length(body) + 1, F.length(text)))


@F.pandas_udf(T.StringType())
def ending_udf(texts: pd.Series, at_limit: pd.Series) -> pd.Series:
    return pd.Series([ending(t, bool(a)) for t, a in zip(texts.where(texts.notna(), None), at_limit)], dtype=object)


def inspect(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, way, at_limit, reason): every document; ``reason`` is null where it is whole.

    The table of limits has one row per source that shows a limit; it is broadcast only while its
    counted rows stay within ``BROADCAST_SOURCES``.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    found = cut(limits(slim, "_source", "_text").drop("at_limit"))
    joined = slim.join(small_side(found, found.count(), BROADCAST_SOURCES), F.col("_source").eqNullSafe(F.col("source")), "left")
    w = ways("_text")
    own = F.coalesce(*(F.when(F.col("way") == n, w[n]) for n in WAYS))  # only the source's own way is counted again
    at = F.coalesce(own >= F.col("limit") - F.col("slack"), F.lit(False))
    full = F.coalesce(own == F.col("limit"), F.lit(False)) & F.col("_text").rlike(r"\S")
    d = joined.select(F.col("_key").alias(key), F.col("_source").alias("source"), "way", "limit", at.alias("at_limit"), full.alias("_full"), tail(F.col("_text")).alias("_tail"))
    d = d.withColumn("reason", ending_udf("_tail", "at_limit"))
    return d.select(key, "source", "way", "limit", "at_limit", F.coalesce("reason", F.when(F.col("_full"), F.lit("limit"))).alias("reason"))


def rates(inspected: DataFrame) -> DataFrame:
    """Per source: documents, cut ones, the rate, and the hidden limit where one shows."""
    return inspected.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("reason").alias("cut"),
        (F.count("reason") / F.count(F.lit(1))).alias("rate"),
        F.max("way").alias("way"),
        F.max("limit").alias("field_limit"),
        F.count_if("at_limit").alias("at_limit"),
    )
