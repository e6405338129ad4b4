"""Finding reported results: pattern families with exact offsets, spans, groups and alignment.

Matching runs over Arrow batches, as offsets and overlapping families are beyond native regex
functions; a native generator without offsets is given beside it for plans that must stay in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.functions import numbers
from loomtally.functions import rules as R

_N = r"-?\d*\.?\d+"
_TAIL = rf"\s*([=<>])\s*({_N})\s*,\s*p\s*([=<>])\s*({_N})"
# How each family writes its name and its degrees of freedom.
FAMILIES = {
    "t": rf"\bt\s*\(\s*(?P<df1>{_N})\s*\)",
    "f": rf"\bF\s*\(\s*(?P<df1>{_N})\s*,\s*(?P<df2>{_N})\s*\)",
    "r": rf"\br\s*\(\s*(?P<df1>{_N})\s*\)",
    "z": r"\bz",
    "chi2": rf"\b(?:χ\s*2|χ2|chi2|X2|c2)\s*\(\s*(?P<df1>{_N})(?:\s*,\s*N\s*[=<>]\s*(?P<n>[\d,]+))?\s*\)",
    "q": rf"\bQ(?:w|b)?\s*\(\s*(?P<df1>{_N})\s*\)",
}
_COMPILED = [(name, re.compile(head + _TAIL, re.I)) for name, head in FAMILIES.items()]

EXTRACTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("test_type", "statistic", "df1", "df2", "n", "p_operator", "p_value")]
    + [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("raw", T.StringType())]
)


def extract(text: str | None) -> list[dict]:
    """Results a pattern can read, by place; one inside another (or on the same span) is dropped."""
    hits = []
    for name, pattern in _COMPILED:
        for m in pattern.finditer(text or ""):
            parts = m.groupdict()
            _, stat, op, p = m.groups()[-4:]
            hits.append({
                "test_type": name, "statistic": stat, "df1": parts.get("df1"), "df2": parts.get("df2"), "n": parts.get("n"),
                "p_operator": op, "p_value": p, "start": m.start(), "end": m.end(), "raw": m.group(),
            })
    hits.sort(key=lambda h: (h["start"], h["end"]))
    spans = [(h["start"], h["end"]) for h in hits]

    def covered(k: int) -> bool:
        a, b = spans[k]
        return any(x <= a and b <= y for j, (x, y) in enumerate(spans) if j != k)

    return [h for k, h in enumerate(hits) if not covered(k)]


@F.pandas_udf(T.ArrayType(EXTRACTION))
def extract_udf(texts: pd.Series) -> pd.Series:
    return texts.map(extract)


@F.pandas_udf(T.ArrayType(T.ArrayType(EXTRACTION)))
def extract_each_udf(texts: pd.Series) -> pd.Series:
    """Results of every text of an array, so that a document stays one row."""
    return texts.map(lambda ts: [extract(t) for t in ts] if ts is not None else None)


def iter_extractions(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per extraction, with its place in the text's list."""
    return df.select("*", F.posexplode(extract_udf(text)).alias("seq", "extraction"))


def _java(pattern: str) -> str:
    p = re.sub(r"\(\?P<\w+>", "(", pattern)
    p = p.replace(r"\b", r"(?<![\p{L}\p{N}_])").replace(r"\s", f"[{R.SPACE}]").replace(r"\d", r"\p{Nd}")
    return "(?iu)" + p


def may_hold(text: Column) -> Column:
    """Native guard: false only for texts that no family can match, as all end in the same way."""
    return F.coalesce(text.rlike(_java(_TAIL)), F.lit(False))


def extract_native(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per match of a family, as (…, raw, test_type, df1, df2, n, statistic, p_operator, p_value),
    JVM-side and in one scan: the matches of all families are one array, exploded once."""
    def matches(family: str, head: str) -> Column:
        groups = re.findall(r"\?P<(\w+)>", head)
        pattern = _java(head + _TAIL)
        at = {g: i + 1 for i, g in enumerate([*groups, None, "statistic", "p_operator", "p_value"])}

        def parts(raw: Column) -> Column:
            get = lambda g: F.nullif(F.regexp_extract(raw, pattern, at[g]), F.lit("")) if g in at else F.lit(None).cast("string")
            return F.struct(raw.alias("raw"), F.lit(family).alias("test_type"), *(get(g).alias(g) for g in ("df1", "df2", "n", "statistic", "p_operator", "p_value")))

        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), parts)

    found = [matches(*x) for x in FAMILIES.items()]
    return df.select(*df.columns, F.explode(F.concat(*found)).alias("_m")).select(*df.columns, "_m.*")


# ---- tags, spans, groups ------------------------------------------------------------------------

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType())])


def spans_of_tags(tags: list[str]) -> list[tuple[int, int, str]]:
    """Islands of a tag sequence; a stray inside or end tag opens an island that goes on as others do."""
    out, start, name = [], 0, None
    for i, tag in enumerate([*tags, "O"]):
        prefix, _, entity = tag.partition("-")
        if name is not None and entity == name and prefix in ("I", "E"):
            if prefix == "E":
                out.append((start, i + 1, name))
                name = None
            continue
        if name is not None:
            out.append((start, i, name))
        start, name = i, entity or None
        if prefix == "S":
            out.append((i, i + 1, entity))
            name = None
    return out


def tags_of_spans(length: int, spans: list[tuple[int, int, str]]) -> list[str]:
    """One tag per character; a later span writes over an earlier one, unknown or empty ones do nothing."""
    tags = ["O"] * length
    for start, end, entity in spans:
        start, end = max(0, start), min(length, end)
        if entity not in R.ENTITIES or end <= start:
            continue
        tags[start:end] = [f"I-{entity}"] * (end - start)
        tags[start], tags[end - 1] = f"B-{entity}", f"E-{entity}"
        if end - start == 1:
            tags[start] = f"S-{entity}"
    return tags


@F.pandas_udf(T.ArrayType(SPAN))
def spans_udf(tags: pd.Series) -> pd.Series:
    return tags.map(lambda t: [{"start": a, "end": b, "entity": e} for a, b, e in spans_of_tags(list(t))] if t is not None else None)


def overlaps(spans: Column) -> Column:
    """Neighbours of the sorted spans that overlap, as pairs."""
    s = F.array_sort(spans)
    pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("a"), F.element_at(s, i + 1).alias("b")))
    return F.when(F.size(s) < 2, F.array().cast("array<struct<a:struct<start:int,end:int,entity:string>,b:struct<start:int,end:int,entity:string>>>")).otherwise(
        F.filter(pairs, lambda p: p["b"]["start"] < p["a"]["end"])
    )


def grouped(text: Column, spans: Column) -> Column:
    """Array of maps label -> text, one per result: a TEST span, or a second STAT, opens a new one."""
    s = F.array_sort(spans)
    empty = F.array().cast("array<map<string,string>>")
    start = F.struct(empty.alias("done"), F.create_map().cast("map<string,string>").alias("open"))

    def step(a: Column, x: Column) -> Column:
        opens = (x["entity"] == "TEST") | ((x["entity"] == "STAT") & F.map_contains_key(a["open"], F.lit("STAT")))
        done = F.when(opens & (F.size(a["open"]) > 0), F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        base = F.when(opens, F.create_map().cast("map<string,string>")).otherwise(a["open"])
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        grown = F.when(F.map_contains_key(base, x["entity"]), base).otherwise(F.map_concat(base, F.map_from_arrays(F.array(x["entity"]), F.array(value))))
        return F.struct(done.alias("done"), grown.alias("open"))

    return F.aggregate(s, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def built(parts: Column) -> Column:
    """Typed result of one group of parts; null without a readable statistic."""
    get = lambda k: F.try_element_at(parts, F.lit(k))
    labels = F.map_keys(parts)
    first = F.try_element_at(F.filter(labels, lambda k: k.startswith("POP_")), F.lit(1))
    op = F.when(first == "POP_EQ", F.lit("=")).when(first == "POP_LT", F.lit("<")).when(first == "POP_GT", F.lit(">"))
    stat = numbers.as_number(get("STAT"))
    name = F.nullif(F.lower(F.trim(get("TEST"))), F.lit(""))
    return F.when(
        stat.isNotNull(),
        F.struct(name.alias("test_type"), stat.alias("statistic"), numbers.as_number(get("DF1")).alias("df1"), numbers.as_number(get("DF2")).alias("df2"), op.alias("p_operator"), numbers.as_number(get("PVAL")).alias("p_value"), get("PVAL").alias("p_text")),
    )


# ---- alignment ----------------------------------------------------------------------------------

def squeezed(text: str) -> tuple[str, list[int]]:
    """The text without white space, and where each of its characters stands."""
    at = [i for i, c in enumerate(text) if not c.isspace()]
    return "".join(text[i] for i in at), at


def locate(flat: str, at: list[int], needle: str, lo: int = 0, hi: int | None = None) -> tuple[int, int, int, int] | None:
    """(start, end) in the text and (start, end) in its squeezed form of a needle, white space aside."""
    n = "".join(needle.split())
    k = flat.find(n, lo, len(flat) if hi is None else hi) if n else -1
    return None if k < 0 else (at[k], at[k + len(n) - 1] + 1, k, k + len(n))


def aligned(text: str | None, result: dict) -> dict | None:
    """Block span and part spans of a result: each part is sought after the one before, else anywhere."""
    if not text or not result.get("quote"):
        return None
    flat, at = squeezed(text)
    block = locate(flat, at, result["quote"])
    if block is None:
        return None
    parts, after = {}, block[2]
    for field, label in R.PART_OF_FIELD:
        value = result.get(field)
        if not value:
            continue
        hit = locate(flat, at, value, after, block[3]) or locate(flat, at, value, block[2], block[3])
        if hit:
            parts[label] = [hit[0], hit[1]]
            after = hit[3]
    return {"block_span": [block[0], block[1]], "part_spans": parts}


ALIGNED = T.StructType([T.StructField("block_span", T.ArrayType(T.IntegerType())), T.StructField("part_spans", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])


@F.pandas_udf(T.ArrayType(ALIGNED))
def align_udf(texts: pd.Series, results: pd.Series) -> pd.Series:
    """Alignment of every result of a text; null where its quote is not found."""
    return pd.Series([None if r is None else [aligned(t, dict(x)) for x in r] for t, r in zip(texts, results)])


def holds_numbers(flat: Column, result: Column, reach: int = 160) -> Column:
    """Whether all numbers of a result stand within ``reach`` characters after one place of the first.

    ``flat`` is text with white space folded. Native: the text is cut at the first number's places.
    """
    parts = F.filter(F.array(*(F.trim(F.regexp_replace(result[f], "^[<>=]+", "")) for f in ("df1", "df2", "statistic", "p_value"))), lambda x: x.isNotNull() & (x != ""))
    first = F.try_element_at(parts, F.lit(1))
    # starts of the first number, found by the lengths of the pieces between them
    pieces = F.split(flat, F.concat(F.lit("\\Q"), first, F.lit("\\E")), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * F.length(first))
    hit = F.exists(ends, lambda at: F.forall(parts, lambda p: F.contains(F.substring(flat, at + F.lit(1), F.lit(reach)), p)))
    return F.coalesce(F.when(F.size(parts) == 0, F.lit(False)).when(F.size(pieces) < 2, F.lit(False)).otherwise(hit), F.lit(False))
