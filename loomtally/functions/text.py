"""Native column builders for text: lines, density, references, windows, damage, pools.

Nothing here leaves the JVM; every builder takes and gives columns, so whole chains stay in one
projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtally.functions import rules as R

_S = f"[{R.SPACE}]"


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns computed once: a one-row generator keeps the optimizer from copying
    their expressions into every place (and every lambda) that uses them."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    one = F.explode(F.array(F.struct(*(e.alias(n) for n, e in columns.items()))))
    return df.select(*(F.col(c) for c in df.columns), one.alias("_held")).select(*kept, *(F.col(f"_held.{n}").alias(n) for n in columns))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def reflow(text: Column) -> Column:
    """Lines beyond the trigger are cut at the last blank before the target width, else at it.

    A match holds only while more than the trigger remains, so the cuts of a line happen in one pass.
    """
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    least, most = R.TARGET_WIDTH // 2, R.TARGET_WIDTH
    piece = rf"(?s)\G(?=.{{{R.REFLOW_TRIGGER + 1},}})(.{{{least},{most - 1}}}(?= )|.{{{most}}}){_S}*"
    cut = F.transform(lines(unix), lambda x: F.when(F.length(x) > R.REFLOW_TRIGGER, F.regexp_replace(x, piece, "$1\n")).otherwise(x))
    return F.array_join(cut, "\n")


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars)))


_SITE = rf"(?<=[)\]a-zA-Z0-9]){_S}*([^{R.SPACE}]){_S}*(?=[-.−]?\p{{Nd}})"


def damaged_operators(text: Column) -> Column:
    """Unknown characters at operator sites, busiest first, then by code point."""
    sites = F.array_distinct(F.regexp_extract_all(text, F.lit(_SITE), F.lit(1)))
    known = f"[{_class(R.KNOWN + R.PROTECTED + R.TEXT_CHARACTERS + R.SLOTS)}]"
    odd = F.filter(sites, lambda c: ~c.rlike(known))
    ranked = F.array_sort(F.transform(odd, lambda c: F.struct(-F.regexp_count(text, F.concat(F.lit("\\Q"), c, F.lit("\\E"))).alias("n"), c.alias("c"))))
    return F.transform(ranked, lambda x: x["c"])


def with_normalised(df: DataFrame, body: str, into: str, renamed: str = "_renamed") -> DataFrame:
    """``df`` with the normalised text and the renaming that was done.

    Steps are columns of their own, as each is used several times by the next.
    """
    df = hold(df, _flow=reflow(F.col(body)))
    plain = ~F.col("_flow").rlike(r"[^\x20-\x7e\n\t\r]")  # such texts hold known characters only
    df = hold(df, _odd=F.when(plain, F.array().cast("array<string>")).otherwise(damaged_operators(F.col("_flow"))))
    free = F.filter(F.array(*map(F.lit, R.SLOTS)), lambda s: ~F.contains(F.col("_flow"), s))
    df = hold(df, _free=F.when(F.size("_odd") > 0, free).otherwise(F.array().cast("array<string>")))
    n = F.least(F.size("_odd"), F.size("_free"))
    df = hold(df, _from=F.slice("_odd", F.lit(1), n), _to=F.slice("_free", F.lit(1), n))
    fixed = F.when(F.size("_from") > 0, F.call_function("translate", F.col("_flow"), F.array_join("_from", ""), F.array_join("_to", ""))).otherwise(F.col("_flow"))
    return hold(df, **{into: fixed, renamed: F.map_from_arrays("_from", "_to")}).drop("_flow", "_odd", "_free", "_from", "_to")


def fold_spaces(text: Column) -> Column:
    """Every space separator as a plain blank; lengths stay."""
    return F.regexp_replace(text, r"\p{Zs}", " ")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, _S, "")


def flatten(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{_S}+", " "), "^ | $", "")


def density(line: Column) -> Column:
    """Share of characters that are not letters; 0 for an empty line."""
    n = F.length(line)
    return F.when(n == 0, F.lit(0.0)).otherwise(1 - F.length(F.regexp_replace(line, r"[^\p{L}]", "")) / n)


def keeps_line(line: Column) -> Column:
    return (F.length(line) >= R.MIN_LINE) & line.rlike("[0-9]") & (density(line) >= R.MIN_DENSITY)


def is_reference(line: Column) -> Column:
    return (F.length(line) <= R.MAX_REFERENCE) & line.rlike(R.REFERENCE_LINE)


def _reference_cut(ls: Column) -> Column:
    first = F.floor(F.size(ls) * F.lit(R.REFERENCE_TAIL)).cast("int")
    heads = F.filter(F.transform(ls, lambda x, i: F.when((i >= first) & x.rlike(R.REFERENCE_HEADING), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(heads), F.size(ls))


def with_stripped(df: DataFrame, body: str, into: str, count: str) -> DataFrame:
    """``df`` with its lines, references blanked so that every line keeps its number, and their count."""
    df = hold(df, _raw=lines(F.col(body)))
    df = hold(df, _cut=_reference_cut(F.col("_raw")))
    blank = F.transform("_raw", lambda x, i: F.when((i >= F.col("_cut")) | is_reference(x), F.lit("")).otherwise(x))
    return hold(df, **{into: blank, count: F.size("_raw")}).drop("_raw", "_cut")


def with_dropped(df: DataFrame, body: str, into: str) -> DataFrame:
    """The sampler's form: the tail is dropped, single references of any length are blanked."""
    odd = "|".join(f"(?:{p})" if i != 2 else f"(?iu:{p})" for i, p in enumerate(R.REFERENCE_LINES)).replace("[S]", _S)
    df = hold(df, _raw=lines(F.col(body)))
    df = hold(df, _kept=F.slice("_raw", F.lit(1), _reference_cut(F.col("_raw"))))
    return hold(df, **{into: F.transform("_kept", lambda x: F.when(x.rlike(odd), F.lit("")).otherwise(x))}).drop("_raw", "_kept")


def with_grown_windows(df: DataFrame, body: str, into: str = "windows", count: str = "lines") -> DataFrame:
    """``df`` with an array of (text, line, start_line, end_line): a window around every kept line.

    References are blanked first. A window takes as many lines to each side as bring it to the target
    size, two at least and eight at most.
    """
    df = with_stripped(df, body, "_ls", count)
    kept = F.filter(F.transform("_ls", lambda x, i: F.when(keeps_line(x), i)), lambda i: i.isNotNull())
    df = hold(df, _kept=kept, _sizes=F.transform("_ls", lambda x: F.length(x) + 1))
    n = F.size("_ls")

    def low(i: Column, k: Column) -> Column:
        return F.greatest(F.lit(0), i - k)

    def high(i: Column, k: Column) -> Column:
        return F.least(n, i + k + 1)

    def held(i: Column, k: Column) -> Column:
        part = F.slice(F.col("_sizes"), low(i, k) + 1, high(i, k) - low(i, k))
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def reach(i: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(R.CONTEXT_LINES), F.lit(R.MAX_CONTEXT)), lambda k: held(i, k) >= R.TARGET_CHARS)
        return F.coalesce(F.try_element_at(steps, F.lit(1)), F.lit(R.MAX_CONTEXT))

    def window(w: Column) -> Column:
        a, b = low(w["i"], w["k"]), high(w["i"], w["k"])
        text = F.array_join(F.slice(F.col("_ls"), a + 1, b - a), "\n")
        return F.struct(text.alias("text"), w["i"].alias("line"), a.alias("start_line"), (b - 1).alias("end_line"))

    df = hold(df, _reach=F.transform("_kept", lambda i: F.struct(i.alias("i"), reach(i).alias("k"))))
    return hold(df, **{into: F.transform("_reach", window)}).drop("_ls", "_kept", "_sizes", "_reach")


def fixed_windows(ls: Column, around: int = R.CONTEXT_LINES) -> Column:
    """The sampler's windows: two lines to each side of every line of twenty characters or more."""
    n = F.size(ls)

    def window(i: Column) -> Column:
        a = F.greatest(F.lit(0), i - around)
        b = F.least(n, i + around + 1)
        return F.struct(F.array_join(F.slice(ls, a + 1, b - a), "\n").alias("text"), F.element_at(ls, i + 1).alias("at"), i.alias("line"))

    kept = F.filter(F.transform(ls, lambda x, i: F.when(F.length(x) >= R.MIN_LINE, i)), lambda i: i.isNotNull())
    return F.transform(kept, window)


def window_spans(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, start, end): where in the text the grown window around each kept line stands.

    Offsets are running sums over the table of lines, so a long text is no square of its lines. A window's
    text differs from that stretch only where references in it were blanked.
    """
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    n = df.select(key, F.posexplode(lines(F.col(body))).alias("i", "value")).select(key, "i", F.length("value").alias("n"))
    at = n.withColumn("at", F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0)))
    grown = with_grown_windows(df.select(key, body), body).select(key, F.explode("windows").alias("w"))
    grown = grown.select(key, "w.line", F.col("w.start_line").alias("_a"), F.col("w.end_line").alias("_b"))
    first = at.select(key, F.col("i").alias("_a"), F.col("at").alias("start"))
    last = at.select(key, F.col("i").alias("_b"), (F.col("at") + F.col("n")).alias("end"))
    return grown.join(first, [key, "_a"]).join(last, [key, "_b"]).select(key, "line", "start", "end")


# What the sampler's pools look for.
_EDGE = r"(?<![\p{L}\p{N}_])"
SAMPLE_STAT = (
    rf"(?iu){_EDGE}(?:t|F|r|z|Q|Qw|Qb|chi2|c2|X2|χ2){_S}*\({_S}*[0-9]+(?:{_S}*,{_S}*[0-9.]+)?"
    rf"(?:{_S}*,{_S}*N{_S}*={_S}*[0-9]+)?{_S}*\){_S}*[=<>]{_S}*-?[0-9]*\.?[0-9]+"
)
SAMPLE_STAT_N = rf"(?iu)\({_S}*[0-9]+{_S}*,{_S}*N{_S}*[=<>]{_S}*[0-9, ]+\)"
SAMPLE_P = rf"(?iu){_EDGE}p{_S}*[=<>]{_S}*\.?[0-9]"
SAMPLE_TESTISH = rf"{_EDGE}(?:t|F|r|z|Z|Q|chi2|χ2|M|SD|OR|CI){_S}*[\(=]{_S}*[-.0-9]"


def pool(line: Column, window: Column) -> Column:
    """Sampling pool of a line: A, AN, B1, B2, C, or null."""
    dense = (density(line) >= R.MIN_DENSITY) & line.rlike("[0-9]")
    flat = flatten(window)
    return (
        F.when(~dense, F.lit("C"))
        .when(line.rlike(SAMPLE_STAT), F.when(line.rlike(SAMPLE_STAT_N), F.lit("AN")).otherwise(F.lit("A")))
        .when(line.rlike(f"[{R.CONTROL_SAMPLER}]") & line.rlike(SAMPLE_TESTISH), F.lit("B2"))
        .when(flat.rlike(SAMPLE_P) & ~flat.rlike(SAMPLE_STAT), F.lit("B1"))
        .when(line.rlike(SAMPLE_TESTISH), F.lit("B2"))
    )


def damage_family(quote: Column) -> Column:
    """Name of the first family of damage a quote shows."""
    q = F.coalesce(quote, F.lit(""))
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in R.DAMAGE_FAMILIES:
        out = out.when(q.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("other damage"))


def character_ids(text: Column, known: Column) -> Column:
    """Ids of the characters by a map column; 1 for characters it lacks."""
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(known, c), F.lit(1)))


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether a text holds a quote, white space aside."""
    return F.coalesce(F.contains(squeeze(text), squeeze(quote)) & (squeeze(quote) != ""), F.lit(False))
