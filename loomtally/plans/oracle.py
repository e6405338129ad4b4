"""SQL of the core's queries, for an engine that reads the same tables (DuckDB's dialect)."""

from __future__ import annotations

from loomtally.functions import rules as R
from loomtally.operators.evaluate import GROUPS, POISSON

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUM = r"-?\p{Nd}*\.?\p{Nd}+"
TAIL = rf"{WS}*([=<>]){WS}*({NUM}){WS}*,{WS}*p{WS}*([=<>]){WS}*({NUM})"

LINES = """
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS value,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents),
"""
DENSITY = r"CASE WHEN length(value) = 0 THEN 0.0 ELSE 1 - length(regexp_replace(value, '[^\p{L}]', '', 'g')) / length(value)::DOUBLE END"
KEEPS = rf"length(value) >= 20 AND regexp_matches(value, '[0-9]') AND ({DENSITY}) >= 0.2"
_B = r"(?:^|[^\p{L}\p{N}_])"
REFERENCE = "|".join(
    f"(?:{p})"
    for p in (
        rf"\({WS}*(?:19|20)\p{{Nd}}\p{{Nd}}[a-z]?{WS}*\)",
        rf"{_B}\p{{Nd}}+{WS}*\({WS}*\p{{Nd}}+{WS}*\){WS}*,{WS}*\p{{Nd}}+{WS}*[-–]{WS}*\p{{Nd}}+",
        rf"{_B}(?:doi:|https?://|dx\.doi\.org)",
        rf"{_B}[A-Z]\.{WS}*,?{WS}*[A-Z]\.",
        rf",{WS}*\p{{Nd}}+{WS}*[-–]{WS}*\p{{Nd}}+{WS}*\.{WS}*$",
    )
)
IS_REFERENCE = f"(length(value) <= 300 AND regexp_matches(value, '{REFERENCE}'))"
HEADING = rf"(?i)^{WS}*(?:references|bibliography|works cited|literature cited){WS}*$"


def _stripped(lines: str) -> str:
    """Lines with references blanked, as CTEs after those that give ``lines``."""
    return f"""{lines}
heads AS (
  SELECT doc_id, count(*) AS n, min(CASE WHEN regexp_matches(value, '{HEADING}') THEN line END) AS any_head
  FROM lines GROUP BY doc_id),
cuts AS (
  SELECT l.doc_id, max(h.n) AS n, coalesce(min(CASE WHEN l.line >= floor(h.n * 0.55) AND regexp_matches(l.value, '{HEADING}') THEN l.line END), max(h.n)) AS cut
  FROM lines l JOIN heads h USING (doc_id) GROUP BY l.doc_id),
ls AS (
  SELECT doc_id, line, n, CASE WHEN line >= cut OR {IS_REFERENCE} THEN '' ELSE value END AS value
  FROM lines JOIN cuts USING (doc_id))
"""


STRIPPED = "\nWITH " + _stripped(LINES)


def _mark(x: str, regex: str) -> str:
    return f"regexp_matches({x}, '{regex}')"


FAMILY_HEADS = {
    "t": (rf"t{WS}*\({WS}*({NUM}){WS}*\)", ("df1",)),
    "f": (rf"F{WS}*\({WS}*({NUM}){WS}*,{WS}*({NUM}){WS}*\)", ("df1", "df2")),
    "r": (rf"r{WS}*\({WS}*({NUM}){WS}*\)", ("df1",)),
    "z": ("z", ()),
    "chi2": (rf"(?:[χΧ]{WS}*2|chi2|X2|c2){WS}*\({WS}*({NUM})(?:{WS}*,{WS}*N{WS}*[=<>]{WS}*([\p{{Nd}},]+))?{WS}*\)", ("df1", "n")),
    "q": (rf"Q(?:w|b)?{WS}*\({WS}*({NUM}){WS}*\)", ("df1",)),
}


def _extract() -> str:
    parts = []
    for name, (head, groups) in FAMILY_HEADS.items():
        body = f"(?i){head}{TAIL}"
        whole = f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({head}{TAIL})"
        k = len(groups)
        col = {g: f"nullif(regexp_extract(raw, '{body}', {i + 1}), '')" for i, g in enumerate(groups)}
        parts.append(
            f"SELECT record_id, raw, '{name}' AS test_type, {col.get('df1', 'NULL')} AS df1, {col.get('df2', 'NULL')} AS df2, {col.get('n', 'NULL')} AS n,"
            f" regexp_extract(raw, '{body}', {k + 2}) AS statistic, regexp_extract(raw, '{body}', {k + 3}) AS p_operator, regexp_extract(raw, '{body}', {k + 4}) AS p_value"
            f" FROM (SELECT record_id, unnest(regexp_extract_all(text, '{whole}', 1)) AS raw FROM holdout)"
        )
    return "\nUNION ALL\n".join(parts)


FAMILIES = (
    ("decimal point lost", r"=\s*\d{3,}\s*,\s*p\s*[<>=]\s*\d{3,}"),
    ("control character", r"[\x01-\x08\x0b\x0c\x0e-\x1f]"),
    ("fraction sign for =", "¼"),
    ("backslash for <", r"\\"),
    ("letter b for <", r"\)\s*b\s*[-.0-9]|\bp\s*b\s*\.?[0-9]"),
    ("letter N for >", r"\bp\s*N\s*\.?[0-9]"),
    ("chi-square symbol lost", r"\b(v2|c2|x2)\s*\(|(?:^|[^0-9A-Za-z])2\s*\(\s*\d"),
    ("letter p or ! for operator", r"\)\s*p\s*[-.0-9]|\bp\s*!\s*\.?[0-9]"),
)


def _family(q: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({q}, ''), '{p}') THEN '{n}'" for n, p in FAMILIES) + " ELSE 'other damage' END"


_NUMERIC = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"


def _double(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NUMERIC}') THEN try_cast({x} AS DOUBLE) END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _thousands(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^[0-9]{{1,3}}(,[0-9]{{3}})+(\.|$)') THEN replace({x}, ',', '') ELSE {x} END"


def _clean(x: str) -> str:
    body = _strip(f"regexp_replace({x}, '^[-−–]', '')")
    neg = _double(_thousands(body))
    pos = _double(_thousands(x))
    return f"CASE WHEN regexp_matches({x}, '^[-−–]') THEN -({neg}) ELSE {pos} END"


def _as_number(x: str) -> str:
    t = _strip(x)
    bare = _strip(rf"regexp_replace({t}, '^[\x00-\x1f]|[\x00-\x1f]$', '', 'g')")
    return f"round(coalesce({_clean(t)}, CASE WHEN {bare} <> {t} THEN abs({_clean(bare)}) END), 4) + 0.0::DOUBLE"


GOLD = f"""
res AS (
  SELECT record_id, window_id, source_doc, r, seq FROM (
    SELECT record_id, window_id, source_doc, unnest(results) AS r, generate_subscripts(results, 1) AS seq FROM holdout)),
gold AS (
  SELECT window_id, value, coalesce(r.damaged, false) AS damaged, lower(coalesce(r.test_type, '')) AS test_type,
    coalesce(r.checkable, false) AS checkable, CASE WHEN coalesce(r.damaged, false) THEN {_family('r.quote')} END AS family, r.tier AS tier
  FROM (SELECT *, {_as_number('r.statistic')} AS value FROM res) WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY window_id, value ORDER BY record_id, seq) = 1),
found AS (SELECT DISTINCT window_id, round(test_value, 4) AS value FROM statcheck_repaired),
fact AS (
  SELECT coalesce(g.window_id, f.window_id) AS window_id, coalesce(g.value, f.value) AS value, g.window_id IS NOT NULL AS in_gold,
    f.window_id IS NOT NULL AS in_found, damaged, test_type, checkable, family
  FROM gold g FULL JOIN found f ON g.window_id = f.window_id AND g.value = f.value)
"""
_RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS p,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS r,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1"""

SPANS = """
parts AS (
  SELECT record_id, seq, CASE WHEN part = 'POP' THEN CASE op WHEN '=' THEN 'POP_EQ' WHEN '<' THEN 'POP_LT' WHEN '>' THEN 'POP_GT' END ELSE part END AS entity, span[1] AS "start", span[2] AS "end"
  FROM (SELECT record_id, seq, r.p_operator AS op, unnest(map_keys(r.part_spans)) AS part, unnest(map_values(r.part_spans)) AS span
        FROM (SELECT record_id, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout))
  WHERE span IS NOT NULL),
spans AS (SELECT * FROM parts WHERE entity IN ('TEST','STAT','DF1','DF2','N','PVAL','POP_EQ','POP_LT','POP_GT')),
blocks AS (
  SELECT record_id, seq, r.block_span[1] AS "start", r.block_span[2] AS "end"
  FROM (SELECT record_id, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout) WHERE r.block_span IS NOT NULL),
hulls AS (SELECT record_id, seq, min("start") AS "start", max("end") AS "end" FROM spans GROUP BY ALL)
"""

RATINGS = r"""
named AS (
  SELECT dispute_id AS item, decision.keep AS label, decision_id,
    regexp_replace(regexp_replace(lower(trim(decision.provenance.rater)), '[^a-z0-9]+', '', 'g'), '^([a-z]+)0*', '\1') AS rater,
    CAST(decision.provenance.collected_at AS TIMESTAMPTZ) AS t
  FROM disputes WHERE decision.keep IS NOT NULL),
ratings AS (
  SELECT item, rater, label FROM named QUALIFY row_number() OVER (PARTITION BY item, rater ORDER BY t DESC NULLS LAST, decision_id DESC) = 1)
"""

CHI = r"""
x AS (
  SELECT l_orderkey, l_linenumber, 2 * (1 + l_partkey % 20) AS df, (50 + (l_orderkey * 37 + l_linenumber * 11) % 2500) / 100.0::DOUBLE AS stat, ((l_suppkey * 13) % 1000) / 1000.0::DOUBLE AS p
  FROM lineitem),
tails AS (
  SELECT l_orderkey, l_linenumber, stat, p, df,
    exp(-stat / 2) * (SELECT sum(exp(k * ln(stat / 2) - lgamma(k + 1))) FROM range(df // 2) t(k)) AS c0,
    exp(-(stat + 0.005) / 2) * (SELECT sum(exp(k * ln((stat + 0.005) / 2) - lgamma(k + 1))) FROM range(df // 2) t(k)) AS lo0,
    exp(-(stat - 0.005) / 2) * (SELECT sum(exp(k * ln((stat - 0.005) / 2) - lgamma(k + 1))) FROM range(df // 2) t(k)) AS up0
  FROM x)
"""

# ---- normalising: long lines cut again, unknown characters at operator sites renamed -------------

_KNOWN = "".join(c for c in dict.fromkeys(R.KNOWN + R.PROTECTED) if ord(c) > 0x7E).replace("'", "''")
NORMALISED = rf"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS value, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)),
flow AS (
  SELECT doc_id, i, '' AS head, value AS rest FROM raw_lines WHERE length(value) > {R.REFLOW_TRIGGER}
  UNION ALL
  SELECT doc_id, i, head || piece || chr(10), regexp_replace(substr(rest, length(piece) + 1), '^{WS}+', '')
  FROM (SELECT *, coalesce(nullif(regexp_extract(rest, '(?s)^(.{{{R.TARGET_WIDTH // 2},{R.TARGET_WIDTH - 1}}}) ', 1), ''), substr(rest, 1, {R.TARGET_WIDTH})) AS piece FROM flow WHERE length(rest) > {R.REFLOW_TRIGGER})),
flowed AS (
  SELECT doc_id, string_agg(coalesce(d.value, r.value), chr(10) ORDER BY i) AS text
  FROM raw_lines r LEFT JOIN (SELECT doc_id, i, head || rest AS value FROM flow WHERE length(rest) <= {R.REFLOW_TRIGGER}) d USING (doc_id, i) GROUP BY doc_id),
odd AS (
  SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) - length(replace(text, c, '')) DESC, c) AS k
  FROM (SELECT DISTINCT doc_id, text, c FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS c FROM flowed WHERE regexp_matches(text, '[^\x20-\x7e\n\t\r]'))
        WHERE regexp_matches(c, '[^\x00-\x08\x20-\x7e\n\t\r]') AND NOT regexp_matches(c, '{WS}') AND NOT contains('{_KNOWN}', c))
  WHERE regexp_matches(text, '[)\]a-zA-Z0-9]{WS}*' || regexp_escape(c) || '{WS}*[-.−]?\p{{Nd}}')),
slots AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k
  FROM (SELECT doc_id, text, chr(s::INT) AS s FROM flowed JOIN (SELECT DISTINCT doc_id FROM odd) USING (doc_id), range(1, 9) t(s)) WHERE NOT contains(text, s)),
renaming AS (SELECT doc_id, string_agg(c, '' ORDER BY k) AS a, string_agg(s, '' ORDER BY k) AS b, count(*) AS n FROM odd JOIN slots USING (doc_id, k) GROUP BY doc_id),
norm AS (SELECT doc_id, CASE WHEN a IS NULL THEN text ELSE translate(text, a, b) END AS text, coalesce(n, 0) AS renamed FROM flowed LEFT JOIN renaming USING (doc_id)),
"""
_FONT = r"\x00-\x08\x0b\x0c\x0e-\x1f¼\\!"
_AT_STAT = rf"(\){WS}*)([{_FONT}bNp])({WS}*-?\p{{Nd}}*\.?\p{{Nd}})"
_AT_P = rf"((?:^|[^\p{{L}}\p{{N}}_])p{WS}*)([{_FONT}bN])({WS}*)(-?\p{{Nd}}*\.?\p{{Nd}}+)"




def _repaired(source: str, key: str) -> str:
    """CTE mended (key, text, twice, a, b, once): damaged operators put back by where they stand."""
    return f"""sites AS (SELECT {key}, text, regexp_replace(text, '{_AT_STAT}', '\\1=\\3', 'g') AS once, regexp_extract_all(text, '{_AT_STAT}', 2) AS a, regexp_extract_all(text, '{_AT_P}', 2) AS b, regexp_extract_all(text, '{_AT_P}', 4) AS v FROM {source}),
marks AS (SELECT {key}, c, CASE WHEN list_contains(any_value(a), c) OR avg(coalesce(try_cast(translate(v, '０１２３４５６７８９', '0123456789') AS DOUBLE) IN (0.05, 0.01, 0.001, 0.0001, 0.1), false)::INT) < {R.ROUND_SHARE} THEN '=' ELSE '<' END AS op
  FROM (SELECT {key}, unnest(b) AS c, unnest(v) AS v, a FROM sites) GROUP BY 1, 2),
mended AS (
  SELECT s.*, coalesce(list_reduce(list_prepend(once, ops), lambda acc, x: regexp_replace(acc, '((?:^|[^\\p{{L}}\\p{{N}}_])p{WS}*)' || regexp_escape(x[1]) || '({WS}*-?\\p{{Nd}}*\\.?\\p{{Nd}}+)', '\\1' || x[2] || '\\2', 'g')), once) AS twice,
    (len(a) + len(regexp_extract_all(once, '{_AT_P}', 2)))::INT AS replacements
  FROM sites s LEFT JOIN (SELECT {key}, list(c || op) AS ops FROM marks GROUP BY 1) USING ({key}))"""


NORM_LINES = NORMALISED + _repaired("norm", "doc_id") + """,
lines AS (
  SELECT doc_id, unnest(string_split(twice, chr(10))) AS value, generate_subscripts(string_split(twice, chr(10)), 1) - 1 AS line FROM mended),
"""


def _grown(key: str = "doc_id") -> str:
    return f"""docs AS (SELECT {key}, max(n) AS n, list(length(value) + 1 ORDER BY line) AS sizes FROM ls GROUP BY {key}),
kept AS (SELECT {key}, line FROM ls WHERE {KEEPS}),
tried AS (
  SELECT k.{key}, k.line, t.s, greatest(0, k.line - t.s) AS lo, least(d.n, k.line + t.s + 1) AS hi,
    list_sum(d.sizes[greatest(0, k.line - t.s) + 1 : least(d.n, k.line + t.s + 1)]) AS held
  FROM kept k JOIN docs d USING ({key}), range(2, 9) t(s)),
spot AS (SELECT {key}, line, lo, hi FROM tried WHERE held >= 250 OR s = 8 QUALIFY row_number() OVER (PARTITION BY {key}, line ORDER BY s) = 1),
win AS (
  SELECT p.{key}, p.line, string_agg(l.value, chr(10) ORDER BY l.line) AS text
  FROM spot p JOIN ls l ON l.{key} = p.{key} AND l.line >= p.lo AND l.line < p.hi GROUP BY 1, 2),
"""


def _hits(source: str, key: str) -> str:
    """CTEs hits and best: pattern results of texts with their places, those inside another left out."""
    parts = []
    for name, (head, groups) in FAMILY_HEADS.items():
        body, whole = f"(?i){head}{TAIL}", f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({head}{TAIL})"
        k = len(groups)
        col = {g: f"nullif(regexp_extract(raw, '{body}', {i + 1}), '')" for i, g in enumerate(groups)}
        parts.append(
            f"SELECT {key}, '{name}' AS test_type, raw, begin, {col.get('df1', 'NULL')} AS df1, {col.get('df2', 'NULL')} AS df2,"
            f" regexp_extract(raw, '{body}', {k + 2}) AS statistic, regexp_extract(raw, '{body}', {k + 3}) AS p_operator, regexp_extract(raw, '{body}', {k + 4}) AS p_value"
            f" FROM (SELECT {key}, raws[j] AS raw, (list_sum([length(x) FOR x IN pre[1:j]]) + coalesce(list_sum([length(x) FOR x IN wholes[1:j - 1]]), 0) + length(wholes[j]) - length(raws[j]))::BIGINT AS begin"
            f"  FROM (SELECT *, unnest(range(1, len(raws) + 1)) AS j FROM (SELECT {key}, string_split_regex(text, '{whole}') AS pre, regexp_extract_all(text, '{whole}', 0) AS wholes, regexp_extract_all(text, '{whole}', 1) AS raws FROM {source})))"
        )
    union = "\n  UNION ALL ".join(parts)
    pair = " AND ".join(f"o.{c.strip()} = h.{c.strip()}" for c in key.split(","))
    return f"""hits AS (SELECT *, begin + length(raw) AS fin, row_number() OVER () AS id FROM ({union})),
best AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY begin, fin) - 1 AS seq FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE {pair} AND o.id <> h.id AND o.begin <= h.begin AND h.fin <= o.fin))
"""


# ---- tails: the integrals by four-point Gauss rules on 400 panels ---------------------------------

def _integral(f: str, upper: str) -> str:
    """Integral of ``f``, an expression of u, from 0 to ``upper``."""
    nodes = ((0.339981043584856264803, 0.652145154862546142627), (0.861136311594052575224, 0.347854845137453857373))
    terms = [f"{w!r}::DOUBLE * ({f.replace('{u}', f'(({upper}) / 400 * (i + 0.5 + {sign}{x / 2!r}::DOUBLE))')})" for x, w in nodes for sign in ("", "-")]
    return f"(({upper}) / 800 * list_sum(list_transform(range(0, 400), lambda i: {' + '.join(terms)})))"


def _beta(a: str, b: str, x: str) -> str:
    f = f"exp((2 * ({a}) - 1) * ln(sin({{u}})) + (2 * ({b}) - 1) * ln(cos({{u}})) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))"
    return f"(2 * {_integral(f, f'asin(sqrt({x}))')})"


def _erfc(z: str) -> str:
    return f"(1 - 1.1283791670955126::DOUBLE * {_integral('exp(-{u} * {u})', z)})"


def _tails(source: str) -> str:
    """CTE tail (id, v, p): two-tailed p-values of ``source`` (id, v, test, stat, df1, df2)."""
    y = "(greatest(stat, 0) / 2)"
    chi = f"""CASE WHEN {y} = 0 THEN 1 WHEN df1 % 2 = 0 THEN list_sum(list_transform(range(0, (df1 / 2)::BIGINT), lambda j: exp(j * ln({y}) - {y} - lgamma(j + 1))))
  ELSE {_erfc(f'sqrt({y})')} + coalesce(list_sum(list_transform(range(1, ((df1 - 1) / 2)::BIGINT + 1), lambda j: exp((j - 0.5) * ln({y}) - {y} - lgamma(j + 0.5)))), 0) END"""
    square = "CASE test WHEN 't' THEN stat * stat ELSE stat * stat * df1 / (1 - stat * stat) END"
    return f"""tail AS (
  SELECT id, v, CASE WHEN stat IS NULL OR df1 <= 0 OR df2 <= 0 THEN NULL
    WHEN test = 'z' THEN {_erfc('abs(stat) / sqrt(2)')}
    WHEN df1 IS NULL THEN NULL
    WHEN test IN ('t', 'r') THEN CASE WHEN test = 'r' AND abs(stat) >= 1 THEN NULL WHEN sq = 0 THEN 1 ELSE {_beta('df1 / 2', '0.5::DOUBLE', 'df1 / (df1 + sq)')} END
    WHEN test = 'f' THEN CASE WHEN df2 IS NULL THEN NULL WHEN stat <= 0 THEN 1 ELSE {_beta('df2 / 2', 'df1 / 2', 'df2 / (df2 + df1 * stat)')} END
    WHEN test IN ('chi2', 'q') THEN {chi} END AS p
  FROM (SELECT *, CASE WHEN test IN ('t', 'r') THEN {square} END AS sq FROM {source}))"""


def _verdicts(source: str) -> str:
    """CTE judged: the check's columns for ``source`` (id, test, stat, df1, df2, op, p, p_text, stat_text)."""
    places = "length(regexp_extract({0}, '\\.(.*)$', 1))"
    return f"""shifted AS (
  SELECT *, 0.5 / power(10, {places.format("CASE WHEN try_cast(stat_text AS DOUBLE) = stat THEN stat_text ELSE stat::VARCHAR END")}) AS half, CASE WHEN stat >= 0 THEN 1 ELSE -1 END AS sgn FROM {source}),
need AS (SELECT id, v, test, stat + v * sgn * half AS stat, df1, df2 FROM (SELECT *, unnest([0, 1, -1]) AS v FROM shifted)),
{_tails('need')},
three AS (SELECT id, max(p) FILTER (v = 0) AS c, CASE WHEN count(p) FILTER (v <> 0) < 2 THEN max(p) FILTER (v = 0) ELSE max(p) FILTER (v = 1) END AS low, CASE WHEN count(p) FILTER (v <> 0) < 2 THEN max(p) FILTER (v = 0) ELSE max(p) FILTER (v = -1) END AS up FROM tail GROUP BY id),
lost AS (
  SELECT s.*, t.c, t.low, t.up, CASE WHEN op = 'ns' THEN '>' ELSE op END AS sign, CASE WHEN op = 'ns' THEN {R.ALPHA}::DOUBLE ELSE s.p END AS claim,
    list_filter([CASE WHEN coalesce(test, '') = '' THEN 'test_type' END, CASE WHEN stat IS NULL THEN 'statistic' END,
      CASE WHEN df1 IS NULL AND coalesce(test, '') <> 'z' THEN 'df1' END, CASE WHEN df2 IS NULL AND test = 'f' THEN 'df2' END,
      CASE WHEN s.p IS NULL THEN 'p_value' WHEN op IS NULL OR op NOT IN ('=', '<', '>') THEN 'p_operator' END], lambda x: x IS NOT NULL) AS parts
  FROM shifted s JOIN three t USING (id)),
wrong AS (
  SELECT *, CASE WHEN c IS NULL OR claim IS NULL OR sign IS NULL OR sign NOT IN ('=', '<', '>') THEN NULL WHEN claim <= 0 THEN true
    WHEN sign = '=' THEN NOT (round(low, {places.format("coalesce(p_text, claim::VARCHAR)")}::INT) <= claim AND claim <= round(up, {places.format("coalesce(p_text, claim::VARCHAR)")}::INT))
    WHEN sign = '<' THEN claim < low ELSE claim > up END AS bad,
    CASE sign WHEN '=' THEN (claim <= {R.ALPHA}) <> (c <= {R.ALPHA}) WHEN '<' THEN claim <= {R.ALPHA} AND c > {R.ALPHA} WHEN '>' THEN claim >= {R.ALPHA} AND c <= {R.ALPHA} END AS flips FROM lost),
judged AS (
  SELECT *, CASE WHEN bad IS NULL THEN 'undecidable' WHEN NOT bad THEN 'consistent' WHEN flips THEN 'decision_error' ELSE 'inconsistent' END AS verdict,
    CASE WHEN bad IS NULL THEN parts ELSE [] END AS missing,
    CASE WHEN bad IS NULL THEN CASE WHEN len(parts) = 0 THEN CASE WHEN c IS NULL THEN '{R.NO_P}' ELSE '{R.NO_CLAIM}' END
        ELSE CASE WHEN len(parts) > 1 THEN list_aggregate([names[x] FOR x IN parts[1:len(parts) - 1]], 'string_agg', ', ') || ' and ' ELSE '' END || names[parts[len(parts)]] || ' found beside this result' END
      WHEN NOT bad THEN '' WHEN flips THEN '{R.DISAGREE_ALPHA}' ELSE '{R.DISAGREE}' END AS reason
  FROM (SELECT *, MAP {{{', '.join(f"'{k}': '{v}'" for k, v in R.PART_NAMES.items())}}} AS names FROM wrong))
"""


# The whole path, with the repair by place; the search over maps needs three damaged results in a document, which
# the documents do not hold.
ONLINE = f"""
WITH RECURSIVE {_stripped(NORM_LINES)}, {_grown()}{_hits('win', 'doc_id, line')},
read AS (SELECT *, {_double('statistic')} AS stat FROM best),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, seq) AS id0 FROM read QUALIFY row_number() OVER (PARTITION BY doc_id, round(stat, 3) + 0.0::DOUBLE ORDER BY line, seq) = 1),
ask AS (
  SELECT row_number() OVER () AS id, doc_id, line, seq, raw, test_type AS test, stat, {_double('df1')} AS df1, {_double('df2')} AS df2, p_operator AS op, {_double('p_value')} AS p, p_value AS p_text, statistic AS stat_text FROM firsts),
{_verdicts('ask')}"""
BASELINE = f"""
WITH named AS (
  SELECT row_id AS id, lower(trim(test_type)) AS test, round(test_value, 4) AS stat, CASE WHEN lower(trim(test_type)) = 'f' THEN df1 ELSE coalesce(df1, df2) END AS df1,
    CASE WHEN lower(trim(test_type)) = 'f' THEN df2 END AS df2, nullif(trim(p_comp), '') AS op, round(reported_p, 4) AS p,
    [coalesce(list_filter(regexp_extract_all(replace(raw, chr(10), ' '), '\\d*\\.\\d+|\\d+'), lambda x: try_cast(x AS DOUBLE) = v)[1], v::VARCHAR) FOR v IN [reported_p, test_value]] AS texts, error, decision_error
  FROM statcheck_repaired),
ask AS (SELECT *, texts[1] AS p_text, texts[2] AS stat_text FROM named),
{_verdicts('ask')}"""

def _replicates(systems: dict[str, str]) -> str:
    """CTE reps: weighted sums of tp, fp and fn of systems (suffix -> filter of found rows) per replicate."""
    out, columns = [], []
    for k, where in systems.items():
        out.append(f"""found{k} AS (SELECT DISTINCT window_id, round(test_value, 4) AS value FROM statcheck_repaired {where}),
counts{k} AS (
  SELECT coalesce(g.window_id, f.window_id) AS window_id, count(*) FILTER (g.window_id IS NOT NULL AND f.window_id IS NOT NULL) AS tp{k}, count(*) FILTER (g.window_id IS NULL) AS fp{k}, count(*) FILTER (f.window_id IS NULL) AS fn{k}
  FROM gold g FULL JOIN found{k} f ON g.window_id = f.window_id AND g.value = f.value GROUP BY 1)""" if k else f"""counts{k} AS (
  SELECT window_id, count(*) FILTER (in_gold AND in_found) AS tp, count(*) FILTER (NOT in_gold) AS fp, count(*) FILTER (NOT in_found) AS fn FROM fact GROUP BY 1)""")
        columns += [f"{c}{k}" for c in ("tp", "fp", "fn")]
    union = " UNION ALL BY NAME ".join(f"SELECT * FROM counts{k}" for k in systems)
    weight = " + ".join(f"(u >= {x})::INT" for x in POISSON)
    return ",\n".join(out) + f""",
docs AS (SELECT window_id, arg_min(source_doc, record_id) AS source_doc FROM holdout GROUP BY 1),
grouped AS (SELECT substr(md5(coalesce(source_doc, '')), 1, {len(f"{GROUPS - 1:x}")}) AS g, {', '.join(f'sum(coalesce({c}, 0)) AS {c}' for c in columns)} FROM ({union}) LEFT JOIN docs USING (window_id) GROUP BY 1),
drawn AS (SELECT *, {weight} AS w FROM (SELECT *, ('0x' || substr(md5('0|' || rep || '|' || g), 1, 8))::BIGINT AS u FROM grouped, range(2000) t(rep))),
reps AS (SELECT rep, {', '.join(f'sum({c} * w)::DOUBLE AS {c}' for c in columns)} FROM drawn GROUP BY 1)"""


def _rate3(k: str) -> str:
    tp, fp, fn = (f"{c}{k}" for c in ("tp", "fp", "fn"))
    return f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END, CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END, CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END"


# The sampler's patterns in this engine's dialect.
_STAT = rf"(?i){_B}(?:t|F|r|z|Q|Qw|Qb|chi2|c2|X2|χ2){WS}*\({WS}*[0-9]+(?:{WS}*,{WS}*[0-9.]+)?(?:{WS}*,{WS}*N{WS}*={WS}*[0-9]+)?{WS}*\){WS}*[=<>]{WS}*-?[0-9]*\.?[0-9]+"
_STAT_N = rf"(?i)\({WS}*[0-9]+{WS}*,{WS}*N{WS}*[=<>]{WS}*[0-9, ]+\)"
_P = rf"(?i){_B}p{WS}*[=<>]{WS}*\.?[0-9]"
_TESTISH = rf"{_B}(?:t|F|r|z|Z|Q|chi2|χ2|M|SD|OR|CI){WS}*[\(=]{WS}*[-.0-9]"
_SAMPLED = "|".join(f"(?:{p})" for p in (
    rf"\({WS}*(?:19|20)\p{{Nd}}\p{{Nd}}[a-z]?{WS}*\)", rf"{_B}\p{{Nd}}+{WS}*\({WS}*\p{{Nd}}+{WS}*\){WS}*,{WS}*\p{{Nd}}+{WS}*[-–]{WS}*\p{{Nd}}+", rf"(?i:{_B}(?:doi:|https?://|dx\.doi\.org))",
    rf"{_B}[A-Z]\.{WS}*,?{WS}*[A-Z]\.", rf",{WS}*\p{{Nd}}+{WS}*[-–]{WS}*\p{{Nd}}+{WS}*\.{WS}*$",
))

_VOTED = (*R.RESULT_FIELDS[:9], "confidence")


def _consensus(name: str) -> str:
    """CTEs members and judged: results that raters let stand, in clusters of equal magnitude per dispute."""
    numeric = ("statistic", "df1", "df2", "n", "p_value")
    keys = {f: f"n_{f}" if f in numeric else f"regexp_replace(regexp_replace({f}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')" if f == "quote" else f for f in _VOTED}
    votes = ",\n  ".join(f"v_{f} AS (SELECT dispute_id, cluster, max(k) AS top_{f}, count(*) FILTER (k = m) AS ties_{f} FROM (SELECT *, max(k) OVER (PARTITION BY dispute_id, cluster) AS m FROM (SELECT dispute_id, cluster, {keys[f]} AS key, count(*) AS k FROM members GROUP BY ALL)) GROUP BY 1, 2)" for f in _VOTED)
    joins = " ".join(f"JOIN v_{f} USING (dispute_id, cluster)" for f in _VOTED)
    pending = "CASE " + " ".join(f"WHEN members > 2 AND ties_{f} > 1 THEN '{f}'" for f in _VOTED[:9]) + " END"
    return f"""dec AS (
  SELECT dispute_id, decision, decision_id, CAST(decision.provenance.collected_at AS TIMESTAMPTZ) AS t,
    regexp_replace(regexp_replace(lower(trim(decision.provenance.{name})), '[^a-z0-9]+', '', 'g'), '^([a-z]+)0*', '\\1') AS rater FROM disputes WHERE decision IS NOT NULL),
panel AS (SELECT DISTINCT rater FROM dec WHERE rater IS NOT NULL),
last AS (SELECT dispute_id, rater, decision FROM dec WHERE rater IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dispute_id, rater ORDER BY t DESC NULLS LAST, decision_id DESC) = 1),
held AS (SELECT dispute_id, rater, {', '.join(f'decision.result.{f} AS {f}' for f in R.RESULT_FIELDS)}, {', '.join(f"{_as_number(f'decision.result.{f}')} AS n_{f}" for f in numeric)} FROM last WHERE decision.keep AND decision.result IS NOT NULL),
members AS (SELECT *, coalesce(abs(n_statistic)::VARCHAR, 'rater ' || rater) AS cluster, count(*) OVER (PARTITION BY dispute_id) AS present FROM held),
{votes},
sized AS (SELECT dispute_id, cluster, count(*) AS members, min(rater) AS first, greatest(3, max(present)) AS panel_size FROM members GROUP BY 1, 2),
judged AS (
  SELECT dispute_id, cluster, members, first, {pending} AS pending,
    CASE WHEN ({pending}) IS NULL AND members = panel_size AND least({', '.join(f'top_{f}' for f in _VOTED)}) = panel_size THEN 'unanimous' ELSE 'majority' END AS tier
  FROM sized {joins})"""


def _near(flat: str) -> str:
    """Whether the numbers in ``parts`` all stand within 160 characters after one place of the first."""
    return f"coalesce(len(parts) > 0 AND len(list_filter(range(1, length({flat}) + 1), lambda i: substr({flat}, i, length(parts[1])) = parts[1] AND len(list_filter(parts, lambda p: NOT contains(substr({flat}, i, 160), p))) = 0)) > 0, false)"


def _flat(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


SQL: dict[str, str] = {
    "normalised_texts": f"WITH RECURSIVE {NORMALISED} z AS (SELECT 1) SELECT doc_id, sha256(text) AS sha256, len(string_split(text, chr(10))) AS lines, renamed FROM norm",
    "online_results": ONLINE + """SELECT doc_id, line, 'pattern' AS source, test AS test_type, stat_text AS statistic_text, df1, df2, op AS p_operator, p_text, verdict, round(c, 8) AS computed_p, reason,
  coalesce(list_aggregate(missing, 'string_agg', ','), '') AS missing, raw AS quote FROM judged""",
    "verdict_counts": ONLINE + """SELECT doc_id, count(*) FILTER (verdict = 'consistent') AS consistent, count(*) FILTER (verdict = 'inconsistent') AS inconsistent, count(*) FILTER (verdict = 'decision_error') AS decision_error,
  count(*) FILTER (verdict = 'undecidable') AS undecidable, count(*) AS results FROM judged GROUP BY 1""",
    "online_stages": ONLINE + """SELECT doc_id, max(h.n) AS lines, (SELECT count(*) FROM spot w WHERE w.doc_id = h.doc_id) AS windows, (SELECT replacements FROM mended m WHERE m.doc_id = h.doc_id) AS replacements, 'simple' AS repair_rule,
  (SELECT count(*) FROM judged j WHERE j.doc_id = h.doc_id) AS by_pattern, 0 AS by_model FROM heads h GROUP BY doc_id""",
    "result_lines": ONLINE + """SELECT doc_id, line, lpad(line::VARCHAR, 5, ' ') || '  ' || coalesce(test, '?') || CASE WHEN df1 IS NULL THEN '' WHEN df2 IS NULL THEN '(' || d1 || ')' ELSE '(' || d1 || ', ' || d2 || ')' END || ' = ' || st
  || ', p ' || coalesce(op, '=') || ' ' || pv || '  ' || coalesce(printf('%.4f', c), 'NA') || '  ' || verdict || '  [pattern]' AS text
FROM (SELECT *, {0} FROM judged)""".replace("{0}", ", ".join(f"coalesce(CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE regexp_replace(printf('%.12f', {c}), '0+$', '') END, 'NA') AS {n}" for c, n in (("df1", "d1"), ("df2", "d2"), ("stat", "st"), ("p", "pv")))),
    "baseline_check": BASELINE + "SELECT id AS row_id, verdict, round(c, 9) AS p, error, decision_error FROM judged",
    "verdict_agreement": BASELINE + """SELECT count(*) FILTER (verdict <> 'undecidable' AND same) AS agree, count(*) FILTER (verdict <> 'undecidable' AND NOT same) AS disagree, count(*) FILTER (verdict = 'undecidable') AS undecidable
FROM (SELECT *, (verdict <> 'consistent') = error AND (verdict = 'decision_error') = decision_error AS same FROM judged)""",
    "extract_spans": f"WITH {_hits('holdout', 'record_id')} SELECT record_id, seq, test_type, begin AS start, fin AS \"end\", raw FROM best",

    "line_density": f"WITH {LINES} z AS (SELECT 1) SELECT doc_id, line, round({DENSITY}, 6) AS density FROM lines",
    "prefilter_lines": f"WITH {LINES} z AS (SELECT 1) SELECT doc_id, line FROM lines WHERE {KEEPS}",
    "reference_lines": f"WITH {LINES} z AS (SELECT 1) SELECT doc_id, line FROM lines WHERE {IS_REFERENCE}",
    "reference_strip": STRIPPED + "SELECT doc_id, max(n) AS lines, count(*) FILTER (value <> '') AS kept FROM ls GROUP BY doc_id",
    "windows_grown": STRIPPED
    + f""", docs AS (SELECT doc_id, max(n) AS n, list(length(value) + 1 ORDER BY line) AS sizes FROM ls GROUP BY doc_id),
kept AS (SELECT doc_id, line FROM ls WHERE {KEEPS}),
tried AS (
  SELECT k.doc_id, k.line, t.s, greatest(0, k.line - t.s) AS lo, least(d.n, k.line + t.s + 1) AS hi,
    list_sum(d.sizes[greatest(0, k.line - t.s) + 1 : least(d.n, k.line + t.s + 1)]) AS held
  FROM kept k JOIN docs d USING (doc_id), range(2, 9) t(s))
SELECT doc_id, line, lo AS start_line, hi - 1 AS end_line, (held - 1)::BIGINT AS chars FROM tried WHERE held >= 250 OR s = 8
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY s) = 1""",
    "windows_fixed": f"""WITH {LINES} w AS (
  SELECT doc_id, line, value, sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::BIGINT - 1 AS chars FROM lines)
SELECT doc_id, line, chars FROM w WHERE length(value) >= 20""",
    "windows_by_frame": f"WITH {LINES} z AS (SELECT 1) SELECT doc_id, line, sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)::BIGINT AS chars FROM lines",
    "folded_spaces": rf"""SELECT record_id, sha256(regexp_replace(text, '\p{{Zs}}', ' ', 'g')) AS folded,
  length(regexp_replace(text, '{WS}', '', 'g')) AS squeezed, sha256(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g')) AS flat FROM holdout""",
    "damage_families": f"SELECT {_family('r.quote')} AS family, count(*) AS n FROM (SELECT unnest(results) AS r FROM holdout) WHERE r.damaged GROUP BY 1",
    "character_ids": """SELECT record_id, sum(CASE WHEN c = ' ' THEN 28 WHEN c BETWEEN 'a' AND 'z' AND length(c) = 1 AND ascii(c) BETWEEN 97 AND 122 THEN ascii(c) - 95 ELSE 1 END)::BIGINT AS total,
  count(*) FILTER (NOT (c = ' ' OR ascii(c) BETWEEN 97 AND 122)) AS unknown
FROM (SELECT record_id, unnest([text[i] FOR i IN range(1, length(text) + 1)]) AS c FROM holdout) GROUP BY record_id""",
    "operator_sites": r"""WITH s AS (
  SELECT 'after_df' AS place, unnest(regexp_extract_all(text, '\)[ \n]*([\x00-\x08\x0b\x0c\x0e-\x1f¼\\!bNp])[ \n]*-?[0-9]*\.?[0-9]', 1)) AS ch FROM holdout
  UNION ALL
  SELECT 'after_p', unnest(regexp_extract_all(text, '[^A-Za-z]p[ \n]*([\x00-\x08\x0b\x0c\x0e-\x1f¼\\!bN])[ \n]*-?[0-9]*\.?[0-9]', 1)) FROM holdout)
SELECT place, hex(ch) AS code, count(*) AS n FROM s GROUP BY ALL""",
    "glyph_table": r"""WITH h AS (SELECT lower(trim(journal)) AS font, text FROM holdout WHERE journal IS NOT NULL),
m AS (SELECT font, unnest(regexp_extract_all(text, '[^A-Za-z]p[ \n]*[\x01-\x08\x0b\x0c\x0e-\x1f¼][ \n]*[0-9]*\.?[0-9]+')) AS m FROM h),
e AS (
  SELECT font, 'after_df' AS place, unnest(regexp_extract_all(text, '\)[ \n]*([\x01-\x08\x0b\x0c\x0e-\x1f¼])[ \n]*-?[0-9]*\.?[0-9]', 1)) AS code, NULL::DOUBLE AS value FROM h
  UNION ALL
  SELECT font, 'after_p', regexp_extract(m, 'p[ \n]*([\x01-\x08\x0b\x0c\x0e-\x1f¼])', 1), try_cast(regexp_extract(m, '([0-9]*\.?[0-9]+)$', 1) AS DOUBLE) FROM m),
g AS (
  SELECT font, code, count(*) FILTER (place = 'after_df') AS after_df, count(*) FILTER (place = 'after_p') AS after_p,
    count(*) FILTER (place = 'after_p' AND value IN (0.05::DOUBLE, 0.01::DOUBLE, 0.001::DOUBLE, 0.0001::DOUBLE, 0.1::DOUBLE)) AS thresholds FROM e GROUP BY ALL)
SELECT font, hex(code) AS code, after_df, after_p, thresholds,
  CASE WHEN after_df >= 3 THEN '=' WHEN thresholds / greatest(after_p, 1)::DOUBLE >= 0.7 THEN '<' ELSE '=' END AS char
FROM g WHERE after_df >= 3 OR after_p >= 3""",
    "extract_pattern": _extract(),
    "quote_found": f"""SELECT record_id, seq, coalesce(contains(regexp_replace(text, '{WS}', '', 'g'), q) AND q <> '', false) AS found
FROM (SELECT record_id, text, seq, regexp_replace(r.quote, '{WS}', '', 'g') AS q FROM (SELECT record_id, text, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout))""",
    "part_labels": f'WITH {SPANS} SELECT entity, count(*) AS n, sum("end" - "start")::BIGINT AS chars FROM spans GROUP BY entity',
    "span_overlaps": f"""WITH {SPANS}, o AS (SELECT *, lead("start") OVER (PARTITION BY record_id ORDER BY "start", "end", entity) AS next FROM spans)
SELECT record_id, entity, "start", "end", next FROM o WHERE next < "end" """,
    "numbers_read": f"""SELECT decision_id, seq, {_as_number('s')} AS value, {_double("regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^" + WS + "+|" + WS + "+$', '', 'g'), '[−–]', '-', 'g'), '^[<>=]+', ''), '^" + WS + "+|" + WS + "+$', '', 'g')")} AS printed
FROM (SELECT decision_id, c.statistic AS s, seq FROM (SELECT decision_id, unnest(candidates) AS c, generate_subscripts(candidates, 1) - 1 AS seq FROM disputes))""",
    "codes_normalised": """SELECT CASE WHEN lower(v) IN ('t','r','z') THEN lower(v) WHEN lower(v) IN ('f','q') THEN upper(v) WHEN lower(v) IN ('chi2','chi²','chi-square','x2','χ2') THEN 'chi2' END AS test_type,
  CASE WHEN o IN ('≤','le') THEN '<' WHEN o IN ('≥','ge') THEN '>' WHEN o IN ('=','<','>') THEN o END AS p_operator, count(*) AS n,
  count(*) FILTER (coalesce(r.statistic <> '' AND r.df1 <> '' AND r.p_value <> '', false)) AS checkable
FROM (SELECT r, trim(r.test_type) AS v, trim(r.p_operator) AS o FROM (SELECT unnest(results) AS r FROM holdout)) GROUP BY 1, 2""",
    "p_values": "SELECT row_id, round(computed_p, 9) AS p FROM statcheck_repaired",
    "printed_tokens": r"""SELECT row_id, length(coalesce(list_filter(regexp_extract_all(replace(raw, chr(10), ' '), '\d*\.\d+|\d+'), lambda x: try_cast(x AS DOUBLE) = abs(test_value))[1], abs(test_value)::VARCHAR)) AS chars
FROM statcheck_repaired WHERE raw IS NOT NULL AND test_value IS NOT NULL""",
    "check_chi2": f"""WITH {CHI}, t AS (SELECT *, round(c0, 9) AS c, round(lo0, 3) AS lo, round(up0, 3) AS up FROM tails)
SELECT l_orderkey, l_linenumber, round(c, 6) AS computed_p,
  CASE WHEN NOT (p <= 0 OR p < lo OR p > up) THEN 'consistent' WHEN (p <= 0.05) <> (c <= 0.05) THEN 'decision_error' ELSE 'inconsistent' END AS verdict FROM t""",
    "cascade_first_wins": f"""WITH {GOLD}, u AS (
  SELECT window_id, round(test_value, 4) + 0.0::DOUBLE AS value, 0 AS rank, 'pattern' AS source FROM statcheck_repaired UNION ALL SELECT window_id, value, 1, 'model' FROM gold)
SELECT window_id, round(value, 3) + 0.0::DOUBLE AS key, arg_min(source, rank) AS source FROM u GROUP BY 1, 2""",
    "common_windows": "SELECT DISTINCT window_id, source_doc FROM holdout WHERE window_id IN (SELECT window_id FROM statcheck_repaired)",
    "unused_documents": "SELECT DISTINCT txt FROM conversion_manifest m WHERE ok AND txt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM holdout h WHERE h.source_doc = m.txt)",
    "set_overlap": "SELECT DISTINCT source_doc, \"set\" FROM holdout WHERE \"set\" <> 'train' AND source_doc IN (SELECT source_doc FROM holdout WHERE \"set\" = 'train')",
    "document_pdfs": """SELECT h.source_doc, h.windows, m.pdf, m.pages FROM (SELECT source_doc, count(*) AS windows FROM holdout GROUP BY 1) h
LEFT JOIN (SELECT txt, min(pdf) AS pdf, max(pages) AS pages FROM conversion_manifest WHERE txt IS NOT NULL GROUP BY 1) m ON h.source_doc = m.txt""",
    "span_match_lenient": f"""WITH {SPANS}, {_hits('holdout', 'record_id')}, j AS (
  SELECT b.record_id AS window_id, b.seq AS i, h.seq AS j, least(b."end", h.fin) - greatest(b."start", h.begin) AS overlap, least(b."end" - b."start", h.fin - h.begin) AS shorter
  FROM blocks b JOIN best h USING (record_id))
SELECT window_id, i, j, overlap FROM j WHERE shorter > 0 AND overlap >= 0.5 * shorter AND overlap >= 0""",
    "raw_agreement": f"WITH {RATINGS}, i AS (SELECT item, count(DISTINCT label) AS k FROM ratings GROUP BY 1) SELECT count(*) AS items, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS raw FROM i",
    "cohen_kappa": f"""WITH {RATINGS}, p AS (
  SELECT a.rater AS rater_a, b.rater AS rater_b, a.label AS x, b.label AS y FROM ratings a JOIN ratings b ON a.item = b.item AND a.rater < b.rater),
c AS (
  SELECT rater_a, rater_b, count(*) AS n, avg((x = y)::INT) AS po, avg(x::INT) * avg(y::INT) + avg((NOT x)::INT) * avg((NOT y)::INT) AS pe FROM p GROUP BY 1, 2)
SELECT rater_a, rater_b, n, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM c""",
    "fleiss_kappa": f"""WITH {RATINGS}, i AS (
  SELECT item, count(*) AS m, count(*) FILTER (label) AS a, count(*) FILTER (NOT label) AS b FROM ratings GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT m AS raters, count(*) AS subjects, avg((a*a + b*b - m) / (m * (m - 1))::DOUBLE) AS p, power(sum(a) / (m * count(*))::DOUBLE, 2) + power(sum(b) / (m * count(*))::DOUBLE, 2) AS pe FROM i GROUP BY m)
SELECT raters, subjects, round(CASE WHEN pe = 1 THEN 1 ELSE (p - pe) / (1 - pe) END, 6) AS kappa FROM s""",
    "rater_against_final": f"""WITH {RATINGS}, final AS (SELECT item, arg_max(label, (coalesce(t, '-infinity'::TIMESTAMPTZ), decision_id)) AS last FROM named GROUP BY 1)
SELECT rater, count(*) AS items, count(*) FILTER (label = last) AS same, round(avg((label = last)::INT), 6) AS agreement, count(*) FILTER (label AND NOT last) AS only_rater, count(*) FILTER (NOT label AND last) AS only_final
FROM ratings JOIN final USING (item) GROUP BY 1""",
    "kripp_alpha": f"""WITH {RATINGS}, u AS (SELECT item, count(*) AS m, count(*) FILTER (label) AS a, count(*) FILTER (NOT label) AS b FROM ratings GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT sum(m) AS n, sum((a*(a-1) + b*(b-1)) / (m - 1)::DOUBLE) AS o, sum(a) AS ta, sum(b) AS tb FROM u)
SELECT n::BIGINT AS n, round(1 - (1 - o / n) / (1 - (ta*(ta-1) + tb*(tb-1)) / (n*(n-1))::DOUBLE), 6) AS alpha FROM s""",
    "consensus_vote": f"""WITH f AS (SELECT dispute_id, arg_min(candidates, decision_id) AS cs FROM disputes GROUP BY 1),
c AS (SELECT dispute_id AS cluster, c.df1 AS raw, {_as_number('c.df1')} AS num, rank FROM (SELECT dispute_id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS rank FROM f)),
v AS (SELECT cluster, num, count(*) AS votes, min(rank) AS r, arg_min(coalesce(raw, '∅'), rank) AS raw FROM c GROUP BY 1, 2),
w AS (SELECT cluster, nullif(raw, '∅') AS raw, votes, sum(votes) OVER (PARTITION BY cluster) AS n FROM v QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, r) = 1)
SELECT cluster, CASE WHEN votes > 1 OR n <> 3 THEN raw END AS value, votes FROM w""",
    "dispute_audit": "SELECT kind, field, count(DISTINCT dispute_id) AS disputes, count(decision) AS decided, count(*) AS rows FROM disputes GROUP BY kind, field",
    "decision_ledger": "SELECT dispute_id, arg_max(decision_id, (ingested_at, decision_id)) AS decision_id, count(*) AS n FROM disputes GROUP BY 1",
    "gold_index": f"WITH {GOLD} SELECT window_id, value, damaged, test_type, checkable, family, tier FROM gold",
    "score_system": f"""WITH {GOLD}, b AS (
  SELECT unnest([x FOR x IN ['overall', CASE WHEN in_gold THEN CASE WHEN damaged THEN 'damaged' ELSE 'undamaged' END END,
    CASE WHEN in_gold THEN 'test:' || coalesce(nullif(test_type, ''), 'unknown') END, CASE WHEN in_gold AND family IS NOT NULL THEN 'damage:' || family END,
    CASE WHEN in_gold AND checkable THEN 'checkable' END] IF x IS NOT NULL]) AS bucket, in_gold, in_found FROM fact),
c AS (SELECT bucket, count(*) FILTER (in_gold AND in_found) AS tp, count(*) FILTER (NOT in_gold) AS fp, count(*) FILTER (NOT in_found) AS fn FROM b GROUP BY 1)
SELECT bucket, tp, fp, fn, {_RATES} FROM c""",
    "score_union": f"""WITH {GOLD}, parted AS (SELECT DISTINCT window_id, round(test_value, 4) AS value FROM statcheck_repaired WHERE lower(test_type) IN ('t', 'r', 'f', 'z', 'chi2')),
part AS (
  SELECT g.window_id IS NOT NULL AS in_gold, f.window_id IS NOT NULL AS in_found, damaged, test_type, checkable, family FROM gold g FULL JOIN parted f ON g.window_id = f.window_id AND g.value = f.value),
b AS (
  SELECT unnest([x FOR x IN ['overall', CASE WHEN in_gold THEN CASE WHEN damaged THEN 'damaged' ELSE 'undamaged' END END,
    CASE WHEN in_gold THEN 'test:' || coalesce(nullif(test_type, ''), 'unknown') END, CASE WHEN in_gold AND family IS NOT NULL THEN 'damage:' || family END,
    CASE WHEN in_gold AND checkable THEN 'checkable' END] IF x IS NOT NULL]) AS bucket, in_gold, in_found FROM part),
c AS (SELECT bucket, count(*) FILTER (in_gold AND in_found) AS tp, count(*) FILTER (NOT in_gold) AS fp, count(*) FILTER (NOT in_found) AS fn FROM b GROUP BY 1)
SELECT bucket, tp, fp, fn, {_RATES} FROM c""",
    "score_spans": f"""WITH {SPANS}, g AS (SELECT DISTINCT record_id, "start", "end" FROM blocks), f AS (SELECT DISTINCT record_id, "start", "end" FROM hulls),
c AS (SELECT count(*) FILTER (g.record_id IS NOT NULL AND f.record_id IS NOT NULL) AS tp, count(*) FILTER (g.record_id IS NULL) AS fp, count(*) FILTER (f.record_id IS NULL) AS fn
  FROM g FULL JOIN f ON g.record_id = f.record_id AND g."start" = f."start" AND g."end" = f."end")
SELECT tp, fp, fn, {_RATES} FROM c""",
    "score_entities": f"""WITH {SPANS}, ok AS (SELECT record_id, seq FROM (SELECT record_id, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout) WHERE list_contains(r.raters, 'mx-small')),
g AS (SELECT DISTINCT record_id, "start", "end", entity FROM spans), f AS (SELECT DISTINCT s.record_id, s."start", s."end", s.entity FROM spans s JOIN ok USING (record_id, seq)),
c AS (SELECT coalesce(g.entity, f.entity) AS entity, count(*) FILTER (g.record_id IS NOT NULL AND f.record_id IS NOT NULL) AS tp, count(*) FILTER (g.record_id IS NULL) AS fp, count(*) FILTER (f.record_id IS NULL) AS fn
  FROM g FULL JOIN f ON g.record_id = f.record_id AND g."start" = f."start" AND g."end" = f."end" AND g.entity = f.entity GROUP BY ROLLUP (1))
SELECT coalesce(entity, 'all') AS entity, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1, tp + fn AS support FROM c""",
    "family_recall": f"""WITH {GOLD}, k AS (SELECT family, count(*) FILTER (in_found) AS k, count(*) AS n FROM fact WHERE in_gold AND family IS NOT NULL GROUP BY 1),
w AS (SELECT *, k / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM k)
SELECT family, k, n, round(p, 6) AS r, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low,
  round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM w""",
    "mcnemar": f"""WITH {GOLD}, a AS (SELECT DISTINCT window_id, round(test_value, 4) AS value FROM statcheck_repaired WHERE lower(test_type) IN ('t','r','z')),
b AS (SELECT DISTINCT window_id, round(test_value, 4) AS value FROM statcheck_repaired WHERE lower(test_type) IN ('f','chi2','q')),
d AS (SELECT count(*) FILTER (a.value IS NOT NULL AND b.value IS NULL) AS b, count(*) FILTER (a.value IS NULL AND b.value IS NOT NULL) AS c
  FROM gold g LEFT JOIN a ON g.window_id = a.window_id AND g.value = a.value LEFT JOIN b ON g.window_id = b.window_id AND g.value = b.value)
SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, least(b, c) + 1) t(i))) END, 9) AS p FROM d""",
    "bootstrap_ci": f"""WITH {GOLD}, {_replicates({'': ''})}
SELECT metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM (
  SELECT unnest(['p', 'r', 'f1']) AS metric, unnest([{_rate3('')}]) AS v FROM reps) GROUP BY 1""",
    "paired_bootstrap": f"""WITH {GOLD}, {_replicates({'_a': '', '_b': "WHERE lower(test_type) IN ('t', 'f')"})},
d AS (SELECT unnest(['p', 'r', 'f1']) AS metric, unnest([{_rate3('_a')}]) - unnest([{_rate3('_b')}]) AS v FROM reps)
SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high,
  round(least(1, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p FROM d GROUP BY 1""",
    "missing_parts": f"""WITH r AS (SELECT lower(trim(coalesce(r.test_type, ''))) AS t, {_as_number('r.statistic')} AS s, {_as_number('r.df1')} AS d1, {_as_number('r.df2')} AS d2, r.p_operator AS op, {_as_number('r.p_value')} AS p FROM (SELECT unnest(results) AS r FROM holdout)),
m AS (
  SELECT unnest(list_filter([CASE WHEN t = '' THEN 'test_type' END, CASE WHEN s IS NULL THEN 'statistic' END, CASE WHEN d1 IS NULL AND t <> 'z' THEN 'df1' END,
    CASE WHEN d2 IS NULL AND t = 'f' THEN 'df2' END, CASE WHEN p IS NULL THEN 'p_value' WHEN op IS NULL OR op NOT IN ('=', '<', '>') THEN 'p_operator' END], lambda x: x IS NOT NULL)) AS part
  FROM r WHERE p IS NULL OR op IS NULL OR op NOT IN ('=', '<', '>', 'ns') OR s IS NULL OR d1 <= 0 OR d2 <= 0 OR t NOT IN ('t', 'r', 'z', 'f', 'chi2', 'q')
    OR (t <> 'z' AND d1 IS NULL) OR (t = 'f' AND d2 IS NULL) OR (t = 'r' AND abs(s) >= 1))
SELECT part, count(*) AS n FROM m GROUP BY 1""",
    "pool_counts": f"""WITH RECURSIVE lines0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM lines0 GROUP BY 1),
cut AS (SELECT doc_id, coalesce(min(CASE WHEN line >= floor(n * {R.REFERENCE_TAIL}) AND regexp_matches(value, '{HEADING}') THEN line END), max(n)) AS cut FROM lines0 JOIN n USING (doc_id) GROUP BY 1),
ls AS (SELECT doc_id, line, CASE WHEN regexp_matches(value, '{_SAMPLED}') THEN '' ELSE value END AS value FROM lines0 JOIN cut USING (doc_id) WHERE line < cut),
w AS (SELECT doc_id, line, value, regexp_replace(regexp_replace(string_agg(value, chr(10)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM ls),
p AS (
  SELECT CASE WHEN NOT (({DENSITY}) >= 0.2 AND regexp_matches(value, '[0-9]')) THEN 'C'
    WHEN regexp_matches(value, '{_STAT}') THEN CASE WHEN regexp_matches(value, '{_STAT_N}') THEN 'AN' ELSE 'A' END
    WHEN regexp_matches(value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AND regexp_matches(value, '{_TESTISH}') THEN 'B2'
    WHEN regexp_matches(flat, '{_P}') AND NOT regexp_matches(flat, '{_STAT}') THEN 'B1' WHEN regexp_matches(value, '{_TESTISH}') THEN 'B2' END AS pool
  FROM w WHERE length(value) >= 20)
SELECT pool, count(*) AS n FROM p WHERE pool IS NOT NULL GROUP BY 1""",
    "class_weights": f"""WITH {SPANS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY "start", "end", entity) AS k FROM spans),
held AS (SELECT r.record_id, greatest(0, "start") AS a, least(length(text), "end") AS b, entity, k FROM ranked r JOIN holdout h USING (record_id) WHERE text IS NOT NULL),
cells AS (SELECT record_id, unnest(range(a, b)) AS i, a, b, entity, k FROM held WHERE b > a),
tags AS (SELECT CASE WHEN b - a = 1 THEN 'S' WHEN i = a THEN 'B' WHEN i = b - 1 THEN 'E' ELSE 'I' END || '-' || entity AS tag FROM cells QUALIFY row_number() OVER (PARTITION BY record_id, i ORDER BY k DESC) = 1),
n AS (SELECT tag, count(*) AS n FROM tags GROUP BY 1 UNION ALL SELECT 'O', (SELECT sum(length(text)) FROM holdout) - (SELECT count(*) FROM tags)),
every AS (SELECT unnest({list(R.TAGS)!r}) AS tag)
SELECT e.tag, round(CASE WHEN e.tag = 'O' OR n IS NULL THEN 1.0 ELSE least(40.0, sqrt((SELECT sum(n) FROM n) / ({len(R.TAGS)} * n)::DOUBLE)) END, 6) AS weight FROM every e LEFT JOIN n ON n.tag = e.tag""",
    "contract_violations": """WITH x AS (SELECT d.*, window_id IN (SELECT window_id FROM holdout) AS there FROM disputes d),
c AS (SELECT unnest(candidates) AS r FROM x),
p AS (
  SELECT unnest(list_filter([CASE WHEN NOT there THEN 'record is not in the batch' END, CASE WHEN NOT there AND window_id IS NOT NULL THEN 'window_id differs' END,
    CASE WHEN decision.keep IS NULL THEN 'contains_result is not boolean' END, CASE WHEN candidates IS NULL THEN 'results is not a list' END], lambda v: v IS NOT NULL)) AS problem FROM x
  UNION ALL
  SELECT unnest(list_filter([CASE WHEN r.p_operator IS NOT NULL AND trim(r.p_operator) NOT IN ('≤', 'le', '≥', 'ge', '=', '<', '>') THEN 'p_operator is not known' END,
    CASE WHEN r.test_type IS NOT NULL AND lower(trim(r.test_type)) NOT IN ('t', 'r', 'z', 'f', 'q', 'chi2', 'chi²', 'chi-square', 'x2', 'χ2') THEN 'test_type is not known' END,
    CASE WHEN r.damaged IS NULL THEN 'damaged is not boolean' END, CASE WHEN coalesce(r.confidence, '') NOT IN ('high', 'low') THEN 'confidence is not high or low' END,
    CASE WHEN coalesce(r.quote, '') = '' THEN 'quote is empty' END], lambda v: v IS NOT NULL)) FROM c)
SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    "rater_f1": f"""WITH r AS (SELECT record_id, i, results[i].raters AS raters, coalesce(results[i].block_span[2] > results[i].block_span[1], {_as_number('results[i].statistic')} IS NOT NULL) AS ok
  FROM (SELECT record_id, results, unnest(range(1, len(results) + 1)) AS i FROM holdout)),
names AS (SELECT DISTINCT unnest(raters) AS x FROM r),
c AS (
  SELECT a.x AS rater_a, b.x AS rater_b, count(*) FILTER (list_contains(raters, a.x) AND list_contains(raters, b.x) AND ok) AS tp,
    count(*) FILTER (list_contains(raters, a.x)) AS na, count(*) FILTER (list_contains(raters, b.x)) AS nb FROM names a JOIN names b ON a.x < b.x, r GROUP BY 1, 2)
SELECT rater_a, rater_b, tp, na - tp AS fp, nb - tp AS fn, round(CASE WHEN na + nb = 0 THEN 1 ELSE 2 * tp / (na + nb)::DOUBLE END, 6) AS f1 FROM c""",
    "consensus_windows": f"""WITH {_consensus('rater')}
SELECT dispute_id AS window_id, count(*) FILTER (members > 1)::INT AS kept, count(*) FILTER (members = 1 OR pending IS NOT NULL)::INT AS disputes,
  coalesce(string_agg(tier, ',' ORDER BY first) FILTER (members > 1), '') AS tiers,
  coalesce(string_agg(CASE WHEN members = 1 THEN 'singleton' ELSE 'field_conflict:' || pending END, ',' ORDER BY first) FILTER (members = 1 OR pending IS NOT NULL), '') AS "open" FROM judged GROUP BY 1""",
    "settled_records": f"""WITH {_consensus('rater')},
latest AS (SELECT dispute_id, arg_max(decision, (ingested_at, decision_id)) AS decision FROM disputes WHERE decision IS NOT NULL GROUP BY 1),
s AS (
  SELECT tier, dispute_id FROM judged WHERE members > 1 AND pending IS NULL
  UNION ALL SELECT 'adjudicated', dispute_id FROM latest WHERE decision.keep AND decision.result IS NOT NULL AND dispute_id IN (SELECT dispute_id FROM judged WHERE members = 1 OR pending IS NOT NULL))
SELECT tier, count(*) AS n, count(DISTINCT dispute_id) AS windows FROM s GROUP BY 1""",
    "field_agreement": f"""WITH {_consensus('model_alias')},
full_ AS (SELECT dispute_id, cluster FROM judged WHERE members = (SELECT count(*) FROM panel)),
g AS (SELECT m.* FROM members m JOIN full_ USING (dispute_id, cluster)),
l AS (SELECT unnest(['test_type', 'p_operator', 'damaged']) AS field, unnest([test_type, p_operator, damaged::VARCHAR]) AS label, dispute_id, cluster FROM g),
k AS (SELECT field, dispute_id, cluster, label, count(*) AS k FROM l WHERE label IS NOT NULL GROUP BY ALL),
u AS (SELECT field, dispute_id, cluster, sum(k) AS m FROM k GROUP BY ALL HAVING sum(k) > 1),
o AS (SELECT field, sum(k) AS n, sum(k * (k - 1) / (m - 1)::DOUBLE) AS o FROM k JOIN u USING (field, dispute_id, cluster) GROUP BY 1),
e AS (SELECT field, sum(t * (t - 1)) AS e FROM (SELECT field, label, sum(k) AS t FROM k JOIN u USING (field, dispute_id, cluster) GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT unnest(['statistic', 'df1', 'df2', 'n', 'p_value']) AS field, unnest([n_statistic, n_df1, n_df2, n_n, n_p_value]) AS value, dispute_id, cluster FROM g),
w AS (SELECT field, dispute_id, cluster, count(DISTINCT coalesce(value::VARCHAR, '∅')) = 1 AS same FROM v GROUP BY ALL)
SELECT f.field, NULL::BIGINT AS groups, round(CASE WHEN n > 1 THEN CASE WHEN e = n * (n - 1) THEN 1 ELSE 1 - (1 - o / n) / (1 - e / (n * (n - 1))::DOUBLE) END END, 6) AS agreement
FROM (SELECT unnest(['test_type', 'p_operator', 'damaged']) AS field) f LEFT JOIN o USING (field) LEFT JOIN e USING (field)
UNION ALL SELECT f.field, (SELECT count(*) FROM w WHERE w.field = f.field), (SELECT round(avg(same::INT), 6) FROM w WHERE w.field = f.field) FROM (SELECT unnest(['statistic', 'df1', 'df2', 'n', 'p_value']) AS field) f""",
    "report_rows": ONLINE + """SELECT doc_id, to_json(list(struct_pack(line := line, test_type := test, statistic := stat, verdict := verdict) ORDER BY line, test, stat, verdict))::VARCHAR AS report FROM judged GROUP BY 1""",
    "stratified_sample": """WITH w AS (SELECT source_doc AS doc, record_id AS line, pool, md5('29|' || source_doc || '|' || record_id) AS h FROM holdout),
p AS (SELECT *, row_number() OVER (PARTITION BY pool, doc ORDER BY h, line) AS n FROM w QUALIFY n <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h, doc, line) AS r FROM p)
SELECT doc, line, pool FROM r WHERE r <= CASE pool WHEN 'A' THEN 60 WHEN 'AN' THEN 40 WHEN 'B1' THEN 300 WHEN 'B2' THEN 450 WHEN 'C' THEN 150 END""",
    "holdout_sample": """WITH w AS (
  SELECT source_doc AS doc, record_id AS line, pool, md5('101|' || source_doc || '|' || record_id) AS h FROM holdout
  WHERE "set" <> 'train' AND source_doc NOT IN (SELECT source_doc FROM holdout WHERE "set" = 'train')),
p AS (SELECT *, row_number() OVER (PARTITION BY pool, doc ORDER BY h, line) AS n FROM w QUALIFY n <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h, doc, line) AS r FROM p)
SELECT doc, line, pool FROM r WHERE r <= CASE pool WHEN 'A' THEN 18 WHEN 'AN' THEN 12 WHEN 'B1' THEN 90 WHEN 'B2' THEN 135 WHEN 'C' THEN 45 END""",
    "split_assign": """WITH d AS (SELECT DISTINCT source_doc FROM holdout),
r AS (SELECT source_doc, row_number() OVER (ORDER BY md5('0|' || source_doc), source_doc) AS r, count(*) OVER () AS n FROM d)
SELECT source_doc, CASE WHEN r <= round(n * 0.15) THEN 'dev' ELSE 'train' END AS split FROM r""",
    "window_ids": "SELECT record_id, substr(sha1(source_doc || source_line::VARCHAR), 1, 10) AS wid, 'ho' || substr(sha1(source_doc || source_line::VARCHAR), 1, 8) AS hid FROM holdout",
    "batch_ids": "SELECT decision_id, dispute_id, candidates, n // 20 AS batch_id, n % 20 AS pos FROM (SELECT decision_id, dispute_id, len(candidates) AS candidates, row_number() OVER (ORDER BY decision_id) - 1 AS n FROM disputes)",
    "char_vocab": """WITH c AS (SELECT unnest([text[i] FOR i IN range(1, length(text) + 1)]) AS ch FROM holdout), k AS (SELECT ch, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 3)
SELECT hex(ch) AS code, n, row_number() OVER (ORDER BY ch) + 1 AS id FROM k""",
    "dataset_counts": """SELECT "set", count(*) AS windows, count(DISTINCT source_doc) AS documents, sum(len(results))::BIGINT AS results, count(*) FILTER (contains_result) AS with_result FROM holdout GROUP BY 1""",
    "tier_counts": """SELECT "set", r.tier AS tier, count(*) AS n FROM (SELECT "set", unnest(results) AS r FROM holdout) GROUP BY 1, 2""",
    "conversion_summary": "SELECT count(*) AS files, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, sum(non_ascii)::BIGINT AS non_ascii FROM conversion_manifest",
    "text_hashes": "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM documents",
    "manifest_check": "SELECT pdf AS path, 'changed' AS problem FROM conversion_manifest WHERE ok GROUP BY pdf HAVING count(DISTINCT chars) > 1",
    "loss_divergence": """WITH e AS (SELECT user_id AS run, event_id AS epoch, value * 100 AS loss, lag(value * 100) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT run, min(epoch) AS epoch FROM e WHERE loss > 100 AND loss > 10 * b GROUP BY run""",
    "ranked_runs": "SELECT event_type AS name, round(avg(value), 6) AS dev_f1 FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "seed_summary": "SELECT event_type AS config, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS latency, count(*) AS seeds FROM events GROUP BY 1",
    "checker_parity": f"""WITH {GOLD}, t AS (SELECT count(*) FILTER (in_gold AND in_found) AS "both", count(*) FILTER (in_gold AND NOT in_found) AS missed, count(*) FILTER (NOT in_gold) AS "only",
  count(*) FILTER (in_gold AND NOT in_found AND damaged) AS damaged_missed FROM fact)
SELECT "both", missed, "only", round("both" / greatest(1, "both" + missed)::DOUBLE, 6) AS recall, damaged_missed FROM t""",
    "numbers_held": f"""WITH h AS (
  SELECT record_id, seq, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS flat,
    list_filter([trim(regexp_replace(x, '^[<>=]+', '')) FOR x IN [r.df1, r.df2, r.statistic, r.p_value]], lambda x: x IS NOT NULL AND x <> '') AS parts
  FROM (SELECT record_id, text, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout))
SELECT record_id, seq, coalesce(len(parts) > 0 AND len(list_filter(range(1, length(flat) + 1), lambda i: substr(flat, i, length(parts[1])) = parts[1]
  AND len(list_filter(parts, lambda p: NOT contains(substr(flat, i, 160), p))) = 0)) > 0, false) AS held FROM h""",
    "window_offsets": STRIPPED + f", {_grown()}ends_at AS (SELECT doc_id, line, sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS e, length(value) AS n FROM lines)"
    + """ SELECT p.doc_id, p.line, (a.e - a.n - 1)::BIGINT AS start, (b.e - 1)::BIGINT AS "end" FROM spot p JOIN ends_at a ON a.doc_id = p.doc_id AND a.line = p.lo JOIN ends_at b ON b.doc_id = p.doc_id AND b.line = p.hi - 1""",
    "cascade_counters": f"""WITH u AS (
  SELECT window_id, round(round(test_value, 4), 3) + 0.0::DOUBLE AS k, 0 AS m, row_id AS o FROM statcheck_repaired
  UNION ALL SELECT window_id, round({_as_number('r.statistic')}, 3) + 0.0::DOUBLE, 1, record_id * 1000 + seq FROM (SELECT window_id, record_id, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout)),
f AS (SELECT *, row_number() OVER (PARTITION BY window_id, k ORDER BY m, o) = 1 AS first FROM u)
SELECT window_id, count(*) FILTER (m = 0 AND first) AS pattern, count(*) FILTER (m = 1 AND first AND k IS NOT NULL) AS model_added, count(*) FILTER (m = 1 AND NOT (first AND k IS NOT NULL)) AS model_duplicate FROM f GROUP BY 1""",
    "window_differences": """SELECT window_id, 'missing' AS side FROM (SELECT window_id FROM disputes EXCEPT SELECT window_id FROM statcheck_repaired)
UNION ALL SELECT window_id, 'extra' FROM (SELECT window_id FROM statcheck_repaired EXCEPT SELECT window_id FROM disputes)""",
    "open_disputes": f"""WITH {_consensus('rater')},
o AS (SELECT *, row_number() OVER (PARTITION BY dispute_id ORDER BY first) - 1 AS k FROM judged WHERE members = 1 OR pending IS NOT NULL)
SELECT 'x-' || o.dispute_id || '-' || k AS dispute_id, CASE WHEN members = 1 THEN 'singleton' ELSE 'field_conflict' END AS kind, pending AS field, members::INT AS candidates,
  (SELECT string_agg(rater, ',' ORDER BY rater) FROM members m WHERE m.dispute_id = o.dispute_id AND m.cluster = o.cluster) AS raters, k = 0 AND o.dispute_id IN (SELECT dispute_id FROM disputes WHERE decision IS NOT NULL) AS resolved FROM o""",
    "blind_candidates": """SELECT decision_id, row_number() OVER (PARTITION BY decision_id ORDER BY md5('5|' || decision_id || '|' || i)) - 1 AS place, c.statistic AS statistic, c.p_value AS p_value
FROM (SELECT decision_id, unnest(candidates) AS c, generate_subscripts(candidates, 1) - 1 AS i FROM disputes)""",
    "split_rows": """WITH d AS (SELECT DISTINCT source_doc FROM holdout),
r AS (SELECT source_doc, row_number() OVER (ORDER BY md5('0|' || source_doc), source_doc) AS r, count(*) OVER () AS n FROM d)
SELECT record_id, CASE WHEN r <= round(n * 0.15) THEN 'dev' ELSE 'train' END AS split FROM holdout JOIN r USING (source_doc)""",
    "ledger_upsert": "SELECT dispute_id AS name, decision_id, kind, decision.keep AS keep FROM disputes QUALIFY row_number() OVER (PARTITION BY dispute_id ORDER BY ingested_at DESC, decision_id DESC) = 1",
    "tags_and_spans": f"""WITH {SPANS} SELECT DISTINCT record_id, "start", "end", entity FROM spans WHERE "end" > "start" """,
    "jsonl_files": "SELECT record_id, journal, sha256(text) AS sha256, source_line FROM holdout",
    "jsonl_quarantine": "SELECT coalesce(journal, '(bad line)') AS journal, count(*) AS n FROM holdout GROUP BY 1",
    "checker_files": "SELECT window_id, len(v)::INT AS n, round(list_sum(v), 3) AS total FROM (SELECT window_id, list(DISTINCT round(test_value, 4)) AS v FROM statcheck_repaired GROUP BY 1)",
    "text_files": "SELECT item_id, length(text) + 1 AS chars, sha256(text || chr(10)) AS sha256 FROM eval_items",
    "streamed_results": ONLINE + "SELECT test AS test_type, verdict, count(*) AS n, count(DISTINCT doc_id) AS documents FROM judged GROUP BY 1, 2",
    "repair_report": f"""WITH {_repaired('holdout', 'record_id')}
SELECT record_id, len(list_distinct(list_concat(a, b)))::INT AS mapped, replacements,
  length(text) - length(regexp_replace(text, '[{_FONT}]', '', 'g')) AS suspects_before, length(twice) - length(regexp_replace(twice, '[{_FONT}]', '', 'g')) AS suspects_after FROM mended""",
    "span_groups": f"""WITH {SPANS}, s AS (SELECT record_id, entity, substr(text, "start" + 1, "end" - "start") AS v, row_number() OVER (PARTITION BY record_id ORDER BY "start", "end", entity) AS o FROM spans JOIN holdout USING (record_id)),
t AS (SELECT *, count(*) FILTER (entity = 'TEST') OVER (PARTITION BY record_id ORDER BY o) AS tn FROM s),
u AS (SELECT *, greatest(0, count(*) FILTER (entity = 'STAT') OVER (PARTITION BY record_id, tn ORDER BY o) - 1) AS sn FROM t),
g AS (SELECT *, dense_rank() OVER (PARTITION BY record_id ORDER BY tn, sn) - 1 AS k FROM u),
b AS (
  SELECT record_id, k, arg_min(v, o) FILTER (entity = 'TEST') AS name, arg_min(v, o) FILTER (entity = 'STAT') AS stat, arg_min(v, o) FILTER (entity = 'DF1') AS d1, arg_min(v, o) FILTER (entity = 'DF2') AS d2,
    arg_min(v, o) FILTER (entity = 'PVAL') AS pv, arg_min(entity, o) FILTER (entity LIKE 'POP%') AS op FROM g GROUP BY 1, 2)
SELECT record_id, k, nullif(lower(trim(name)), '') AS test_type, {_as_number('stat')} AS statistic, {_as_number('d1')} AS df1, {_as_number('d2')} AS df2,
  CASE op WHEN 'POP_EQ' THEN '=' WHEN 'POP_LT' THEN '<' WHEN 'POP_GT' THEN '>' END AS p_operator, {_as_number('pv')} AS p_value FROM b WHERE ({_as_number('stat')}) IS NOT NULL""",
    "quote_alignment": f"""WITH h AS (
  SELECT record_id, seq, r, regexp_replace(text, '{WS}', '', 'g') AS flat, regexp_replace(r.quote, '{WS}', '', 'g') AS q, text
  FROM (SELECT record_id, text, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS seq FROM holdout)),
p AS (SELECT *, CASE WHEN q <> '' THEN nullif(instr(flat, q), 0) END AS k, list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(text[i], '{WS}')) AS spots FROM h)
SELECT record_id, seq, (spots[k] - 1)::INT AS start, (spots[k + length(q) - 1])::INT AS "end",
  CASE WHEN k IS NOT NULL THEN len(list_filter([r.test_type, r.df1, r.df2, r.n, r.statistic, r.p_operator, r.p_value], lambda x: coalesce(regexp_replace(x, '{WS}', '', 'g'), '') <> '' AND contains(q, regexp_replace(x, '{WS}', '', 'g'))))::INT END AS parts FROM p""",
    "engine_gate": "WITH " + _stripped("""lines AS (
  SELECT record_id AS doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM holdout),
""") + f""", {_grown()}w AS (SELECT doc_id, {_flat('text')} AS flat FROM win),
r AS (
  SELECT record_id, pool, seq, {_flat('text')} AS flat, list_filter([trim(regexp_replace(x, '^[<>=]+', '')) FOR x IN [r.df1, r.df2, r.statistic, r.p_value]], lambda x: x IS NOT NULL AND x <> '') AS parts
  FROM (SELECT record_id, pool, text, unnest(results) AS r, generate_subscripts(results, 1) AS seq FROM holdout)),
k AS (SELECT r.record_id, r.seq, any_value(pool) AS engine, any_value({_near('r.flat')}) AS in_text, coalesce(bool_or({_near('w.flat')}) FILTER (w.flat IS NOT NULL), false) AS kept FROM r LEFT JOIN w ON w.doc_id = r.record_id GROUP BY 1, 2),
g AS (SELECT engine, count(*) AS results, count(*) FILTER (in_text) AS in_text, count(*) FILTER (kept) AS kept, avg(kept::INT) AS rate FROM k GROUP BY 1)
SELECT engine, results, in_text, kept, round(rate, 6) AS rate, round(max(rate) OVER () - min(rate) OVER (), 6) AS spread, max(rate) OVER () - min(rate) OVER () <= 0.06 AS passes FROM g""",
    "misaligned_rows": f"""WITH {SPANS} SELECT DISTINCT record_id FROM spans JOIN holdout USING (record_id) WHERE "start" < 0 OR "end" > length(text) OR "end" <= "start" """,
    "collected_rows": f"""SELECT record_id AS pos, 'b7' AS batch, k, CASE WHEN lower(v) IN ('t','r','z') THEN lower(v) WHEN lower(v) IN ('f','q') THEN upper(v) WHEN lower(v) IN ('chi2','chi²','chi-square','x2','χ2') THEN 'chi2' END AS test_type,
  CASE WHEN o IN ('≤','le') THEN '<' WHEN o IN ('≥','ge') THEN '>' WHEN o IN ('=','<','>') THEN o END AS p_operator, coalesce(contains(flat, q) AND q <> '', false) AS aligned
FROM (SELECT record_id, k, trim(r.test_type) AS v, trim(r.p_operator) AS o, regexp_replace(text, '{WS}', '', 'g') AS flat, regexp_replace(r.quote, '{WS}', '', 'g') AS q
  FROM (SELECT record_id, text, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS k FROM holdout))""",
    "tagged_digits": "SELECT record_id, length(text)::INT AS chars, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS digits, coalesce(list_position(string_split(regexp_replace(text, '[0-9]', '0', 'g'), ''), '0'), 0)::BIGINT AS first FROM holdout",
}
