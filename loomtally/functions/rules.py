"""Rules and constants of the analysis, with Java-regex forms of the classes they need."""

from __future__ import annotations

# Line widths and limits of the text rules.
TARGET_WIDTH, REFLOW_TRIGGER, MAX_REFERENCE = 90, 180, 300
MIN_LINE, MIN_DENSITY, CONTEXT_LINES, TARGET_CHARS, MAX_CONTEXT = 20, 0.2, 2, 250, 8
REFERENCE_TAIL = 0.55
ALPHA = 0.05
MAX_SUSPECTS, MIN_TESTABLE, ROUND_SHARE = 4, 3, 0.8
ROUND_THRESHOLDS = (0.05, 0.01, 0.001, 0.0001, 0.1)
POOL_WEIGHTS = {"A": 0.06, "AN": 0.04, "B1": 0.30, "B2": 0.45, "C": 0.15}

#: White space as Python's str.split sees it, for a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: Control characters that font damage leaves behind.
CONTROL = r"\x01-\x08\x0b\x0c\x0e-\x1f"
CONTROL_SAMPLER = r"\x00-\x08\x0b\x0c\x0e-\x1f"

SLOTS = "".join(map(chr, range(1, 9)))
# Characters a renaming of damaged operators must leave alone.
PROTECTED = "χφϕαβημσρλ−–—²³°≤≥≈"
TEXT_CHARACTERS = "".join(map(chr, range(0x20, 0x7F))) + "\n\t\r"
# Characters beyond ASCII that readers of the text know.
KNOWN = (
    "\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0e\x81\x82\x95\xa0£§¨©\xad¯°±²µ·¼×ÞåéðñöøþɑˆΔΦαβγεηλμξπρσχωϕе"
    " ​‐–—‘’“”†‡•… ′⁎€⃝ℓ⇑∈−∕∗≤≥⍵☆ﬀﬁﬂﬃ\U0001d6d8"
)

# What a reference heading and a reference line look like.
REFERENCE_HEADING = r"(?iu)^[SPACE]*(?:references|bibliography|works cited|literature cited)[SPACE]*$".replace("SPACE", SPACE)
REFERENCE_LINES = (
    r"\([S]*(?:19|20)\p{Nd}\p{Nd}[a-z]?[S]*\)",
    r"(?<![\p{L}\p{N}_])\p{Nd}+[S]*\([S]*\p{Nd}+[S]*\)[S]*,[S]*\p{Nd}+[S]*[-–][S]*\p{Nd}+",
    r"(?<![\p{L}\p{N}_])(?:doi:|https?://|dx\.doi\.org)",
    r"(?<![\p{L}\p{N}_])[A-Z]\.[S]*,?[S]*[A-Z]\.",
    r",[S]*\p{Nd}+[S]*[-–][S]*\p{Nd}+[S]*\.[S]*$",
)
REFERENCE_LINE = "|".join(f"(?:{p})" for p in REFERENCE_LINES).replace("[S]", f"[{SPACE}]")

# Families of damage, the first that matches names it (Java form).
DAMAGE_FAMILIES = (
    ("decimal point lost", r"=\s*\d{3,}\s*,\s*p\s*[<>=]\s*\d{3,}"),
    ("control character", f"[{CONTROL}]"),
    ("fraction sign for =", "¼"),
    ("backslash for <", r"\\"),
    ("letter b for <", r"\)\s*b\s*[-.0-9]|\bp\s*b\s*\.?[0-9]"),
    ("letter N for >", r"\bp\s*N\s*\.?[0-9]"),
    ("chi-square symbol lost", r"\b(v2|c2|x2)\s*\(|(?<![0-9A-Za-z])2\s*\(\s*\d"),
    ("letter p or ! for operator", r"\)\s*p\s*[-.0-9]|\bp\s*!\s*\.?[0-9]"),
)

# Parts of a result and the tags of a character tagger.
ENTITIES = ("TEST", "STAT", "DF1", "DF2", "N", "PVAL", "POP_EQ", "POP_LT", "POP_GT")
TAGS = ("O", *(f"{p}-{e}" for e in ENTITIES for p in "BIES"))
OPERATOR_ENTITY = {"=": "POP_EQ", "<": "POP_LT", ">": "POP_GT"}
RESULT_FIELDS = ("test_type", "statistic", "df1", "df2", "n", "p_operator", "p_value", "quote", "damaged", "confidence")
PART_OF_FIELD = (("test_type", "TEST"), ("df1", "DF1"), ("df2", "DF2"), ("n", "N"), ("statistic", "STAT"), ("p_operator", "POP"), ("p_value", "PVAL"))

# What each test needs, and how a missing part is named.
REQUIRED = {"t": ("df1",), "r": ("df1",), "chi2": ("df1",), "q": ("df1",), "f": ("df1", "df2"), "z": ()}
PART_NAMES = {
    "test_type": "no test name",
    "statistic": "no test statistic",
    "df1": "no degrees of freedom",
    "df2": "no second degrees of freedom",
    "p_value": "no p-value",
    "p_operator": "no operator before the p-value",
}

# What a verdict says where no part is missing.
NO_P = "the statistic and its degrees of freedom give no p-value"
NO_CLAIM = "there is no reported p-value to compare against"
DISAGREE = "the reported and computed p-values disagree"
DISAGREE_ALPHA = "the reported and computed p-values disagree about significance"
