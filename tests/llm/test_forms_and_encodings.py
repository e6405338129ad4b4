from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtally.llm import encodings, forms, queries

CASES = [
    ("ｔ（197） ＝ 0.64， p ＝ .５", "t(197) = 0.64, p = .5"), ("𝑡𝑎𝑠𝑘 𝐹(1,24)", "task F(1,24)"), ("coun​ting a­b ﻿c⁠d", "counting ab cd"),
    ("of 23 years", "of 23 years"), ("Grüneval, Ráséví́c", "Grüneval, Ráséví́c"), ("shuﬀled ﬂ ﬁ", "shuffled fl fi"),
    ("grоuр of сuriоsity", "group of curiosity"), ("Τhe nοt Αttrition", "The not Attrition"), ("А drawing", "A drawing"),
]
REGULAR = ["χ²(3) = 2.70, χ2 (6, N ¼ 4)", "η² = .04, α = .83; β7 = −.2, Δ = .2, ω²", "ON RAINY DAYS, Χ2(21) = 3", "“after” – it’s 2 × 3 ± 4 ≤ k", "t(3) \x02 2.1\r\nnew\nline", "Øskeval Brançado Größe", ""]


@pytest.mark.parametrize("text,want", CASES)
def test_one_form(text, want):
    want = unicodedata.normalize("NFC", want)
    assert forms.uniform(text) == want and forms.uniform(want) == want


@pytest.mark.parametrize("text", REGULAR)
def test_regular_stays(text):
    assert forms.uniform(text) == text


def test_wrong_decoding_is_left():
    for t in ("cafГ© group", "Ï‡Â²(1)", "Ã\xa0 la", "О” = .8", "Вј -2.71"):
        assert forms.uniform(t) == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FFF), st.sampled_from("ａ𝑡ﬁоαΤ​́　")), max_size=30))
def test_a_form_is_final(text):
    once = forms.uniform(text)
    if not forms._garbled(once):
        assert forms.uniform(once) == once


SCRIPTS = [
    ("Հello Ꮋello ꓮBC", "Hello Hello ABC"), ("ɡood ıdea ᴛest", "good idea test"), ("ѵіѕіt", "visit"), ("ёlan vital", "ëlan vital"), ("cаfе́ аnd nаi\u0308ve", "café and naïve"),
    ("Yıldız ığdır", "Yıldız iğdir"), ("Уes", "Yes"), ("ⲞꓳＯ o", "OOO o"),
]


@pytest.mark.parametrize("text,want", SCRIPTS)
def test_letters_of_many_scripts(text, want):
    assert forms.uniform(text) == want and forms.uniform(want) == want


@pytest.mark.parametrize("text", ["Հայաստան", "ᎣᏏᏲ ᏣᎳᎩ", "ꓡꓲ‐ꓢꓴ", "москва", "Ελλάδα"])
def test_other_scripts_by_themselves_stay(text):
    assert forms.uniform(text) == text


def test_compiling_refuses_conflicts():
    for table in ({"ａ": "b"}, {"а": "ѕ", "ѕ": "а"}):
        with pytest.raises(ValueError):
            forms.Transducer(table)
    with pytest.raises(ValueError):
        forms.Transducer.compile({"e\u0301": "x"})
    for t in (forms.PLAIN, forms.LATIN, forms.LATIN_LOWER, forms.CYRILLIC_ALONE, forms.GREEK_LETTER):
        assert all(k != v and not any(c in t.symbols for c in v) for k, v in t.symbols.items())
    assert all(len(k) > 1 for k in forms.SEQUENCES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("aeiouşñęAEOzșǘék"), st.text(st.sampled_from([chr(o) for o in range(0x300, 0x340)]), max_size=4)), max_size=4))
def test_clusters_compose_as_unicode_says(clusters):
    text = "".join(b + m for b, m in clusters)
    assert forms.PLAIN(text) == unicodedata.normalize("NFC", text)


def test_memory_does_not_grow_with_texts():
    """Words are kept between texts, and only short ones: no text is."""
    forms._kept.cache_clear()
    for i in range(2000):
        forms.uniform(f"Ｎο {i} " + "w" * 500 + "é" + "ａ" * 200)
    assert forms._kept.cache_info().currsize <= 4 and not hasattr(forms.uniform, "cache_info")


def test_guard_loses_nothing(spark):
    alphabet = [*forms.SINGLE][::7] + list(forms._ALIKE)
    rows = [(i, f"a{c}b") for i, c in enumerate(alphabet)] + [(10**6 + i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i long, t string")
    for r in df.select("t", forms.may_differ(F.col("t")).alias("m")).collect():
        assert r["m"] or forms.uniform(r["t"]) == r["t"], repr(r["t"])


def _disputes(spark, rows):
    return spark.createDataFrame(rows, "decision_id long, candidates array<struct<quote:string>>")


def test_found_with_nulls_and_extras(spark):
    h = spark.createDataFrame([(1, None), (2, ""), (3, "t​o"), (4, "plain"), (5, "x" * 200_000 + "　")], "record_id long, text string").withColumn("row_key", F.lit("clash")).withColumn("origin", F.lit(1))
    d = _disputes(spark, [(1, None), (2, []), (3, [(None,)]), (4, [("ok",), ("ｐ = 1",), ("ｐ = 1",)])]).withColumn("text", F.lit("clash"))
    assert {tuple(r) for r in forms.found(h, d).collect()} == {("holdout", 3), ("holdout", 5), ("disputes", 4)}
    assert forms.found(h.limit(0), d.limit(0)).count() == 0


ORIGINALS = ["χ²(3) = 2.30", "Größe: F(3, 133) = 1", "Brançado’s test, t(226)", "z = −0.36", "2 × 3 design", "“after” block", "élève 2", "naïve café", "η² = .08 ≤ k", "Raševic – niños"]


@pytest.mark.parametrize("page", encodings.PAGES)
def test_round_trip(page):
    """What a page can hold of the UTF-8 bytes comes back; twice wrong comes back too."""
    done = 0
    for text in ORIGINALS:
        try:
            once = text.encode("utf-8").decode(page)
        except UnicodeDecodeError:
            continue
        garbled, fixed, ops = encodings.diagnose(once)
        assert garbled and fixed == text and ops, (page, text, once, fixed)
        done += 1
        try:
            twice = once.encode("utf-8").decode(page)
        except UnicodeDecodeError:
            continue
        if page in ("cp1252", "latin-1"):
            assert encodings.diagnose(twice)[1] == text
    assert done


def test_partly_garbled_and_lost():
    assert encodings.diagnose("GröÃŸe")[1] == "Größe"
    assert encodings.diagnose("t(12) = �3.20") == (True, "t(12) = �3.20", ())
    assert encodings.diagnose("Ã© &amp; b")[1] == "é & b"


PAGES_MIXED = [
    ("Ïðèâåò, êàê äåëà", "Привет, как дела"), ("¤³¤ó¤Ë¤Á¤Ï", "こんにちは"), ("‚±‚ñ‚É‚¿‚Í", "こんにちは"), ("ÄãºÃÊÀ½ç", "你好世界"), ("оПХБЕР", "Привет"), ("ÊáëçìÝñá", "Καλημέρα"),
    ("H\0e\0l\0l\0o\0", "Hello"), ("¾È³çÇÏ¼¼¿ä", "안녕하세요"),
]


@pytest.mark.parametrize("text,want", PAGES_MIXED)
def test_one_page_read_as_another(text, want):
    garbled, fixed, ops = encodings.diagnose(text)
    assert garbled and fixed == want and len(ops) == 1 and encodings.diagnose(want)[0] is False


def test_escapes_are_undone_but_no_wrong_decoding():
    assert encodings.diagnose("caf%C3%A9 100% a%20b")[:2] == (False, "café 100% a%20b")
    assert encodings.diagnose("caf\\u00e9 \\u0041")[:2] == (False, "café \\u0041")
    assert encodings.diagnose("&eacute;t&eacute; A&B")[:2] == (False, "été A&B")


def test_deep_and_long_texts_are_searched_to_the_end():
    text = "Größe – élève"
    for _ in range(4):
        text = text.encode("utf-8").decode("latin-1")
    assert encodings.diagnose(text)[1] == "Größe – élève"
    long = "Ã©lÃ¨ve word " * 3000
    assert encodings.diagnose(long)[1] == "élève word " * 3000
    encodings._kept.cache_clear()
    encodings.diagnose("é" * 500)
    assert encodings._kept.cache_info().currsize == 0


@pytest.mark.parametrize("text", ["«аvаnt» r(53)", "уеаr 4 – t(22)", "F(\xad\xad\xad4", "Raševic – niños – élève", "Москва и Тверь", "ΔΕΖ αβγδ", "東京大学", "Señorías año"])
def test_no_new_damage(text):
    assert encodings.diagnose(text)[:2] == (False, text)


@pytest.mark.parametrize("text", [*REGULAR, *ORIGINALS, "SÃVIK ÂGE RÂLE BRANÇÃO", "r(30) ¼ .11", "p b .05", "A & B", "Ø “x” Ü–", None])
def test_clean_texts_are_clean(text):
    assert encodings.diagnose(text)[0] is False


def test_encodings_found(spark, small):
    d = _disputes(spark, [(1, None), (2, [("Ã©lÃ¨ve",), (None,)]), (3, [("ok",)])]).withColumn("garbled", F.lit(1))
    r = spark.createDataFrame([(1, None), (2, ""), (3, "√©l√®ve" * 2000)], "row_id long, raw string").withColumn("text", F.lit("clash"))
    assert {tuple(x) for x in encodings.found(d, r).collect()} == {("disputes", 2), ("statcheck_repaired", 3)}
    assert encodings.found(d.limit(0), r.limit(0)).count() == 0
    fixed = encodings.restored(d, r).where("origin = 'disputes'").first()
    assert fixed["restored"] == "élève" and fixed["operations"] == ["cp1252>utf-8"]
    assert queries.p5_found(spark, small).count() > 0 and queries.p3_found(spark, small).count() > 0
