"""Scalar functions against small tables of cases, thresholds at, below and above."""

import pytest
from pyspark.sql import functions as F

from lineloom.functions import chords as C
from lineloom.functions import lines as L
from lineloom.functions import sections as S
from lineloom.functions import similarity as M
from lineloom.functions import text as T


def values(spark, f, xs):
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


CASES = [
    (C.clean, {"Bim": "Bm", "Blsus4": "Bsus4", "Cma7": "Cmaj7", "Gi7": "G7", "Ah": "A", "e": "Em", "E": "E", "(G)": "G", "Di9": "D9", "": ""}),
    (C.german, {"B": "H", "Bb": "B", "Bm": "Hm", "B7": "H7", "Bm/F#": "Hm/F#", "A/B": "A/H", "A/Bb": "A/B", "Bm/B": "Hm/B", "C": "C"}),
    (C.is_chord, {"C": True, "Cmaj7": True, "F#m7": True, "Am/G": True, "Cis": True, "X": False, "Cadd9": True, "am": True, "hello": False}),
    (C.is_valid_bracket, {"[Am]": True, "[t]": False, "[h]": False, "[D/F#]": True, "[1t]": False, "[B♭]": True}),
    (C.root, {"F#m": "F#", "Bb": "Bb", "x": None, None: None}),
    (C.is_chord_only, {"C  G Am": True, "C hello": False, "": False}),
    (C.is_bare_row, {"A #": True, "F m": True, "B m D E": True, "[A]": False, "no way": False}),
    (C.is_mostly_chords, {"C G la": True, "C la la": False, "C": False, "A B C D E F": False, "Am B C D E F#": True}),
    (C.is_dominant, {"C G la": False, "C G Am la": True, "la": False}),
    (C.is_likely, {"C la": True, "la le": False, "": True}),
    (C.has_chords, {"a [C] b": True, "C G": True, "la": False}),
    (lambda c: F.size(C.segments(c)), {"C G la le Am": 3, "": 0, "la": 1}),
    (lambda c: C.paragraph_chords(c, F.split(c, "/")), {"C G": ["C", "G"], "C/G": ["C/G"], "la le": None, "la/C": None}),
    (lambda c: F.size(C.only_tokens(c)), {"C G": 2, "C la": None}),
    (L.is_staff_noise, {"": True, "a === b": True, "plain words": False, "|| x": True}),
    (L.is_short_tokens, {"a b c d e f": True, "a b c d e word": False}),
    (L.is_lyric, {"1. la la la": False, "la la la la la": True}),
    (L.is_lyric_start, {"1. lala lala": True, "short one": False, "long enough to begin": True, "has 1 digit in the line": False}),
    (L.is_body_garbage, {"": True, "this is a fine line of words here": False}),
    (L.is_note_noise, {"=== ---- ===": True, "this is a fine line of words here": False}),
    (L.is_chord_noise, {"la la": True, "C G": False, "C": True}),
    (L.is_fragmented, {"a 1 b c": True, "whole words in here": False}),
    (L.is_footer_credit, {"Anna und Bernd": True, "Rights: somebody": True, "Anna und Bernd 1999": False, "la la la la": False, "und so": False}),
    (L.is_lowercase_lead, {"and so it goes": True, "And so it goes": False, "and so": False}),
    (L.is_noisy_lead, {"a b c d": True, "words of some length": False, "a1 b2": True}),
    (L.is_mostly_noise, {"===": True, "12": False, "fine": False}),
    (L.is_section_label, {"Vers 1": True, "Refrain:": True, "la": False}),
    (L.is_solo, {"solo C G": True, "solo": False}),
    (L.is_fragmented_words, {"A b C d ef gh": True, "five words of some length here": False}),
    (lambda c: L.is_title_candidate(c, F.lit("My file")), {"A fine title": True, "my file": True, "x1": False, "[C] title here": False}),
    (lambda c: L.is_region_noise(c, F.lit(0.9), F.lit(9.0), F.lit(9.0)), {"la": False, "": True, "12": True, "a1": False, "#%&*": True, "#%&* abcd": False, "#%& a": False}),
    (lambda c: S.prefers_name(c, F.lit("Two words")), {"Tw!!": True, "Other title": False}),
    (lambda c: S.is_title_fragment(c, F.lit("a mighty fortress")), {"a mighty fortres": True, "something else": False, "short": False}),
    (lambda c: S.prefix_section(c, 20), {"Vers 25": "Vers 2", "Vers 3": "Vers 3", "Bridge x": "Bridge", "la": None, "Refrain": "Chorus"}),
    (lambda c: S.title_penalty(c), {"": 40.0, "Fine title": 0.0, "Title 1": 18.0, "Who?": 18.0}),
    (lambda c: S.format_comment(c), {"verse 2": "{comment: verse 2}", "pre_chorus": "{comment: pre chorus}"}),
    (lambda c: F.size(S.metadata(c)), {"Text: a; Melodie: b": 2, "© me": 1, "la": 0}),
    (C.strip_chords, {"[C]la [G]le": "la le"}),
    (C.drop_invalid, {"[C]la [t]le [1t]lo": "[C]la le lo"}),
    (T.phrase_key, {"Größe, 1!": "grosse1", None: ""}),
    (T.normal_space, {"a  b , c": "a b, c", "  x ": "x", None: ""}),
    (T.join_hyphens, {"Weih - nachts": "Weihnachts", "a-b-c": "abc", "x - 1": "x - 1"}),
    (T.strip_accents, {"éàü": "eau"}),
    (T.escape_marks, {"{a}[b]": r"\{a\}\[b\]"}),
    (T.artefacts, {"Gegenwartf": "Gegenwart", "Wegen.1": "Wegen!", "a – b": "a - b"}),
    (T.drop_leading_noise, {"a / b word here": "word here", "a word here now": "a word here now", "a b c d": ""}),
    (L.is_garbage, {"": False, "x": True, "ab": False, "=~|%$ ab": True, "{=~|&}": False, "[Am] =~|": False, "a=": False, "=": True}),
    (L.is_structure_comment, {"{comment: Vers 2}": True, "{comment: Chorus}": True, "{comment: la}": False, "{comment: verse 2}": True}),
    (L.is_verse_number, {"1. la": True, "l) la": True, "la": False}),
    (L.is_gibberish, {"plain words in a line": False, "a1 b2 c3": True, "#### ####": True}),
    (S.single_word_label, {"Chorus:": "chorus", "hello": None, "Bridge": "bridge", "two words": None}),
    (S.structure_marker, {"Vers 3": "Vers 3", "Vers 12": None, "D.C. al Fine": "D.C. al Fine", "Fine": "Fine", "chorus": "Chorus"}),
    (S.section_type, {"Refrain": "Chorus", "strophe": "Vers", "my part": "My Part"}),
    (S.clean_title, {"My_song  -": "My song"}),
    (lambda c: S.directive(c, "title"), {"{title: A b}": "A b", "{TITLE:x}": "x", "title: x": None}),
    (lambda c: S.parse_label(c)["section"], {"Refrain: la": "chorus", "Vers 2": "verse 2", "3) la": "verse 3", "Outro: la": None, "Outtro: la": "outtro", "Solo. la": "solo", "Refr. la": "chorus", "12 la": None, "la la": None, "ain la": "chorus"}),
    (lambda c: S.verse_prefix(c)["rest"], {"2. text": "text", "text": "text"}),
    (lambda c: S.header_line(c)["key"], {"Melodie: X": "composer", "Title: y": "title", "Foo: z": None}),
    (lambda c: C.split_leading(c)["rest"], {"C G la le": "la le", "C la le": None, "C G": None}),
    (lambda c: F.array_join(C.merge_split(F.split(c, " ")), " "), {"C m G 7": "Cm G7", "C G": "C G", "m": "m"}),
    (lambda c: F.array_join(C.carry_minor(F.split(c, " ")), " "), {"Am D G": "Am Dm G", "A D G": "A D G", "Am D E G": "Am Dm Em G"}),
    (lambda c: F.array_join(C.retokenize(c), " "), {"C is G 7 A /E": "Cis G7 A/E", "": "", "la": "la"}),
    (lambda c: C.anchors(c)["pos"], {"[C]la [G]le": [0, 3], "la": []}),
    (lambda c: C.positions(c)["pos"], {"\tC\tG": [12, 24], "C  G": [0, 3]}),
    (lambda c: T.word_spans(c)["start"], {"la  le": [0, 4], "": []}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(spark, k):
    f, cases = CASES[k]
    assert values(spark, f, list(cases)) == list(cases.values())


def test_even_placement(spark):
    def at(chords, words):
        df = spark.createDataFrame([(chords, words)], "c array<string>, w array<string>")
        return [r["at"] for r in df.select(C.even_placement(F.col("c"), F.col("w")).alias("p")).first()["p"]]

    assert at(["a", "b", "c"], list("vwxyz")) == [0, 2, 4]
    assert at(["a", "b", "c", "d"], list("xyz")) == [0, 1, 1, 2]
    assert at(["a", "b", "c"], list("xy")) == [0, 0, 1]  # halves go to the even word
    assert at(["a"], list("xy")) == [0]
    assert at(["a"], []) == []


def test_insert_at(spark):
    df = spark.createDataFrame([("lala", [(0, "C"), (2, "G"), (9, "D")])], "t string, p array<struct<pos:int,chord:string>>")
    assert df.select(C.insert_at(F.col("t"), F.col("p")).alias("x")).first()["x"] == "[C]la[G]la[D]"


def test_similarity(spark):
    def one(f, a, b):
        return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first()["x"]

    assert round(one(M.edit_similarity, "abc", "abd"), 4) == 0.6667
    assert one(M.edit_similarity, "", "") == 1.0 and one(M.edit_similarity, "", "a") == 0.0
    assert one(M.word_jaccard, "the big house", "big house here") == 0.5
    assert one(M.lyric_similarity, "abcd", "bc") == 0.9
    assert one(M.near_duplicate, "abcdefgh", "abcdefxy") is True  # 0.75
    assert one(M.near_duplicate, "abcdefg", "abcdefx") is False  # too short
