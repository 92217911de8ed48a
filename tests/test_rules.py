"""Rules at, below and above their thresholds."""

import pytest
from pyspark.sql import functions as F

from lineloom.functions import chords as C
from lineloom.functions import lines as L
from lineloom.functions import sections as S
from lineloom.functions import text as T
from lineloom.operators import cleaner, folds, scoring
from lineloom.plans import convert


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["v"] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (T.weighted_length, {"": 0, "il|I": 2.2, "mwMW": 5.4, "-/\\": 1.95, ".,:;!": 2.25, "()[]": 2.4, "ABÄ": 3.3, "abc ?'": 6, "Ox": 2.1}),
        (L.is_note_noise, {"": True, "ab ____": True, "ab ___": True, "abc /|/|/| ab": True, "abc [la": False, "a b c d e f": True, "hello there / all of you": False, "C G Am //": False, "1234 ab": True, "123 ab": False}),
        (L.is_lyric_start, {"1. abcdef": True, "1. abcde": False, "abcdefgh ijkl": True, "abcdefgh ijk": False, "abcdefgh ijkl 1": False, "Anna und Bernd": False, "l. abcdef": False, "so a b 1 c d sing": False}),
        (L.is_mostly_noise, {"": True, "12 3": False, "12-3": True, "ab ____": True, "ab ___": False, "abc ___ lalalala": False, "a /b| ........................": True, "— — — — — — viele worte stehen hier": True}),
        (lambda c: L.is_footer_credit(c, ("noel",)), {"by noel me": True, "by joel me": False, "abc und d": True, "ab und": False, "one two und three four five six": False, "a 1 und b": False}),
        (lambda c: C.is_chord(c, "loose"), {"Am7": True, "Csus4": True, "F#m7/C#": True, "H": True, "word": False, "Xm": False, "C/": True}),
        (C.is_mostly_chords, {"C # G": True, "C G": True, "C": False, "C G la la la": False, "C G la": True, "C D E F G A": False}),
        (T.repair_text, {"Weih - nacht": "Weihnacht", " a  b , c ": "a b, c", "a ' b": "a b", "so­ft": "soft"}),
        (T.repair_scan, {"Gegenwartf": "Gegenwart", "3.>Vater": "3. Vater", "al - ler": "aller", "a_b [c] ~d^": "ab c d", "du / ich": "du ich", "eins 0 zwei": "eins zwei", "hallo „wort“ ,": "hallo wort,"}),
        (lambda c: S.header_line(c)["key"], {"Tempo: 90": "tempo", "sorttitle: x": "sorttitle", "Nothing: x": None, "scene: 1": "scene"}),
        (lambda c: S.parse_label(c)["rest"], {"Refrain: la": "la", "ain: la": "la", "Vers 2. la": "la", "3) la": "la", "Teil: la lo": "la lo", "Bridge": "", "Verse la": None}),
        (lambda c: S.header_line(c)["key"], {"Original Key: C": "original_key", "Melodie: x": "composer", "Key:": None, ": x": None}),
        (S.single_word_label, {"Chor": "chor", "Teil:": "teil", "Zwischenspiel": "zwischenspiel", "hello": None}),
    ],
)
def test_boundaries(spark, f, cases):
    got = dict(zip(cases, values(spark, f, cases), strict=True))
    assert {k: round(v, 6) if isinstance(v, float) else v for k, v in got.items()} == cases


def test_region_noise_thresholds(spark):
    rows = [("a1", 0.57, 9.0, 9.0, True), ("a1", 0.58, 9.0, 9.0, False), ("abc", 0.1, 3.9, 9.0, True), ("abc", 0.1, 4.0, 4.0, False), ("a b cde f", 0.54, 9.0, 9.0, True), ("a b cde f", 0.55, 9.0, 9.0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s double, w double, h double, want boolean")
    assert df.filter(L.is_region_noise(F.col("t"), F.col("s"), F.col("w"), F.col("h")) != F.col("want")).count() == 0


def numbered(spark, *texts):
    return spark.createDataFrame([(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t)], "doc_id long, line_no int, line string")


def lines_of(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["doc_id"], []).append(r["line"])
    return out


def test_a_dropped_comment_starts_the_count_anew(spark):
    c = "{comment: Chorus}"
    got = lines_of(folds.drop_repeated_structure(numbered(spark, [c, "a", "b", "", c, "d", "e", c, "f"], [c, "a", "b", "d", "e", c], [c, c, "a"])))
    assert got == {0: [c, "a", "b", "d", "e", "f"], 1: [c, "a", "b", "d", "e", c], 2: [c, c, "a"]}


def test_fragments_join(spark):
    long, open_ = "a line that is long enough!", "this line has no end and is quite long"
    got = lines_of(folds.join_fragments(numbered(spark, ["kurz", "auch kurz"], [long, "Neu beginnt hier, weiter so"], [long, "! nein, das nicht so weiter"], [open_, "Weiter geht es hier und dort"], [long, ": mit Zeichen ist es lang genug"], ["ends with hy-", "phen and so on and on"])))
    assert [len(v) for v in got.values()] == [1, 2, 2, 1, 1, 1] and got[5] == ["ends with hyphen and so on and on"]


def test_regions_of_one_word_merge(spark):
    def region(n, left, right, text, top=0.0, bottom=20.0):
        return (n, 0, 0, left, right, top, bottom, text)

    cases = [
        ([(0, 10, "la"), (18.4, 30, "le")], 1), ([(0, 10, "la"), (18.5, 30, "le")], 2), ([(0, 10, "Am"), (11, 30, "le")], 2), ([(0, 10, "LA"), (11, 30, "LE")], 2),
        ([(0, 10, "la1"), (11, 30, "le")], 2), ([(0, 10, "abcdef"), (12, 30, "Ghijkl")], 2), ([(0, 10, "abcdef"), (11.5, 30, "Ghijkl")], 1), ([(0, 10, "abcdef"), (12, 30, "ghijkl")], 1),
    ]
    rows = [(d, 0, 0, i, float(a), float(b), 0.0, 20.0, t) for d, (rs, _) in enumerate(cases) for i, (a, b, t) in enumerate(rs)]
    rows += [(99, 0, 0, 0, 0.0, 10.0, 0.0, 20.0, "la"), (99, 0, 0, 1, 11.0, 20.0, 5.1, 25.1, "le")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, region_no int, left double, right double, top double, bottom double, text string")
    got = {r["doc_id"]: r["count"] for r in folds.merge_regions(df).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, (_, n) in enumerate(cases)} | {99: 2}
    assert folds.merge_regions(df.filter("doc_id = 0")).first()["text"] == "lale"


def test_regions_read_twice():
    a = (0.0, 10.0, 0.0, 10.0, "Wort")
    assert folds.same_region(a, (0.0, 10.0, 0.0, 10.0, "wort!")) and folds.same_region(a, (0.0, 10.0, 1.0, 11.0, "ein wort"))
    assert folds.same_region(a, (3.5, 13.5, 3.5, 13.5, "wort")) and not folds.same_region(a, (3.6, 13.6, 0.0, 10.0, "Wort x"))
    assert not folds.same_region(a, (3.6, 13.6, 3.0, 13.0, "wort")) and not folds.same_region(a, (0.0, 10.0, 0.0, 10.0, "??"))


def test_chords_come_from_their_section(spark):
    own = ["{comment: Vers 1}", "sing a song of joy", "{comment: Chorus}", "sing a song of joy", "{comment: Bridge}", "over the sea we go"]
    donor = ["{comment: Chorus}", "[C]sing a [G]song of joy", "{comment: vers 1}", "[Am]sing a [F]song of joy", "[Dm]over the [Em]sea we go"]
    got = lines_of(folds.transfer_chords(numbered(spark, own), numbered(spark, donor)))[0]
    assert got == ["{comment: Vers 1}", "[Am]sing a [F]song of joy", "{comment: Chorus}", "[C]sing a [G]song of joy", "{comment: Bridge}", "[Dm]over the [Em]sea we go"]
    # Six chords are enough, and a donor must have three more.
    rich = ["[C]a [C]b [C]c [C]d [C]e [C]f", "sing a song of joy"]
    assert lines_of(folds.transfer_chords(numbered(spark, rich), numbered(spark, donor)))[0] == rich
    assert lines_of(folds.transfer_chords(numbered(spark, own), numbered(spark, donor[:2])))[0] == own


def test_split_words_are_mended(spark):
    got = lines_of(cleaner.repair_fragments(numbered(spark, ["S0 ist meir Ge bet", "ie be unc Ehr Furcht ,  ", "Worte er fullt", "{comment: unc}", "schons tes En de", ""])))[0]
    assert got == ["so ist mein Gebet", "Liebe und Ehrfurcht,", "Die Worte erfüllt", "{comment: unc}", "schönstes Ende", ""]


def test_german_names_in_the_conversion(spark):
    h = ["Lied", "H  Em  H  B", "sing a song of joy"]
    df = numbered(spark, h, ["Song", "B  Em  B  H", "sing a song of joy"])
    got = {r["doc_id"]: r["cho"] for r in convert.text_to_cho(df).collect()}
    assert got[0].count("[H]") == 3 and "[B]" not in got[0] and got[1].count("[B]") == 2
    off = {r["doc_id"]: r["cho"] for r in convert.text_to_cho(df, convert.Options(use_german_notation=False)).collect()}
    assert "[B]" in off[0]
    lone = convert.text_to_cho(numbered(spark, ["Lied", "la la la la", "C  G"])).first()["cho"]
    assert lone.rstrip().endswith("[C] [G] ----")


def test_images_only(spark):
    out = convert.text_to_cho(numbered(spark, ["Only a title"], ["T", "C  G", "la la"]))
    images = spark.createDataFrame([(0,), (1,)], "doc_id long")
    got = {r["doc_id"]: (r["status"], r["message"]) for r in convert.images_to_status(out, images).collect()}
    assert got[0] == ("SKIP", "image only") and got[1] == ("OK", None)
    kept = {r["doc_id"]: r["message"] for r in convert.images_to_status(out, images, convert.Options(abort_on_image_only=False)).collect()}
    assert kept[0] == "no text"


def test_post_processing(spark):
    c = "{comment: Chorus}"
    text = ["", "Sing a song of joyful days", "Sing a song of joyful day5", "", "", c, c, "Another line of words here", "Anna und Bernd", "{comment: Vers 1}"]
    assert lines_of(convert.post_processed(numbered(spark, text)))[0] == ["Sing a song of joyful days", "", c, "Another line of words here"]


def test_letters_that_begin_together(spark):
    rows = [(0, 0, 5.0, 1.0, 3.0, "b"), (0, 0, 5.0, 1.0, 2.0, "a"), (0, 0, 5.0, 1.0, 3.0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, bottom double, left double, right double, letter string")
    assert {scoring.letters_to_lines(df.repartition(3)).first()["line"] for _ in range(3)} == {"abc"}
