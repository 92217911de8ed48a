"""Operators over small line streams and boxes."""

import zipfile
from io import BytesIO

import numpy as np
from pyspark.sql import functions as F

from lineloom.operators import cleaner, folds, images, matching, scoring
from lineloom.operators import sequence as W
from lineloom.plans import convert
from lineloom.sources import files
from lineloom.streaming import folder


def doc(spark, *lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")


def text(df):
    return [r["line"] for r in df.orderBy("doc_id", "line_no").collect()]


def test_lines_round_trip(spark):
    d = spark.createDataFrame([(1, "a\r\nb\n\nc"), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in W.explode_lines(d).orderBy("doc_id", "line_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (1, 3, "c"), (2, 0, "")]
    assert {r["doc_id"]: r["text"] for r in W.join_lines(W.explode_lines(d)).collect()} == {1: "a\nb\n\nc", 2: ""}


def test_blanks_and_comments(spark):
    assert text(W.collapse_blanks(doc(spark, "a", "", " ", "", "b", ""))) == ["a", "", "b", ""]
    assert text(W.drop_repeated_comments(doc(spark, "{c: x}", "{c: x}", "la", "{c: x}"))) == ["{c: x}", "la", "{c: x}"]
    d = doc(spark, "{comment: Chorus}", "{comment: Vers 1}", "la", "{comment: Vers 2}")
    assert text(W.drop_empty_comments(d)) == ["{comment: Vers 1}", "la"]


def test_merge_chord_rows(spark):
    d = doc(spark, "C", "", "G", "", "la la la").withColumn("is_chord", F.col("line").isin("C", "G"))
    assert text(W.merge_chord_rows(d)) == ["C G", "la la la"]


def test_sections(spark):
    rows = [(0, "la", None, False), (1, "Chorus", "chorus", True), (2, "le", None, False), (3, "", None, False), (4, "lo", None, False), (5, "lu", None, False)]
    d = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, line_no int, line string, explicit string, is_label boolean")
    got = {r["line"]: r["section"] for r in W.assign_sections(d).collect()}
    assert got == {"la": "verse 1", "le": "chorus", "lo": "verse 2", "lu": "verse 2"}


def test_pairs(spark):
    d = doc(spark, "C G", "", "Vers 1", "la", "Am", "D", "le").withColumn("is_chord", F.col("line").isin("C G", "Am", "D")).withColumn("is_label", F.col("line") == "Vers 1")
    assert {(r["chords"], r["lyric"]) for r in W.pair_chords(d).collect()} == {("C G", "la"), ("Am", None), ("D", "le")}


def test_bands_and_staves(spark):
    def systems(*centres):
        b = spark.createDataFrame([(1, i, float(c)) for i, c in enumerate(centres)], "doc_id long, band int, centre double")
        return [r["spacing"] for r in W.staff_systems(b, F.lit(1000.0)).collect()]

    assert systems(10, 20, 30, 40, 50) == [10.0]
    assert systems(10, 20, 30, 40, 80) == []
    rows = spark.createDataFrame([(1, y) for y in (1, 2, 8, 20)], "doc_id long, y int")
    assert sorted((r["top"], r["bottom"]) for r in W.row_bands(rows).collect()) == [(1, 8), (20, 20)]


def test_otsu(spark):
    h = spark.createDataFrame([(10, 5), (12, 5), (200, 9)], "bin int, n long")
    assert W.otsu(h).first()["threshold"] == 12
    assert W.otsu(spark.createDataFrame([(10, 5)], "bin int, n long")).first()["threshold"] == 128


def test_footer_title_key(spark):
    d = doc(spark, "My song (a test)", "C G", "la la", "Text: someone", "© 1999 others")
    assert text(W.footers(d)) == ["la la", "Text: someone", "© 1999 others"]
    t = W.title_of(d).first()
    assert (t["title"], t["subtitle"]) == ("My song", "a test")
    assert W.key_of(doc(spark, "x y", "Am/G C")).first()["key"] == "Am"


def test_nearest_above(spark):
    box = "doc_id long, page_no int, line_no int, left double, top double, right double, bottom double"
    lyrics = spark.createDataFrame([(1, 1, 5, 0.0, 200.0, 100.0, 210.0), (1, 1, 6, 0.0, 700.0, 100.0, 710.0), (1, 2, 7, 0.0, 200.0, 100.0, 210.0)], box)
    chords = spark.createDataFrame([(1, 1, 1, 0.0, 100.0, 50.0, 110.0), (1, 1, 2, 0.0, 180.0, 50.0, 190.0), (1, 1, 3, 300.0, 190.0, 350.0, 199.0), (1, 1, 4, 0.0, 20.0, 9.0, 20.0)], box)
    got = {(r["page_no"], r["line_no"]): r["chord_no"] for r in matching.nearest_above(lyrics, chords).collect()}
    assert got == {(1, 5): 2, (1, 6): None, (2, 7): None}


def test_overlap_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(1, 1, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(1, 200, (60, 4)))]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, region_no int, left double, top double, right double, bottom double")

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h) if w > 0 and h > 0 else 0

    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and iou(a, b) >= 0.3}
    got = [(r["a"], r["b"]) for r in matching.overlapping(df, least=0.3).collect()]
    assert set(got) == want and len(got) == len(want)


def test_occurrence_and_headers(spark):
    ref = doc(spark, "x", "la", "la")
    got = matching.match_by_occurrence(doc(spark, "la", "la", "la", "y"), ref).orderBy("line_no").collect()
    assert [r["ref_no"] for r in got] == [1, 2, None, None]
    heads = spark.createDataFrame([(1, "My  Title")], "doc_id long, value string")
    assert text(matching.drop_header_lines(doc(spark, "my title", "la"), heads)) == ["la"]


def test_scores(spark):
    d = spark.createDataFrame([(1, "{title: My song}\n[C]la la la la"), (2, ""), (3, None), (4, "{x: y}")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in scoring.quality_score(d).collect()}
    assert got[1] == 11 + 1 + 8 + 18 + 3 and got[4] is None and got.get(2) is None
    e = {r["doc_id"]: r["empty"] for r in scoring.is_effectively_empty(spark.createDataFrame([(1, "{a: b}"), (2, "x" * 19), (3, "\n".join(["ab"] * 20)), (4, "x" * 20)], "doc_id long, text string")).collect()}
    assert e == {1: True, 2: True, 3: True, 4: False}


def test_best_candidate(spark):
    c = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (2, "layout", 10.0), (2, "plain", 70.0), (3, "layout", 10.0), (3, "plain", 60.0), (4, "a", None)], "doc_id long, source string, score double")
    assert {r["doc_id"]: r["source"] for r in scoring.best_candidate(c, "layout").collect()} == {1: "a", 2: "plain", 3: "layout", 4: "a"}


def test_cleaner(spark):
    d = doc(spark, "=~|%$", "{comment: Chorus}", "la    la le", "{comment: Chorus}", "lo lo lo [t]", "&x", "")
    assert text(cleaner.clean(d)) == ["{comment: Chorus}", "la la le", "lo lo lo", "&x"]
    assert text(cleaner.remove_notation(doc(spark, "&x", "##", "A #", "la", "", "", "[D][A]#"))) == ["la", "", "[D][A]"]


def test_folds(spark):
    d = doc(spark, "hello wonderful world", "hello wonderfull world", "other line here")
    assert text(folds.collapse_near_repeats(d)) == ["hello wonderfull world", "other line here"]
    assert text(folds.join_fragments(doc(spark, "a long line that goes on-", "ward to the end.", "Next one is here and rather long."))) == ["a long line that goes onward to the end.", "Next one is here and rather long."]
    assert folds.strip_marks("éǖ") == "eu"
    assert folds.edit_distance("kitten", "sitting") == 3
    many = spark.createDataFrame([(i // 3, i % 3, f"line {i % 3} of the text {i}") for i in range(900)], "doc_id long, line_no int, line string")
    assert folds.join_fragments(many).select("doc_id").distinct().count() == 300


def test_transfer(spark):
    own = doc(spark, "la la la", "le le le lo")
    donor = doc(spark, "[C]la [G]la la", "[Am]le le [F]le lo")
    assert text(folds.transfer_chords(own, donor)) == ["[C]la [G]la la", "[Am]le le [F]le lo"]


def test_clusters(spark):
    w = spark.createDataFrame([(1, 1, 0, 0.0, 100.0), (1, 1, 1, 9.0, 101.0), (1, 1, 2, 0.0, 90.0)], "doc_id long, page_no int, word_no int, left double, bottom double")
    assert {r["word_no"]: r["line_no"] for r in folds.cluster_lines(w).collect()} == {1: 0, 0: 0, 2: 1}


def test_images():
    page = np.full((400, 600), 255, np.uint8)
    for y in (100, 110, 120, 130, 140):
        page[y, 50:550] = 0
    assert images.looks_like_staff(page)
    assert (images.without_staves(page) == 255).all() and (images.without_rules(page) == 255).all()
    assert not images.looks_like_staff(np.full((400, 600), 255, np.uint8))
    assert (images.decode_pnm(images.encode_pgm(page)) == page).all()


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>C</w:t><w:tab/><w:t>G</w:t></w:r></w:p><w:p><w:r><w:t>la</w:t></w:r><w:r><w:t> le</w:t></w:r></w:p></w:body></w:document>"
    buf = BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "noten.pdf").write_bytes(b"%PDF")
    found = files.with_status(files.input_files(spark, str(tmp_path)))
    assert {(r["kind"], r["status"]) for r in found.collect()} == {("docx", "OK"), ("pdf", "SKIP")}
    rows = files.docx_lines(found.filter("kind = 'docx'")).orderBy("path", "line_no").collect()
    assert [r["text"] for r in rows] == ["C\tG", "la le", ""] and rows[2]["error"].startswith("BadZipFile")
    out = files.write_text_files(spark.createDataFrame([("x/a.docx", "la")], "path string, text string"), str(tmp_path / "out")).collect()
    assert out[0]["written"] and (tmp_path / "out" / "a.docx.converted.cho").read_bytes() == b"\xef\xbb\xbfla"


def test_conversion(spark):
    d = doc(spark, "My song", "Vers 1", "C    G", "la la la", "", "Chorus:", "Am", "le le")
    r = convert.text_to_cho(d).first()
    assert r["status"] == "OK" and "{title: My song}" in r["cho"] and "{key: C}" in r["cho"] and "[C]la la [G]la" in r["cho"] and "{comment: chorus}" in r["cho"]
    assert convert.text_to_cho(doc(spark, "just a title", "words only")).first()["status"] == "SKIP"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "la la la\n## 1 ##")], "doc_id long, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    q = folder.content_by_window(folder.watch(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from counted").first()
    assert (r["content_lines"], r["gibberish_lines"]) == (2, 1)
