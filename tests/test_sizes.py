"""Work that grows with the input: long lines, full pages, many copies; results against the plain way."""

import random
import time

from pyspark.sql import functions as F

from lineloom.functions import chords as C
from lineloom.functions import text as T
from lineloom.operators import folds, matching
from lineloom.plans import catalogue


def numbered(spark, *docs):
    return spark.createDataFrame([(d, i, x) for d, lines in enumerate(docs) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")


def lines_of(df):
    out = {}
    for r in df.orderBy("doc_id", "line_no").collect():
        out.setdefault(r["doc_id"], []).append(r["line"])
    return out


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_repeats_of_long_lines(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in "ab")
        assert folds.edit_distance(a, b) == plain_distance(a, b)
    long = "".join(rng.choice("abcdefghij") for _ in range(16_000))
    docs = [[long[:k] + f"x{k}x" + long[k:] for k in range(0, 16_000, 1_000)], ["one line of words here", "one line of wards here 1", "one line of words here", "", "one line of words here"]]
    began = time.time()
    got = lines_of(folds.collapse_near_repeats(numbered(spark, *docs)))
    assert time.time() - began < 60
    assert len(got[0]) == 1 and got[1] == ["one line of words here", "", "one line of words here"]


def boxes_of(rng, n, wide=900, high=700):
    """``(left, right, top, bottom)``, drawn to meet now and then."""
    out = []
    for _ in range(n):
        left, top = float(rng.randrange(wide)), float(rng.randrange(high))
        out.append((left, left + rng.randint(4, 90), top, top + rng.randint(4, 30)))
    return out


def plain_dedupe(rows, least):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[2], r[1])):
        box = (*r[2:6], r[6])
        same = next((k for k, q in enumerate(kept) if folds.same_region((*q[2:6], q[6]), box, least)), None)
        if same is None:
            kept.append(r)
        elif r[7] + 0.01 * len(r[6] or "") > kept[same][7] + 0.01 * len(kept[same][6] or ""):
            kept[same] = r
    return {(r[0], r[1]) for r in kept}


def regions(spark, rows):
    return spark.createDataFrame([(d, 0, n, *map(float, x)) + (t, float(s)) for d, n, *x, t, s in rows], "doc_id long, page_no int, region_no int, left double, right double, top double, bottom double, text string, score double")


def test_regions_of_full_pages(spark):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        rows += [(d, i, *b, rng.choice(["la", "la la", "Le", "??", None]), rng.random()) for i, b in enumerate(boxes_of(rng, rng.randint(1, 40), 200, 100))]
    for least in (0.2, 0.55, 0.0):
        want = set().union(*(plain_dedupe([r for r in rows if r[0] == d], least) for d in range(60)))
        for most in (512, 8):
            got = {(r["doc_id"], r["region_no"]) for r in folds.drop_duplicate_regions(regions(spark, rows), least, most).collect()}
            assert got == want, (least, most)
    full = [(0, i, *b, "word", 0.5) for i, b in enumerate(boxes_of(rng, 5_000, 9_000, 90_000))] + [(1, i, 0.0, 50.0, 0.0, 20.0, "copy", 0.5) for i in range(5_000)]
    began = time.time()
    assert folds.drop_duplicate_regions(regions(spark, full)).filter("doc_id = 1").count() == 1
    assert time.time() - began < 15


def test_many_lines_of_regions(spark):
    many = spark.range(120_000).select(
        F.expr("id div 2").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(0).alias("line_no"), (F.col("id") % 2).cast("int").alias("region_no"),
        (F.col("id") % 2 * 12.0).alias("left"), (F.col("id") % 2 * 12.0 + 10).alias("right"), F.lit(0.0).alias("top"), F.lit(20.0).alias("bottom"), F.when(F.col("id") % 4 < 2, "la").otherwise("A").alias("text"),
    )
    began = time.time()
    got = {r["text"]: r["count"] for r in folds.merge_regions(many).groupBy("text").count().collect()}
    assert time.time() - began < 10
    assert got == {"lala": 30_000, "A": 60_000}
    row = spark.createDataFrame([(1, 0, 0, i, 12.0 * i, 12.0 * i + 10, 0.0, 20.0, t) for i, t in enumerate(["la ", "le", "Am", "lo", " lu", "Li"])], many.schema)
    got = [(r["region_no"], r["text"], r["left"], r["right"]) for r in folds.merge_regions(row).orderBy("region_no").collect()]
    assert got == [(0, "lale", 0.0, 22.0), (1, "Am", 24.0, 34.0), (2, "loluLi", 36.0, 70.0)]


def plain_buckets(rows, least=8.0, share=0.62):
    lines, out = [], {}
    for n, _, _, top, bottom in sorted(rows, key=lambda r: (r[3], r[1], r[0])):
        c, h = (top + bottom) / 2, bottom - top
        near = min(range(len(lines)), key=lambda i: (abs(lines[i][0] - c), i), default=-1)
        if near >= 0 and abs(lines[near][0] - c) <= max(least, share * max(h, lines[near][1])):
            x, y, k = lines[near]
            lines[near] = [(x * k + c) / (k + 1), (y * k + h) / (k + 1), k + 1]
        else:
            near = len(lines)
            lines.append([c, h, 1])
        out[n] = near
    return out


def test_lines_of_long_pages(spark):
    rng = random.Random(7)
    pages = [[(i, *b) for i, b in enumerate(boxes_of(rng, rng.randint(1, 60), 50, high))] for high in (30, 90, 400, 900) for _ in range(15)]
    rows = [(d, i, *b, "", 0) for d, page in enumerate(pages) for i, *b in page]
    got = {(r["doc_id"], r["region_no"]): r["line_no"] for r in folds.bucket_regions(regions(spark, rows)).collect()}
    assert got == {(d, n): k for d, page in enumerate(pages) for n, k in plain_buckets(page).items()}
    long = [(0, i, 0.0, 9.0, 20.0 * i, 20.0 * i + 10, "", 0) for i in range(16_000)]
    began = time.time()
    assert folds.bucket_regions(regions(spark, long)).agg(F.max("line_no")).first()[0] == 15_999
    assert time.time() - began < 10


def test_lines_of_many_pages(spark):
    words = spark.range(200_000).select(F.expr("id div 4").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("id") % 4).cast("int").alias("word_no"), F.lit(0.0).alias("left"), F.expr("array(10.0D, 11.5D, 13.0D, 30.0D)[cast(id % 4 as int)]").alias("bottom"))
    began = time.time()
    got = {(r["word_no"], r["line_no"]): r["count"] for r in folds.cluster_lines(words).groupBy("word_no", "line_no").count().collect()}
    assert time.time() - began < 10
    # From the top: 30 alone, then 13 and 11.5; 10 is 2.25 from their mean.
    assert got == {(3, 0): 50_000, (2, 1): 50_000, (1, 1): 50_000, (0, 2): 50_000}


def test_even_placement_as_sql(spark, tmp_path):
    texts = ["", None, "a b c", "a\x0bb c", "one two", " \tx"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(d, n, 0, 0) for d in range(6) for n in (1, 2)] + [(4, None, 5, 1), (4, 2, None, 0), (4, 2, 1, 0)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["doc_id"]: r["line"] for r in catalogue.even_placement(spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: "[C]a b [C]c", 3: "[C]a\x0bb [C]c", 4: "[C][C][Am]one [H7]two", 5: "[C][C]x"}


def test_many_chords_on_a_long_line(spark):
    df = spark.createDataFrame([("la " * 6_000, "\t".join(["C"] * 3_000))], "lyric string, chords string")
    began = time.time()
    got = df.select(C.insert_at(F.col("lyric"), C.positions(F.col("chords"))).alias("x")).first()["x"]
    assert time.time() - began < 20
    assert got.count("[C]") == 3_000 and got.replace("[C]", "") == "la " * 6_000 and got.startswith("[C]la la la la [C]la")
    df = spark.createDataFrame([("ab", [(-1, "x"), (1, "y"), (0, "z"), (9, "w"), (1, "v"), (2, None)]), ("", [(3, "x"), (0, "y")])], f"lyric string, placed {C.ANCHOR}")
    assert [r[0] for r in df.select(C.insert_at(F.col("lyric"), F.col("placed"))).collect()] == ["[x][z]a[y][v]b[w]", "[x][y]"]


def test_companions_of_many_copies(spark):
    rng = random.Random(9)
    rows = [(i % 50 if i % 9 == 0 else i, rng.choice(["red ring", "red rings", "red ring 7", "bolt", "old bolts", "", None, "!!"]), f"b{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, block string")

    def key(name):
        return "".join(c for c in (name or "") if c.isalpha())

    def score(a, b):
        return (1.0 if a == b else 0.0 if not a or not b else 1 - plain_distance(a, b) / max(len(a), len(b))) + (0.15 if a and b and (a in b or b in a) else 0.0)

    want = {}
    for i, a, x in rows:
        for j, b, y in rows:
            if x == y and i != j and score(key(a), key(b)) > 0.72:
                want[i] = max(want.get(i, (0, 0)), (score(key(a), key(b)), -j))
    got = {r["id"]: (r["score"], -r["other"]) for r in matching.companions(df, df, "block").collect()}
    assert got == want
    # A block of 40,000 rows and one name has as many answers, not their square of pairs.
    many = spark.range(40_000).select("id", F.lit("one name").alias("name"), F.lit("b").alias("block"))
    began = time.time()
    assert matching.companions(many, many, "block").groupBy("other").count().orderBy("other").collect() == [(0, 39_999), (1, 1)]
    assert time.time() - began < 20


def alike_plainly(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else 0.9 if a in b or b in a else 1.0 - plain_distance(a, b) / max(len(a), len(b))


def test_best_lines_of_all_documents_of_a_block(spark):
    rng = random.Random(11)
    rows = []
    for d in range(14):
        rows += [(d, i, "".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.choice([0, 1, 3, 9, 30, 70])))) for i in range(rng.randint(1, 14))]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    # Blocks of two, of three and of five documents; with all of them no donor is left out.
    for size in (2, 3, 5):
        df = lines.withColumn("block", F.floor(F.col("doc_id") / size))
        want = {}
        for d, i, a in rows:
            best = max(((alike_plainly(a, b), -e, -j) for e, j, b in rows if e // size == d // size and e != d), default=(0,))
            if best[0] >= 0.32:
                want[d, i] = (-best[2], best[0])
        for donors in (df, df.select("*")):
            got = {(r["doc_id"], r["line_no"]): (r["donor_no"], r["similarity"]) for r in matching.best_lines(df, donors, "block").collect()}
            assert got == want, size


def test_best_lines_of_long_documents(spark):
    rng = random.Random(13)
    rows = [(d, i, "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(100, 300))), 0) for d in range(2) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string, block int")
    began = time.time()
    assert matching.best_lines(df, df, "block", 0.05).count() == 500
    assert time.time() - began < 15


def test_counts_as_patterns_have_them(spark):
    rng = random.Random(17)
    marks = "aÄß Z9٣-_[](){}\t\n\x0b\x85\xa0  　​\U0001f600\U00010400.,'é"
    lines = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", " \n ", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    c, x = F.col("line"), F.coalesce("line", F.lit(""))
    pairs = [(T.letters(c), r"\p{L}"), (T.digits(c), r"\p{Nd}"), (T.uppers(c), r"\p{Lu}"), (T.symbols(c), r"[^\p{L}\p{Nd}\s]"), (T.symbols(c, r"\[\]"), r"[^\p{L}\p{Nd}\s\[\]]")]
    same = [a == F.regexp_count(x, F.lit(p)) for a, p in pairs] + [T.stripped(c) == F.regexp_replace(x, r"(?U)^\s+|\s+$", "")]
    assert all(all(r) for r in df.select(*same).collect())


def test_chord_lines_among_prose(spark):
    prose = spark.range(60_000).select(F.concat(F.lit("it was a line of prose with some words in it, number "), F.col("id").cast("string"), F.lit(" and a few more words than that")).alias("line")).cache()
    prose.count()
    began = time.time()
    assert prose.filter(C.is_chord_only(F.col("line"))).count() == 0
    assert prose.filter(F.size(C.chord_tokens(F.col("line"))) > 1).count() == 60_000
    assert time.time() - began < 10
    cases = {"C  Am": True, "(C) [Am]": True, "C ---": True, "---": False, "": False, "C word": False, "h e": True, "Bim A/Bb": True, "#C": False, "9 C": False}
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r[0]: r[1] for r in rows.select("line", C.is_chord_only(F.col("line"))).collect()} == cases
