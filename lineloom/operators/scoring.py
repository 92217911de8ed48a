"""Document scores and the choice of the best candidate.  One pass over lines, then one aggregation by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import sections as S
from ..functions.text import count, digits, letters, once, stripped, symbols
from .sequence import explode_lines

#: Characters that no song text holds, those of staves, and runs that only rubbish has.  Fixed values.
WEIRD = r"[^\p{L}\p{Nd}\s\[\](){}:;,.!?\"'`+\-*/#&%|=°♭♯]"
RULES = "[=_|—–]"
RUNS = r"[=_]{3,}|[-–—]{6,}|\|{4,}|\\{3,}|/{3,}|\*{4,}"


def line_profile(lines: DataFrame) -> DataFrame:
    """Counts of letters, digits, capitals, symbols and tokens of each line."""
    from ..functions.text import tokens, uppers

    line = F.col("line")
    return lines.select("doc_id", "line_no", F.length("line").alias("n_chars"), letters(line).alias("n_letters"), digits(line).alias("n_digits"), uppers(line).alias("n_upper"), symbols(line).alias("n_symbols"), F.size(tokens(line)).alias("n_tokens"))


def _counted(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def quality_score(documents: DataFrame, expected: str | None = None, source: str | None = None) -> DataFrame:
    """``(doc_id, content_lines, gibberish_lines, score)`` of ``documents(doc_id, text, ...)``.

    Letters, chords, comments and lines count for a document; weird characters, lines of digits,
    scraps, gibberish, a suspicious first line and a poor title against it.  Documents without a
    content line have no score (null).  ``expected`` and ``source`` name columns, if there are any.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n", "\n")
    totals = documents.select("doc_id", text.alias("text"), *[F.col(c) for c in (expected, source) if c])
    line = stripped(F.col("line"))
    rows = explode_lines(totals).withColumn("line", line)
    content = L.is_content(F.col("line"))
    agg = rows.groupBy("doc_id").agg(
        F.coalesce(F.sum(letters(F.col("line"))), F.lit(0)).alias("n_letters"),
        F.sum(F.regexp_count("line", F.lit(r"\[[^\]]+\]"))).alias("n_chords"),
        F.sum(F.regexp_count("line", F.lit(r"(?i)\{comment:\s*[^}]+\}"))).alias("n_comments"),
        F.sum(F.regexp_count("line", F.lit(r"[_|~^\x{FFFD}]"))).alias("n_weird"),
        _counted(content).alias("content_lines"),
        _counted(content & (digits(F.col("line")) > letters(F.col("line")))).alias("n_digit_lines"),
        _counted(content & (F.length("line") <= 4)).alias("n_short"),
        _counted(content & L.is_score_gibberish(F.col("line"))).alias("gibberish_lines"),
        F.min_by(L.is_suspicious_first(F.col("line")), F.when(content, F.col("line_no"))).alias("suspicious"),
        F.min_by(S.directive(F.col("line"), "title"), F.when(S.directive(F.col("line"), "title").isNotNull(), F.col("line_no"))).alias("title"),
        F.min_by(S.directive(F.col("line"), "subtitle"), F.when(S.directive(F.col("line"), "subtitle").isNotNull(), F.col("line_no"))).alias("subtitle"),
    )
    penalty = S.title_penalty(F.coalesce("title", F.lit("")), F.col(expected) if expected else None)
    if expected or source:
        agg = agg.join(documents.select("doc_id", *[c for c in (expected, source) if c]), "doc_id")
    score = (
        F.col("n_letters") + F.col("n_chords") * 18.0 + F.col("n_comments") * 4.0 + F.col("content_lines") * 3.0
        - F.col("n_weird") * 6.0 - F.col("n_digit_lines") * 10.0 - F.col("n_short") * 4.0 - F.col("gibberish_lines") * 35.0
        - F.when(F.coalesce("suspicious", F.lit(False)), 60.0).otherwise(0.0) - penalty
        - F.when(digits(F.coalesce("subtitle", F.lit(""))) > 0, 8.0).otherwise(0.0)
        + (F.when(F.lower(F.col(source)) == "layout-ocr", 10.0).otherwise(0.0) if source else F.lit(0.0))
    )
    keep = [c for c in (expected, source) if c]
    return agg.select("doc_id", *keep, "content_lines", "gibberish_lines", F.when(F.col("content_lines") > 0, score).alias("score"))


def line_counts(documents: DataFrame) -> DataFrame:
    """Gibberish, fragmented and numbered lines of each document."""
    rows = explode_lines(documents).withColumn("line", stripped(F.col("line")))
    line = F.col("line")
    content = L.is_content(line)
    return rows.groupBy("doc_id").agg(
        _counted(content & L.is_gibberish(line)).alias("n_gibberish"),
        _counted(content & L.is_fragmented_words(line)).alias("n_fragmented"),
        _counted(line.rlike(L.VERSE)).alias("n_numbered"),
    )


def text_score(text: Column) -> Column:
    """Score of raw recognised text, for choosing among recognitions of one page."""
    from ..functions.text import tokens

    t = F.coalesce(text, F.lit(""))
    parts = tokens(t)
    chords = F.size(F.filter(parts, lambda x: x.rlike("^[A-H][#b]?(?:m|maj|sus|dim|aug)?[245679]?$")))
    single = F.size(F.filter(parts, lambda x: F.length(x) == 1))
    return (
        letters(t) + 0.25 * digits(t) + 1.2 * count(t, " ") + 2.0 * count(t, "\n") + 20.0 * chords + 8.0 * count(t, "[äöüÄÖÜß]") + 3.0 * count(t, r"\p{L}{4,}")
        - 3.0 * count(t, r"[^\p{L}\p{Nd}\s.,;:!?'\"()\[\]#/&-]") - 1.5 * single
    )


def is_effectively_empty(documents: DataFrame) -> DataFrame:
    """``(doc_id, empty)``: no content lines, under 20 characters in them, or under 3 a line."""
    rows = explode_lines(documents).withColumn("line", stripped(F.col("line"))).withColumn("c", L.is_content(F.col("line")))
    agg = rows.groupBy("doc_id").agg(_counted(F.col("c")).alias("n"), F.sum(F.when(F.col("c"), F.length("line")).otherwise(0)).alias("chars"))
    return agg.select("doc_id", ((F.col("n") == 0) | (F.col("chars") < 20) | (F.col("chars") / F.greatest("n", F.lit(1)) < 3.0)).alias("empty"))


def notation_ratios(documents: DataFrame, lines: int = 80, tokens: int = 600) -> DataFrame:
    """Character and token ratios of the first content lines, and whether they look like notation."""
    rows = explode_lines(documents).withColumn("line", stripped(F.col("line"))).filter(L.is_content(F.col("line")))
    # The first lines only, as the feature asks; lines are kept as an array so that one group is one row.
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).filter(F.col("__n") <= lines)
    sample = first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("s"))
    s = F.col("s")
    total, n = count(s, r"\S"), letters(s)
    score = count(s, RULES)
    weird = count(s, WEIRD)
    parts = F.slice(F.filter(F.split(s, r"\s+"), lambda t: t != ""), F.lit(1), F.lit(tokens))
    bare = F.transform(parts, lambda t: F.regexp_replace(t, "^[\\[\\](){},.;:\"'`]+|[\\[\\](){},.;:\"'`]+$", ""))

    def junk(t: Column) -> Column:
        # What takes no pattern comes first, and marks are all that is neither letter nor digit.
        marked = once(F.length(F.regexp_replace(t, r"[\p{L}\p{Nd}]+", "")), lambda n: (n >= 2) & (n >= F.floor(F.length(t) / 2)))
        return (t == "") | ((F.length(t) <= 2) & ~F.lower(t).isin(*L.SHORT_WORDS)) | ~t.rlike(r"[\p{L}\p{Nd}]") | t.rlike("[=_¥]") | marked

    junk_share = once(bare, lambda b: F.size(F.filter(b, junk)) / F.greatest(F.size(b), F.lit(1)))
    runs = s.rlike(RUNS)
    out = sample.select("doc_id", (n / total).alias("letter_ratio"), (weird / total).alias("weird_ratio"), (score / total).alias("score_ratio"), junk_share.alias("junk_ratio"), runs.alias("runs"))
    a, b, c, d = (F.col(x) for x in ("letter_ratio", "weird_ratio", "score_ratio", "junk_ratio"))
    notation = (b > 0.45) | ((c > 0.15) & ((a < 0.70) | (b > 0.15))) | ((d > 0.35) & (F.col("runs") | (c > 0.10) | (b > 0.25))) | (F.col("runs") & ((a < 0.55) | (b > 0.25)))
    return out.withColumn("notation", notation)


def best_candidate(candidates: DataFrame, prefer: str | None = None, floor: float = 40.0, lead: float = 55.0) -> DataFrame:
    """Of each document the candidate of best score, ties to the smaller source name.

    With ``prefer``, that source wins unless it scores below ``floor`` and another leads by ``lead``.
    """
    best = candidates.groupBy("doc_id").agg(
        F.max(F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("score"), F.when(F.col("source") == (prefer or ""), 1).otherwise(0).alias("p"))).alias("__b"),
        F.min_by("source", F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "source")).alias("__source"),
        F.max(F.when(F.col("source") == (prefer or ""), F.col("score"))).alias("__own"),
    )
    if prefer is None:
        return best.select("doc_id", F.col("__source").alias("source"), F.col("__b.score").alias("score"))
    stay = F.col("__own").isNotNull() & ~((F.col("__own") < floor) & (F.col("__b.score") >= F.col("__own") + lead))
    return best.select("doc_id", F.when(stay, F.lit(prefer)).otherwise(F.col("__source")).alias("source"), F.when(stay, F.col("__own")).otherwise(F.col("__b.score")).alias("score"))


def accept_donor(pairs: DataFrame) -> DataFrame:
    """What becomes of a dump of the same pages: ``choice`` is ``merged``, ``donor`` or ``own``; the first rule that fits.

    ``pairs`` holds ``score, fragments, chords, chorus`` of both sides (the donor's with ``donor_`` before
    them) and ``merged_score, merged_chords``.
    """
    c = F.col
    richer = ~c("chorus") | (c("donor_chords") >= c("chords") + 2)
    clearer = (c("fragments") >= c("donor_fragments") + 2) & c("donor_chorus") & richer & (c("donor_score") >= c("score") - 8)
    choice = F.when((c("merged_score") > c("score") + 8) | (c("merged_chords") > c("chords")), "merged").when((c("donor_score") > c("score") + 18) | clearer, "donor").otherwise("own")
    return pairs.withColumn("choice", choice)


def accept_companion(pairs: DataFrame) -> DataFrame:
    """As :func:`accept_donor`, for another document of like name; also ``gibberish`` and ``verses`` of both sides."""
    c = F.col
    gain = c("donor_chords") - c("chords")
    choice = (
        F.when(c("merged_score") > c("score") + 8, "merged")
        .when((c("fragments") >= c("donor_fragments") + 2) & (c("donor_verses") >= 2) & (gain >= 2) & (c("donor_score") >= c("score") - 12), "donor")
        .when((c("gibberish") >= 6) & (c("donor_verses") >= 2) & (gain >= 2) & (c("donor_gibberish") <= c("gibberish")), "donor")
        .when(~c("chorus") & c("donor_chorus") & (gain >= 4) & (c("donor_gibberish") <= F.greatest(F.lit(0), c("gibberish") - 2)) & (c("donor_score") >= c("score") - 10), "donor")
        .when((c("verses") == 0) & (c("donor_verses") >= 2) & (gain >= 4) & (c("donor_gibberish") <= F.greatest(F.lit(0), c("gibberish"))) & (c("donor_score") >= c("score") - 5), "donor")
        .when((c("donor_score") > c("score") + 20) | ((c("score") < 90) & (c("donor_score") > c("score") + 8)), "donor")
        .otherwise("own")
    )
    return pairs.withColumn("choice", choice)


def status_rollup(files: DataFrame) -> DataFrame:
    """Files by status."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def german_vote(chords: DataFrame) -> DataFrame:
    """Whether a document writes chords in German: two H roots or more, and more than B roots."""
    upper = F.upper(F.col("chord"))
    agg = chords.groupBy("doc_id").agg(_counted(upper.startswith("H")).alias("n_h"), _counted(upper.startswith("B")).alias("n_b"))
    return agg.withColumn("german", (F.col("n_h") >= 2) & (F.col("n_h") > F.col("n_b")))


def box_union(words: DataFrame, *keys: str) -> DataFrame:
    """The box around all words of a group, and their mean height."""
    return words.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.avg(F.col("bottom") - F.col("top")).alias("mean_height"), F.count(F.lit(1)).alias("n_words"))


def split_wide_lines(words: DataFrame) -> DataFrame:
    """Words with the segment of their line: a gap of 60, 2.8 mean widths or 3.5 line heights, the largest, starts a new one."""
    line = Window.partitionBy("doc_id", "page_no", "line_no")
    by_x = line.orderBy("left", "word_no")
    rows = words.withColumn("__gap", F.col("left") - F.lag("right").over(by_x)).withColumn("__w", F.avg(F.col("right") - F.col("left")).over(line)).withColumn("__h", (F.max("bottom").over(line) - F.min("top").over(line)))
    wide = F.coalesce(F.col("__gap") >= F.greatest(F.lit(60.0), F.col("__w") * 2.8, F.col("__h") * 3.5), F.lit(False))
    return rows.withColumn("__new", wide.cast("int")).withColumn("segment", F.sum("__new").over(by_x.rowsBetween(Window.unboundedPreceding, 0))).select(*words.columns, "segment")


def words_of_regions(regions: DataFrame) -> DataFrame:
    """Regions cut into words, the box shared out by printed width."""
    from ..functions.text import tokens, weighted_length

    rows = regions.select("doc_id", "page_no", "region_no", "left", "right", "top", "bottom", F.posexplode(tokens(F.col("text"))).alias("word_no", "word"))
    part = Window.partitionBy("doc_id", "page_no", "region_no")
    upto = part.orderBy("word_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__w", weighted_length(F.col("word")) + 0.5).withColumn("__end", F.sum("__w").over(upto)).withColumn("__all", F.sum("__w").over(part))
    scale = (F.col("right") - F.col("left")) / F.col("__all")
    return rows.select("doc_id", "page_no", "region_no", "word_no", "word", (F.col("left") + (F.col("__end") - F.col("__w")) * scale).alias("w_left"), (F.col("left") + F.col("__end") * scale).alias("w_right"), "top", "bottom")


def letters_to_lines(letters_: DataFrame) -> DataFrame:
    """Letters of a page grouped by rounded baseline, a blank where the gap exceeds 1 and 1.6 mean widths."""
    base = F.bround("bottom", 1)
    rows = letters_.withColumn("base", base)
    line = Window.partitionBy("doc_id", "page_no", "base")
    # Letters that begin together come by their right edge, then by themselves.
    by_x = line.orderBy("left", "right", "letter")
    rows = rows.withColumn("__gap", F.col("left") - F.lag("right").over(by_x)).withColumn("__w", F.avg(F.col("right") - F.col("left")).over(line))
    piece = F.concat(F.when(F.col("__gap") > F.greatest(F.lit(1.0), F.col("__w") * 1.6), " ").otherwise(""), F.col("letter"))
    return rows.withColumn("piece", piece).groupBy("doc_id", "page_no", "base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "right", "letter", "piece"))), lambda x: x["piece"]), "").alias("line"))


def best_mode(recognised: DataFrame) -> DataFrame:
    """Of each page's recognitions ``(doc_id, mode_no, text)`` the one of best text score, the first mode on ties."""
    rows = recognised.withColumn("score", text_score(F.col("text")))
    best = rows.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("mode_no")).alias("m"), "text")).alias("b"))
    return best.select("doc_id", (-F.col("b.m")).alias("mode_no"), F.col("b.score").alias("score"), F.col("b.text").alias("text"))
