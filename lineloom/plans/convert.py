"""Whole conversions: lines in, chord documents out, one status row a document."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chords as C
from ..functions import lines as L
from ..functions import sections as S
from ..functions.text import is_blank
from ..operators import cleaner, folds, scoring
from ..operators import sequence as W


@dataclass
class Options:
    """Settings of a conversion, with their defaults."""

    tab_width: int = 12
    abort_on_image_only: bool = True
    abort_on_no_chords: bool = True
    use_german_notation: bool = True
    max_chord_gap: float = 180.0
    rules: list[tuple[str, str]] = field(default_factory=list)
    chorus: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Options:
        """Options of a JSON object; unknown names are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text or "{}").items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def classified(lines: DataFrame) -> DataFrame:
    """Lines with what they are: ``is_chord``, ``is_label``, ``explicit`` section."""
    line = F.col("line")
    label = S.parse_label(line)
    rows = lines.withColumn("is_chord", ~is_blank(line) & C.is_chord_only(line)).withColumn("__label", label)
    rows = rows.withColumn("is_label", ~F.col("is_chord") & F.col("__label").isNotNull() & (F.col("__label.rest") == ""))
    return rows.withColumn("explicit", F.when(~F.col("is_chord"), F.col("__label.section"))).drop("__label")


def german_chords(rows: DataFrame) -> DataFrame:
    """Lines with the chords of chord lines in German names, in documents that write them so; see :func:`scoring.german_vote`."""
    tokens = C.chord_tokens(F.col("line"))
    said = rows.filter("is_chord").select("doc_id", F.explode(tokens).alias("chord"))
    german = scoring.german_vote(said).filter("german").select("doc_id", F.lit(True).alias("__german"))
    parts = F.regexp_extract_all("line", F.lit(r"(\s+|\S+)"), F.lit(1))
    named = F.array_join(F.transform(parts, lambda p: F.when(C.is_chord(C.clean(p)), C.german(C.clean(p))).otherwise(p)), "")
    out = rows.join(german, "doc_id", "left").withColumn("line", F.when(F.col("is_chord") & F.col("__german"), named).otherwise(F.col("line")))
    return out.select(*rows.columns)


def images_to_status(converted: DataFrame, images: DataFrame, options: Options | None = None) -> DataFrame:
    """``converted`` with documents that hold ``images(doc_id)`` and no text set aside, if the options say so."""
    options = options or Options()
    found = images.select("doc_id").distinct().withColumn("__images", F.lit(True))
    only = F.coalesce("__images", F.lit(False)) & (F.col("message") == "no text") & F.lit(options.abort_on_image_only)
    rows = converted.join(found, "doc_id", "left")
    return rows.withColumn("status", F.when(only, "SKIP").otherwise(F.col("status"))).withColumn("message", F.when(only, "image only").otherwise(F.col("message"))).drop("__images")


def post_processed(lines: DataFrame) -> DataFrame:
    """The last steps over rendered lines, in order.

    Credits go, comments without lines or repeated at once go, blanks at the start and in runs go,
    neighbouring near repeats become their better line, and a noisy lead-in goes.
    """
    rows = lines.filter(~F.coalesce(L.is_footer_credit(F.col("line")), F.lit(False))).transform(W.drop_empty_comments).transform(W.drop_repeated_comments)
    rows = rows.withColumn("__on", F.max((~is_blank(F.col("line"))).cast("int")).over(W.so_far())).filter("__on = 1").drop("__on")
    return rows.transform(W.collapse_blanks).transform(folds.collapse_near_repeats).transform(W.trim_lead_in)


def text_to_cho(lines: DataFrame, options: Options | None = None) -> DataFrame:
    """Chord documents from text lines: ``(doc_id, title, cho, n_chords, status, message)``.

    Chord lines are merged, paired with the line below and placed into it; body lines get their
    section, and a comment where it changes; header and key lead the document.
    """
    options = options or Options()
    rows = lines.transform(W.expand_columns)
    named = L.is_content(F.col("line")) & ~C.is_chord_only(F.col("line"))
    rows = rows.withColumn("__title", F.min(F.when(named, F.col("line_no"))).over(W.whole())).filter(~F.col("line_no").eqNullSafe(F.col("__title"))).drop("__title")
    chord = rows.withColumn("is_chord", ~is_blank(F.col("line")) & C.is_chord_only(F.col("line")))
    merged = classified(W.merge_chord_rows(chord))
    if options.use_german_notation:
        merged = german_chords(merged)
    pairs = W.pair_chords(merged)
    used = pairs.select("doc_id", F.col("lyric_no").alias("line_no"), "chords").filter("line_no is not null")
    lone = pairs.filter("lyric_no is null").select("doc_id", "line_no", F.lit(True).alias("__lone"))
    body = W.assign_sections(merged).join(used, ["doc_id", "line_no"], "left").join(lone, ["doc_id", "line_no"], "left")
    even = C.insert_evenly(C.chord_tokens(F.col("chords")), F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    tabbed = C.insert_at(F.col("line"), C.place_by_column(F.col("chords"), F.col("line"), options.tab_width))
    rendered = F.when(F.col("__lone"), C.render_line(C.chord_tokens(F.col("line")))).when(F.col("chords").isNull(), F.col("line")).when(F.col("chords").contains("\t"), tabbed).otherwise(even)
    body = body.filter(~F.col("is_chord") | F.coalesce("__lone", F.lit(False))).withColumn("out", rendered)
    changed = ~F.col("section").eqNullSafe(F.lag("section").over(W.ordered()))
    comment = F.when(changed & F.col("section").isNotNull(), F.concat(F.lit("\n"), S.format_comment(F.col("section")), F.lit("\n"))).otherwise("")
    body = body.withColumn("out", F.concat(comment, F.col("out")))
    text = body.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda x: x["out"]), "\n").alias("__body"))
    docs = lines.select("doc_id").distinct().join(W.title_of(lines), "doc_id", "left").join(W.key_of(lines), "doc_id", "left").join(text, "doc_id", "left")
    head = S.header({"title": F.coalesce("title", F.lit("Untitled")), "subtitle": F.col("subtitle"), "key": F.col("key")})
    out = docs.withColumn("cho", F.concat_ws("\n", head, F.coalesce("__body", F.lit(""))))
    n = C.count_brackets(F.col("cho"))
    message = F.when(F.col("__body").isNull(), "no text").when(F.lit(options.abort_on_no_chords) & (n == 0), "no chords")
    return out.select("doc_id", "title", "cho", n.alias("n_chords"), F.when(message.isNull(), "OK").otherwise("SKIP").alias("status"), message.alias("message"))


def cleaned(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """Documents ``(doc_id, text)`` through all stages of the cleaner."""
    options = options or Options()
    return W.join_lines(cleaner.clean(W.explode_lines(documents), options.rules, chorus=options.chorus))


def choose(candidates: DataFrame, prefer: str | None = None) -> DataFrame:
    """Of each document's candidates ``(doc_id, source, text, expected)`` the best by quality score, with its text and status."""
    keyed = candidates.withColumn("__id", F.xxhash64("doc_id", "source"))
    scores = scoring.quality_score(keyed.select(F.col("__id").alias("doc_id"), "text", "expected", "source"), "expected", "source").select(F.col("doc_id").alias("__id"), "score")
    rows = keyed.join(scores, "__id").select("doc_id", "source", "score", "text")
    best = scoring.best_candidate(rows.select("doc_id", "source", "score"), prefer)
    out = best.join(rows.select("doc_id", "source", "text"), ["doc_id", "source"])
    return out.withColumn("status", F.when(F.col("score") == float("-inf"), "SKIP").otherwise("OK"))


def layout_to_cho(lines: DataFrame, chords: DataFrame, words: DataFrame, options: Options | None = None) -> DataFrame:
    """Lyric lines with the chords of the nearest line above placed by x: ``(doc_id, page_no, line_no, line)``.

    ``lines`` and ``chords`` have boxes; ``chords`` also ``tokens array<struct<chord, x>>``; ``words`` are the
    lyric words with boxes.
    """
    from ..operators.matching import closest, nearest_above

    options = options or Options()
    near = nearest_above(lines.select("doc_id", "page_no", "line_no", "left", "top", "right", "bottom"), chords, options.max_chord_gap)
    spots = words.groupBy("doc_id", "page_no", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", (F.col("left") + 0.2 * (F.col("right") - F.col("left"))).alias("x"), "text"))).alias("w"))
    tokens = chords.select("doc_id", "page_no", F.col("line_no").alias("chord_no"), "tokens")
    rows = near.join(spots, ["doc_id", "page_no", "line_no"]).join(tokens, ["doc_id", "page_no", "chord_no"], "left")
    xs = F.transform("w", lambda w: w["x"])
    placed = F.transform(F.coalesce("tokens", F.array()), lambda t: F.struct(closest(xs, t["x"]).alias("at"), t["chord"].alias("chord")))
    line = F.array_join(F.transform("w", lambda w, i: F.concat(F.array_join(F.transform(F.filter(placed, lambda p: p["at"] == i), lambda p: F.concat(F.lit("["), p["chord"], F.lit("]"))), ""), w["text"])), " ")
    return rows.select("doc_id", "page_no", "line_no", line.alias("line"))


def merge_sources(*parts: DataFrame) -> DataFrame:
    """Pages or lines of several sources one after another, numbered anew by source, page and line."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__source", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    w = Window.partitionBy("doc_id").orderBy("__source", "line_no")
    return rows.withColumn("line_no", F.row_number().over(w) - 1).drop("__source")
