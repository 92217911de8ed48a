"""Operators over ordered lines: DataFrame to DataFrame, windows by document and line number.

All take ``(doc_id, line_no, ...)`` and share one window, so Spark sorts once for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import sections as S
from ..functions.chords import chord_tokens, is_chord_only
from ..functions.similarity import near_duplicate
from ..functions.text import at, columns_of, is_blank, lyric_key

DOC, ORDER = "doc_id", "line_no"


def ordered(key: str = DOC, order: str = ORDER) -> Window:
    return Window.partitionBy(key).orderBy(order)


def so_far(key: str = DOC, order: str = ORDER) -> Window:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)


def ahead(key: str = DOC, order: str = ORDER) -> Window:
    return ordered(key, order).rowsBetween(1, Window.unboundedFollowing)


def whole(key: str = DOC) -> Window:
    return Window.partitionBy(key)


def explode_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: ``(key, line_no, line)``; any newline convention, numbers from 0."""
    normal = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return documents.select(F.col(key), F.posexplode(F.split(normal, "\n")).alias("line_no", "line"))


def join_lines(lines: DataFrame, text: str = "line", name: str = "text") -> DataFrame:
    """The lines of each document joined again, in order."""
    rows = lines.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct(ORDER, F.col(text).alias("t")))).alias("a"))
    return rows.select(DOC, F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias(name))


def expand_columns(lines: DataFrame, least: int = 120) -> DataFrame:
    """Long lines cut at wide gaps; numbers are dealt anew."""
    parts = lines.select(DOC, ORDER, F.posexplode(columns_of(F.col("line"), least)).alias("part", "line"))
    return parts.select(DOC, (F.row_number().over(Window.partitionBy(DOC).orderBy(ORDER, "part")) - 1).alias(ORDER), "line")


def fill_forward(df: DataFrame, column: str, name: str) -> DataFrame:
    """The last value of ``column`` that is not null, up to and with the row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(so_far()))


def islands(df: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """A running count of rows that start something."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(so_far()))


def collapse_blanks(df: DataFrame) -> DataFrame:
    """Of a run of blank lines the first stays."""
    blank = is_blank(F.col("line"))
    return df.withColumn("__after", F.coalesce(F.lag(blank).over(ordered()), F.lit(False))).filter(~(blank & F.col("__after"))).drop("__after")


def drop_repeated_comments(df: DataFrame) -> DataFrame:
    """A comment equal to the line before it goes."""
    same = L.is_directive(F.col("line")) & (F.col("line") == F.lag("line").over(ordered()))
    return df.withColumn("__same", F.coalesce(same, F.lit(False))).filter(~F.col("__same")).drop("__same")


def merge_chord_rows(df: DataFrame, is_chord: str = "is_chord") -> DataFrame:
    """Runs of chord lines as one, blank lines within and after a run absorbed: ``(doc_id, line_no, line)``."""
    blank = is_blank(F.col("line"))
    kept = df.withColumn("__last", F.last(F.when(~blank, F.col(is_chord)), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1)))
    kept = kept.filter(~(blank & F.coalesce(F.col("__last"), F.lit(False))))
    joins = F.col(is_chord) & F.coalesce(F.lag(is_chord).over(ordered()), F.lit(False))
    runs = kept.withColumn("__joins", joins).withColumn("__run", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(so_far()))
    return runs.groupBy(DOC, "__run").agg(F.min(ORDER).alias(ORDER), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ORDER, "line"))), lambda x: x["line"]), " ").alias("line")).drop("__run")


def next_where(df: DataFrame, wanted: Column, name: str) -> DataFrame:
    """The number of the next line for which ``wanted`` holds."""
    return df.withColumn(name, F.first(F.when(wanted, F.col(ORDER)), ignorenulls=True).over(ahead()))


def drop_empty_comments(df: DataFrame) -> DataFrame:
    """Structure comments without a lyric line before the next one go."""
    line = F.col("line")
    out = next_where(next_where(df, L.is_structure_comment(line), "__comment"), L.is_content(line), "__lyric")
    empty = F.col("__lyric").isNull() | F.coalesce(F.col("__comment") < F.col("__lyric"), F.lit(False))
    return out.filter(~(L.is_structure_comment(line) & empty)).drop("__comment", "__lyric")


def assign_sections(df: DataFrame) -> DataFrame:
    """Sections of body lines: ``explicit`` labels fill forward; a break after a chorus or bridge, or a
    start without label, opens a numbered verse.

    Takes ``(doc_id, line_no, line, explicit)``; ``explicit`` is the label a line carries or null, and
    rows that are labels only have ``is_label``: theirs goes to the next body line.  Returns body rows with ``section`` and ``opens``.
    """
    blank = is_blank(F.col("line"))
    body = ~blank & ~F.col("is_label")
    rows = df.withColumn("__bodies", F.coalesce(F.sum(body.cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    since = Window.partitionBy(DOC, "__bodies")
    rows = rows.withColumn("__break", F.max(blank.cast("int")).over(since) == 1)
    rows = rows.withColumn("__explicit", F.last("explicit", ignorenulls=True).over(since.orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0))).filter(body)
    rows = rows.withColumn("__seg", F.count("__explicit").over(so_far())).withColumn("__label", F.last("__explicit", ignorenulls=True).over(so_far()))
    free = F.col("__explicit").isNull()
    eligible = free & ((F.col("__seg") == 0) | (F.col("__label").isin("chorus", "bridge") & F.col("__break")))
    rows = rows.withColumn("__open", F.min(F.when(eligible, F.col(ORDER))).over(Window.partitionBy(DOC, "__seg")))
    rows = rows.withColumn("opens", F.coalesce(F.col("__open") == F.col(ORDER), F.lit(False)))
    rows = rows.withColumn("__verse", F.sum(F.col("opens").cast("int")).over(so_far()))
    opened = F.col("__open").isNotNull() & (F.col(ORDER) >= F.col("__open"))
    return rows.withColumn("section", F.when(opened, F.concat(F.lit("verse "), F.col("__verse").cast("string"))).otherwise(F.col("__label"))).select(*df.columns, "section", "opens")


def pair_chords(df: DataFrame, is_chord: str = "is_chord", is_label: str = "is_label") -> DataFrame:
    """Chord lines with the line they stand over: the next non-blank one, or the one after a label."""
    w = ordered()
    rows = df.filter(~is_blank(F.col("line")) & ~F.col("line").rlike(r"^\s*\d+\s*$"))
    seen = F.struct("line", ORDER, F.col(is_label).alias("label"), F.col(is_chord).alias("chord"))
    for k in (1, 2):
        rows = rows.withColumn(f"__l{k}", F.lead(seen, k).over(w))
    over = F.when(F.col("__l1.label"), F.col("__l2")).otherwise(F.col("__l1"))
    return rows.filter(F.col(is_chord)).withColumn("__over", over).select(DOC, ORDER, F.col("line").alias("chords"), F.when(~F.col("__over.chord"), F.col("__over.line")).alias("lyric"), F.when(~F.col("__over.chord"), F.col("__over.line_no")).alias("lyric_no"))


def trim_lead_in(df: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Content before the first structure comment goes if it is short and mostly lower-case or noisy."""
    line = F.col("line")
    rows = df.withColumn("__first", F.min(F.when(L.is_structure_comment(line), F.col(ORDER))).over(whole()))
    lead = F.col("__first").isNotNull() & (F.col(ORDER) < F.col("__first")) & L.is_content(line)
    poor = lead & (L.is_lowercase_lead(line) | L.is_noisy_lead(line))
    rows = rows.withColumn("__lead", lead).withColumn("__n", F.sum(lead.cast("int")).over(whole())).withColumn("__poor", F.sum(poor.cast("int")).over(whole()))
    gone = F.col("__lead") & F.col("__n").between(least, most) & (F.col("__poor") * 2 >= F.col("__n"))
    return rows.filter(~F.coalesce(gone, F.lit(False))).select(*df.columns)


def from_start(df: DataFrame, starts: Column) -> DataFrame:
    """Lines from the first one for which ``starts`` holds."""
    rows = df.withColumn("__on", F.max(F.coalesce(starts, F.lit(False)).cast("int")).over(so_far()))
    return rows.filter("__on = 1").drop("__on")


def first_of(df: DataFrame, key: Column) -> DataFrame:
    """The first row of each key within a document."""
    rows = df.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy(DOC, "__key").orderBy(ORDER)))
    return rows.filter(F.col("__n") == 1).drop("__key", "__n")


def first_lines(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each document."""
    return df.withColumn("__n", F.row_number().over(ordered())).filter(F.col("__n") <= n).drop("__n")


def near_repeats(df: DataFrame) -> DataFrame:
    """Content lines that nearly repeat the one before them, compared by normalised lyrics."""
    rows = df.filter(L.is_content(F.col("line"))).withColumn("__a", lyric_key(F.col("line")))
    rows = rows.withColumn("previous", F.lag("line").over(ordered())).withColumn("__b", F.lag("__a").over(ordered()))
    return rows.filter(F.col("previous").isNotNull() & near_duplicate(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def footers(df: DataFrame) -> DataFrame:
    """The credits at the end: from the lowest keyword line upward to a chord, label or tab line; blanks are passed over."""
    line = F.col("line")
    up = Window.partitionBy(DOC).orderBy(F.desc(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(~is_blank(line)).withColumn("__in", F.max(line.rlike(L.FOOTER).cast("int")).over(up))
    stop = line.rlike(r"[\t\[]") | L.is_section_label(line) | is_chord_only(line)
    rows = rows.withColumn("__out", F.max(F.when((F.col("__in") == 1) & stop, 1).otherwise(0)).over(up))
    return rows.filter("__in = 1 and __out = 0").drop("__in", "__out")


def key_of(df: DataFrame) -> DataFrame:
    """The first chord of each document's first chord line, without its bass."""
    rows = df.filter(is_chord_only(F.col("line"))).withColumn("__c", at(chord_tokens(F.col("line")), 1))
    return rows.groupBy(DOC).agg(F.min_by(F.regexp_replace("__c", "/.*$", ""), ORDER).alias("key"))


def title_of(df: DataFrame) -> DataFrame:
    """Title and subtitle from the first line that is neither blank, chords nor a directive."""
    rows = df.filter(L.is_content(F.col("line")) & ~is_chord_only(F.col("line")))
    first = rows.groupBy(DOC).agg(F.min_by("line", ORDER).alias("__t"))
    return first.select(DOC, S.clean_title(F.regexp_replace("__t", r"\([^)]*\)", "")).alias("title"), S.subtitle_of(F.col("__t")).alias("subtitle"))


def row_bands(rows: DataFrame, key: str = "doc_id", at: str = "y", gap: int = 6) -> DataFrame:
    """Rows at most ``gap`` apart as bands: ``(key, band, top, bottom, centre)``."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True))
    marked = rows.withColumn("__new", new).withColumn("band", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "band").agg(F.min(at).alias("top"), F.max(at).alias("bottom")).withColumn("centre", (F.col("top") + F.col("bottom")) / 2)


def staff_systems(bands: DataFrame, height: Column, key: str = "doc_id", uneven: float = 0.45, least: float = 6.0, most: float = 24.0) -> DataFrame:
    """Windows of five bands that are evenly spaced within ``uneven`` and no wider than a staff."""
    w = Window.partitionBy(key).orderBy("centre")
    rows = bands
    for k in range(1, 5):
        rows = rows.withColumn(f"__c{k}", F.lead("centre", k).over(w))
    gaps = [F.col("__c1") - F.col("centre")] + [F.col(f"__c{k}") - F.col(f"__c{k - 1}") for k in range(2, 5)]
    rows = rows.withColumn("spacing", (F.col("__c4") - F.col("centre")) / 4)
    even = F.lit(True)
    for g in gaps:
        even = even & (F.abs(g - F.col("spacing")) <= F.col("spacing") * uneven)
    return rows.filter(F.col("__c4").isNotNull() & even & F.col("spacing").between(F.lit(least), F.least(F.lit(most), height * 0.06))).select(key, "band", "centre", "spacing")


def otsu(histogram: DataFrame, bins: str = "bin", n: str = "n", key: str | None = None) -> DataFrame:
    """The threshold of largest variance between classes, the smallest on ties, 128 without any: ``(key, threshold)``."""
    keys = [key] if key else []
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy(bins).rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("__w", F.sum(n).over(upto)).withColumn("__s", F.sum(F.col(bins) * F.col(n)).over(upto)).withColumn("__all", F.sum(n).over(part)).withColumn("__sum", F.sum(F.col(bins) * F.col(n)).over(part))
    b, f = F.col("__w"), F.col("__all") - F.col("__w")
    between = b * f * F.pow(F.col("__s") / b - (F.col("__sum") - F.col("__s")) / f, F.lit(2.0))
    rows = rows.withColumn("__v", F.when((b > 0) & (f > 0), between).otherwise(0.0))
    best = F.max(F.struct(F.col("__v").alias("v"), (-F.col(bins)).alias("b")))
    return rows.groupBy(*keys).agg(F.when(best["v"] > 0, -best["b"]).otherwise(128).cast("int").alias("threshold"))


def documents_with_chords(df: DataFrame) -> DataFrame:
    """``(doc_id, has_chords)``: whether any line shows chords."""
    from ..functions.chords import has_chords

    return df.groupBy(DOC).agg(F.coalesce(F.bool_or(has_chords(F.col("line"))), F.lit(False)).alias("has_chords"))


def titles_by_name(df: DataFrame, names: DataFrame, first: int = 12) -> DataFrame:
    """``(doc_id, title)``: the first candidate among the first lines, the file's name without one or where it serves better."""
    rows = first_lines(df, first).join(names, DOC)
    found = rows.filter(L.is_title_candidate(F.col("line"), F.col("name"))).groupBy(DOC).agg(F.min_by("line", ORDER).alias("__t"))
    out = names.join(found, DOC, "left")
    title = S.clean_title(F.coalesce("__t", "name"))
    return out.select(DOC, F.when(F.col("__t").isNull() | S.prefers_name(title, F.col("name")), F.col("name")).otherwise(title).alias("title"))


def copyrights(df: DataFrame) -> DataFrame:
    """``(doc_id, copyright)``: the first labelled notice, else the first with a sign."""
    rows = df.withColumn("__c", S.copyright_of(F.col("line"))).filter("__c is not null")
    return rows.groupBy(DOC).agg(F.min_by(F.col("__c.value"), F.struct(F.col("__c.rank"), ORDER)).alias("copyright"))


def drop_false_verses(df: DataFrame, titles: DataFrame, most: int = 4) -> DataFrame:
    """``Vers n`` comments with ``n`` beyond ``most`` go where the next content line is a fragment of the title."""
    line = F.col("line")
    number = F.regexp_extract(line, r"(?i)^\{comment:\s*vers(?:e)?\s*(\d+)\s*\}$", 1)
    rows = df.withColumn("__next", F.first(F.when(L.is_content(line), line), ignorenulls=True).over(ahead())).join(titles, DOC, "left")
    false = (number != "") & (number.cast("long") > most) & S.is_title_fragment(F.coalesce("__next", F.lit("")), F.coalesce("title", F.lit("")))
    return rows.filter(~F.coalesce(false, F.lit(False))).select(*df.columns)


def lines_by_section(df: DataFrame, section: str = "section") -> DataFrame:
    """``(doc_id, section, lines)``: the lines of each section in order; names that differ in case are one."""
    rows = df.groupBy(DOC, F.lower(section).alias("section")).agg(F.array_sort(F.collect_list(F.struct(ORDER, "line"))).alias("a"))
    return rows.select(DOC, "section", F.transform("a", lambda x: x["line"]).alias("lines"))
