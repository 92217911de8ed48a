"""The cleaning pipeline over lines.  The order of stages is part of its meaning; rules are data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chords as C
from ..functions import lines as L
from ..functions import text as T
from . import sequence as W

#: Words that recognition splits or misreads in German lyrics, in order.  Fixed values, extend by parameter.
FRAGMENTS = [
    (r"(?U)\bS0\b", "so"),
    (r"(?iU)\bmeir\b", "mein"),
    (r"(?iU)\bunc\b", "und"),
    (r"(?iU)\bGe bet\b", "Gebet"),
    (r"(?iU)\bEn de\b", "Ende"),
    (r"(?iU)\bEhr Furcht\b", "Ehrfurcht"),
    (r"(?iU)\bschons tes\b", "schönstes"),
    (r"(?iU)\ber fullt\b", "erfüllt"),
    (r"(?iU)\bge nört\b", "gehört"),
    (r"(?iU)^\s*ie\s+be\b", "Liebe"),
    (r"(?iU)^\s*Worte\b", "Die Worte"),
    (r"(?iU)^\s*Ehrfurcht\b", "Voll Ehrfurcht"),
    (r"(?U)\s+([,.;:!?])", "$1"),
]


def _body(line: Column, changed: Column) -> Column:
    """``changed`` for lines that are neither blank nor directives."""
    return F.when(L.is_content(line), changed).otherwise(line)


def remove_garbage(df: DataFrame) -> DataFrame:
    return df.filter(~L.is_garbage(F.col("line")))


def repair_artefacts(df: DataFrame) -> DataFrame:
    return df.withColumn("line", _body(F.col("line"), T.artefacts(F.col("line"))))


def drop_invalid_chords(df: DataFrame) -> DataFrame:
    return df.withColumn("line", C.drop_invalid(F.col("line")))


def repair_fragments(df: DataFrame, rules: Sequence[tuple[str, str]] = FRAGMENTS) -> DataFrame:
    """``rules`` in order on lines that neither are blank nor begin with a brace, right ends trimmed."""
    line = F.col("line")
    fixed = F.regexp_replace(T.apply_rules(line, list(rules)), r"(?U)\s+$", "")
    return df.withColumn("line", F.when((T.stripped(line) != "") & ~T.stripped(line).startswith("{"), fixed).otherwise(line))


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rewriting rules for lines; a rule whose replacement is None drops the lines it matches."""
    for pattern, by in rules:
        df = df.filter(~(L.is_content(F.col("line")) & F.col("line").rlike(pattern))) if by is None else df.withColumn("line", _body(F.col("line"), F.regexp_replace("line", pattern, by)))
    return df


def insert_markers(df: DataFrame, phrases: Sequence[str], label: str = "Chorus") -> DataFrame:
    """A comment before the first line of each section that contains one of ``phrases``, unless its section has that label."""
    if not phrases:
        return df
    line = F.col("line")
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(T.phrase_key(line), T.phrase_key(F.lit(p)))
    comment = F.lit("{comment: " + label + "}")
    rows = df.withColumn("__c", F.last(F.when(L.is_structure_comment(line), line), ignorenulls=True).over(W.so_far())).withColumn("__seg", F.count(F.when(L.is_structure_comment(line), 1)).over(W.so_far()))
    wanted = hit & L.is_content(line) & ~F.coalesce(F.lower("__c") == F.lower(comment), F.lit(False))
    rows = rows.withColumn("__first", F.min(F.when(wanted, F.col(W.ORDER))).over(W.Window.partitionBy(W.DOC, "__seg")))
    both = F.when(F.col("__first") == F.col(W.ORDER), F.array(comment, line)).otherwise(F.array(line))
    out = rows.select(W.DOC, W.ORDER, F.posexplode(both).alias("__i", "line"))
    return out.select(W.DOC, (F.row_number().over(W.Window.partitionBy(W.DOC).orderBy(W.ORDER, "__i")) - 1).alias(W.ORDER), "line")


def drop_repeated_structure(df: DataFrame, most: int = 3) -> DataFrame:
    """A structure comment equal to the last one kept, after one to ``most`` lyric lines, goes."""
    from .folds import drop_repeated_structure as fold

    return fold(df, most)


def tidy_space(df: DataFrame) -> DataFrame:
    """Wide gaps narrowed, right ends trimmed, blank lines at the end dropped."""
    rows = df.withColumn("line", T.layout_space(F.col("line")))
    last = F.max(F.when(~T.is_blank(F.col("line")), F.col(W.ORDER))).over(W.whole())
    return rows.withColumn("__last", last).filter(F.col(W.ORDER) <= F.col("__last")).drop("__last")


def remove_notation(df: DataFrame) -> DataFrame:
    """Lines of notation go, stray sharps after chords too; blank runs collapse."""
    line = F.col("line")
    s = T.stripped(line)
    gone = L.is_content(line) & (s.rlike(L.NOTE_GLYPHS) | s.startswith("&") | s.rlike(r"^#+$") | s.rlike(r"(?i)^#+\s+[a-z]\s*$") | C.is_bare_row(s))
    rows = df.filter(~gone).withColumn("line", F.when(L.is_content(line), F.regexp_replace(F.regexp_replace(line, r"(?<=\])\s*#+\s*$", ""), r"\s+$", "")).otherwise(line))
    return W.collapse_blanks(rows)


def clean(df: DataFrame, rules: Sequence[tuple[str, str]] = (), fragments: Sequence[tuple[str, str]] = FRAGMENTS, chorus: Sequence[str] = ()) -> DataFrame:
    """All stages over ``(doc_id, line_no, line)``."""
    return (
        df.transform(remove_garbage)
        .transform(repair_artefacts)
        .transform(drop_invalid_chords)
        .transform(repair_fragments, fragments)
        .transform(W.trim_lead_in)
        .transform(insert_markers, chorus)
        .transform(drop_repeated_structure)
        .transform(W.drop_empty_comments)
        .transform(apply_rules, rules)
        .transform(tidy_space)
    )
