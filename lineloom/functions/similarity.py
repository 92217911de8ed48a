"""Similarity of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; two equal texts have 1, an empty one against another 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def contains_either(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def lyric_similarity(a: Column, b: Column) -> Column:
    """Edit similarity, 0.9 where one text holds the other."""
    return F.when(a == b, F.lit(1.0)).when(contains_either(a, b), F.lit(0.9)).otherwise(edit_similarity(a, b))


def long_words(c: Column, least: int = 3) -> Column:
    """Distinct lower-cased words without accents, of ``least`` letters or more."""
    words = F.split(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))


def word_jaccard(a: Column, b: Column, least: int = 3) -> Column:
    x, y = long_words(a, least), long_words(b, least)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def near_duplicate(a: Column, b: Column, least: int = 8, similar: float = 0.74) -> Column:
    """Equal, or both of ``least`` characters and similar or one within the other."""
    short, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    # The most edits that still are similar, told as the result would be; beyond them the distance is -1, and soon found.
    k = F.floor(longer * (1.0 - similar)).cast("int")
    most = F.when(1.0 - (k + 1) / longer >= similar, k + 1).when(1.0 - k / longer >= similar, k).otherwise(k - 1)
    # The distance is at least the difference in length, so most pairs need none.
    close = (short >= longer * similar - 1e-9) & (F.call_function("levenshtein", a, b, most) >= 0)
    return (a == b) | ((short >= least) & (contains_either(a, b) | close))
