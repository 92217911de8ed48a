"""Scalar text functions: character classes, clean-up, normal forms.  All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what stays of them.  Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: White space, as ``(?U)\\s`` has it.  Fixed value.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Rests that recognition leaves at words, and what they become, in order.  Fixed values.
ARTEFACTS = [
    (r"(?<=\p{L}{2})[qT{%€£)(]+(?=\s|$)", ""),
    (r"(?<=\p{L}{4})f+(?=\s|$)", ""),
    (r"(?<=\p{L}{2})fl(?=\s|$)", ""),
    (r"(?:^|\s)[>„<»«]+(?=\p{L})", " "),
    (r"(\d+\.)>", "$1 "),
    ("ﬂ", "fl"),
    ("ﬁ", "fi"),
    (r"(?<=\p{L})\.1(?=\s|$)", "!"),
    (r"(?<=\p{L})1(?=\s|$)", ""),
    ("[–—]", "-"),
    (r"\s+[§®¤•◦·]+\s+", " "),
    (" {2,}", " "),
]
#: Widths of characters in shares of a usual one.  Fixed values.
WIDTHS = [
    (r"[ilI|]", 0.55),
    (r"[mwMW]", 1.35),
    (r"[-/\\]", 0.65),
    (r"[.,:;!]", 0.45),
    (r"[()\[\]]", 0.6),
    (r"[\p{Lu}&&[^IMW]]", 1.1),
    (r"[^ilI|mwMW/\\.,:;!()\[\]\p{Lu}-]", 1.0),
]
#: Repairs of extracted text, in order: of a text layer, and of scanned pages.  Fixed values.
REPAIR_TEXT = [
    (r"(\p{L})\s*-\s*(\p{L})", "$1$2"),
    ("[\u2011\u00ad]", ""),
    (r"\s{2,}", " "),
    (r"\s+([,.;:!?])", "$1"),
    (r"\s+['`´]{1,3}\s+", " "),
]
REPAIR_SCAN = [
    ("[–—]", "-"),
    ("_", ""),
    (r"[|\[\]]", " "),
    ("[§®¤•◦·…ﬂ\u201c\u201d\u2019\u2018]", " "),
    (r"(?<=\p{L}{2})[qT{%€)(]+(?=\s|$)", ""),
    (r"(?<=\p{L}{4})f+(?=\s|$)", ""),
    (r"(?<=\p{L}{2})fl(?=\s|$)", ""),
    ("(?:^|\\s)[>„<»«]+(?=\\p{L})", " "),
    (r"(\d+\.)>", "$1 "),
    (r"(?<=\p{L})\s*-\s*(?=\p{L})", ""),
    (r"\s+[\\/]{1,3}\s+", " "),
    (r"\s+['`´]{1,3}\s+", " "),
    ("~", " "),
    (r"\^", ""),
    (r"\s+[0OoIl]\s+", " "),
]


def at(c: Column | str, i: Column | int) -> Column:
    """The ``i``-th element, from 1 or from the end if negative, or a map's value; null if there is none."""
    return F.try_element_at(F.col(c) if isinstance(c, str) else c, F.lit(i) if isinstance(i, int) else i)


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return at(F.transform(F.array(x), lambda v: f(v)), 1)


def count(c: Column, pattern: str) -> Column:
    """How often ``pattern`` matches; nulls count as empty."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def among(c: Column, marks: str) -> Column:
    """How many characters are of the class ``[marks]``; nulls count as empty.  The others go in runs, not one by one."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{marks}]+", ""))


def letters(c: Column) -> Column:
    return among(c, r"\p{L}")


def digits(c: Column) -> Column:
    return among(c, r"\p{Nd}")


def uppers(c: Column) -> Column:
    return among(c, r"\p{Lu}")


def symbols(c: Column, but: str = "") -> Column:
    """Characters that are no letter, digit or white space, nor one of ``but``."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\p{{L}}\p{{Nd}}\s{but}]+", ""))


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (stripped(c) == "")


def tokens(c: Column) -> Column:
    """The parts between white space, none of them empty."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def strip_accents(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def phrase_key(c: Column) -> Column:
    """Lower case, umlauts folded, only a-z and 0-9 kept."""
    return F.regexp_replace(F.replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "äöü", "aou"), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "")


def lyric_key(c: Column) -> Column:
    """The phrase key without bracketed chords."""
    return phrase_key(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]+\]", ""))


def header_key(c: Column) -> Column:
    """Lower case with single spaces, for comparing header lines."""
    return F.lower(normal_space(c))


def companion_key(c: Column) -> Column:
    """The phrase key without a trailing number."""
    return F.regexp_replace(phrase_key(c), r"\d+$", "")


def normal_space(c: Column) -> Column:
    """Runs of white space become one blank, none before punctuation, none at the ends."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(one, r" ([,.;:!?])", "$1"))


def layout_space(c: Column) -> Column:
    """Three or more blanks become two, the right end is trimmed."""
    return F.regexp_replace(F.regexp_replace(c, " {3,}", "  "), r"(?U)\s+$", "")


def join_hyphens(c: Column) -> Column:
    """Syllables joined where a spaced or bare hyphen stands between letters."""
    return F.regexp_replace(c, r"(?<=\p{L})\s*[-–—]\s*(?=\p{L})", "")


def plain_dashes(c: Column) -> Column:
    return F.regexp_replace(c, "[–—]", "-")


def escape_marks(c: Column) -> Column:
    """Braces and brackets with a backslash before them."""
    return F.regexp_replace(c, r"([{}\[\]])", r"\\$1")


def file_name(c: Column) -> Column:
    """Characters that no file name may hold become underscores."""
    return F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_")


def repair_text(c: Column) -> Column:
    """Clean-up of a text layer: syllables joined, soft hyphens and stray quotes out; blank is empty."""
    return stripped(apply_rules(stripped(c), REPAIR_TEXT))


def repair_scan(c: Column) -> Column:
    """Clean-up of recognised text: marks and letters that recognition adds, leading noise, spaces; blank is empty."""
    out = drop_leading_noise(apply_rules(F.coalesce(c, F.lit("")), REPAIR_SCAN))
    return stripped(F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"(?U)\s+([,.;:!?])", "$1"))


def artefacts(c: Column) -> Column:
    """Repairs of letters that recognition appends to words or confuses."""
    out = apply_rules(c, ARTEFACTS)
    return F.regexp_replace(out, r"(?U)\s+$", "")


def drop_leading_noise(c: Column, least_tokens: int = 4, least_removed: int = 3, most: int = 10) -> Column:
    """Without up to ``most`` one-letter or slash tokens at the start, if there are enough of them."""
    t = tokens(c)
    n = F.least(F.coalesce(F.array_min(F.transform(t, lambda x, i: F.when(~x.rlike(r"^(?:\p{L}|/+)$"), i))), F.size(t)), F.lit(most))
    cut = F.array_join(F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0))), " ")
    return F.when((F.size(t) >= least_tokens) & (n >= least_removed), cut).otherwise(c)


def corrected_words(c: Column, rules: dict[str, str]) -> Column:
    """Whole words replaced by rule, the case of the first letter kept."""
    out = c
    for wrong, right in rules.items():
        for a, b in ((wrong, right), (wrong[:1].upper() + wrong[1:], right[:1].upper() + right[1:])):
            out = F.regexp_replace(out, rf"(?U)\b{a}\b", b)
    return out


def apply_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern rules in order."""
    out = c
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


def word_spans(c: Column) -> Column:
    """Words with 0-based start and inclusive end: ``array<struct<text, start, end>>``."""
    return _spans(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)(\s+|\S+)"), F.lit(1)))


def syllable_spans(c: Column) -> Column:
    """As :func:`word_spans`, hyphens separating too."""
    return _spans(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)([\s-]+|[^\s-]+)"), F.lit(1)))


def _spans(parts: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct(p.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(p) - 1).alias("end"))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.rlike(r"(?U)^[\s-]+$"), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(parts, start, step)["out"]


def weighted_length(c: Column) -> Column:
    """Printed width in rough units: a letter is 1, narrow ones and marks less, wide ones and other capitals more."""
    weights = F.lit(0.0)
    for marks, weight in WIDTHS:
        weights = weights + count(c, marks) * F.lit(weight)
    return weights


def columns_of(c: Column, least: int = 120) -> Column:
    """Long lines without brackets cut at runs of two or more blanks."""
    cut = F.filter(F.split(c, r" {2,}"), lambda p: F.trim(p) != "")
    return F.when((F.length(c) > least) & ~c.contains("["), cut).otherwise(F.array(c))


def processed_lyric(c: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """A lyric line of a dump: nothing before its first letter, bars and rules out, dashes plain, rules applied."""
    out = F.regexp_replace(c, r"^[^\p{L}]+", "")
    out = F.regexp_replace(plain_dashes(out), r"[_|~=^]+", " ")
    return normal_space(apply_rules(out, rules or []))
