"""Predicates over one line of text.  Thresholds that differ between the document paths are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chords
from .text import count, digits, is_blank, letters, once, stripped, symbols, tokens, uppers

#: Marks that recognition leaves behind.  Fixed values.
GARBAGE = r"[=~|&%$#@!;?\\\"'`<>(){}]"
NOTE_GLYPHS = "[œŒ˙Óˆ‰∑∏˘˜Ω]"
VERSE = r"^\s*(?:\[[^\]]+\])?\s*(?:\d+|[lI])\s*[.)]"
#: Words of a credit line besides names.  Fixed values.
CREDIT = ("und", "and", "copyright", "rights")
SHORT_WORDS = ("a", "an", "am", "im", "in", "to", "of", "my", "we", "me", "du", "ich", "der", "die", "das", "und", "ist", "ein", "eine")
#: Words of credits at the end of a document; a choice of this engine.
FOOTER = r"(?i)\b(?:text|melodie|satz|musik|worte|autor|urheber|copyright|rechte|ccli)\b|©"


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def is_directive(line: Column) -> Column:
    return stripped(line).rlike(r"(?s)^\{.*\}$")


def is_content(line: Column) -> Column:
    return (stripped(line) != "") & ~is_directive(line)


def is_garbage(line: Column) -> Column:
    """Too short, or marks outnumber letters; blank lines, directives and lines with a chord never are."""
    s = stripped(line)
    bare = stripped(chords.strip_chords(s))
    n, marks = letters(bare), count(bare, GARBAGE)
    noisy = ((marks > 0) & (marks > n * 2) & (n < 5)) | ((F.length(bare) < 30) & (share(marks, F.length(bare)) > 0.5))
    return F.when(s == "", False).when(F.length(s) < 2, True).when(is_directive(s) | s.rlike(chords.BRACKETED) | (bare == ""), False).otherwise(noisy)


def is_staff_noise(line: Column, light: bool = False) -> Column:
    """Rests of staves; ``light`` counts bars and rules only (and holds blank lines for none)."""
    s = F.coalesce(line, F.lit(""))
    if light:
        n = count(s, r"[_|=~^]")
        return (n >= 6) | ((n >= 3) & (letters(s) <= 3))
    return once(F.struct(s.alias("s"), letters(s).alias("n"), digits(s).alias("d"), symbols(s).alias("y")), lambda v: _staff_noise(v["s"], v["n"], v["d"], v["y"]))


def _staff_noise(s: Column, n: Column, d: Column, y: Column) -> Column:
    """Of a line with its numbers of letters, digits and symbols."""
    length = F.length(s)
    return is_blank(s) | s.rlike(r"===|___|%%|\|\||[=_]{2,}|-{4,}") | ((share(y, length) > 0.22) & (share(n, length) < 0.40)) | ((y + d >= 10) & (n <= 6))


def is_short_tokens(line: Column, long_word: bool = True) -> Column:
    """Six tokens or more, four in five of two characters at most; ``long_word``: none of four or more, and few letters."""
    return once(tokens(line), lambda t: _short_tokens(t, letters(line), long_word))


def _short_tokens(t: Column, n: Column, long_word: bool = True) -> Column:
    out = (F.size(t) >= 6) & (F.size(F.filter(t, lambda x: F.length(x) <= 2)) >= F.size(t) * 0.8)
    return out & ~F.exists(t, lambda x: F.length(x) >= 4) & (n <= 12) if long_word else out


def is_lyric(line: Column, least: int = 8) -> Column:
    return letters(F.regexp_replace(F.coalesce(line, F.lit("")), VERSE, "")) >= least


def is_verse_number(line: Column, misread: bool = True) -> Column:
    return F.coalesce(line, F.lit("")).rlike(VERSE if misread else r"^\s*\d+\s*[.)]")


def is_lyric_start(line: Column, least: int = 12) -> Column:
    """A numbered line of six letters, or a lyric line without digits of ``least`` letters; credits and fragments never are."""

    def start(s: Column) -> Column:
        starts = F.when(s.rlike(r"^\d+\s*[.)]"), letters(s) >= 6).otherwise((digits(s) == 0) & is_lyric(s) & (letters(s) >= least))
        return (s != "") & starts & ~is_footer_credit(s) & ~is_fragmented(s)

    return once(stripped(line), start)


def is_processed_lyric(line: Column) -> Column:
    return (letters(line) >= 8) & (count(line, r"\p{L}+") >= 3)


def is_body_garbage(line: Column) -> Column:
    n = letters(line)
    return is_staff_noise(line) | is_short_tokens(line) | (~is_lyric(line) & ((n < 10) | (F.length(line) < 30))) | ((symbols(line) + digits(line) >= 8) & (n <= 10))


def is_note_noise(line: Column) -> Column:
    """Noise of notation; the first rule that fits decides, lyrics and chords are exempt from the last."""

    def noisy(s: Column, n: Column, d: Column, y: Column, t: Column) -> Column:
        noise = count(s, r"[_|=~^\[\]{}\\/*\u201c\u201d\u2019\u2018]")
        ratio = share(n, F.length(s))
        single = F.size(F.filter(t, lambda x: F.length(x) == 1))
        found = F.size(F.filter(t, lambda x: x.rlike(chords.MAYBE) & chords.is_chord(chords.clean(x))))
        return (
            F.when(s == "", True)
            .when((n <= 2) & (noise >= 4), True)
            .when((ratio < 0.20) & (noise >= 6), True)
            .when(_staff_noise(s, n, d, y) | _short_tokens(t, n), True)
            .when((F.size(t) >= 6) & (single >= F.size(t) * 0.7) & (n <= 4), True)
            .when((n >= 8) & (ratio > 0.35), False)
            .when(found >= 2, False)
            .otherwise((F.length(s) < 20) & ((noise >= 3) | (d >= 4)) & (n <= 3))
        )

    def counted(s: Column) -> Column:
        return F.struct(s.alias("s"), letters(s).alias("n"), digits(s).alias("d"), symbols(s).alias("y"), tokens(s).alias("t"))

    return once(stripped(line), lambda s: once(counted(s), lambda v: noisy(v["s"], v["n"], v["d"], v["y"], v["t"])))


def is_chord_noise(line: Column, light: bool = False) -> Column:
    found = chords.chord_tokens(line)
    single = F.size(F.filter(found, lambda x: F.length(x) == 1))
    n = F.size(found)
    if light:
        return is_staff_noise(line, light=True)
    return (n == 0) | ((n >= 6) & (single == n)) | ((n == 1) & (single == 1)) | (is_staff_noise(line) & (n < 2))


def is_fragmented(line: Column) -> Column:
    """Many tiny tokens with digits or single letters among them."""

    def fragmented(t: Column) -> Column:
        n, short = F.size(t), F.size(F.filter(t, lambda x: F.length(x) <= 2))
        digit = F.size(F.filter(t, lambda x: x.rlike(r"\p{Nd}")))
        lone = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}$")))
        marks = F.size(F.filter(t, lambda x: ~x.rlike(r"\p{L}")))
        return ((n >= 4) & (short >= n * 0.6) & ((digit >= 1) | (lone >= 2))) | ((short >= 2) & (digit >= 2)) | ((short >= 3) & (marks >= 2))

    return once(tokens(line), fragmented)


def is_footer_credit(line: Column, names: tuple[str, ...] = ()) -> Column:
    """Two to six words without digits, one of them of CREDIT or ``names``."""
    s = stripped(line)
    t = tokens(s)
    word = r"(?iU)\b(?:" + "|".join([*CREDIT, *names]) + r")\b"
    return F.length(s).between(8, 80) & (digits(s) == 0) & s.rlike(word) & F.size(t).between(2, 6) & F.forall(t, lambda x: x.rlike(r"\p{L}"))


def is_lowercase_lead(line: Column) -> Column:
    return (F.regexp_extract(line, r"(\p{L})", 1).rlike(r"^\p{Ll}$")) & (F.size(tokens(line)) >= 3) & ~line.contains("[")


def is_noisy_lead(line: Column) -> Column:
    t = tokens(line)
    short = F.size(F.filter(t, lambda x: F.length(x) <= 2))
    return (share(letters(line), F.length(line)) < 0.45) | (digits(line) >= 2) | (symbols(line) >= 4) | ((F.size(t) >= 4) & (short >= F.size(t) * 0.6))


def is_mostly_noise(line: Column) -> Column:
    """Blank, without letters unless it is a number, or marks of notation and recognition outnumber them."""
    s = F.coalesce(line, F.lit(""))
    n = letters(s)
    weird = count(s, "[\ufffd™—_|]")
    heavy = count(s, r"[|_—–…\[\]{}\\/*]+")
    return (
        F.when(is_blank(s), True)
        .when(n == 0, ~s.rlike(r"(?U)^[\p{Nd}\s]*$"))
        .when((n <= 2) & (count(s, r"[_|=~^*]") >= 4), True)
        .otherwise(((share(n, F.length(s)) < 0.20) & (weird + heavy >= 2)) | (weird >= 6))
    )


def is_structure_comment(line: Column) -> Column:
    return stripped(line).rlike(r"(?i)^\{comment:\s*(?:vers(?:e)?\s*\d+|chorus|bridge|coda|fine|d\.\s*[cs]\.\s*al\s*fine)\s*\}$")


def is_section_label(line: Column) -> Column:
    return stripped(line).rlike(r"(?i)^(?:vers(?:e)?\s*\d*|strophe\s*\d*|chorus|refrain|bridge|intro|outro|interlude|coda|ending)\s*:?$")


def is_solo(line: Column) -> Column:
    return F.lower(line).contains("solo") & (F.size(chords.chord_tokens(line)) >= 2)


def is_notation_name(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).contains("noten")


def is_gibberish(line: Column) -> Column:
    """The counting form, stricter than the one of the score."""
    n, d = letters(line), digits(line)
    return (share(n, F.length(line)) < 0.45) | ((d >= 2) & (d > F.floor(n / 3))) | (symbols(line, r"\[\]") >= 5) | ((n < 8) & (F.length(line) > 10))


def is_score_gibberish(line: Column) -> Column:
    n, d, u = letters(line), digits(line), uppers(line)
    return (share(n, F.length(line)) < 0.35) | (symbols(line, r"\[\]") >= 8) | ((d >= 3) & (d > n)) | ((u >= 8) & (u > n * 0.65))


def is_suspicious_first(line: Column) -> Column:
    return (digits(line) > 0) | (uppers(line) > F.greatest(F.lit(4.0), letters(line) * 0.7)) | (symbols(line) >= 4)


def is_fragmented_words(line: Column) -> Column:
    """Counting form over word, number and mark tokens."""
    s = stripped(chords.strip_chords(line))
    words, all_tokens = count(s, r"\p{L}+"), count(s, r"\p{L}+|\d+|\S")
    tiny, upper, bursts = count(s, r"(?<!\p{L})\p{L}{1,2}(?!\p{L})"), count(s, r"(?<!\p{L})\p{Lu}(?!\p{L})"), count(s, r"[^\p{L}\d\s]{2,}")
    return (all_tokens >= 5) & (words >= 4) & (((tiny >= 4) & (tiny >= F.ceil(words * 0.35))) | (upper >= 2) | (bursts >= 2))


def is_region_noise(value: Column, score: Column, width: Column, height: Column, least: float = 0.5) -> Column:
    """Recognised regions to discard: empty, tiny, low scores with digits or scraps, digits alone, or weird characters."""
    s = F.coalesce(value, F.lit(""))
    n, d, t = letters(s), digits(s), tokens(s)
    short = F.size(F.filter(t, lambda x: F.length(x) <= 2))
    return (
        (F.length(s) == 0)
        | (width < 4)
        | (height < 4)
        | ((score < max(least + 0.08, 0.55)) & (n <= 2) & (d > 0))
        | ((score < 0.55) & (F.size(t) >= 3) & (short >= F.size(t) * 0.75))
        | ((n == 0) & (d > 0))
        | ((symbols(s, r"\-/()") >= 4) & (n <= 3))
    )


def is_title_candidate(line: Column, name: Column) -> Column:
    s = stripped(line)
    fits = F.length(s).between(3, 80) & (digits(s) == 0) & ~s.rlike(r"[\[\]]") & ~is_section_label(s) & (letters(s) >= 6) & (uppers(s) >= 1) & ~chords.is_mostly_chords(s)
    return fits | (F.lower(s) == F.lower(name))


def lyric_score(line: Column) -> Column:
    """Of near-duplicate lines the one of larger score is better."""
    return letters(line) * 4 + F.size(tokens(line)) - digits(line) * 3 - symbols(line, r".,;:!?'\"()-") * 5


def is_notation_message(message: Column) -> Column:
    """Messages that speak of notation, images only or missing chords."""
    return F.lower(F.coalesce(message, F.lit(""))).rlike("noten|notation|sheet music|image.only|no chords")
