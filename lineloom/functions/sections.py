"""Section labels, headers, comments, directives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import edit_similarity
from .text import at, digits, letters, phrase_key, stripped, symbols, uppers

#: Header keys and section names that documents may use.  Fixed values.
HEADER_KEYS = (
    "title", "sorttitle", "subtitle", "artist", "composer", "lyricist", "copyright", "rights", "album",
    "year", "key", "time", "tempo", "duration", "capo", "meta", "author", "ccli", "book", "number",
    "flow", "midi", "midi_index", "pitch", "keywords", "topic", "comment", "restrictions",
    "ccli_license", "footer", "notes", "original_key", "original_capo", "transposedkey", "in",
    "subdivision", "beat", "transpose", "scene",
)
SECTIONS = (
    "chorus", "verse", "bridge", "grid", "part", "define", "tap", "comment", "start_of_chorus", "end_of_chorus",
    "start_of_verse", "start_of_bridge", "start_of_tab", "start_of_grid", "end_of_verse", "end_of_bridge",
    "end_of_tab", "end_of_grid", "start_of_part", "end_of_part", "comment_bold", "comment_italic",
    "guitar_comment", "new_page", "new_physical_page", "intro", "outtro", "refrain", "vers", "strophe",
    "coda", "ending", "interlude", "zwischenspiel", "pre_chorus", "pre_refrain", "post_chorus",
    "post_refrain", "misc", "pre_bridge", "pre_coda", "post_bridge", "poat_coda", "teil", "unbekannt",
    "unbenannt", "instrumental", "chor", "solo", "tag",
)
KEY_ALIASES = {"text": "lyricist", "melodie": "composer", "rechte": "rights", "urheber": "copyright", "autor": "author"}
SECTION_ALIASES = {"refrain": "Chorus", "refr": "Chorus", "ref": "Chorus", "chorus": "Chorus", "strophe": "Vers", "verse": "Vers", "vers": "Vers", "zwischenspiel": "Interlude", "interlude": "Interlude", "bridge": "Bridge", "intro": "Intro", "outro": "Outro"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normal_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(c)), r"\s+", "_")


#: Labels at the start of a line, in order: pattern and section; of a verse the first group is its number.  Fixed values.
LABELS = [
    (r"(?i)^(?:refrain|refr\.?|chorus)\s*[:.]?\s*", "chorus"),
    (r"(?i)^bridge\s*[:.]?\s*", "bridge"),
    (r"(?i)^(?:verse|vers)\s*(\d+)\s*[:.]?\s*", "verse"),
    (r"^(\d+)[.)]\s*", "verse"),
]


def parse_label(line: Column) -> Column:
    """``struct<section, rest>`` or null: what recognition leaves of a refrain, the LABELS in order, then ``word:`` or ``word.`` of SECTIONS."""
    s = stripped(line)

    def out(section: Column, remains: Column) -> Column:
        return F.struct(section.alias("section"), stripped(remains).alias("rest"))

    found = F.when(F.lower(s).startswith("ain"), out(F.lit("chorus"), F.regexp_replace(F.substring(s, 4, 1 << 20), "^[ :.-]+", "")))
    for pattern, section in LABELS:
        name = F.concat(F.lit("verse "), F.regexp_extract(s, pattern, 1)) if section == "verse" else F.lit(section)
        found = found.when(s.rlike(pattern), out(name, F.regexp_replace(s, pattern, "")))
    word = r"(?s)^([A-Za-zÄÖÜäöüß_]+)\s*[:.]\s*(.*)$"
    label = normal_label(F.regexp_extract(s, word, 1))
    return found.when(label.isin(*SECTIONS), out(label, F.regexp_extract(s, word, 2)))


def prefix_section(line: Column, most: int = 0) -> Column:
    """``Vers n``, Chorus, Bridge, Intro, Outro, Interlude at the start of a line; verses beyond ``most`` shrink to their first digit."""
    s = F.lower(stripped(line))
    n = F.regexp_extract(s, r"^vers(?:e)?\s*(\d+)", 1)
    number = F.when(n.cast("long") > most, F.substring(n, 1, 1)).otherwise(n) if most else n
    out = F.when(n != "", F.when(number.cast("long") > 0, F.concat(F.lit("Vers "), number)))
    for name in ("Chorus", "Bridge", "Intro", "Outro", "Interlude"):
        out = out.when(s.startswith(name.lower()), F.lit(name))
    return out.when(s.startswith("refr"), F.lit("Chorus"))


def structure_marker(line: Column) -> Column:
    """A line that is nothing but a structure marker."""
    s = F.lower(stripped(line))
    n = F.regexp_extract(s, r"^vers(?:e)?\s*([1-9])[.:]?$", 1)
    return (
        F.when(n != "", F.concat(F.lit("Vers "), n))
        .when(s.rlike(r"^(?:chorus|refrain)[.:]?$"), "Chorus")
        .when(s.rlike(r"^fine[.:]?$"), "Fine")
        .when(s.rlike(r"^d\.?\s*c\.?\s*al\s*fine[.:]?$"), "D.C. al Fine")
        .when(s.rlike(r"^d\.?\s*s\.?\s*al\s*fine[.:]?$"), "D.S. al Fine")
        .when(s.rlike(r"^coda[.:]?$"), "Coda")
        .when(s.rlike(r"^bridge[.:]?$"), "Bridge")
    )


def verse_prefix(line: Column) -> Column:
    """``struct<marker, rest>`` of ``2. text`` (1 to 9; l and I are 1), else a null marker and the line."""
    n = F.regexp_extract(line, r"^\s*([1-9lI])\s*[.)]\s*\S", 1)
    marker = F.when(n != "", F.concat(F.lit("Vers "), F.when(n.isin("l", "I"), F.lit("1")).otherwise(n)))
    return F.struct(marker.alias("marker"), F.when(n != "", F.regexp_replace(line, r"^\s*[1-9lI]\s*[.)]\s*", "")).otherwise(line).alias("rest"))


def single_word_label(line: Column) -> Column:
    """The section that a line of one word names, whatever marks stand around its letters."""
    s = stripped(line)
    word = normal_label(F.regexp_replace(s, "[^a-zA-ZäöüÄÖÜß]", ""))
    return F.when(~s.rlike(r"\s") & word.isin(*SECTIONS), word)


def section_type(name: Column) -> Column:
    """Canonical name of a section; others with a capital."""
    key = F.lower(stripped(name))
    return F.coalesce(at(_map(SECTION_ALIASES), key), F.initcap(key))


def format_comment(section: Column, label: Column | None = None) -> Column:
    """The comment directive of a section; a label of a reference document goes first."""
    default = F.when(section.startswith("verse "), section).when(section == "chorus", "chorus").otherwise(F.replace(section, F.lit("_"), F.lit(" ")))
    name = default if label is None else F.coalesce(label, default)
    return F.concat(F.lit("{comment: "), name, F.lit("}"))


def header_line(line: Column) -> Column:
    """``struct<key, value>`` of ``Key: value`` with a known key or alias, else null."""
    key = normal_label(F.regexp_extract(line, r"^\s*([^:]+):", 1))
    name = F.coalesce(F.when(key.isin(*HEADER_KEYS), key), at(_map(KEY_ALIASES), key))
    value = stripped(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    return F.when(name.isNotNull() & (value != ""), F.struct(name.alias("key"), value.alias("value")))


def metadata(line: Column) -> Column:
    """All credits of a line: ``array<struct<key, value>>``."""
    rules = (("lyricist", r"(?i)\b(?:text|worte):\s*([^;|]+)"), ("composer", r"(?i)\b(?:melodie|musik):\s*([^;|]+)"), ("arranger", r"(?i)\bsatz:\s*([^;|]+)"), ("rights", r"(?i)\brechte:\s*([^;|]+)"), ("copyright", r"(?:©|\(c\))\s*([^;|]+)"))
    found = [F.when(F.regexp_extract(line, p, 1) != "", F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(line, p, 1)).alias("value"))) for k, p in rules]
    return F.array_compact(F.array(*found))


def directive(line: Column, name: str) -> Column:
    """The value of ``{name: value}`` or null."""
    pattern = rf"(?i)^\{{{name}:(.*)\}}$"
    return F.when(stripped(line).rlike(pattern), F.trim(F.regexp_extract(stripped(line), pattern, 1)))


def subtitle_of(line: Column) -> Column:
    got = F.regexp_extract(line, r"\(([^)]*)\)", 1)
    return F.when(got != "", got)


def cut_header(line: Column) -> Column:
    """Without what follows a bar or a run of rules."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\|.*$", ""), r"[=~_-]{3,}.*$", ""))


def clean_title(c: Column) -> Column:
    return stripped(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\s*[-–—:]\s*$|\s{2,}", " "))


def is_suspicious_title(c: Column) -> Column:
    return (digits(c) > 0) | (symbols(c, ":,-") >= 2) | (uppers(c) > F.greatest(F.lit(4.0), letters(c) * 0.8))


def better_title(title: Column, name: Column) -> Column:
    """The file's name where a title is unlike it or suspicious."""
    return F.when((edit_similarity(phrase_key(title), phrase_key(name)) < 0.45) | is_suspicious_title(title), name).otherwise(title)


def is_title_fragment(line: Column, title: Column) -> Column:
    """Parts of the title that recognition left in the body."""
    a, b = phrase_key(line), phrase_key(title)
    t = F.filter(F.split(stripped(line), r"\s+"), lambda x: x != "")
    mean = F.aggregate(t, F.lit(0.0), lambda acc, x: acc + F.length(x)) / F.greatest(F.size(t), F.lit(1))
    s = edit_similarity(a, b)
    return (F.length(a) >= 10) & ((s >= 0.72) | ((F.size(t) >= 4) & (mean <= 4.2) & (s >= 0.48)) | (F.contains(b, a) & (F.length(a) >= F.length(b) * 0.55)))


def header(fields: dict[str, Column]) -> Column:
    """Directives of all fields that are not null, one a line."""
    return F.concat_ws("\n", *[F.when(v.isNotNull() & (v != ""), F.concat(F.lit("{" + k + ": "), v, F.lit("}"))) for k, v in fields.items()])


def title_penalty(title: Column, expected: Column | None = None) -> Column:
    n, u = letters(title), uppers(title)
    out = F.when(digits(title) > 0, 18.0).otherwise(0.0) + F.when(title.rlike("[:;|_?!]"), 18.0).otherwise(0.0) + F.when((n > 0) & (u > F.greatest(F.lit(4.0), n * 0.72)), 14.0).otherwise(0.0)
    if expected is not None:
        s = edit_similarity(phrase_key(title), phrase_key(expected))
        out = out + F.when(stripped(expected) == "", 0.0).when(s < 0.45, 30.0).when(s < 0.70, 12.0).otherwise(0.0)
    return F.when(stripped(title) == "", F.lit(40.0)).otherwise(out)


def prefers_name(title: Column, name: Column) -> Column:
    """Whether the file's name makes the better title: one doubtful word against several, or a doubtful likeness of it."""
    words = lambda c: F.size(F.filter(F.split(stripped(c), r"\s+"), lambda x: x != ""))
    doubtful = is_suspicious_title(title)
    s = edit_similarity(phrase_key(title), phrase_key(name))
    return ((words(title) == 1) & (words(name) >= 2) & (doubtful | (F.length(title) < F.length(name) * 0.5))) | ((s >= 0.45) & (doubtful | (s >= 0.78)))


def copyright_of(line: Column) -> Column:
    """``struct<rank, value>``: an explicit label ranks before a bare sign, other lines are null."""
    named = F.regexp_extract(line, r"(?i)\b(?:copyright|urheber|rechte)\s*:\s*(.+)$", 1)
    sign = F.regexp_extract(line, r"((?:©|\(c\)).{2,120})$", 1)
    return F.when(named != "", F.struct(F.lit(0).alias("rank"), F.trim(named).alias("value"))).when((sign != "") & (letters(line) >= 4), F.struct(F.lit(1).alias("rank"), F.trim(sign).alias("value")))
