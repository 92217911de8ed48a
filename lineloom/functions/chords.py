"""Chord tokens: grammar, repair, naming, sequences, positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import at

_ROOT, _ACC = "[A-H]", "(?:#|b|is|es)?"
_QUALITY = "(?:m|maj|min|sus|add|dim|aug)?"
_EXT = "(?:2|4|5|6|7|9|11|13)?"
_BASS = f"(?:/{_ROOT}{_ACC})?"
#: One grammar; the variants differ in extensions, suspensions and accidentals.  Fixed values.
GRAMMAR = {
    "basic": f"{_ROOT}{_ACC}{_QUALITY}{_EXT}{_BASS}",
    "sus": f"{_ROOT}{_ACC}{_QUALITY}{_EXT}(?:sus[24])?{_BASS}",
    "any_sus": rf"{_ROOT}{_ACC}{_QUALITY}\d*(?:sus[24])?{_BASS}",
    "any": rf"{_ROOT}{_ACC}{_QUALITY}\d*{_BASS}",
    "sharp": f"{_ROOT}[#b]?{_QUALITY}{_EXT}(?:/{_ROOT}[#b]?)?",
    "loose": "[A-H](?:#|b)?(?:m|maj|min|sus|add|dim|aug)?[0-9/+#b]*(?:/[A-H](?:#|b)?)?",
}
BRACKETED = r"\[[A-GH][#b♯♭]?(?:m|M|maj|min|dim|aug)?(?:add|sus)?(?:[0-9]{1,2})?(?:/[A-GH][#b♯♭]?)?\]"
#: Misread chord tokens and what they mean, in order.  Fixed values.
MISREAD = [
    (r"(?i)^([A-H])l(?=[A-Z])", "$1"),
    (r"(?i)^([A-H])i?m$", "$1m"),
    (r"(?i)^([A-H])(?:ma|mqj|maij|mai)7$", "$1maj7"),
    (r"(?i)^([A-H])i([0-9]+)$", "$1$2"),
]
#: Tokens of a row of chord names without brackets.  Fixed value.
BARE = r"^(?:[A-H][#b]?(?:m|M|maj|min|dim|aug|sus\d?|add\d?)?[0-9]?|[#b♯♭]|m|[0-9])$"
#: Tokens of which cleaning leaves anything, and those of which it may leave a chord: the first letter stays the first.
SOME, MAYBE = "[A-Za-z0-9#/]", "^[^A-Za-z0-9#/]*[A-Ha-h]"
ANCHOR = "array<struct<pos:int,chord:string>>"


def is_chord(token: Column, variant: str = "basic") -> Column:
    return F.coalesce(token, F.lit("")).rlike(f"(?i)^{GRAMMAR[variant]}$")


def find_chords(c: Column, variant: str = "basic") -> Column:
    """Chords standing anywhere between word ends."""
    return F.regexp_extract_all(c, F.lit(rf"(?i)(?<![\p{{L}}\p{{Nd}}])({GRAMMAR[variant]})(?![\p{{L}}\p{{Nd}}#])"), F.lit(1))


def is_valid_bracket(c: Column) -> Column:
    """Whether ``[...]`` holds a well-formed chord."""
    return F.coalesce(c, F.lit("")).rlike(f"^{BRACKETED}$")


def clean(token: Column) -> Column:
    """A chord token with the usual misreadings repaired; a lone small letter is a minor chord."""
    def named(out: Column) -> Column:
        minor = F.concat(F.upper(out), F.lit("m"))
        raised = F.regexp_replace(F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20)), "^([A-H])[hH]", "$1")
        return F.when(out.rlike("^[a-h]$"), minor).when(out.rlike("^[A-H]$"), out).otherwise(raised)

    return text.once(text.apply_rules(F.regexp_replace(text.stripped(token), "[^A-Za-z0-9#b/]+", ""), MISREAD), named)


def light_clean(token: Column) -> Column:
    """Punctuation around a token and marks within it removed."""
    return F.regexp_replace(F.regexp_replace(token, r"^[\[\](){},.;:|]+|[\[\](){},.;:|]+$", ""), "[^A-Za-z0-9#/+-]+", "")


def german(chord: Column) -> Column:
    """English names in German: B flat is B, B is H; of other chords the bass only."""
    bass = F.regexp_replace(F.regexp_replace(chord, "/B(?!b)", "/H"), "/Bb", "/B")
    return F.when(chord.startswith("Bb"), F.concat(F.lit("B"), F.substring(chord, 3, 1 << 20))).when(chord.startswith("B"), F.concat(F.lit("H"), F.substring(chord, 2, 1 << 20))).otherwise(bass)


def root(chord: Column) -> Column:
    got = F.regexp_extract(F.coalesce(chord, F.lit("")), "^([A-H](?:#|b|is|es)?)", 1)
    return F.when(got != "", got)


def is_minor(chord: Column, strict: bool = False) -> Column:
    """``m`` at the end; strictly, a lone ``m`` after a mark."""
    return chord.rlike(r"(?i)(?:^|[^\w])m(?!aj)(?![\w])") if strict else F.lower(chord).endswith("m")


def is_major(chord: Column, strict: bool = False) -> Column:
    return F.lower(chord).contains("maj") | ~is_minor(chord, strict)


def is_root_token(token: Column) -> Column:
    return token.rlike("^[A-H][#b]?$")


def is_modifier_token(token: Column) -> Column:
    return token.rlike(r"(?i)^(?:m|maj|min|sus|add|dim|aug)?\d{0,2}$") & (token != "")


def chord_tokens(line: Column, variant: str = "sus") -> Column:
    """The chords among a line's tokens, repaired."""
    return F.filter(F.transform(F.filter(text.tokens(line), lambda t: t.rlike(MAYBE)), clean), lambda t: is_chord(t, variant))


def cleaned_tokens(line: Column) -> Column:
    return F.transform(F.filter(text.tokens(line), lambda t: t.rlike(SOME)), clean)


def is_chord_only(line: Column, variant: str = "sus") -> Column:
    """At least one token, and every one a chord."""
    t = F.filter(text.tokens(line), lambda x: x.rlike(SOME))
    return text.once(t, lambda t: (F.size(t) > 0) & F.forall(t, lambda x: x.rlike(MAYBE) & is_chord(clean(x), variant)))


def is_mostly_chords(line: Column, least: int = 2, share: float = 0.6) -> Column:
    """Tolerant form: split tokens are merged first; six or more chords that are nearly all single letters do not count."""
    t = F.filter(merge_split(text.tokens(line)), lambda x: x.rlike(SOME))

    def mostly(t: Column, found: Column) -> Column:
        n, m, single = F.size(found), F.size(t), F.size(F.filter(found, lambda x: F.length(x) == 1))
        return (n >= least) & (n >= m * share) & ~((n >= 6) & (single >= n * 0.85))

    def chords(t: Column) -> Column:
        return F.filter(F.transform(F.filter(t, lambda x: x.rlike(MAYBE)), clean), lambda x: is_chord(x))

    return text.once(t, lambda t: text.once(chords(t), lambda found: mostly(t, found)))


def is_dominant(line: Column, share: float = 0.7) -> Column:
    t = cleaned_tokens(line)
    n = F.size(F.filter(t, lambda x: is_chord(x)))
    return (n >= 1) & (n >= F.ceil(F.size(t) * share))


def is_likely(line: Column) -> Column:
    """All tokens but one at most are chords; an empty line is."""
    t = cleaned_tokens(line)
    return (F.size(t) == 0) | (F.size(F.filter(t, lambda x: is_chord(x))) >= F.greatest(F.lit(1), F.size(t) - 1))


def only_tokens(line: Column) -> Column:
    """The chords of a line of chords, null for any other line."""
    return F.when(is_chord_only(line), chord_tokens(line))


def is_bare_row(line: Column) -> Column:
    """One to eight tokens without brackets, each a chord, an accidental, ``m`` or a digit."""
    t = text.tokens(line)
    return ~line.rlike(r"[\[\]]") & F.size(t).between(1, 8) & F.forall(t, lambda x: x.rlike(BARE))


def has_chords(line: Column) -> Column:
    n = F.size(chord_tokens(line))
    return line.rlike(r"\[[^\]]*\]") | ((n >= 2) & (is_chord_only(line) | line.contains("\t")))


def strip_chords(line: Column) -> Column:
    return F.regexp_replace(line, r"\[[^\]]+\]", "")


def count_brackets(line: Column) -> Column:
    return text.count(line, r"\[[^\]]+\]")


def drop_invalid(line: Column) -> Column:
    """Without bracketed parts that are no chord."""
    return F.regexp_replace(line, rf"(?!{BRACKETED})\[[^\]]*\]", "")


def render(chords: Column, joint: str = " ") -> Column:
    return F.array_join(F.transform(chords, lambda c: F.concat(F.lit("["), c, F.lit("]"))), joint)


def render_line(chords: Column) -> Column:
    """A line of chords alone: bracketed, with rules after them that keep them apart from the text."""
    return F.concat(render(chords), F.lit(" ----"))


def even_placement(chords: Column, words: Column) -> Column:
    """``array<struct<chord, at>>``: the word each chord goes to, spread evenly, halves to even."""
    c, w = F.size(chords), F.size(words)
    at = F.when(c <= 1, F.lit(0)).otherwise(0)
    return F.when(
        w > 0,
        F.transform(chords, lambda x, i: F.struct(x.alias("chord"), F.when(c > 1, F.bround(i * (w - 1) / F.greatest(c - 1, F.lit(1)))).otherwise(at).cast("int").alias("at"))),
    ).otherwise(F.array().cast("array<struct<chord:string,at:int>>"))


def insert_evenly(chords: Column, words: Column) -> Column:
    """The words with the chords before the words they go to."""
    placed = even_placement(chords, words)
    return F.array_join(F.transform(words, lambda w, j: F.concat(F.array_join(F.transform(F.filter(placed, lambda p: p["at"] == j), lambda p: F.concat(F.lit("["), p["chord"], F.lit("]"))), ""), w)), " ")


def carry_minor(chords: Column, both: bool = False) -> Column:
    """Left to right: a single letter beside a minor chord (or between two) becomes minor; changes carry on."""
    last = F.size(chords) - 1
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        i = acc["i"]
        before = F.when(i > 0, F.lower(at(acc["out"], -1)).endswith("m")).otherwise(False)
        after = F.when(i < last, F.lower(at(chords, F.least(i + 2, F.size(chords)))).endswith("m")).otherwise(False)
        inner = (i > 0) & (i < last)
        turn = (F.length(c) == 1) & inner & ((before & after) if both else (before | after))
        return F.struct((i + 1).alias("i"), F.concat(acc["out"], F.array(F.when(turn, F.concat(c, F.lit("m"))).otherwise(c))).alias("out"))

    return F.when(F.size(chords) > 0, F.aggregate(chords, start, step)["out"]).otherwise(chords)


def merge_split(tokens: Column) -> Column:
    """A root followed by a modifier becomes one token, pairwise from the left."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"])))

    def step(acc: Column, t: Column) -> Column:
        joins = acc["open"].isNotNull() & is_root_token(acc["open"]) & is_modifier_token(t)
        return F.when(joins, F.struct(F.lit(None).cast("string").alias("open"), F.concat(acc["out"], F.array(F.concat(acc["open"], t))).alias("out"))).otherwise(F.struct(t.alias("open"), put(acc).alias("out")))

    return F.aggregate(tokens, start, step, put)


def retokenize(line: Column) -> Column:
    """Tokens rejoined: a letter with is or es, a chord with digits or with a bass; what is joined may join on."""
    start = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        last = at(acc, -1)
        joins = (F.size(acc) > 0) & ((last.rlike("^[A-Ha-h]$") & t.rlike("(?i)^[ie]s$")) | (is_chord(last, "any") & (t.rlike(r"^\d+$") | t.rlike("(?i)^/[A-H]"))))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, t)))
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(text.tokens(line), start, step)


def split_leading(line: Column) -> Column:
    """``struct<chords, rest>`` of a line of three tokens or more whose first two or more are chords, else null."""
    t = text.tokens(line)
    n = F.coalesce(F.array_min(F.transform(t, lambda x, i: F.when(~is_chord(clean(x), "any"), i))), F.size(t))
    return F.when((F.size(t) >= 3) & (n >= 2) & (n < F.size(t)), F.struct(F.slice(t, F.lit(1), n).alias("chords"), F.array_join(F.slice(t, n + 1, F.size(t) - n), " ").alias("rest")))


def anchors(line: Column) -> Column:
    """Bracketed chords of a line with their positions in the text without chords."""
    parts = F.regexp_extract_all(line, F.lit(r"(\[[^\]]+\]|[^\[]+|\[)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(ANCHOR).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        chord = p.rlike(r"^\[[^\]]+\]$")
        one = F.array(F.struct(acc["at"].alias("pos"), F.substring(p, 2, F.length(p) - 2).alias("chord")))
        return F.when(chord, F.struct(acc["at"].alias("at"), F.concat(acc["out"], one).alias("out"))).otherwise(F.struct((acc["at"] + F.length(p)).alias("at"), acc["out"].alias("out")))

    return F.aggregate(parts, start, step)["out"]


def positions(line: Column, tab: int = 12) -> Column:
    """Tokens of a line with their columns, tab stops every ``tab`` characters: ``array<struct<pos, chord>>``."""
    parts = F.regexp_extract_all(line, F.lit(r"(\t| +|[^\t ]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(ANCHOR).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"]
        return (
            F.when(p == "\t", F.struct(((F.floor(at / tab) + 1) * tab).cast("int").alias("at"), acc["out"].alias("out")))
            .when(p.startswith(" "), F.struct((at + F.length(p)).alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct((at + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("pos"), p.alias("chord")))).alias("out")))
        )

    return F.aggregate(parts, start, step)["out"]


def insert_at(lyric: Column, placed: Column) -> Column:
    """``lyric`` with each chord of ``placed`` before its character; chords of one position in order given."""
    n = F.length(lyric)
    spots = F.array_sort(F.transform(placed, lambda p, i: F.struct(F.least(F.greatest(p["pos"], F.lit(0)), n).alias("pos"), i.alias("i"), p["chord"].alias("chord"))))

    def put(found: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            end = F.coalesce(at(found, i + 2)["pos"], n)
            return F.concat(F.coalesce(F.concat(F.lit("["), p["chord"], F.lit("]")), F.lit("")), F.substring(lyric, p["pos"] + 1, end - p["pos"]))

        return F.concat(F.substring(lyric, F.lit(1), F.coalesce(at(found, 1)["pos"], n)), F.array_join(F.transform(found, piece), ""))

    # Put through an array of one, so that the places are found once and not for each use.
    return at(F.transform(F.array(spots), put), 1)


def place_by_column(chord_line: Column, lyric: Column, tab: int = 12) -> Column:
    """Anchors scaled from a tabbed chord line to a lyric, moved to word starts; the first chord goes to column 0."""
    found = positions(chord_line, tab)
    width = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda p: p["pos"] + F.length(p["chord"]))), F.lit(1)), F.lit(1))
    words = text.word_spans(lyric)

    def move(target: Column) -> Column:
        inside = at(F.filter(words, lambda w: (w["start"] <= target) & (w["end"] >= target)), 1)
        following = at(F.filter(words, lambda w: w["start"] > target), 1)
        previous = at(F.filter(words, lambda w: w["end"] < target), -1)
        short = inside.isNotNull() & ((inside["end"] - inside["start"] + 1) <= 3) & following.isNotNull()
        return F.coalesce(F.when(short & (target > inside["start"]), following["start"]), inside["start"], F.when(previous.isNotNull() & (target - previous["end"] <= 4), previous["start"]), following["start"], target)

    return F.transform(found, lambda p, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(move(F.bround(p["pos"] / width * F.length(lyric)).cast("int"))).cast("int").alias("pos"), p["chord"].alias("chord")))


def paragraph_chords(line: Column, runs: Column) -> Column:
    """The chords of a paragraph of chords, told by its text or, if it has two runs of text or more, by its runs; else null."""
    parts = F.filter(F.transform(runs, lambda r: clean(r)), lambda t: t != "")
    by_run = (F.size(parts) >= 2) & F.forall(parts, lambda x: is_chord(x))
    return F.when(is_chord_only(line), chord_tokens(line)).when(F.coalesce(by_run, F.lit(False)), parts)


def segments(line: Column) -> Column:
    """A line cut into runs of chords and of other tokens: ``array<struct<chord, tokens>>``."""
    start = F.array().cast("array<struct<chord:boolean,tokens:array<string>>>")

    def step(acc: Column, t: Column) -> Column:
        chord, last = is_chord(clean(t), "any"), at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(chord.alias("chord"), F.concat(last["tokens"], F.array(t)).alias("tokens"))))
        return F.when((F.size(acc) > 0) & F.coalesce(last["chord"] == chord, F.lit(False)), grown).otherwise(F.concat(acc, F.array(F.struct(chord.alias("chord"), F.array(t).alias("tokens")))))

    return F.aggregate(text.tokens(line), start, step)
