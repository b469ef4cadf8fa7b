"""Text functions as column expressions: script routing, cleaning, legacy encodings, repetition, tokens."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexicarta.functions.repeats import collapse_repeats

NATIVE_LETTER, LATIN_LETTER = "[က-႟]", "[A-Za-z]"
#: Consonants at which a syllable starts, and digits, which end one (fixed values).
CONSONANTS = "ကခဂဃငစဆၡညယရလဝသမဘဖပနဒထတဟအဧ"
DIGITS = "0-9၀-၉"
#: Texts that are no translation, whole and in part (fixed values).
BAD_EXACT = [
    "about glosbe", "about us", "add examples in batch", "add translations in batch", "all dictionaries", "contact us", "dictionary", "dictionary builder",
    "downloads", "feedback", "home", "partners", "privacy policy", "pronunciation recorder", "transliteration", "version",
]
BAD_MARKERS = ["no translation", "no exact", "sorry, no results", "fatal error", "not found", "failed"]
#: Words that carry no meaning of their own (fixed values).
STOPWORDS = (
    "a an and are as at be by can for from has have how in into is it its of on or that the this to was what when where which who with you your"
).split()
#: The first legacy encoding: a character, and the native one that it stands for; and characters that are dropped (fixed values).
LEGACY = [
    ("u", "က"), ("c", "ခ"), ("g", "ဂ"), ("C", "ဃ"), ("i", "င"), ("p", "ဘ"), ("q", "ဆ"), ("Z", "ဇ"), ("P", "ဈ"), ("n", "န"), ("m", "မ"), ("y", "ယ"),
    ("r", "ရ"), ("l", "လ"), ("w", "ဝ"), ("o", "သ"), ("h", "ဟ"), ("e", "အ"), ("E", "အ"), ("b", "ပ"), ("k", "ဖ"), ("x", "ထ"), ("v", "ဉ"), ("j", "ည"),
    ("D", "ည"), ("s", "စ"), ("t", "က"), ("f", "လ"), ("&", "အ"), (">", "ိ"), ("G", "ီ"), ("H", "ွ"), ("J", "ြ"), ("X", "ာ"), ("L", "ာ"), ("'", "်"),
    (".", "့"), (",", "ံ"), (";", "း"), ("<", "္"), ("0", "၀"), ("R", "ျ"), ("M", "ံ"), ("[", "ေ"), ("]", "ဲ"), ("z", "ဿ"), ("d", "ါ"), ("S", "ျ"),
    ("V", "ာ"), ("K", "ွ"), ("A", "ိ"), ("B", "ပ"), ("F", "လ"), ("N", "န"), ("T", "က"), ("W", "ဝ"), ("I", "င"), ("O", "ၚ"), ("U", "ဥ"), ("%", "း"),
    ("+", "ြ"), ("/", "္"), ("=", "ာ"), ("_", "း"),
]
LEGACY_FROM, LEGACY_TO = ("".join(x) for x in zip(*LEGACY, strict=True))
LEGACY_DROPPED = " \t\n-{}*"
#: Grammar labels (fixed values).
GRAMMAR = r"\b(v\.i\.|v\.t\.|v\.|n\.|adj\.|adv\.|prep\.|conj\.|pron\.|interj\.|part\.)\b"


def clean_visible_text(text: Column) -> Column:
    """White space squeezed and stripped."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


#: Letters that Unicode's full mapping makes several capitals of, and the one capital that the simple mapping has for them, or they themselves.
GROWING = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
CAPITALS = [{"ß": "ẞ"}.get(c) or (c.title() if len(c.title()) == 1 else c) for c in GROWING]


def simple_upper(text: Column) -> Column:
    """Upper case as SQL engines have it, a letter for a letter; Spark's own upper() makes two letters of `ß`."""
    grow = "".join(GROWING)
    pieces = F.regexp_extract_all(text, F.lit(f"[{grow}]|[^{grow}]+"), 0)
    each = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{grow}]$"), F.translate(p, grow, "".join(CAPITALS))).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{grow}]"), F.array_join(each, "")).otherwise(F.upper(text))


def normalise_english(text: Column) -> Column:
    """Joining marks become spaces, & becomes and, other marks go, lower case, one space between words."""
    joined = F.replace(F.translate(F.coalesce(text, F.lit("")), "_-", "  "), F.lit("&"), F.lit(" and "))
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(joined, "[^A-Za-z0-9' ]+", " ")), " +", " "))


def split_tokens(text: Column) -> Column:
    """The words of the normalised text."""
    return F.filter(F.split(normalise_english(text), " "), lambda t: t != "")


def script_flags(text: Column) -> Column:
    """(native, latin, leads): holds a native letter, a Latin one, has a line that starts with a native one."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.rlike(NATIVE_LETTER).alias("native"), t.rlike(LATIN_LETTER).alias("latin"), t.rlike(r"(?m)^\s*" + NATIVE_LETTER).alias("leads"))


def detect_direction(text: Column, mode: Column | None = None) -> Column:
    """The forced mode, else by script, else the default."""
    auto = F.when(text.rlike(NATIVE_LETTER), "ksw-to-en").when(text.rlike(LATIN_LETTER), "en-to-ksw").otherwise("en-to-ksw")
    return auto if mode is None else F.when(mode.isin("en-to-ksw", "ksw-to-en"), mode).otherwise(auto)


def is_useful_result(text: Column, direction: Column) -> Column:
    """Not blank, of 180 characters at most, none of the texts known to be bad, of the script asked for."""
    t = clean_visible_text(text)
    low = F.lower(t)
    marked = low.rlike("|".join(BAD_MARKERS))
    script = F.when(direction == "en-to-ksw", t.rlike(NATIVE_LETTER)).otherwise(t.rlike(LATIN_LETTER))
    return (t != "") & (F.length(t) <= 180) & ~low.isin(BAD_EXACT) & ~marked & script


def is_clean(text: Column) -> Column:
    """No ASCII but the marks that native text has."""
    return ~text.rlike(r"[\x00-\x09\x0b-\x1f!-&(-+/-9<-\x7f]")


def convert_legacy(text: Column) -> Column:
    """A whole-string repeat collapsed, then each character of the first legacy encoding converted or dropped; others stay."""
    return F.translate(dedupe_block(text), LEGACY_FROM + LEGACY_DROPPED, LEGACY_TO)


def dedupe_block(text: Column) -> Column:
    """One copy of a string that is eight, four or two copies of something."""
    n = F.length(text)
    out = None
    for k in (8, 4, 2):
        part = F.substring(text, F.lit(1), (n / k).cast("int"))
        hit = (n > 0) & (n % k == 0) & (F.repeat(part, F.lit(k)) == text)
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out.otherwise(text)


@F.pandas_udf(StringType())
def dedupe_walk(text: pd.Series) -> pd.Series:
    """Local repeats collapsed, in strings of any length."""
    return text.map(collapse_repeats, na_action="ignore")


def split_syllables(text: Column) -> Column:
    """Syllables: each starts at a consonant; digits, spaces and other scripts end one."""
    other = f"[က-႟&&[^{CONSONANTS}{DIGITS}]]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{CONSONANTS}]{other}*|{other}+"), 0)


def syllables_of(text: str) -> list[str]:
    """split_syllables() of one text, for Python inside a task."""
    other = f"(?![{CONSONANTS}{DIGITS}])[က-႟]"
    return re.findall(f"[{CONSONANTS}](?:{other})*|(?:{other})+", text)


def part_of_speech(text: Column) -> Column:
    """The first grammar label, null without one; as the label's last mark is followed by a word boundary, it is glued to a word."""
    return F.nullif(F.regexp_extract(text, GRAMMAR, 1), F.lit(""))


def extract_after(text: Column, marker: str) -> Column:
    """What follows the first marker: the first native run after it, else English words directly after; null without."""
    at = F.instr(F.lower(text), F.lit(marker.lower()))
    rest = F.substring(text, at + len(marker), F.length(text))
    # what counts as a target: a native run, or English words of so many letters (fixed patterns)
    native = F.btrim(F.regexp_extract(rest, r"[က-႟ꩠ-ꩿ][က-႟ꩠ-ꩿ\s]*", 0))
    english = F.btrim(F.regexp_extract(rest, r"^[A-Za-z][A-Za-z\s\-]{1,40}", 0))
    return F.when(at > 0, F.coalesce(F.nullif(native, F.lit("")), F.nullif(english, F.lit(""))))


def split_columns(line: Column) -> Column:
    """(left, right) of a line of two columns with two or more blanks between; null if it isn't one."""
    parts = F.split(line, r"\s{2,}", 2)
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.struct(parts[0].alias("left"), parts[1].alias("right")))


def short_gloss(meanings: Column) -> Column:
    """The first alternative of each meaning, in order; those without one are left out."""
    known = F.filter(meanings, lambda m: (m != "") & (m != "??"))
    first = F.transform(known, lambda m: F.btrim(F.substring_index(F.substring_index(m, "/", 1), ",", 1)))
    return F.when(F.size(known) == 0, "unresolved").otherwise(F.array_join(first, " "))
