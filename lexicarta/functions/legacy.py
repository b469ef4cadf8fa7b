"""The second legacy encoding: native text and romanised form of its words, token by token."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the encoding: token, native text, romanised form.
CONSONANTS = [
    ("u", "က", "guh"), ("c", "ခ", "hkuh"), ("C", "ဂ", "ghuh"), ("*", "ဃ", "hcah"), ("i", "င", "nguh"), ("p", "စ", "suh_chuh"), ("q", "ဆ", "hsuh_shuh"),
    ("n", "ည", "nyuh"), ("w", "တ", "tuh"), ("x", "ထ", "htuh"), ("'", "ဒ", "duh"), ("e", "န", "nuh"), ("y", "ပ", "pbuh"), ("z", "ဖ", "hpuh"), ("b", "ဘ", "buh"),
    ("r", "မ", "muh"), (",", "ယ", "yuh"), ("&", "ရ", "ruh"), ("v", "လ", "luh"), ("0", "ဝ", "wuh"), ("o", "သ", "thuh"), ("[", "ဟ", "huh"), ("t", "အ", "uh"), ("{", "ဧ", "uh2"),
]
VOWELS = [("g", "ါ", "ah"), ("R", "ံ", "ee"), ("X", "ၢ", "er"), ("m", "့", "ay"), ("L", "ီ", "aw"), ("H", "ိ", "oh"), ("J", "ဲ", "eh"), ("l", "ူ", "oo"), ("k", "ု", "u")]
TONES = [("I", "ၒ", "tone2_er_thee"), ("P", "ၓ", "tone3_ah_thee"), (">", "း", "tone4_pler_chee"), ("O", "ၔ", "tone5_hah_thee"), (":", "ၕ", "tone6_geh_poh")]
MEDIALS = [("F", "ျ", "med_ya"), ("-", "ြ", "med_ra"), ("G", "ွ", "med_wa"), ("s", "ၠ", "med_la")]
PAIRS = [("%S", "ၡ", "shuh2"), ("r~", "မ်", "maw"), ("'~", "ဒ်", "dee")]
WITHOUT_MEDIALS = ["t", "{"]

TOKEN = r"(?s)%S|r~|'~|."


def lookup(rows: list, column: int) -> Column:
    return F.create_map(*[F.lit(x) for r in rows for x in (r[0], r[column])])


def decode_legacy2(word: Column) -> Column:
    """Native text: tokens converted, others kept; a medial after a consonant that takes none stays as it is."""
    known = lookup(CONSONANTS + VOWELS + TONES + MEDIALS + PAIRS, 1)
    consonants, medials = [r[0] for r in CONSONANTS] + ["%S"], [r[0] for r in MEDIALS]
    first = F.struct(F.lit("").alias("out"), F.lit(False).alias("bare"))

    def step(state: Column, token: Column) -> Column:
        kept = token.isin(medials) & state["bare"]
        return F.struct(
            F.concat(state["out"], F.when(kept, token).otherwise(F.coalesce(F.try_element_at(known, token), token))).alias("out"),
            F.when(token.isin(consonants), token.isin(WITHOUT_MEDIALS)).otherwise(state["bare"]).alias("bare"),
        )

    return F.aggregate(F.regexp_extract_all(F.coalesce(word, F.lit("")), F.lit(TOKEN), 0), first, step)["out"]


def romanise(word: Column) -> Column:
    """The romanised tokens joined; others are left out, and a word without any stays as it is."""
    known = lookup(CONSONANTS + VOWELS + TONES + MEDIALS + PAIRS, 2)
    out = F.array_join(F.transform(F.regexp_extract_all(word, F.lit(TOKEN), 0), lambda t: F.coalesce(F.try_element_at(known, t), F.lit(""))), "")
    return F.when(out == "", word).otherwise(out)
