"""Collation keys of native syllables: consonant, tone, vowel, medial."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of each level in dictionary order (fixed values).
CONSONANT = "ကခဂဃငစဆၡညတထဒနပဖဘမယရလဝသဟအဧ"
TONE = "ါၒၓးၔၕ"
VOWEL = "ံၢုူ့ဲိီ"
MEDIAL = "ှၠျြွ"
CONTRACTIONS = ("မ်", "ဒ်")
UNKNOWN = 99


def last_of(text: Column, chars: str) -> Column:
    """The last of these characters, or nothing."""
    return F.regexp_extract(text, f"(?s).*([{chars}])", 1)


def decompose(text: Column) -> Column:
    """(consonant, medials, vowel, tone) of a syllable: of each kind the last counts, but all medials; a contraction is a tone."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(t, "|".join(CONTRACTIONS), "")
    return F.struct(
        last_of(bare, CONSONANT).alias("consonant"),
        F.regexp_extract_all(bare, F.lit(f"[{MEDIAL}]"), 0).alias("medials"),
        last_of(bare, VOWEL).alias("vowel"),
        F.regexp_extract(t, f"(?s).*({'|'.join(CONTRACTIONS)}|[{TONE}])", 1).alias("tone"),
    )


def rank(char: Column, chars: str, first: int = 0) -> Column:
    """The place of a character in an order, UNKNOWN outside it."""
    at = F.instr(F.lit(chars), char)
    return F.when((F.length(char) == 1) & (at > 0), at - 1 + first).otherwise(UNKNOWN)


def collation_key(text: Column, absent_first: bool = False) -> Column:
    """(consonant, tone, vowel, medial) ranks; what is absent comes last, but an absent tone first.

    With absent_first a syllable without vowel or medial comes before those with one, and a contraction after its consonant.
    """
    d = decompose(text)
    tone = F.when(d["tone"] == "", 0).otherwise(rank(d["tone"], TONE, 1))
    medial = F.coalesce(F.array_min(F.transform(d["medials"], lambda m: rank(m, MEDIAL))), F.lit(UNKNOWN))
    vowel, consonant = rank(d["vowel"], VOWEL), rank(d["consonant"], CONSONANT)
    if absent_first:
        vowel, medial = F.when(d["vowel"] == "", -1).otherwise(vowel), F.when(F.size(d["medials"]) == 0, -1).otherwise(medial)
        consonant = F.when((d["consonant"] == "") & d["tone"].isin(*CONTRACTIONS), rank(F.substring(d["tone"], 1, 1), CONSONANT)).otherwise(consonant)
    return F.struct(consonant.alias("consonant"), tone.alias("tone"), vowel.alias("vowel"), medial.alias("medial"))
