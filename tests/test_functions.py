"""Golden cases of text functions and collation, worked out by hand or against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexicarta.functions import collation, legacy, text


def one(spark, f, *values):
    """f over a column of values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def test_collation_golden_order(spark):
    words = ["ကံ", "ကါ", "ကူၒ", "ကၒ"]
    assert [tuple(k) for k in one(spark, collation.collation_key, *words)] == [(0, 0, 0, 99), (0, 1, 99, 99), (0, 2, 3, 99), (0, 2, 99, 99)]


def test_collation_of_contractions_and_unknowns(spark):
    assert [tuple(k) for k in one(spark, collation.collation_key, "မ်", "abc", None)] == [(99, 99, 99, 99), (99, 0, 99, 99), (99, 0, 99, 99)]
    first = [tuple(k) for k in one(spark, lambda c: collation.collation_key(c, absent_first=True), "မ်", "က")]
    assert first[0][0] == collation.CONSONANT.index("မ") and first[1][2:] == (-1, -1)


def decompose_by_hand(word):
    out, i = {"consonant": "", "medials": [], "vowel": "", "tone": ""}, 0
    while i < len(word):
        if word[i : i + 2] in collation.CONTRACTIONS:
            out["tone"], i = word[i : i + 2], i + 2
            continue
        c = word[i]
        for level, chars in (("consonant", collation.CONSONANT), ("vowel", collation.VOWEL), ("tone", collation.TONE)):
            if c in chars:
                out[level] = c
        if c in collation.MEDIAL:
            out["medials"].append(c)
        i += 1
    return out


def test_decompose_random(spark):
    rng = random.Random(1)
    chars = collation.CONSONANT[:4] + "မဒ်" + collation.VOWEL[:2] + collation.TONE[:2] + collation.MEDIAL[:2]
    words = ["".join(rng.choice(chars) for _ in range(rng.randrange(7))) for _ in range(300)]
    assert [r.asDict() for r in one(spark, collation.decompose, *words)] == [decompose_by_hand(w) for w in words]


def test_repeats(spark):
    a, p, v = "က", "ပါ", "း"
    assert one(spark, text.dedupe_block, a * 4, p * 4 + v * 4, "", "x") == [a, p * 4 + v * 4, "", "x"]
    assert one(spark, text.dedupe_walk, a * 4, p * 4 + v * 4, "", None, " ab ") == [a, p * 2 + v * 2, "", None, "ab"]


def test_legacy_encodings(spark):
    assert one(spark, text.convert_legacy, "ugug", "u -c", "u?") == ["ကဂ", "ကခ", "က?"]
    assert one(spark, legacy.decode_legacy2, "uFg", "tF", "r~%SF", "u?", None) == ["ကျါ", "အF", "မ်ၡျ", "က?", ""]
    assert one(spark, legacy.romanise, "uFg", "r~", "??") == ["guhmed_yaah", "maw", "??"]


def test_syllables_random(spark):
    rng = random.Random(2)
    chars = text.CONSONANTS[:3] + "ါး့" + "0၁ ax"

    def by_hand(t):
        out, now = [], ""
        for c in t:
            if not "က" <= c <= "႟" or c in "၀၁၂၃၄၅၆၇၈၉":
                out, now = out + [now] * bool(now), ""
            elif c in text.CONSONANTS:
                out, now = out + [now] * bool(now), c
            else:
                now += c
        return out + [now] * bool(now)

    words = ["".join(rng.choice(chars) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert one(spark, text.split_syllables, *words) == [by_hand(w) for w in words]


def test_routing_and_cleaning(spark):
    assert one(spark, text.normalise_english, "Add_new-song & Play!", None, "It's  OK") == ["add new song and play", "", "it's ok"]
    assert one(spark, text.detect_direction, "က", "abc", "12", None) == ["ksw-to-en", "en-to-ksw", "en-to-ksw", "en-to-ksw"]
    assert one(spark, lambda c: text.is_useful_result(c, F.lit("ksw-to-en")), "a word", "Not found here", "Home", "x" * 181, "က", "") == [True, False, False, False, False, False]
    assert one(spark, text.is_clean, "က း .,;:'-", "ကA", "က=") == [True, False, False]
    assert [tuple(r) for r in one(spark, text.script_flags, "a\n  က b", "x က", None)] == [(True, True, True), (True, True, False), (False, False, False)]


def test_grammar_and_markers(spark):
    assert one(spark, text.part_of_speech, "n. house", "n.house", "v.t. to", "v.t.to", "none") == [None, "n.", "v.", "v.t.", None]
    assert one(spark, lambda c: text.extract_after(c, "see "), "See ကခ also", "see also this-one; more", "see 12", "nothing") == ["ကခ", "also this-one", None, None]
    assert [tuple(x) if x else None for x in one(spark, text.split_columns, "ab  cd  e", "a b", "  x", "a  ")] == [("ab", "cd  e"), None, None, None]


@pytest.mark.parametrize("seed", range(3))
def test_collapse_repeats_keeps_plain_text(seed):
    rng = random.Random(seed)
    t = "".join(rng.sample("abcdefghijklmnop", 10))
    assert text.collapse_repeats(t) == t and not re.search(r"(..+)\1", text.collapse_repeats(t * 4))
