"""Segmentation with a lexicon of either size, rows with any ids, and as a table function in SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.functions.runs import Entries
from lexicarta.functions.trie import Syllables, Trie, contained, pieces
from lexicarta.operators import lexicon
from lexicarta.operators.containment import holding

SYLLABLES = ["က", "ကါ", "ခ", "ဂိ", "ဃ"]
CONNECTORS = {"က": 1, "ခဂိ": 2}


def test_trie_finds_what_a_dictionary_has():
    rng = random.Random(2)
    for _ in range(60):
        known = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))})
        texts = [[rng.choice(SYLLABLES) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(0, 6))] + [None, []]
        s, trie = Syllables(pa.array(texts, pa.list_(pa.string()))), Trie(known, [f"m{k}" for k in known])
        found, at = s.matches(trie, 3), 0
        for t in texts:
            for i in range(len(t or [])):
                for k in range(1, 4):
                    run = "".join(t[i : i + k]) if i + k <= len(t) else None
                    entry = found[k - 1][at]
                    assert (trie.meanings[entry] == f"m{run}") if run in known else entry == -1
                at += 1


def test_texts_that_contain_entries():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab က") for _ in range(rng.randint(1, 4))) for _ in range(15)})
    texts = ["".join(rng.choice("ab က") for _ in range(rng.randrange(0, 20))) for _ in range(50)] + [None, ""]
    row, entry = contained(pa.array(texts), Trie(words, words))
    assert list(zip(row.tolist(), (words[e] for e in entry.tolist()))) == [(i, w) for i, t in enumerate(texts) for w in words if t and w in t]
    batch = pa.record_batch({"t": texts})
    assert [p.num_rows for p in pieces(batch, np.array([len(t or "") for t in texts]), 30)][0] < 10 and sum(p.num_rows for p in pieces(batch, np.ones(52), 7)) == 52


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    lists = [[rng.choice(SYLLABLES) for _ in range(rng.randrange(0, 30))] for _ in range(40)]
    rows = [*enumerate(lists), (None, lists[3]), (None, lists[4]), (7, lists[5]), (7, lists[7]), (50, None), (51, []), (None, None), (52, [None, "က", "", "ခ"])]
    return spark.createDataFrame(rows, "doc_id long, syllables array<string>")


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(6)
    known = {"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(25)}
    return spark.createDataFrame([(w, f"m{k}") for k, w in enumerate(sorted(known))] + [("က", "zz"), ("က", "yy"), (None, "x"), ("ခ", None), ("", "e")], "chunk string, meaning string")


@pytest.mark.parametrize("kind", ["greedy", "connected"])
def test_both_sizes_of_lexicon_and_any_ids(spark, texts, words, kind, monkeypatch):
    run = lambda: sorted(((r.doc_id, r.parts) for r in (lexicon.segment_greedy(texts, words, 4) if kind == "greedy" else lexicon.segment(texts, words, CONNECTORS, 4)).collect()), key=str)
    sent = run()
    both = lexicon.segmented
    monkeypatch.setattr(lexicon, "segmented", lambda *a: both(*a, most_sent=-1))
    joined = run()
    assert joined == sent and len(sent) == texts.count()
    nulls = [parts for i, parts in sent if i is None]
    assert len(nulls) == 3 and sum(any(p.meaning != "??" for p in parts) for parts in nulls) == 2
    assert [p.chunk for i, parts in sent if i == 52 for p in parts if p.reason == "stuck"] in ([], ["ခ"], ["က", "ခ"])


def test_a_table_function_gives_the_same_parts(spark, words):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice([*SYLLABLES, " ", "5", "x", "ိ"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(90, None), (91, ""), (None, "ကခ")]
    df = spark.createDataFrame(rows, "doc_id long, native string")
    lexicon.register_segment_text(spark, words, CONNECTORS, 4)
    df.createOrReplaceTempView("native_texts")
    got = spark.sql("SELECT d.doc_id, s.* FROM native_texts d, LATERAL segment_text(d.native) s").collect()
    parts = lexicon.segment(df.select("doc_id", text.split_syllables(F.col("native")).alias("syllables")), words, CONNECTORS, 4)
    want = parts.select("doc_id", F.posexplode("parts").alias("place", "p")).select("doc_id", "place", "p.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 300
    alone = spark.sql("SELECT chunk FROM segment_text('ကခ ဂိ') ORDER BY place").collect()
    assert "".join(r.chunk for r in alone) == "ကခဂိ"
    with pytest.raises(ValueError):
        lexicon.register_segment_text(spark, words, CONNECTORS, 4, most_sent=10)


def test_syllables_of_one_text(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ကခဂါိ ့a5၅\nး") for _ in range(30)),) for _ in range(200)]
    for r in spark.createDataFrame(rows, "t string").select("t", text.split_syllables(F.col("t")).alias("s")).collect():
        assert text.syllables_of(r.t) == r.s


def test_patterns_in_several_passes(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(40)] + [None]
    patterns = [(w, k) for k, w in enumerate(["a", "ab", "ab", "cab", "", None, "bbb", "ccc", "abcabc"])]
    df, p = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(patterns, "w string, k int")
    want = sorted((i, k) for i, t in enumerate(texts) for w, k in patterns if t and w and w in t)
    for most in (1 << 20, 300):
        assert sorted((r.i, r.k) for r in holding(df, "t", p, "w", most).collect()) == want
    assert holding(df, "t", p.limit(0), "w").count() == 0


def test_table_of_hashes_finds_what_a_trie_finds():
    rng = random.Random(12)
    for _ in range(60):
        known = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([0, 3, 40]))})
        s = Syllables(pa.array([[rng.choice(SYLLABLES) for _ in range(rng.randrange(0, 30))] for _ in range(5)] + [None], pa.list_(pa.string())))
        trie, table = Trie(known, known), Entries.of(known, known)
        for a, b in zip(s.matches(trie, 4), table.matches(s, 4), strict=True):
            assert [known[e] if e >= 0 else None for e in a.tolist()] == [table.meanings[e].as_py() if e >= 0 else None for e in b.tolist()]


def test_syllables_of_a_batch_of_texts():
    rng = random.Random(13)
    texts = ["".join(rng.choice("ကခဂါိ ့a5၅\nး😀ꩠ") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [None, "", "ါ", "က"]
    s = Syllables.of_texts(pa.array(texts, pa.string()))
    flat = s.chunks(np.arange(s.n), np.arange(s.n) + 1).to_pylist()
    assert [flat[a:z] for a, z in zip(s.rows[:-1].tolist(), s.rows[1:].tolist())] == [text.syllables_of(t or "") for t in texts]


def test_a_lexicon_whose_trie_took_more_than_was_sent(spark):
    """200,000 entries: 74 MB by 24 bytes a character, refused before; about 12 MB by hashes."""
    many = spark.range(200_000).select(F.translate(F.lpad(F.col("id").cast("string"), 13, "0"), "0123456789", "ကခဂဃငစဆညယရ").alias("chunk"), F.col("id").cast("string").alias("meaning"))
    lexicon.register_segment_text(spark, many, {}, 13, name="segment_many")
    got = spark.sql("SELECT meaning FROM segment_many('ကကကကကကကခဂဃငစဆ') ORDER BY place").collect()
    assert [r.meaning for r in got] == ["123456"]


def test_a_table_function_takes_texts_by_batches(spark, words):
    """Each text was a call of its own before."""
    lexicon.register_segment_text(spark, words, CONNECTORS, 4)
    df = spark.createDataFrame([(i, "ကခ ဂိ" * (i % 5)) for i in range(50)], "doc_id long, native string")
    rows = spark.sql("SELECT doc_id, s.* FROM {df} d, LATERAL segment_text(d.native) s", df=df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan
    assert {r.doc_id for r in rows.collect()} == {i for i in range(50) if i % 5}
    assert spark.sql("SELECT * FROM {df} d, LATERAL segment_text(d.native) s", df=df.limit(0)).count() == 0


@pytest.mark.parametrize("stride, rounds, surely", [(1, 256, False), (32, 1, False), (3, 2, True), (32, 256, True), (32, 256, False)])
def test_parts_of_reached_places_are_those_of_all(stride, rounds, surely, monkeypatch):
    rng = random.Random(21)
    known = sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = [[rng.choice(SYLLABLES) for _ in range(rng.choice([0, 1, 5, 40, 400]))] for _ in range(60)] + [["ခ"] * 300]
    s, table = Syllables(pa.array(texts, pa.list_(pa.string()))), Entries.of(known, known)
    say = lambda parts: [p.tolist() if isinstance(p, np.ndarray) else p.to_pylist() for p in parts]
    monkeypatch.setattr(lexicon, "STRIDE", 1)
    want = say(lexicon.connected_parts(s, table, CONNECTORS, 4, surely=True))
    seen, whole = [], lexicon.followed
    monkeypatch.setattr(lexicon, "followed", lambda rows, decide: whole(rows, lambda at: (seen.append(len(at)), decide(at))[1]))
    monkeypatch.setattr(lexicon, "STRIDE", stride)
    monkeypatch.setattr(lexicon, "ROUNDS", rounds)
    assert say(lexicon.connected_parts(s, table, CONNECTORS, 4, surely=surely)) == want
    assert sum(seen) <= s.n and (sum(seen) < s.n) == (stride == 32 and rounds == 256)


def test_second_hashes_decide_of_parts():
    """An entry that has the first hash of a run and another second one is none."""
    table = Entries.of(["ကခ", "ဂိ"], ["a", "b"])
    table.second[table.meanings.to_pylist().index("a")] ^= 1
    s = Syllables(pa.array([["က", "ခ", "ဂိ"]], pa.list_(pa.string())))
    starts, ends, entry, reasons = lexicon.connected_parts(s, table, {}, 4)
    assert ends.tolist() == [1, 2, 3] and reasons.to_pylist() == ["stuck", "stuck", "rest"] and entry.tolist()[:2] == [-1, -1]
