"""Runs of syllables, counted and found, of texts that share ids or have none."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.operators import lexicon


def native_rows(spark):
    rng = random.Random(21)
    rows = [(i, "".join(rng.choice("ကခဂါိ 5x") for _ in range(rng.randrange(0, 40)))) for i in range(30)]
    return spark.createDataFrame(rows + [(3, rows[3][1]), (3, "ကခ"), (None, "ကခကခ"), (None, rows[5][1]), (40, None), (41, "")], "doc_id long, native string")


def test_counts_of_runs(spark):
    df = native_rows(spark)
    n, docs = Counter(), {}
    for r in df.collect():
        s = text.syllables_of(r.native or "")
        for i in range(len(s)):
            for z in range(i + 1, min(i + 3, len(s)) + 1):
                n["".join(s[i:z])] += 1
                docs.setdefault("".join(s[i:z]), set()).update(set() if r.doc_id is None else {r.doc_id})
    got = lexicon.chunk_counts(df, 3)
    assert "ArrayJoin" not in lexicon.chunk_counts(df.where("doc_id <> 3"), 3)._jdf.queryExecution().toString()
    assert {r.chunk: (r.n, r.docs) for r in got.collect()} == {c: (k, len(docs[c])) for c, k in n.items()}
    listed = df.select("doc_id", text.split_syllables(F.col("native")).alias("syllables"))
    assert sorted(map(tuple, lexicon.chunk_counts(listed, 3).collect())) == sorted(map(tuple, got.collect()))


def test_spans_of_connectors_are_found_in_tasks(spark):
    df = native_rows(spark)
    known = spark.createDataFrame([("က", 1), ("ကခ", 2), ("ကခ", 2), ("ခါ", 1), ("ခါ", 2), (None, 1), ("", 1)], "connector string, size int")
    want = Counter()
    for r in df.collect():
        s = text.syllables_of(r.native or "")
        for c, k in [("က", 1), ("ကခ", 2), ("ကခ", 2), ("ခါ", 1), ("ခါ", 2)]:
            want.update((r.doc_id, i, i + k, c) for i in range(len(s) - k + 1) if "".join(s[i : i + k]) == c)
    sent, joined = lexicon.connector_spans(df, known), lexicon.connector_spans(df, known, most_sent=-1)
    assert Counter(map(tuple, sent.collect())) == want == Counter(map(tuple, joined.collect())) and len(want) > 30
    assert "MapInArrow" in sent._jdf.queryExecution().toString()
