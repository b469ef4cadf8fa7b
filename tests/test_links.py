from lexicarta.operators import entries
from lexicarta.plans import entry_queries


def test_terms_meet_headwords_where_they_are(spark):
    rows = [(k, f"k{k % 7}", "headword" if k % 2 else "compound") for k in range(30)] + [(99, None, "headword"), (98, "", "headword")]
    e = spark.createDataFrame(rows, "pos long, karen string, entry_type string")
    terms = spark.createDataFrame([(k % 5, f"k{k % 9}") for k in range(60)] + [(7, None), (8, "")], "pos long, term string")
    sent, joined = entries.link_headwords(e, terms), entries.link_headwords(e, terms, most_sent=0)
    best = {w: min((kind != "headword", pos) for pos, x, kind in rows if x == w)[1] for w in {x for _, x, _ in rows if x is not None}}
    want = sorted((r.pos, r.term, best[r.term]) for r in terms.collect() if r.term in best)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect())) == want
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    words = entry_queries.terms_of(spark.createDataFrame([(1, ["a b", "a"])], "pos long, definitions array<string>"))
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, words.collect())) == [(1, "a"), (1, "b")]


def test_links_of_positions_that_repeat_are_distinct(spark, tmp_path):
    rows = [(1, "ab ab cd", "s"), (1, "ab\nab cd", "s"), (2, "cd x", "s"), (None, "ab", "s"), (3, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in entry_queries.link_headwords(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and (1, "cd", 2) in got
    assert {(p, t) for p, t, _ in got} == {(1, "ab"), (1, "cd"), (2, "cd"), (None, "ab"), (3, "")}
