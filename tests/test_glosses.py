"""Glosses of documents: words stay in their row, rows that share an id come together."""

from lexicarta.plans.text_queries import QUERIES


def test_glosses_without_a_shuffle_of_words(spark, tmp_path):
    rows = [(1, "one two three four five"), (2, "a"), (3, None), (4, ""), (5, "x y"), (5, "p q"), (None, "n m"), (None, "k l")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/all/documents.parquet")
    got = {r.doc_id: r.gloss for r in QUERIES["short_gloss"](spark, f"{tmp_path}/all").collect()}
    assert got.pop(5) == "q y" and got.pop(None) == "l m" and got == {1: "two three four", 2: "unresolved"}
    spark.createDataFrame(rows[:4], "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/some/documents.parquet")
    plan = QUERIES["short_gloss"](spark, f"{tmp_path}/some")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_candidates_of_pages_are_found_a_few_pages_at_a_time(spark):
    from lexicarta.operators import lexicon

    pages = spark.range(300).selectExpr("id AS page_id", "concat('<p>text ', id, '</p><h2>head</h2><li>item</li>') AS html").coalesce(1)
    out = lexicon.html_candidates(pages)
    assert "MapInArrow" in out._jdf.queryExecution().toString() and "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert {r.page_id: r.candidates for r in out.collect()} == {i: ["item", f"text {i}", "head"] for i in range(300)}
