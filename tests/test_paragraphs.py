from pyspark.sql import functions as F

from lexicarta.operators import generate


def test_paragraphs_are_the_same_sent_or_joined_and_draws_are_not_shuffled(spark):
    words = spark.range(300).select(F.concat(F.lit("ကခ"), F.col("id").cast("string")).alias("native"))
    ids = spark.range(500)
    sent, joined = generate.sample_paragraphs(ids, words, 7), generate.sample_paragraphs(ids, words, 7, most_sent=0)
    assert sorted(sent.collect()) == sorted(joined.collect()) and sent.count() == 500
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    assert sent.schema == joined.schema
    assert [generate.sample_paragraphs(ids, words.limit(0), 7, most).count() for most in (0, 1 << 20)] == [0, 0]
