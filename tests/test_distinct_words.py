import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexicarta.functions.runs import letter_runs
from lexicarta.plans import bindings


def test_words_of_ids_that_repeat_are_distinct_and_others_are_not_shuffled(spark, tmp_path):
    rows = [(1, "the cat The dog"), (1, "cat the cat"), (None, "one two"), (None, "two one one"), (2, "a b a b a"), (3, None), (4, "1 2")]
    for name, some in (("all", rows), ("single", rows[1:3] + rows[4:])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string").repartition(8).write.parquet(f"{d}/documents.parquet")
        sides = {(i, k % 2 == 0, w) for i, t in some for k, w in enumerate(re.findall("[a-z]+", (t or "").lower()))}
        got = bindings.distinct_words(spark, d, sides=True)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(sides, key=key)
        plain = bindings.distinct_words(spark, d)
        assert sorted(map(tuple, plain.collect()), key=key) == sorted({(i, w) for i, _, w in sides}, key=key)
        if name == "single":
            assert "Aggregate" not in plain._jdf.queryExecution().executedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_batches(spark, tmp_path):
    """As many rows as the texts have words were exploded and added up before."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBcÉİ K1\n-") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "", "zz", "zz", "1"]
    column = pa.array([t and t.lower() for t in texts], pa.string())
    for some in (column, column.slice(3, 50), column.slice(7), column.slice(0, 0), column.slice(200, 1)):
        assert letter_runs(some).to_pylist() == [w for t in some.to_pylist() for w in re.findall("[a-z]+", t or "")]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = bindings.vocabulary(spark, str(tmp_path))
    want = bindings.words(spark, str(tmp_path)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", F.translate("word", bindings.LATIN, bindings.NATIVE), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["n"].dataType.typeName() == "long"
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
