import random

from lexicarta.operators.containment import holding


def test_texts_are_read_twice_however_many_patterns_there_are(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("aé𝒳က") for _ in range(n))
    texts = [word(rng.randrange(0, 14)) for _ in range(80)] + [None, "", "a" * 500, "aé" * 300]
    known = [word(rng.randrange(1, 6)) for _ in range(200)] + ["a" * 40, "éa" * 20, "", None]
    df, p = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(w, k) for k, w in enumerate(known)], "w string, k int")
    want = sorted((i, k, w) for i, t in enumerate(texts) for k, w in enumerate(known) if t and w and w in t)
    for most in (4000, 300, 0):
        met = holding(df, "t", p, "w", most)
        assert met._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2
        assert sorted((r.i, r.k, r.w) for r in met.collect()) == want
