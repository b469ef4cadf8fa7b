"""Upper case as the SQL has it."""

import duckdb
from pyspark.sql import functions as F

from lexicarta.functions import text


def test_one_capital_for_a_letter(spark):
    words = ["geßzu", "ß", "ŉa", "xﬁy", "ᾳb", "ᾼ", "naïve", "", "plain", "ß\nß", "𐐨ß", None, "ıİ"]
    got = [r.u for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(text.simple_upper(F.col("w")).alias("u")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT upper(w) FROM (SELECT unnest(?) AS w, unnest(range(13)) AS i) ORDER BY i", [words]).fetchall()]
    assert got == want and got[0] == "GEẞZU"
