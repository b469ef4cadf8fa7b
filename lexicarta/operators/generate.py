"""Grids of labels and sampling plans."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexicarta.sources import files


def grid_label(class_id: Column, levels: list[tuple[str, int]]) -> Column:
    """The label of a number in a grid of levels (name, size), the last level running fastest."""
    parts, below = [], 1
    for name, size in reversed(levels):
        at = F.floor(class_id / below).cast("long")
        parts.append(F.concat(F.lit(name), (at if (name, size) == levels[0] else at % size).cast("string")))
        below *= size
    return F.concat_ws("_", *reversed(parts))


def syllable_grid(
    spark: SparkSession, bases: list[str], medials: list[str], vowels: list[str], tones: list[str], plain: list[str] = (), contractions: list[str] = (), medial_vowels: int | None = None, medial_tones: int | None = None
) -> DataFrame:
    """(class_id, label): bases with vowels and tones, then those that take medials (all but the plain ones) with each of them, then contractions.

    With medials only the first medial_vowels and medial_tones come, all without. Numbers come from the ordinals by
    arithmetic, so they are the same in every run: 25 bases (two plain), 5 medials, 10 vowels and 6 tones give 1,500 and,
    with 5 vowels and 3 tones, 1,725; without plain ones and all vowels and tones, 7,500.
    """
    takes, some_v, some_t = [x for x in bases if x not in plain], list(vowels[:medial_vowels]), list(tones[:medial_tones])

    def product(start: int, *levels: list[str]) -> DataFrame:
        size, below, parts = 1, 1, []
        for level in levels:
            size *= len(level)
        for level in reversed(levels):
            parts.insert(0, F.element_at(F.array(*map(F.lit, level)), (F.floor(F.col("id") / below) % len(level) + 1).cast("int")) if level else F.lit(""))
            below *= max(1, len(level))
        return spark.range(size).select((F.col("id") + start).alias("class_id"), F.concat_ws("_", *parts).alias("label"))

    n_base = len(bases) * len(vowels) * len(tones)
    return union_syllables(product(0, bases, vowels, tones), product(n_base, takes, medials, some_v, some_t), product(n_base + len(takes) * len(medials) * len(some_v) * len(some_t), list(contractions)))


def union_syllables(base: DataFrame, medial: DataFrame, contraction: DataFrame) -> DataFrame:
    """The three kinds of syllables, numbers running on; columns that one kind lacks are null there."""
    return base.unionByName(medial, allowMissingColumns=True).unionByName(contraction, allowMissingColumns=True)


#: Bytes of words that are sent to the tasks, as measured.
MOST_SENT = 512 << 20


def sample_paragraphs(ids: DataFrame, words: DataFrame, seed: int, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, text) of each row of ids: 2 to 4 lines of 4 to 9 words drawn with replacement.

    All distinct words are numbered in a fixed order, by a hash's bucket and the word; each drawn number is a hash of
    the seed, the id, the line and the place, modulo their count. Words of up to most_sent bytes are sent to the ids, and
    nothing is shuffled for a draw; more of them meet the draws of ids, which then must differ, in a join.
    """
    buckets = 4096
    full = lambda *xs: F.xxhash64(F.lit(seed), *xs)
    h = lambda *xs: F.pmod(full(*xs), F.lit(2**31))
    pool = files.written(words.where(F.col("native").isNotNull()).select(F.col("native").alias("word")).distinct().withColumn("bucket", (h("word") % buckets).cast("int")), "words")
    sizes = pool.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # at most a row for each bucket
    below = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("below"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word"))
    numbered = pool.withColumn("at", place).join(F.broadcast(below), "bucket").select((F.col("below") + F.col("at") - 1).alias("number"), "word")
    total, held = pool.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 4), F.lit(0))).first()
    number = lambda line, at: F.pmod(full("id", line, at), F.lit(total))
    if not 0 < total or held > most_sent:
        lines = ids.select("id", F.explode(F.sequence(F.lit(1), (2 + h("id") % 3).cast("int"))).alias("line"))
        places = lines.select("id", "line", F.explode(F.sequence(F.lit(1), (4 + h("id", "line") % 6).cast("int"))).alias("place"))
        rows = places.where(F.lit(total > 0)).withColumn("number", number("line", "place") if total else F.lit(0)).join(numbered, "number")
        drawn = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "place", "word"))).alias("drawn"))
        line = lambda k: F.array_join(F.transform(F.filter("drawn", lambda x: x["line"] == k), lambda x: x["word"]), " ")
        return drawn.select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.array_max("drawn.line")), line), "\n").alias("text"))
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = numbered.toArrow().sort_by("number").column("word").combine_chunks()
    sent = ids.sparkSession.sparkContext.broadcast(table)

    def joined(lists, texts, by):
        """The texts of each list, joined."""
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), by)

    def run(batches):
        for b in batches:
            lines = b.column("drawn").flatten()
            said = joined(lines, sent.value.take(lines.flatten()), " ")
            yield pa.RecordBatch.from_arrays([b.column("id"), joined(b.column("drawn"), said, "\n")], ["id", "text"])

    draws = lambda line: F.transform(F.sequence(F.lit(1), (4 + h("id", line) % 6).cast("int")), lambda at: number(line, at))
    drawn = ids.select("id", F.transform(F.sequence(F.lit(1), (2 + h("id") % 3).cast("int")), draws).alias("drawn"))
    return drawn.mapInArrow(run, StructType([drawn.schema["id"], StructField("text", StringType())]))
