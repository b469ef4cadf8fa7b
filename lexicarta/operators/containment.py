"""Which patterns of a table texts contain: a trie of the shortest patterns, walked from every place of the texts; the others meet them in a join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexicarta.functions.runs import marks, marked, strings
from lexicarta.functions.trie import Trie, contained, pieces
from lexicarta.sources import files

#: Bytes of patterns (24 a character in their trie, and the rows) that are sent to the texts, and of the marks of the others.
MOST_SENT = 32 << 20
#: Bits of a row of marks, as Spark's bitmaps have them, and bits of marks for a pattern, as far as they go.
ROW_BITS, BITS_EACH = 15, 64


def holding(texts: DataFrame, column: str, patterns: DataFrame, pattern: str, most_sent: int = MOST_SENT) -> DataFrame:
    """(texts.*, patterns.*) for each text and each row of patterns whose pattern the text's column contains.

    The shortest patterns, those that stand in the most texts, are sent to the texts: all lengths that fit in most_sent bytes, as
    measured. Of longer ones only marks are sent, one bit by the hash of each; what is marked in a text meets the patterns in
    a join, which decides. So texts are read twice at most, however many patterns there are. Null and empty patterns and null texts
    pair with nothing; columns of both must differ in name.
    """
    import pyarrow.compute as pc

    spark, known = texts.sparkSession, files.written(patterns.where(F.col(pattern) != ""), "patterns")
    row_bytes = 24 * F.char_length(pattern) + F.octet_length(F.to_json(F.struct(*known.columns))) + 100
    sizes = known.groupBy(F.char_length(pattern).alias("length")).agg(F.sum(row_bytes).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    sent_to, held = 0, 0
    for r in sizes:
        held += r.bytes
        if held > most_sent:
            break
        sent_to = r.length
    longer = [r for r in sizes if r.length > sent_to]
    packed = texts.select(F.struct("*").alias("row"))
    schema = StructType([*packed.schema.fields, StructField("found", ArrayType(StringType()))])

    def hits(search):
        """(texts.*, pattern) of what search(texts) finds, as rows by row and strings."""
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for batch in batches:
                lengths = pc.fill_null(pc.utf8_length(pc.struct_field(batch.column(0), column)), 0).to_numpy()
                for piece in pieces(batch, lengths):
                    row, found = search(pc.struct_field(piece.column(0), column))
                    ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["row", "found"])

        return packed.mapInArrow(run, schema).select("row.*", F.explode("found").alias(pattern))

    part = known.where(F.char_length(pattern) <= sent_to)
    names = [r[0] for r in part.select(pattern).distinct().toLocalIterator()]
    trie = spark.sparkContext.broadcast(Trie(names, names))

    def by_trie(column):
        import pyarrow as pa

        row, entry = contained(column, trie.value)
        return row, pa.array(trie.value.meanings, pa.string()).take(pa.array(entry))

    out = hits(by_trie).join(F.broadcast(part), pattern)
    if not longer:
        return out
    rest, by_length = known.where(F.char_length(pattern) > sent_to), [r.length for r in longer]
    bits = max(ROW_BITS, min(BITS_EACH * sum(r.n for r in longer), 8 * most_sent).bit_length() - 1)
    table = spark.sparkContext.broadcast(marks_of(rest.select(pattern), bits))

    def by_marks(column):
        return strings(column, *marked(column, table.value, by_length))

    return out.unionByName(hits(by_marks).join(rest, pattern))


def marks_of(patterns: DataFrame, bits: int):
    """The marks of patterns (pattern), none null: of 2^bits bits, those at the upper bits of their hashes, put together by rows of bits."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(marks(batch.column(0), bits))], ["mark"])

    row, place = F.shiftright("mark", ROW_BITS).alias("row"), F.col("mark").bitwiseAND((1 << ROW_BITS) - 1).alias("place")
    # dealt by rows first, so that no task makes bitmaps of rows that others make too
    rows = patterns.mapInArrow(run, "mark long").select(row, place).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    out, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (ROW_BITS - 3)
    for r in rows.toLocalIterator():
        out[r.row * width : (r.row + 1) * width] = np.frombuffer(r.bitmap, np.uint8)
    return out
