"""Line dedup: repeated lines go from all documents but one, as keep bitmaps.

1. Lines become 128-bit hashes with their document and position, range-partitioned
   by (hash, document) and sorted by position inside: a line that a third of all
   documents hold spreads over as many partitions as it needs.
2. A stream over the sorted rows marks the first occurrence in each document. The
   first occurrences are counted, with the largest document, for each hash and
   partition, and those few rows for each hash.
3. Repeated hashes meet the sorted lines again; the positions that go come
   together as one compressed bitmap a document.

Only built-in functions run, and texts are split once. Bitmaps are sent to the
texts while they are small; beyond that bound both meet in a sorted join.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.llm.shared import SPACES, ascii_lower, forget, sent, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of bitmaps that are broadcast at most, and of repeated hashes.
MOST_SENT = 32 << 20


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of each line whose key has min_chars code points."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line")
    )
    keys = rows.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(977), "key").alias("h2"), "doc_id", "text_hash", "pos")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The lines, range-partitioned and sorted, each with whether it is the first of its hash in its document."""
    dealt = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    return dealt.withColumn("first", F.lag("pos").over(stream).isNull())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For documents that lose lines: (doc_id, text_hash, dropped), the sorted positions of those lines, as a written table.

    A key of at least min_chars code points that at least min_docs documents hold stays in the largest doc_id
    alone (there on all its lines). Rows with a null doc_id lose nothing and count nowhere; rows that repeat a
    doc_id count as one document and each lose what is theirs; a null text is one empty line.
    """
    hashed = written(hashed_lines(docs, min_chars), "lines")
    lines = written(first_occurrences(hashed), "sorted-lines")
    repeated = (
        lines.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("first_doc"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "first_doc")
    )
    repeated = written(repeated, "repeated")
    gone = lines.join(sent(repeated, F.lit(64), MOST_SENT), ["h1", "h2"]).where(F.col("doc_id") != F.col("first_doc"))
    bitmaps = written(gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "bitmaps")
    forget(hashed, lines, repeated)
    return bitmaps


def keep_runs(n_lines, dropped):
    """The keep bitmap, run-length compressed: (start, length) of each run of kept lines."""
    edges = F.zip_with(
        F.concat(F.array(F.lit(-1)), dropped),
        F.concat(dropped, F.array(n_lines)),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return F.filter(edges, lambda r: r["length"] > 0)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each row of docs: (row, n_lines, n_dropped, keep_runs, kept).

    row is the input row as a struct, so its columns clash with nothing; keep_runs is the compressed bitmap and
    kept the text of the lines that stay (empty if none does). An empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bitmaps = keep_bitmaps(rows.select("doc_id", "text"), min_chars, min_docs)
    joined = rows.withColumn("text_hash", F.xxhash64("text")).join(sent(bitmaps, 64 + 4 * F.size("dropped"), MOST_SENT), ["doc_id", "text_hash"], "left")
    lines = joined.select("row", "text", "dropped", F.split("text", "\n").alias("lines"))
    runs = lines.withColumn("runs", keep_runs(F.size("lines"), F.coalesce("dropped", F.array().cast("array<int>"))))
    kept = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    return runs.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("runs").alias("keep_runs"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
