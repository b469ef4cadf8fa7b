"""The shapes that operators take, bound to the given tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.functions.numbers import rounded
from lexicarta.functions.runs import letter_runs
from lexicarta.functions.trie import pieces
from lexicarta.sources import files

#: Letters of the tables' texts and the native characters that stand for them in bindings.
LATIN = "abcdefghijklmnopqrstuvwxyz"
NATIVE = "ါကခဒံဂဃဟၢငစြမနူပဆျၒတုလွၓယး"
#: Bytes of texts whose words a task counts at once.
COUNTED_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where the table comes in fewer pieces than there are cores, as a file of one row group does."""
    d, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries: a document's first word is the key, its lines are the definitions."""
    d = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("pos"),
        F.substring_index(text, " ", 1).alias("karen"),
        F.split(text, "\n").alias("definitions"),
        (F.col("doc_id") % 600).cast("int").alias("page"),
        (F.col("doc_id") % 7 == 0).alias("flag"),
        F.col("source"),
        F.lit("headword").alias("entry_type"),
    )


ENTRIES = """entries AS (
  SELECT doc_id AS pos, split_part(coalesce(text, ''), ' ', 1) AS karen, string_split(coalesce(text, ''), chr(10)) AS definitions,
    CAST(doc_id % 600 AS INTEGER) AS page, doc_id % 7 = 0 AS flag, source, 'headword' AS entry_type FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, raw): the lines of each document."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))


LINES = """lines AS (
  SELECT doc_id AS file, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word): runs of a-z of each lower-cased text."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("pos", "word"))


def distinct_words(spark: SparkSession, sf_dir: str, sides: bool = False) -> DataFrame:
    """(doc_id, word) or, with sides, (doc_id, even, word): the different words of a document, or those at its even and at its odd places, once for a doc_id.

    They are made distinct in their row; only those of ids that repeat are shuffled for it.
    """
    d = documents(spark, sf_dir)
    repeated = files.written(table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated")

    def of(df: DataFrame) -> DataFrame:
        ws = df.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("ws"))
        if not sides:
            return ws.select("doc_id", F.explode(F.array_distinct("ws")).alias("word"))
        at = lambda k: F.array_distinct(F.filter("ws", lambda _, i: i % 2 == k)).alias("ws")
        side = F.explode(F.array(F.struct(F.lit(True).alias("even"), at(0)), F.struct(F.lit(False).alias("even"), at(1))))
        return ws.select("doc_id", side.alias("side")).select("doc_id", "side.even", F.explode("side.ws").alias("word"))

    if repeated.isEmpty():
        return of(d)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return of(d.join(repeated, same, "left_anti")).unionByName(of(d.join(repeated, same, "left_semi")).distinct())


WORDS = """words AS (
  SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents))"""


def native_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, word, native): each word with its letters as native characters."""
    return words(spark, sf_dir).withColumn("native", F.translate("word", LATIN, NATIVE))


NATIVE_WORDS = WORDS + f""", native_words AS (SELECT *, translate(word, '{LATIN}', '{NATIVE}') AS native FROM words)"""


def counted_words(batches):
    """(word, n) of batches of lower-cased texts: the different words of some texts, and how often they occur there."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for b in pieces(batch, pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), COUNTED_BYTES):
            counts = letter_runs(b.column(0).cast(pa.string())).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, native, n): distinct words and how often they occur. Tasks count the words of some texts at once, so few rows are left to add up."""
    counts = documents(spark, sf_dir).select(F.lower("text")).mapInArrow(counted_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.select("word", F.translate("word", LATIN, NATIVE).alias("native"), "n")


VOCABULARY = NATIVE_WORDS + """, vocabulary AS (SELECT word, native, count(*) AS n FROM native_words GROUP BY word, native)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in corner form: events as boxes on the page of their user."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    d = e.select(
        "event_id",
        F.col("user_id").alias("image"),
        (i % 2311).cast("int").alias("class_idx"),
        ((i * 7919) % 1000 / 1000.0).alias("conf"),
        ((i * 31) % 600).cast("int").alias("x1"),
        ((i * 17) % 440).cast("int").alias("y1"),
        "event_type",
        "ts",
        "value",
    )
    return d.withColumn("x2", F.col("x1") + 20 + (i % 13).cast("int")).withColumn("y2", F.col("y1") + 24 + (i % 7).cast("int"))


DETECTIONS = """detections AS (
  SELECT *, CAST(x1 + 20 + event_id % 13 AS INTEGER) AS x2, CAST(y1 + 24 + event_id % 7 AS INTEGER) AS y2 FROM (
    SELECT event_id, user_id AS image, CAST(event_id % 2311 AS INTEGER) AS class_idx, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS conf,
      CAST((event_id * 31) % 600 AS INTEGER) AS x1, CAST((event_id * 17) % 440 AS INTEGER) AS y1, event_type, ts, value FROM events))"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_idx, name): classes named after parts (base, optional medial, vowel or tone); detections have others too."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat_ws("_", F.element_at(F.split("p_name", " "), 1), F.when(k % 3 == 0, F.lit("medya")), F.when(k % 4 != 0, F.element_at(F.split("p_name", " "), 2)), F.concat(F.lit("t"), (k % 6).cast("string")))
    return p.select(k.cast("int").alias("class_idx"), name.alias("name"))


CLASSES = """classes AS (
  SELECT CAST(p_partkey AS INTEGER) AS class_idx, concat_ws('_', split_part(p_name, ' ', 1), CASE WHEN p_partkey % 3 = 0 THEN 'medya' END,
    CASE WHEN p_partkey % 4 <> 0 THEN split_part(p_name, ' ', 2) END, 't' || CAST(p_partkey % 6 AS VARCHAR)) AS name FROM part)"""


def labels_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of images: line items as boxes on their order's image, split by the order's key."""
    li = table(spark, sf_dir, "lineitem")
    o = F.col("l_orderkey")
    split = F.when(o % 20 < 14, "train").when(o % 20 < 17, "valid").otherwise("test")
    return li.select(split.alias("split"), o.alias("stem"), F.col("l_linenumber").cast("int").alias("line_no"), F.col("l_partkey").cast("int").alias("class_idx"))


LABELS_TXT = """labels_txt AS (
  SELECT CASE WHEN l_orderkey % 20 < 14 THEN 'train' WHEN l_orderkey % 20 < 17 THEN 'valid' ELSE 'test' END AS split, l_orderkey AS stem,
    CAST(l_linenumber AS INTEGER) AS line_no, CAST(l_partkey AS INTEGER) AS class_idx FROM lineitem)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, stem, file): an image for all orders but some, named after class and identifier."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    split = F.when(k % 20 < 14, "train").when(k % 20 < 17, "valid").otherwise("test")
    name = F.concat(F.lit("guh_a_t"), (k % 6).cast("string"), F.lit("_"), F.lpad(F.conv(k.cast("string"), 10, 16), 8, "0"), F.lit(".jpg"))
    return o.where(k % 11 != 5).select(split.alias("split"), k.alias("stem"), name.alias("file"))


IMAGES = """images AS (
  SELECT CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'valid' ELSE 'test' END AS split, o_orderkey AS stem,
    'guh_a_t' || CAST(o_orderkey % 6 AS VARCHAR) || '_' || printf('%08X', o_orderkey) || '.jpg' AS file FROM orders WHERE o_orderkey % 11 <> 5)"""


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_idx, n, map50): mean confidence of each class as its metric."""
    return detections(spark, sf_dir).groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("conf") * F.col("class_idx") % 1.0, 6).alias("map50"))


CLASS_METRICS = DETECTIONS + """, class_metrics AS (
  SELECT class_idx, count(*) AS n, round((avg(conf) * class_idx) % 1.0, 6) AS map50 FROM detections GROUP BY class_idx)"""
