"""Cleaning of a training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. SQL can't express them together: tests hold the run against plain Python.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.llm import toxicity
from lexicarta.llm.bpe import bpe_encode_decode
from lexicarta.llm.decontaminate import decontaminate
from lexicarta.llm.jaccard_join import jaccard_components
from lexicarta.llm.line_dedup import line_dedup
from lexicarta.llm.shared import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, doesn't reject."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).where("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines that stay; n_chars follows the text, and a text that loses nothing stays as it is."""
    out = line_dedup(docs).select("row", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text").cast("long"), F.col("row.n_chars"))}
    return out.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of the smallest id; rows without an id stay.

    Rows that repeat an id are one document: all of them stay or go.
    """
    gone = jaccard_components(docs, size=5, percent=80).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is nearly a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian unsigned 32-bit integers), their number, and the decoded text."""
    import public_tokenizers

    out = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("row.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, last = written(stage(spark, docs, sf_dir), name.replace(" ", "-")), before
        if last is not None:
            forget(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
