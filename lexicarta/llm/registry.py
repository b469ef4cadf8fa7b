"""The registered queries of the training-data operators and their DuckDB SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.llm import language_id, toxicity
from lexicarta.llm.bpe import bpe_encode_decode
from lexicarta.llm.decontaminate import decontaminate
from lexicarta.llm.jaccard_join import jaccard_components
from lexicarta.llm.knn_join import top_k
from lexicarta.llm.line_dedup import line_dedup
from lexicarta.llm.merkle import leaf_of, manifest
from lexicarta.llm.near_vectors import near_vectors
from lexicarta.llm.oracles import ORACLES as ORACLES
from lexicarta.llm.periodic_runs import looped, periodic_runs
from lexicarta.llm.secrets import joined_spans, scan_secrets
from lexicarta.llm.shared import ascii_lower, table
from lexicarta.llm.token_counts import context_answers, length_histogram, token_lengths
from lexicarta.llm.warc import derivatives, page_responses


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derivatives(page_responses(table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", "block", "record")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("text")
    return context_answers(length_histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), lambda i: ~toxicity.held_out(i, 5, 0))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i, 4, 2))
    out = toxicity.toxicity(docs, model)
    return out.select("row.doc_id", toxicity.held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return out.select(
        "row.doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined_spans(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "row.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), least=0.93)
    return out.select("row.vec_id", "n_links", "component_id", "kept")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=looped)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    return out.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    shown = F.when(tampered, leaf_of(*fields, ascii_lower(F.col("text"))))
    leaves = docs.select("doc_id", "lang", leaf_of(*fields, "text").alias("leaf"), shown.alias("shown"))
    out = manifest(leaves.withColumn("shown", F.coalesce("shown", "leaf")), group="lang", key="doc_id", leaf="leaf", shown="shown")
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_top_k": op6_top_k,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
    "op11_near_vectors": op11_near_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
