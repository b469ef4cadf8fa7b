"""Token counts: the exact histogram of encoded lengths, and what its sums answer for every context limit."""

import base64
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.llm.shared import map_rows, worker_object

#: White space from this length on is cut out before the tokenizer's splitter sees it, whose stack has a limit.
LONG = 10_000
RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")


def encoder(path: str):
    """The byte-level BPE in a file of base64 tokens and ranks; a worker process reads it once."""
    def read():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_object(("token counts", path), read)


def token_length(encoding, text: str | None) -> int:
    """Tokens of a whole text. The pattern never joins a blank to what stands before it, and takes all of a run of
    blanks but the last as one piece (all of it at the end of the text), so long runs are such pieces by themselves."""
    if not text:
        return 0
    if len(text) < LONG or not (runs := list(RUN.finditer(text))):
        return len(encoding.encode_ordinary(text))
    total = at = 0
    for run in runs:
        stop = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : stop]))
        at = stop
    return total + len(encoding.encode_ordinary(text[at:]))


def token_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, n_tokens) of each row: the whole text's tokens, a null or empty text having none; special strings are plain text.

    Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """

    def lengths(texts):
        encoding = encoder(path)
        return [[token_length(encoding, t) for t in texts]]

    return map_rows(docs, lengths, "n_tokens long", text)


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs) of each length that occurs; null lengths count as 0."""
    return lengths.groupBy(F.coalesce(column, F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def context_answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, what holds of all documents.

    n_tokens, docs: the histogram. docs_over, tokens_over: documents longer than the limit, and their tokens (the
    suffix sums). tokens_total: tokens of all documents. tokens_truncated: tokens left when each document is cut
    at the limit. quantile: the part of documents that the limit holds whole. Between two lengths the truncated
    total grows by docs_over a token, so the rows answer every limit (see truncated_at). The histogram has a row
    for each length alone, so its order is a small sort.
    """
    after = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return histogram.select(
        "n_tokens",
        "docs",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(after), F.lit(0)).alias("tokens_over"),
        F.sum(F.col("docs") * F.col("n_tokens")).over(whole).alias("tokens_total"),
        F.sum("docs").over(whole).alias("docs_total"),
    ).select(
        "n_tokens",
        "docs",
        "docs_over",
        "tokens_over",
        "tokens_total",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )


def truncated_at(answers: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, tokens_truncated) for any limits: from the longest length within each, else from none."""
    held = answers.join(limits.select("limit").distinct(), F.col("n_tokens") <= F.col("limit"))
    nearest = held.groupBy("limit").agg(F.max_by(F.struct("n_tokens", "docs_over", "tokens_truncated"), "n_tokens").alias("a"))
    all_docs = answers.agg(F.max(F.col("docs") + F.col("docs_over")).alias("all_docs"))
    out = limits.select("limit").distinct().join(nearest, "limit", "left").crossJoin(F.broadcast(all_docs))
    within = F.col("a.tokens_truncated") + (F.col("limit") - F.col("a.n_tokens")) * F.col("a.docs_over")
    return out.select("limit", F.coalesce(within, F.greatest("limit", F.lit(0)) * F.coalesce("all_docs", F.lit(0))).alias("tokens_truncated"))
