"""Very long texts, empty tables, repeated rows, nulls and clashing columns in the operators of texts, and what their limits were."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import language_id, toxicity
from lexicarta.llm.bpe import bpe_encode_decode, loaded
from lexicarta.llm.decontaminate import decontaminate
from lexicarta.llm.secrets import joined_spans, scan_secrets
from lexicarta.llm.token_counts import encoder, token_length, token_lengths
from lexicarta.llm.warc import derivatives, page_responses

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def docs_of(spark, rows):
    """Rows with columns that clash with the operators' own names; ids may be null and repeat."""
    return spark.createDataFrame([(i, t, "r", "s", 2, 0.5) for i, t in rows], "doc_id long, text string, row string, spans string, n_tokens int, score double")


def test_warc_keeps_every_header(spark):
    headers = "HTTP/1.1 200 OK\r\n" + "".join(f"X-{k}: {k}\r\n" for k in range(1500))
    row = [(1, "<urn:x>", "http://a/", "2024-01-01T00:00:00Z", headers, "<p>x</p>")]
    out = derivatives(spark.createDataFrame(row, "page_id long, record_id string, target_uri string, date string, http_headers string, body string"))
    meta = out.where("record_type = 'metadata'").first()
    assert meta.block.count("sourceHeader: ") == 1500 and "sourceHeader: X-1499: 1499\r\n" in meta.block


def test_warc_of_nothing_and_of_long_pages(spark):
    schema = "page_id long, url string, html string"
    assert derivatives(page_responses(spark.createDataFrame([], schema))).count() == 0
    long = "<p>" + "word " * 200_000 + "</p>"
    out = derivatives(page_responses(spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, None)], schema))).collect()
    texts = [r.block for r in out if r.record_type == "conversion"]
    assert len(out) == 6 and sorted(map(len, texts)) == [0, 999_999, 999_999]
    assert all(r.block_digest == "sha1:" + hashlib.sha1(r.block.encode()).hexdigest() for r in out)


def test_token_counts_of_long_runs(spark):
    encoding = encoder(BYTES)
    once = lambda t: len(encoding.encode_ordinary(t))
    run = lambda t: len(encoding._encode_single_piece(t))
    n = 1_000_000
    assert token_length(encoding, " " * n) == run(" " * n) == n
    assert token_length(encoding, "a b" + " " * n + "c") == once("a b") + run(" " * (n - 1)) + once(" c")
    assert token_length(encoding, "x\n" + "\t" * n + "\n" + "c") == once("x") + run("\n" + "\t" * n) + once("\nc")
    assert token_length(encoding, "a" * n) == once("a" * n) and token_length(encoding, "^" * n) == once("^" * n)
    rows = [(1, " " * n), (1, " " * n), (None, None), (2, "")]
    got = sorted(r.n_tokens for r in token_lengths(docs_of(spark, rows), BYTES).select(F.col("row.doc_id"), "n_tokens").collect())
    assert got == [0, 0, n, n]


def test_token_counts_cut_runs_as_the_encoder_does(monkeypatch):
    import re

    from lexicarta.llm import token_counts

    encoding, rng = encoder(BYTES), random.Random(1)
    monkeypatch.setattr(token_counts, "RUN", re.compile(token_counts.RUN.pattern.replace(str(token_counts.LONG), "2")))
    monkeypatch.setattr(token_counts, "LONG", 2)
    for _ in range(1500):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "bc", "^^", "1", "'s"]) for _ in range(rng.randint(1, 30)))
        assert token_length(encoding, text) == len(encoding.encode_ordinary(text)), repr(text)


def test_bpe_of_long_pieces(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(WORDS), random.Random(3)
    texts = ["".join(rng.choice(s) for _ in range(n)) for s in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "é", "^~") for n in (511, 512, 513, 20_000)] + ["ab" * 900 + " cd " + "the" * 700]
    bpe = loaded(WORDS)
    bpe.encode(["warm"])
    began = time.time()
    bpe.encode(["".join(rng.choice("abcdefghij") for _ in range(20_000))])
    assert time.time() - began < 2
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "x"), (None, None)]
    for r in bpe_encode_decode(docs_of(spark, rows), WORDS).collect():
        ids = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(k, f"{w} " * 30, g) for k, (w, g) in enumerate([("the thing which", "xx"), ("ein schule und", "yy")] * 20)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, PIECES)
    odd = [(1, "² ½ Ⅷ ③ 12 _ -"), (2, "क़ि"), (3, "the thing which" * 30), (None, "schule"), (3, "the thing which" * 30), (4, "the " * 5 + "x" * 30_000)]
    out = language_id.identify(docs_of(spark, odd), model).select("row.doc_id", "lang_pred", F.col("score").alias("p")).collect()
    got = {r.doc_id: r.lang_pred for r in out}
    assert got[1] == "und" and got[2] in ("xx", "yy") and got[3] == "xx" and got[None] == "yy" and len(out) == len(odd)
    assert language_id.words_of("က္ခာ a²b") == ["က္ခာ", "a", "b"]
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_of_more_than_200(spark):
    rows = [(2 * k + j, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 5, f"l{k:03d}") for k in range(205) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, PIECES)
    assert len(model.languages) == 205


def test_maximal_segments_are_linear():
    n = 100_000
    began = time.time()
    assert len(toxicity.maximal_segments([1.0] * n, [2.0] * n)) == n
    assert len(toxicity.maximal_segments([1.0] * n, [0.5] * n)) == 1
    assert time.time() - began < 2


def test_toxicity_of_odd_rows(spark):
    model = toxicity.Model({"vile": 3.0}, 0.1, 1.0, 0.001, -4.0, 3.0, "k")
    rows = [(1, "vile " * 50_000 + "good " * 100_000), (1, "vile " * 50_000 + "good " * 100_000), (None, "vile vile vile"), (2, None), (3, "x" * 500_000)]
    got = [(r.doc_id, r.predicted) for r in toxicity.toxicity(docs_of(spark, rows), model).select("row.doc_id", "predicted").collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (None, 1), (2, 0), (3, 0)], key=str)


def test_secrets_before_and_after_words(spark):
    """Random keys of 20 to 80 characters near a sensitive word, on either side: nine in ten are found; the same prose without keys gives nothing."""
    rng, words = random.Random(11), "the of and settings deploy server then when notes about local branch".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, spans = [], []
    for _ in range(200):
        key = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(20, 81)))
        word = rng.choice(["private key", "credential", "bearer", "passphrase", "access key"])
        near = f"{key} is the {word}" if rng.random() < 0.5 else f"{word} of it {key}"
        before = prose(rng.randrange(1, 40)) + " "
        texts.append(f"{before}{near} {prose(10)}")
        at = texts[-1].index(key)
        spans.append(f"novel:{at}:{at + len(key)}")
    rows = [*enumerate(texts), *((1000 + k, f"{prose(30)} secret {prose(30)} access key {prose(20)}") for k in range(100))]
    got = {r.doc_id: r.s for r in scan_secrets(docs_of(spark, rows)).select("row.doc_id", joined_spans(F.col("spans")).alias("s")).collect()}
    assert sum(got[k] == s for k, s in enumerate(spans)) >= 0.9 * len(spans)
    assert all(got[1000 + k] == "" for k in range(100))


def test_secrets_and_benchmark_of_odd_rows(spark):
    rows = [(1, "token=abcdefghij"), (1, "token=abcdefghij"), (None, "password: 12345678"), (None, None), (2, "")]
    out = scan_secrets(docs_of(spark, rows)).select("row.doc_id", joined_spans(F.col("spans")).alias("s")).collect()
    assert sorted(r.s for r in out) == ["", "", "assign:0:16", "assign:0:16", "assign:0:18"]
    assert scan_secrets(docs_of(spark, rows).limit(0)).count() == 0
    item = " ".join(f"w{k}" for k in range(30))
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string")
    rows = [(1, "x " * 60_000 + item + " y" * 60_000), (None, item), (2, item), (2, item), (3, None)]
    got = decontaminate(docs_of(spark, rows), benchmark).select("row.doc_id", F.size("matches").alias("n"), "matches").collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == [("1", 1), ("2", 1), ("2", 1), ("3", 0), ("None", 1)]
    assert next(r.matches[0].start_word for r in got if r.doc_id == 1) == 60_000
    assert decontaminate(docs_of(spark, rows).limit(0), benchmark).count() == 0


def test_words_are_the_same_by_both_patterns():
    rng = random.Random(2)
    points = [c for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    for c in points:
        text = f"a{chr(c)}b {chr(c)}"
        assert language_id.words_of(text) == language_id.word_pattern().findall(text.lower()), hex(c)
    for _ in range(200):
        text = "".join(chr(rng.choice(points)) for _ in range(60))
        assert language_id.words_of(text) == language_id.word_pattern().findall(text.lower())


def test_warc_of_null_bodies_and_headers(spark):
    rows = [(1, "<urn:x>", "http://a/", "2024-01-01T00:00:00Z", None, None), (2, "<urn:y>", "http://b/", "2024-01-01T00:00:00Z", "HTTP/1.1 204 No Content\r\n\r\n", None), (3, "<urn:z>", "http://c/", "2024-01-01T00:00:00Z", "", "<p>x</p>")]
    out = derivatives(spark.createDataFrame(rows, "page_id long, record_id string, target_uri string, date string, http_headers string, body string")).collect()
    got = {(r.page_id, r.record_type): r for r in out}
    none = "sha1:" + hashlib.sha1(b"").hexdigest()
    assert got[1, "metadata"].block == f"sourceLength: 0\r\nsourceDigest: {none}\r\n"
    assert got[2, "metadata"].block == f"sourceStatus: HTTP/1.1 204 No Content\r\nsourceLength: 0\r\nsourceDigest: {none}\r\n"
    assert got[1, "conversion"].block == "" and got[3, "conversion"].block == "x" and got[1, "conversion"].content_length == 0
    assert len(out) == 6 and all(r.record and "\r\n\r\n" in r.record and f"Content-Length: {r.content_length}\r\n" in r.record for r in out)
