"""The pipeline against plain Python, stage by stage, on a small corpus with planted cases."""

import random

import numpy as np
import pytest
from test_pairs_and_lines import components_by_hand, contaminated_by_hand, lines_by_hand

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{c}" for a in ("lor", "men", "tan", "sil", "gor", "pel", "vin") for c in ("ab", "ec", "id", "of", "un", "ya", "os")]
    line = "this line stands in many documents, word for word as it is"
    items = [(k, " ".join(rng.choice(words) for _ in range(25))) for k in range(4)]
    docs, labels = [], []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        toxic = int(i % 8 == 0)
        for _ in range(5 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "rotten", "scumbag"]))
        labels.append((i, 1, toxic))
        body = " ".join(text)
        if i % 20 == 3:
            body += " " + items[i % 4][1].upper()
        if i % 10 == 5:
            body += "\n" + line
        docs.append((i, body))
    docs += [(300 + i, docs[i][1] + " extra") for i in (1, 2, 9)] + [(400, docs[1][1]), (500, ""), (501, None), (502, line)]
    folder = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items, {i for i, _, y in labels if y}


def test_stages_by_hand(spark, corpus):
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder, docs, items, toxic = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "benchmark decontamination", "bpe"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = now.columns, dict(docs)
    expected = {i: t for i, t in kept.items() if i not in toxic}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, folder)
        assert now.columns == columns
        got = {r.doc_id: r.text for r in now.collect()}
        if k == 1:
            by_hand = {i: t for i, _, dropped, t in lines_by_hand(list(expected.items())) if dropped}
            expected = {i: by_hand.get(i, t) for i, t in expected.items()}
        elif k == 2:
            root, _ = components_by_hand(list(expected.items()), 5, 80)
            expected = {i: t for i, t in expected.items() if root[i] == i}
        elif k == 3:
            bad = {i for i, _ in contaminated_by_hand(list(expected.items()), items)}
            assert bad
            expected = {i: t for i, t in expected.items() if i not in bad}
        assert got == expected
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(expected)
    for r in rows:
        ids = library.encode(expected[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_pipeline_on_nothing(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, *_ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
