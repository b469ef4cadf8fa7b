"""Operators of entries, lexicons, detections and files on small cases: long connectors, lexicons beyond the bound, corrections of any length."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.functions import text
from lexicarta.operators import detections, entries, generate, lexicon, series
from lexicarta.sources import files
from lexicarta.streaming import flows


def test_connectors_of_any_length(spark):
    long = "က" * 40
    texts = spark.createDataFrame([(1, ["က"] * 45), (2, ["ခ"]), (3, []), (4, None)], "doc_id long, syllables array<string>")
    known = spark.createDataFrame([*((f"{'ဂ' * k}", k) for k in range(2, 40)), (long, 40), ("ခ", 1)], "connector string, size int")
    got = {(r.doc_id, r.start, r.end) for r in lexicon.connector_spans(texts, known).collect()}
    assert got == {(1, k, k + 40) for k in range(6)} | {(2, 0, 1)}


def test_segments_are_the_same_with_a_joined_lexicon(spark, monkeypatch):
    rng = random.Random(3)
    texts = spark.createDataFrame([(k, [rng.choice("ကခဂဃ") for _ in range(rng.randrange(0, 40))]) for k in range(60)] + [(99, None)], "doc_id long, syllables array<string>")
    known = {"".join(rng.choice("ကခဂဃ") for _ in range(rng.randrange(1, 5))) for _ in range(40)}
    words = spark.createDataFrame([(w, f"m{k}") for k, w in enumerate(sorted(known))] + [("က", "zz"), ("က", "yy")], "chunk string, meaning string")
    run = lambda: {r.doc_id: r.parts for r in lexicon.segment_greedy(texts, words, 4).collect()} | {-r.doc_id - 1: r.parts for r in lexicon.segment(texts, words, {"က": 1, "ခဂ": 2}, 4).collect()}
    sent = run()
    both = lexicon.segmented
    monkeypatch.setattr(lexicon, "segmented", lambda *a: both(*a, most_sent=-1))
    assert run() == sent and sent[99] == [] and any(p.reason == "longest" for p in sent[0])


def test_corrections_of_any_length_are_those_that_contain(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("ကခဂါိ") for _ in range(rng.randrange(1, 7))) for _ in range(60)] + ["", None]
    fixes = sorted({"".join(rng.choice("ကခဂါိ") for _ in range(rng.randrange(1, 4))) for _ in range(12)})
    df = spark.createDataFrame([*enumerate(keys)], "pos long, native string")
    f = spark.createDataFrame([(x, x + "း", "other") for x in fixes], "original string, corrected string, error_type string")
    got = {(r.pos, r.original) for r in entries.propagate_correction(df, f).collect()}
    assert got == {(i, x) for i, k in enumerate(keys) for x in fixes if k and x in k}
    assert any(len(x) == 1 for x in fixes)
    assert entries.propagate_correction(df, f.limit(0)).count() == 0


def test_analysis_of_odd_values(spark):
    rows = [(1, None), (2, "[]"), (3, "no json"), (4, '{"examples": "x", "segments": [{"text": "a"}, "b", "b"], "other": [1]}')]
    df = spark.createDataFrame(rows, "pos long, analysis string").select("pos", entries.normalise_analysis(F.col("analysis")).alias("a"))
    got = {r.pos: r for r in df.select("pos", "a.examples", "a.segments", entries.dedupe_items(F.col("a.segments")).alias("items")).collect()}
    assert all(got[k].examples == [] for k in (1, 2, 3, 4)) and got[4].segments == ['{"text":"a"}', "b", "b"]
    assert got[4]["items"] == ['{"text":"a"}', '{"text":"b"}']


def test_addresses_are_resolved(spark):
    from urllib.parse import urljoin

    base = ["http://a.b/c/d.html?q=1", "http://a.b", "https://a.b/x/y/"]
    seen = ["img/x.png", "/r.png", "//h/z.png", "../up.png", "./here.png", "../../../a/./b/../c.png", "http://o/k.png", "data:image/png;base64,AA", "a/..", "q.png?x=../y"]
    df = spark.createDataFrame([(b, u) for b in base for u in seen], "url string, found string")
    for r in df.select("*", files.resolved(F.col("found"), F.col("url")).alias("whole")).collect():
        assert r.whole == urljoin(r.url, r.found), (r.url, r.found)


def test_page_images_are_img_alone(spark):
    html = '<html><!-- <img src="no.png"> --><a href="/l">link</a><article src="x">t</article><IMG class="c" src="a.png"><img alt=""><script>var x;</script> two</html>'
    r = files.page_sample(spark.createDataFrame([(1, "http://h/d/", html)], "page_id long, url string, html string")).first()
    assert r.images == ["http://h/d/no.png", "http://h/d/a.png"] and r.text == "link\nt\ntwo"


def test_repeats_collapse_as_by_hand():
    def by_hand(t):
        t = t.strip()
        for k in (8, 4, 2):
            if t and len(t) % k == 0 and t[: len(t) // k] * k == t:
                return t[: len(t) // k]
        out, at, n = [], 0, len(t)
        while at < n:
            copies = lambda end: next(((end - at) // k for k in (4, 8, 2) if (end - at) % k == 0 and end - at >= 2 * k and t[at : at + (end - at) // k] * k == t[at:end]), 0)  # noqa: E731, B023
            end = next((e for e in (n, *range(at + 4, n + 1, 2)) if copies(e)), 0)
            out.append(t[at : at + copies(end)] if end else t[at])
            at = end or at + 1
        return "".join(out)

    rng = random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice(["ab", "a", "b", "abc", "c"]) * rng.choice([1, 1, 2, 4, 8]) for _ in range(rng.randrange(0, 7)))
        assert text.collapse_repeats(t) == by_hand(t), t
    assert len(text.collapse_repeats("ab" * 2001 + "c")) < 2100


def test_grids_and_lists(spark, tmp_path):
    grid = generate.syllable_grid(spark, list("abcd"), ["m", "n"], ["u", "v", "w"], ["1", "2"], plain=["d"], contractions=["x", "y"], medial_vowels=2, medial_tones=1)
    rows = [(r.class_id, r.label) for r in grid.orderBy("class_id").collect()]
    assert [i for i, _ in rows] == list(range(4 * 3 * 2 + 3 * 2 * 2 + 2)) and rows[0] == (0, "a_u_1") and rows[24] == (24, "a_m_u_1") and rows[-2:] == [(36, "x"), (37, "y")]
    files.write_class_list(grid, f"{tmp_path}/classes")
    assert [line for p in sorted((tmp_path / "classes").glob("*.txt")) for line in p.read_text().split()] == [x for _, x in rows]
    kv = spark.createDataFrame([("f", 1, 0, "note"), ("f", 0, 1, "b = 2"), ("f", 0, 0, "a = 1"), ("g", 0, 0, "c")], "file string, section int, line_no int, text string")
    files.write_kv_result(kv, f"{tmp_path}/kv")
    assert "".join(p.read_text() for p in sorted((tmp_path / "kv" / "file=f").glob("*.txt"))) == "a = 1\nb = 2\nnote\n"
    assert {r.level for r in series.alphabet_reference(spark).collect()} == {"consonant", "tone", "vowel", "medial"}


def test_paragraphs_draw_from_all_words(spark):
    words = spark.createDataFrame([(f"w{k}",) for k in range(50)] + [(None,), ("w1",)], "native string")
    rows = generate.sample_paragraphs(spark.range(300), words, seed=3).collect()
    lines = [line.split(" ") for r in rows for line in r.text.split("\n")]
    assert len(rows) == 300 and all(2 <= len(r.text.split("\n")) <= 4 for r in rows) and all(4 <= len(x) <= 9 for x in lines)
    assert {w for x in lines for w in x} == {f"w{k}" for k in range(50)}


def test_small_splits_and_plans(spark):
    f = spark.createDataFrame([(k, None if k % 5 == 0 else f"g{k % 2}") for k in range(200)] + [(1000, "lone")], "id long, grp string")
    got = detections.stratified_split(f, "id", "grp").groupBy("grp", "part").count().collect()
    n = {(r.grp, r.part): r["count"] for r in got}
    assert n[None, "train"] == 28 and n[None, "valid"] == 6 and n[None, "test"] == 6 and n["lone", "train"] == 1
    plan, skipped = detections.oversample_plan(spark.createDataFrame([(1,), (9,)], "class_idx int"), spark.createDataFrame([(1, "a")], "class_idx int, name string"), "p", 3, 2)
    assert {(r.split, r.classes, r.samples) for r in detections.oversample_totals(plan).collect()} == {("train", 1, 3), ("valid", 1, 2)} and [r.class_idx for r in skipped.collect()] == [9]


def test_snapshots_and_batches(spark, tmp_path):
    path = f"{tmp_path}/snap"
    for n in (5, 3):
        files.write_snapshot(spark.range(n), path)
        assert files.read_snapshot(spark, path).count() == n
    for batch in range(4):
        flows.keep_snapshot(spark.range(batch + 1), f"{tmp_path}/b", batch)
    assert flows.batches_of(spark, f"{tmp_path}/b") == [2, 3] and flows.latest_snapshot(spark, f"{tmp_path}/b").count() == 4


def test_new_files_alone_are_read(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}.txt").write_text(f"line {k}\n")
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file"))
    lines, ledger = files.ingest_new(spark, str(tmp_path), listed.where("file like '%f0.txt' or file like '%f1.txt'"))
    assert sorted(r.value for r in lines.collect()) == ["line 2", "line 3"] and ledger.count() == 4
    assert files.ingest_new(spark, str(tmp_path), ledger)[0].count() == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Elsewhere:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        files.scratch(Elsewhere(), "x")


def test_repeats_of_long_texts_by_both_ways(monkeypatch):
    from lexicarta.functions import repeats

    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "a", "b", "abc", "c"]) * rng.choice([1, 1, 2, 4, 8]) for _ in range(rng.randrange(0, 9))) for _ in range(600)]
    short = [repeats.collapse_repeats(t) for t in texts]
    monkeypatch.setattr(repeats, "SHORT", -1)
    assert [repeats.collapse_repeats(t) for t in texts] == short
    began = time.time()
    for t in ("a" * 100_000 + "b", "".join(rng.choice("ab") for _ in range(100_000)), "".join(rng.choice("abcdefgh") for _ in range(100_000))):
        repeats.collapse_repeats(t)
    assert time.time() - began < 20


def test_all_runs_by_hand():
    from lexicarta.functions.repeats import all_runs

    rng = random.Random(7)
    for _ in range(300):
        t = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 40))]
        want = set()
        for p in range(1, len(t) // 2 + 1):
            for s in range(len(t)):
                e = s + p
                while e < len(t) and t[e] == t[e - p]:
                    e += 1
                first = s == 0 or s + p - 1 >= len(t) or t[s - 1] != t[s + p - 1]
                if e - s >= 2 * p and first and not any(all(t[i] == t[i + q] for i in range(s, e - q)) for q in range(1, p)):
                    want.add((s, e, p))
        assert set(zip(*(x.tolist() for x in all_runs(np.array(t, np.int64))))) == want


def test_places_in_a_global_order(spark):
    from lexicarta.operators.ranking import with_places

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.randrange(10**6), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, k int").repartition(7)
    everyone = {r.k: r.place for r in with_places(df, ["v", "k"]).collect()}
    assert everyone == {k: i for i, (_, _, k) in enumerate(sorted(rows, key=lambda r: r[1:]))}
    grouped = {r.k: r.place for r in with_places(df, ["v", "k"], ["g"]).collect()}
    for g in ("a", "b", None):
        assert [grouped[k] for _, k in sorted((v, k) for x, v, k in rows if x == g)] == list(range(sum(x == g for x, _, _ in rows)))
    assert with_places(df.limit(0), ["v"]).count() == 0


def test_posting_lists_decode(spark):
    rng = random.Random(9)
    rows = sorted({(rng.choice("ab"), rng.randrange(4), rng.randrange(60)) for _ in range(200)})
    lists = series.posting_lists(spark.createDataFrame(rows, "word string, file long, line_no int"), size=16)
    got = [(r.word, r.chunk, tuple(k)) for r in series.posting_keys(lists).collect() for k in r["keys"]]
    for word in "ab":
        own = [(f, n) for w, f, n in rows if w == word]
        assert [k for w, _, k in sorted(got) if w == word] == own and max(c for w, c, _ in got if w == word) == (len(own) - 1) // 16
    assert all(r.n <= 16 and len(r.gaps) == r.n - 1 for r in lists.collect())


def test_suppression_of_one_chain(spark):
    n = 3000  # each box meets the next two; every third stays
    rows = [(1, i, 1.0 - i / n, 10 * i, 7 * (i % 2), 10 * i + 34, 7 * (i % 2) + 40) for i in range(n)] + [(2, n + i, 0.5, 0, 0, 10, 10) for i in range(3)]
    df = spark.createDataFrame(rows, "image long, event_id long, conf double, x1 int, y1 int, x2 int, y2 int")
    whole = {r.event_id for r in detections.nms(df, 0.2).collect()}
    assert {r.event_id for r in detections.nms(df, 0.2, boxes_at_once=700).collect()} == whole and len(whole) < n / 2


def test_candidates_in_the_order_of_selectors(spark):
    html = (
        "<ul><li>first item</li></ul><div id='content-summary'><b>bold</b><strong>Query</strong><strong> sum <i>mary</i> </strong></div><strong>outside</strong>"
        "<span class='x translation__snippet y'>snippet</span><span class='not-translation'>no class</span><div class='translation'>classed<br>twice</div>"
        "<q data-element='phraseTranslation'>phrase &amp; one</q><h3>three</h3><p>para<p>nested</div><h2>two</h2><script>li = '<li>x</li>'</script><!-- <li>gone</li> -->"
    )
    rows = [(1, html, "query"), (2, "<p>only one</p>tail\nnext", "q"), (3, None, "q"), (4, "", None), (5, "<li>- က mixed; -</li><li>တ</li><li>home</li><li>" + "x" * 200 + "</li>", "")]
    df = spark.createDataFrame(rows, "page_id int, html string, query string")
    got = {r.page_id: r.candidates for r in lexicon.html_candidates(df, most=20).collect()}
    assert got[1] == ["sum mary", "snippet", "phrase & one", "classed twice", "first item", "para nested two", "nested two", "two", "three"]
    assert got[2] == ["only one", "tail", "next"] and got[5] == ["mixed"] and 3 not in got and 4 not in got
    assert lexicon.html_candidates(df.where("page_id = 1"), most=2).first().candidates == ["sum mary", "snippet"]
    assert lexicon.html_candidates(df.where("page_id = 1").drop("query"), most=1).first().candidates == ["Query"]


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text('[\n  {"karen": "က",\n   "definitions": ["x"]},\n  {"karen": "ခ"}\n]\n', encoding="utf-8")
    assert [(r.pos, r.karen) for r in files.read_entries(spark, f"{tmp_path}/e").orderBy("pos").collect()] == [(0, "က"), (1, "ခ")]
    (tmp_path / "data.yaml").write_text("nc: 3\nnames:\n  - c_a\n- b\n  - a_t1\n")
    assert [(r.class_idx, r.name) for r in files.read_classes(spark, f"{tmp_path}/data.yaml").orderBy("class_idx").collect()] == [(0, "c_a"), (1, "b"), (2, "a_t1")]
