"""Operators on entries, detections, lexicons and files: hand-worked cases, invariants and plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexicarta.operators import detections as det_ops
from lexicarta.operators import entries as entry_ops
from lexicarta.operators import generate, lexicon, series
from lexicarta.sources import files


def entry_rows(spark, rows):
    return spark.createDataFrame(rows, "pos long, karen string, definitions array<string>, page int, flag boolean, source string, entry_type string")


# --- entries


def test_normalise_entries(spark):
    rows = [(0, " a\t", ["x ", " ", ""], None, None, None, "odd"), (1, None, None, 3, True, "s", "example")]
    got = entry_ops.normalise_entries(entry_rows(spark, rows), source="scan", page=9).orderBy("pos").collect()
    assert [tuple(r)[1:7] for r in got] == [("a", ["x"], 9, False, "scan", "headword"), ("", [], 3, True, "s", "example")]


def test_labels_and_segments(spark):
    labels = F.array(F.struct(F.lit("1").alias("number"), F.lit("noun").alias("label")), F.struct(F.lit("2").alias("number"), F.lit("").alias("label")))
    got = spark.range(1).select(
        entry_ops.inject_labels(F.lit("1. a (1. b) 21. c 2. d x1. e"), labels).alias("a"),
        entry_ops.highlight_segments(F.lit("a<b ab a<b"), F.array(F.struct(F.lit("b").alias("text"), F.lit("XREF").alias("kind")), F.struct(F.lit("a<b").alias("text"), F.lit("").alias("kind")))).alias("b"),
        entry_ops.segment_kind(F.lit(" Cf ")).alias("c"),
        entry_ops.merge_lists(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))).alias("d"),
    ).first()
    assert got.a == "1. (noun) a (1. (noun) b) 21. c 2. d x1. e"
    assert got.b == '<span class="seg seg-other">a&lt;<span class="seg seg-cross_reference">b</span></span> ab a&lt;b'.replace("a&lt;<span", "a&lt;<span")
    assert got.c == "cross_reference" and got.d == ["x", "y", "z"]


def test_search_edit_and_link(spark):
    rows = [(i, f"k{i % 3}", [f"def {i}"], i, i == 2, "s", "headword" if i else "compound") for i in range(6)]
    e = entry_rows(spark, rows)
    assert [r.pos for r in entry_ops.search_entries(e, "DEF", limit=2).collect()] == [0, 1]
    assert entry_ops.search_entries(e, "DEF", limit=2).first().total == 6
    assert [r.pos for r in entry_ops.search_entries(e, "#4").collect()] == [4]
    assert [r.pos for r in entry_ops.search_entries(e, flagged=True, page="2").collect()] == [2]
    links = entry_ops.link_headwords(e, spark.createDataFrame([(9, "k0"), (9, "none")], "pos long, term string"))
    assert [tuple(r) for r in links.collect()] == [(9, "k0", 3)]  # the compound at 0 comes after the headword at 3
    edits = spark.createDataFrame([(1, None, ["new"], None, True)], "pos long, karen string, definitions array<string>, flag boolean, promote boolean")
    out = {r.pos: r for r in entry_ops.edit_entries(e, edits, e.where("pos = 5"), "now").collect()}
    assert set(out) == {0, 1, 2, 3, 4} and out[1].definitions == ["new"] and out[1].karen == "k1" and out[1].promoted and out[0].updated_at is None


def test_model_output(spark):
    good = json.dumps([{"karen": "k", "definitions": ["d"]}])
    raws = [good, f"```json\n{good}\n```", '{"entries": ' + good + "}", f"So: {good} done", "none", None, "[broken"]
    out = entry_ops.parse_model_output(spark.createDataFrame(list(enumerate(raws)), "request_id int, raw string")).orderBy("request_id").collect()
    assert [r.karen for r in out] == ["k"] * 4 + [None] * 3
    assert [r.error is None for r in out] == [True] * 4 + [False] * 3


def test_model_output_query_keeps_all_definitions(spark, tmp_path):
    from lexicarta.plans.entry_queries import QUERIES

    texts = [(i, "k\n" + "\n".join(f"line {j}" for j in range(i + 3)), "s") for i in range(4)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.request_id: r.definitions for r in QUERIES["parse_model_output"](spark, str(tmp_path)).collect()}
    assert got == {i: t for i, t, _ in texts}


def test_relations(spark):
    rows = [(0, "k", ["from old; see here", "see there. from new", "see here"], 1, False, "s", "headword")]
    got = {r.field: r.found for r in entry_ops.relations(entry_rows(spark, rows)).collect()}
    assert got == {"etymology": ["old"], "cross_reference": ["here", "there"]}


def test_corrections(spark):
    words = spark.createDataFrame([(0, "ကံၒ"), (1, "ခံၒ"), (2, "ကံၒး")], "pos long, native string")
    fixes = spark.createDataFrame([("ကံၒ", "ကံၓ", "tone_error")], "original string, corrected string, error_type string")
    got = {r.pos: (r.applied, r.after) for r in entry_ops.propagate_correction(words, fixes).collect()}
    assert got == {0: (True, "ကံၓ"), 2: (True, "ကံၓး")}
    e = entry_rows(spark, [(0, "a", ["long text"], 1, False, "s", "headword"), (1, "b", ["x"], 1, False, "s", "headword"), (2, "c", ["y"], 1, False, "s", "headword")])
    c = spark.createDataFrame([("a", 1, "wrong_headword", None), ("a", 2, "formatting_error", None), ("b", 1, "wrong_definition", ["fixed"])], "karen string, at int, kind string, definitions array<string>")
    out = {r.pos: (r.definitions, r.needs_review, r.review_reason) for r in entry_ops.apply_ground_truth(e, c).collect()}
    assert out == {0: (["long text"], True, "cut definition"), 1: (["fixed"], False, None), 2: (["y"], False, None)}


# --- detections


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        x, y = rng.randrange(200), rng.randrange(150)
        rows.append((i, i % 3, i % 9, rng.randrange(1000) / 1000, x, y, x + rng.randrange(10, 60), y + rng.randrange(10, 40)))
    return rows, spark.createDataFrame(rows, "event_id long, image long, class_idx int, conf double, x1 int, y1 int, x2 int, y2 int")


def iou(a, b):
    w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
    area = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def test_nms_keeps_a_maximal_set(boxes):
    rows, df = boxes
    kept = {r.event_id for r in det_ops.nms(df, 0.4).collect()}
    for r in rows:
        better = [s for s in rows if s[1] == r[1] and s[0] in kept and s[0] != r[0] and iou(r, s) >= 0.4]
        assert (r[0] in kept) == (not any((s[3], -s[0]) > (r[3], -r[0]) for s in better))


def test_iou_pairs_by_hand(boxes):
    rows, df = boxes
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and round(iou(a, b), 6) >= 0.3}
    assert {(r.a, r.b) for r in det_ops.iou_pairs(df, 0.3).collect()} == expected


def test_reading_order_by_hand(boxes):
    rows, df = boxes
    got = {}
    for r in det_ops.reading_order(df).collect():
        got.setdefault(r.image, []).append((r.place, r.event_id))
    for image in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == image]
        near, lines = 0.4 * sum(r[7] - r[5] for r in mine) / len(mine), []
        for r in sorted(mine, key=lambda r: ((r[5] + r[7]) / 2, r[0])):
            y = (r[5] + r[7]) / 2
            line = next((x for x in lines if abs(y - sum((s[5] + s[7]) / 2 for s in x) / len(x)) <= near), None)
            if line is None:
                lines.append([r])
            else:
                line.append(r)
        order = [s[0] for x in lines for s in sorted(x, key=lambda s: ((s[4] + s[6]) / 2, s[0]))]
        assert [e for _, e in sorted(got[image])] == order


def test_cut_images_give_the_same(boxes):
    _, df = boxes
    for f in (det_ops.nms, det_ops.reading_order):
        whole = {tuple(r) for r in f(df).collect()}
        assert {tuple(r) for r in f(df, boxes_at_once=3).collect()} == whole and {tuple(r) for r in f(df, boxes_at_once=1).collect()} == whole


def test_file_names_and_components(spark):
    names = ["guh_a_t1_0A1B2C3D.jpg", "hsuhshuh_a_t1_0A1B2C3D.jpg", "plain.jpg", "a_b.png"]
    rows = spark.createDataFrame([(n,) for n in names], "file string").select("file", det_ops.class_from_filename(F.col("file")).alias("name"))
    assert {r.file: r.name for r in rows.collect()} == {names[0]: "guh_a_t1", names[1]: "hsuhshuh_a_t1_0A1B2C3D", names[2]: "plain", names[3]: "a_b"}
    parts = det_ops.label_components(spark.createDataFrame([("guh_medya_ah_t3",)], "name string")).collect()
    assert [(r.kind, r.part) for r in parts] == [("base", "guh"), ("medial", "medya"), ("vowel", "ah"), ("tone", "t3")]


def test_splits_partition_the_input(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}") for i in range(100)] + [(500, "alone")], "id long, g string")
    out = det_ops.stratified_split(rows, "id", "g").groupBy("g", "part").count().collect()
    assert sum(r["count"] for r in out) == 101
    assert {(r.part, r["count"]) for r in out if r.g == "alone"} == {("train", 1)}
    assert all(sum(r["count"] for r in out if r.g == f"g{k}" and r.part == "train") == int((15 if k < 2 else 14) * 0.7) for k in range(7))


def test_tiles_and_plans(spark):
    tiles = det_ops.tile_grid(spark.createDataFrame([(1, 700, 500)], "image long, width int, height int")).collect()
    assert sorted((r.tile_x, r.tile_y, r.x2, r.y2) for r in tiles) == [(0, 0, 640, 500), (560, 0, 700, 500)]
    gaps, classes = spark.createDataFrame([(1,), (9,)], "class_idx int"), spark.createDataFrame([(1, "a")], "class_idx int, name string")
    plan, skipped = det_ops.oversample_plan(gaps, classes, "b", 3)
    assert [r.sample for r in plan.orderBy("k").collect()] == ["b_a_0000", "b_a_0001", "b_a_0002"] and [r.class_idx for r in skipped.collect()] == [9]
    kept, moved = det_ops.clean_classes(spark.createDataFrame([(0, "Legacy x"), (1, "a"), (2, "b")], "class_idx int, name string"), spark.createDataFrame([("s", 0), ("s", 2)], "stem string, class_idx int"), ["legacy"])
    assert [(r.class_idx, r.new_idx) for r in kept.orderBy("class_idx").collect()] == [(1, 0), (2, 1)] and [(r.class_idx, r.new_idx) for r in moved.collect()] == [(2, 1)]


def test_syllable_grid_sizes(spark):
    bases, vowels, tones = [f"b{i}" for i in range(25)], [f"v{i}" for i in range(10)], [f"t{i}" for i in range(6)]
    grid = generate.syllable_grid(spark, bases, ["m1", "m2"], vowels, tones, ["b23", "b24"])
    assert grid.count() == 25 * 10 * 6 + 23 * 2 * 10 * 6 and grid.select("label").distinct().count() == grid.count()
    assert grid.where("class_id = 61").first().label == "b1_v0_t1"


def test_sample_paragraphs_draw_from_all_words(spark):
    ids = spark.range(4000)
    for n, least in ((1, 1), (3, 3), (12000, 11900)):
        words = spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("native"))
        out = generate.sample_paragraphs(ids, words.unionByName(words).unionByName(spark.sql("select string(null) as native")), 7).collect()
        lines = [line.split(" ") for r in out for line in r.text.split("\n")]
        assert sorted(r.id for r in out) == list(range(4000))
        assert {len(r.text.split("\n")) for r in out} == {2, 3, 4} and {len(x) for x in lines} == {4, 5, 6, 7, 8, 9}
        drawn = {w for x in lines for w in x}
        assert least <= len(drawn) and drawn <= {f"w{k}" for k in range(n)}


# --- lexicon


def segment_by_hand(s, known, connectors, longest):
    """Candidates in the stated order, tried one by one without any index."""
    n = len(s)
    spans = [(i, j) for i in range(n) for j in range(n, i, -1) if connectors.get("".join(s[i:j])) == j - i]
    out, at = [], 0
    while at < n:
        tries = [(at, n)]
        for a, z in spans:
            if z <= at:
                continue
            stop = min((b for b, _ in spans if b > z), default=n)
            tries += [(at, a)] * (a > at) + [(at, z)] + [(at, stop)] * (a == at) + [(z, stop)] * (z < stop)
        tries += [(at, e) for e in range(n, at, -1)]
        hit = next(((a, z) for a, z in tries if 0 < z - a <= longest and "".join(s[a:z]) in known), None)
        out.append("".join(s[hit[0] : hit[1]]) if hit else s[at])
        at = hit[1] if hit else at + 1
    return out


def test_segment_by_hand(spark):
    rng = random.Random(11)
    syl = ["က", "ခ", "ဂ", "ဃ", "င"]
    connectors = {"ခ": 1, "ဂဃ": 2}
    known = {"".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(14)}
    texts = [[rng.choice(syl) for _ in range(rng.randrange(0, 14))] for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, syllables array<string>")
    lex = spark.createDataFrame([(k, f"m-{k}") for k in known], "chunk string, meaning string")
    got = {r.doc_id: [p.chunk for p in r.parts] for r in lexicon.segment(df, lex, connectors, 4).collect()}
    assert got == {i: segment_by_hand(s, known, connectors, 4) for i, s in enumerate(texts)}
    greedy = {r.doc_id: [p.chunk for p in r.parts] for r in lexicon.segment_greedy(df, lex, 4).collect()}
    assert all("".join(greedy[i]) == "".join(s) for i, s in enumerate(texts))


def test_lookup_and_compose(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, query string")
    table = lambda rows: spark.createDataFrame(rows, "query string, result string")
    got = {r.id: (r.result, r.source) for r in lexicon.lookup_cascade(q, [("seed", table([("a", "A")])), ("cache", table([("a", "x"), ("b", "B")])), ("web", table([("c", "")]))]).collect()}
    assert got == {1: ("A", "seed"), 2: ("B", "cache"), 3: (None, "none")}


def test_key_value_lines_keep_their_order(spark):
    raws = ["", "# note", "save =", "save = က", "က = save", "save = other", "ကခ", "text"]
    lines = spark.createDataFrame([(1, i, r) for i, r in enumerate(raws)], "file int, line_no int, raw string")
    assert [r.kind for r in lexicon.kv_classify(lines).orderBy("line_no").collect()] == ["keep", "keep", "fill", "parse", "parse", "keep", "parse", "keep"]
    out = lexicon.kv_translate(lines, spark.createDataFrame([("save", "ခ")], "query string, result string"), spark.createDataFrame([("က", "thing/one")], "chunk string, meaning string"))
    rows = {r.line_no: (r.output, r.analysis) for r in out.collect()}
    assert set(rows) == set(range(8)) and rows[2][0] == "save = ခ" and rows[6][1] == "# ကခ -> thing (က: thing/one) + (ခ: ??)"


def test_html_candidates(spark):
    html = "<script>var p='<p>no</p>'</script><ul><li>- one thing -</li><li>Home</li></ul><p>two က things</p><h2>one thing</h2><p></p>"
    got = lexicon.html_candidates(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()
    assert [(r.page_id, r.candidates) for r in got] == [(1, ["one thing", "two things"])]


# --- series and files


def test_paragraphs_and_islands(spark):
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(["ကခ" "ဂ", "း", "x1", "ငစ", ""])], "doc_id long, pos int, text string")
    got = series.paragraphs(words, least=4, most=5).orderBy("paragraph").collect()
    assert [r.text for r in got] == ["ကခဂး", "ငစ"]
    rows = [(1, p, v) for p, v in enumerate([0, 9, 9, 0, 9, 9, 0, 0, 0, 9, 0, 9, 9, 9])]
    out = series.islands(spark.createDataFrame(rows, "key int, pos long, value int"), 0.5, 2, 2)
    assert sorted((r.first_pos, r.last_pos) for r in out.collect()) == [(1, 5), (11, 13)]


def test_files_round_trip(spark, tmp_path):
    e = entry_rows(spark, [(i, f"k{i}", ["a"], i % 2, False, "s", "headword") for i in range(5)])
    files.write_entries(e, f"{tmp_path}/e")
    assert {r.karen for r in files.read_entries(spark, f"{tmp_path}/e", whole=False).collect()} == {f"k{i}" for i in range(5)}
    (tmp_path / "bad.json").write_text("{not json")
    assert files.read_entries(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "c.csv").write_text("epoch,map50\n1,0.5\n2,inf\n")
    assert [r.map50 for r in files.read_curve(spark, f"{tmp_path}/c.csv", "epoch int, map50 double").orderBy("epoch").collect()] == [0.5, float("inf")]
    files.write_snapshot(e, f"{tmp_path}/snap")
    files.write_snapshot(e.where("pos < 2"), f"{tmp_path}/snap")
    assert files.read_snapshot(spark, f"{tmp_path}/snap").count() == 2
    files.write_groups(e.select("pos", "karen", "page"), f"{tmp_path}/g", "page")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g/csv").count() == spark.read.json(f"{tmp_path}/g/json").count() == 5


def test_ingest_ledger(spark, tmp_path):
    for name, body in (("a.txt", "1\n2\n"), ("b.txt", "3\n"), ("empty.txt", "")):
        (tmp_path / name).write_text(body)
    ledger = spark.createDataFrame([(f"file:{tmp_path}/a.txt",)], "file string")
    lines, after = files.ingest_new(spark, f"{tmp_path}/*.txt", ledger)
    assert [r.value for r in lines.collect()] == ["3"] and after.count() == 2
