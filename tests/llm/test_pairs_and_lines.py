"""Line dedup, Jaccard join, top-k search and decontamination against plain Python, with odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import decontaminate as decontaminate_module
from lexicarta.llm.decontaminate import RADIUS, ItemIndex, decontaminate, weighted_similarity, window_marks
from lexicarta.llm.jaccard_join import PrefixTree, jaccard_components, jaccard_join
from lexicarta.llm.knn_join import top_k
from lexicarta.llm.line_dedup import line_dedup
from lexicarta.llm.shared import components, shingled, word_hashes

SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def docs_of(spark, rows):
    """Rows with columns that clash with the operators' own names."""
    full = [(i, t, "x", f"s{k}", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, dropped string, h1 string, lines int")


# --- line dedup


def lines_by_hand(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(SPACES))
            if i is not None and len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [
            i is not None and len(k) >= min_chars and len(holders.get(k, ())) >= min_docs and i != max(holders[k])
            for k in (ascii_lower(x.strip(SPACES)) for x in lines)
        ]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_line_dedup_by_hand(spark):
    rng = random.Random(3)
    pool = [f"  Shared LINE number {n} that is long enough to count É\t" for n in range(8)] + ["short", "", " \x0b", "É" * 39 + "a", "k" * 39]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0]), (None, "\n".join(pool)), (7, pool[0] + "\nother"), (8, rows[8][1]), (200, "\n".join(pool * 500))]
    got = line_dedup(docs_of(spark, rows))
    got = sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str)
    assert got == lines_by_hand(rows)
    assert any(x[2] for x in got)


def test_line_dedup_bitmaps_and_empty(spark):
    line = "a line of at least forty code points, held by all"
    out = line_dedup(docs_of(spark, [(i, f"top\n{line}\n{line}\nend") for i in range(6)]))
    runs = {r.row.doc_id: [tuple(x) for x in r.keep_runs] for r in out.collect()}
    assert runs[5] == [(0, 4)] and runs[0] == [(0, 1), (3, 1)]
    assert line_dedup(docs_of(spark, []).limit(0)).count() == 0


# --- Jaccard join


def sets_by_hand(text, size):
    words = ascii_lower(text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1)))


def components_by_hand(rows, size, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(sets_by_hand(text, size))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                links.add((a, b))
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}, links


def near_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    rows, base = [], [" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))) for _ in range(12)]
    for i in range(n):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text = (passage + " " + " ".join(text[:10])).split()
        rows.append((i, " ".join(x.upper() if rng.random() < 0.1 else x for x in text)))
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3)])
def test_jaccard_components_by_hand(spark, size, percent, seed):
    rows = near_rows(seed) + [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  b"), (505, "one"), (None, "a b"), (506, "x " * 3000)]
    rows += [(5, rows[20][1]), (5, "own words only here and nowhere else at all in this list of rows " + " ".join(f"z{k}" for k in range(300)))]
    expected, _ = components_by_hand(rows, size, percent)
    out = jaccard_components(docs_of(spark, rows), size, percent).collect()
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id is not None} == set(expected.items())
    assert len(out) == len(rows)
    assert {r.doc_id: r.n for r in out}[503] == 1 and {r.doc_id: r.n for r in out}[500] == 0


def test_jaccard_links_and_blocks(spark):
    rows = near_rows(5)
    _, expected = components_by_hand(rows, 4, 85)
    members, links = jaccard_join(docs_of(spark, rows), 4, 85, every=True, block=400)
    classes = {r.doc_id: r.class_id for r in members.collect()}
    assert {(r.a, r.b) for r in links.collect()} == {tuple(sorted((classes[a], classes[b]))) for a, b in expected if classes[a] != classes[b]}
    assert jaccard_components(docs_of(spark, rows).limit(0), 4, 85).count() == 0


def test_prefix_tree_finds_all_links():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 30)))) for _ in range(80)]
    sets = [np.array(x) for x in {tuple(s.tolist()) for s in sets}]
    found = {tuple(sorted((i, j))) for i, j, _ in PrefixTree(sets, np.array([len(s) for s in sets]), 60).links(every=True)}
    by_hand = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}
    assert found == {tuple(sorted(x)) for x in by_hand}


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


# --- top-k search


def top_by_hand(rows, k, every):
    ints = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        ints[i] = min(ints[i], q) if i in ints else q
    out = set()
    for q in ints:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(4)]) for i in range(180)]
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan"), 1.0]), (203, [float("inf")]), (None, [1.0]), (204, []), (205, [1.0]), (50, [9.0, 9.0, 9.0, 9.0]), (300, [1e3, 2.0, 3.0, 4.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in top_k(data, 5, 50).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == top_by_hand([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 50)


def test_top_k_of_several_groups(spark, monkeypatch):
    from lexicarta.llm import knn_join

    monkeypatch.setattr(knn_join, "GROUP", 8)
    rng = random.Random(14)
    centres = [[rng.uniform(-4, 4) for _ in range(4)] for _ in range(6)]
    rows = [(i, [round(x + rng.uniform(-0.2, 0.2), 2) for x in rng.choice(centres)]) for i in range(240)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in top_k(data, 5, 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == top_by_hand([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5, 5)
    asking, served, _ = knn_join.served_rows(data, 5, 5)
    assert asking.select("cell").distinct().count() > 2 and served.count() > 0


def test_top_k_replicates_little_among_clusters(spark, monkeypatch):
    from lexicarta.llm import knn_join

    monkeypatch.setattr(knn_join, "GROUP", 12)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.arange(3000) % 12] + 0.004 * rng.normal(size=(3000, 24))
    data = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int")
    asking, served, _ = knn_join.served_rows(data, 5, 25)
    groups = asking.select("cell", "part").distinct().count()
    assert groups >= 10 and served.count() < 0.5 * groups * 3000
    got = {tuple(r) for r in top_k(data, 5, 25).collect()}
    assert got == top_by_hand([(i, v.tolist()) for i, v in enumerate(x)], 5, 25)


def test_top_k_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5])], schema)).collect()] == [(0, 1, 1, 256 * 128)]
    assert top_k(spark.createDataFrame([(1, [1.0])], schema)).count() == 0


# --- decontamination


def contaminated_by_hand(rows, items, similarity=0.8):
    out = {}
    for i, text in rows:
        words = word_hashes(text)
        for item, passage in items:
            want = word_hashes(passage)
            if passage is None or not len(want) or item is None:
                continue
            target, n = shingled(want, 5), len(want)
            for at in range(len(words) - n + 1):
                s = weighted_similarity(shingled(words[at : at + n], 5), target)
                if s >= similarity and s > out.get((i, item), 0):
                    out[i, item] = s
    return out


def test_decontaminate_by_hand(spark):
    rng = random.Random(6)
    words = [f"b{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 20, 45])))) for k in range(12)] + [(50, None), (51, ""), (None, "b1 b2 b3"), (52, "z z z z z z z z")]
    rows = []
    for i in range(50):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        if i % 2:
            passage = (rng.choice(items[:12])[1]).upper().split()
            if i % 3 == 0 and len(passage) > 40:
                passage[0] = "other"
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = passage
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, "z " * 300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(docs_of(spark, rows), benchmark)
    got = {(r.row.doc_id, m.item_id): m.similarity for r in out.collect() for m in r.matches}
    assert got == pytest.approx(contaminated_by_hand(rows, items))
    assert out.count() == len(rows)
    assert decontaminate(docs_of(spark, rows), benchmark.limit(0)).where(F.size("matches") > 0).count() == 0


def shorter_by_hand(rows, items, similarity=0.8):
    """Similarity of each document, as one window, to the items of more words."""
    out = {}
    for i, text in rows:
        for item, passage in items:
            words, want = word_hashes(text), word_hashes(passage)
            if 0 < len(words) < len(want):
                s = weighted_similarity(shingled(words, 5), shingled(want, 5))
                if s >= similarity:
                    out[i, item] = s
    return out


def test_decontaminate_documents_shorter_than_items(spark):
    rng = random.Random(12)
    words = [f"c{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 20, 38, 60])))) for k in range(40)] + [(60, "z z z z z z z z z z")]
    items += [(61, items[30][1] + " and one more")]
    rows = [(1, ""), (2, None), (3, "z " * 9), (4, "z " * 6)]
    for k, passage in items:
        held = passage.split()
        for cut in range(1, min(len(held), 14)):
            rows += [(1000 * (k + 1) + 2 * cut, " ".join(held[cut:]).upper()), (1000 * (k + 1) + 2 * cut + 1, " ".join(held[:-cut]))]
    out = decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.row.doc_id, m.item_id): m.similarity for r in out for m in r.matches}
    short = shorter_by_hand(rows, items)
    assert len(short) > 100 and got == pytest.approx(contaminated_by_hand(rows, items) | short)
    assert {(m.start_word, m.n_words) for r in out for m in r.matches if r.row.doc_id == 3} == {(0, 9)}


def random_index(n, seed):
    rng = np.random.default_rng(seed)
    return ItemIndex(30, list(range(n)), [rng.integers(0, 1 << 62, 30).astype(np.uint64) for _ in range(n)], 0.8)


@pytest.mark.parametrize("read", [1 << 17, 0])
def test_hamming_blocks_find_all_within_radius(monkeypatch, read):
    monkeypatch.setattr(decontaminate_module, "READ", read)
    rng, index = np.random.default_rng(2), random_index(20, 2)
    for item in range(20):
        for flips in (0, 7, 14, 20):
            bits = np.unpackbits(index.marks[item].view(np.uint8))
            bits[rng.permutation(64)[:flips]] ^= 1
            w, i = index.near(np.packbits(bits).view(np.uint32)[None, :])
            assert item in i.tolist()
    assert RADIUS == 20 and len(window_marks(shingled(np.arange(30, dtype=np.uint64), 5), 26)) == 1


def test_hamming_blocks_leave_random_fingerprints(monkeypatch):
    index, marks = random_index(400, 3), np.random.default_rng(4).integers(0, 1 << 32, (100, 2)).astype(np.uint32)
    pairs = lambda: {(a, b) for a, b in zip(*(x.tolist() for x in index.candidates(marks)), strict=True)}
    read = pairs()
    assert 0 < len(read) < 0.05 * 100 * 400
    monkeypatch.setattr(decontaminate_module, "CELLS", 1000)
    assert pairs() == read
    monkeypatch.setattr(decontaminate_module, "READ", 0)
    assert pairs() == read


def test_simhash_recall_near_the_threshold():
    """Of windows whose similarity to an item is 0.8 to 0.85, what the index finds."""
    rng = np.random.default_rng(5)
    tried = found = 0
    for n in (25, 40, 80, 200):
        items = [rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(20)]
        index = ItemIndex(n, list(range(20)), items, 0.8)
        for item, words in enumerate(items):
            for _ in range(60):
                near = words.copy()
                for at in rng.integers(0, n, rng.integers(1, max(2, n // 30) + 1)):
                    near[at] = rng.integers(0, 1 << 62)
                if 0.8 <= weighted_similarity(shingled(near, 5), index.sets[item]) <= 0.85:
                    tried += 1
                    found += item in index.near(window_marks(shingled(near, 5), index.width))[1].tolist()
    assert tried > 200 and found / tried >= 0.99


def test_digest_columns(spark, tmp_path):
    from lexicarta.llm.registry import op1_line_dedup

    docs_of(spark, [(1, "a\nb"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.kept_sha256) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, hashlib.sha256(b"a\nb").hexdigest()), 2: (1, hashlib.sha256(b"").hexdigest())}


def test_pages_of_one_template_are_told_apart_quickly():
    """20,000 sets of 100 shingles, 70 of them the template's, of which no two link: slots hold one of 20 values."""
    import time

    rng = np.random.default_rng(2)
    sets = [np.concatenate([np.arange(30) * 1000 + rng.integers(0, 20, 30), 10**6 + np.arange(70)]) for _ in range(20_000)]
    began = time.time()
    assert list(PrefixTree(sets, np.full(20_000, 100), 80).links()) == [] and time.time() - began < 60


def test_links_span_components_whatever_is_shared():
    rng = random.Random(4)
    for _ in range(120):
        percent, pool = rng.choice([50, 60, 80, 85]), rng.choice([12, 30, 60])
        base = [rng.sample(range(pool), rng.randint(1, min(pool, 25))) for _ in range(6)]
        sets = [np.array(sorted({*rng.choice(base), *rng.sample(range(pool), rng.randrange(0, 4))}), np.int64) for _ in range(rng.randint(1, 40))]
        sizes = np.array([len(s) + rng.choice([0, 0, 1]) for s in sets])
        both = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist()))
        want = {(j, i) for i in range(len(sets)) for j in range(i) if 100 * both(i, j) >= percent * (sizes[i] + sizes[j] - both(i, j))}
        side = np.array([rng.randrange(2) for _ in sets])
        found = lambda *how: [tuple(sorted((i, j))) for i, j, _ in PrefixTree(sets, sizes, percent).links(*how)]
        assert sorted(found(None, True)) == sorted(want) and sorted(found(side, True)) == sorted((a, b) for a, b in want if side[a] != side[b])
        root = list(range(len(sets)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in want:
            root[max(top(a), top(b))] = min(top(a), top(b))
        names, spans = [top(x) for x in range(len(sets))], found()
        assert set(spans) <= want and len(spans) == len(sets) - len(set(names))


def test_decontamination_in_several_passes(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(40)]
    benchmark = spark.createDataFrame([*items, (3, items[3][1]), (None, "x y z"), (50, None)], "item_id long, text string")
    texts = [" ".join([*rng.choices(words, k=20), items[rng.randrange(40)][1], *rng.choices(words, k=5), items[rng.randrange(40)][1]]) for _ in range(30)]
    rows = [*enumerate(texts), (None, texts[0]), (5, texts[6]), (5, texts[5]), (90, None), (91, "")]
    run = lambda: sorted(((r.row.doc_id, r.row.text, [tuple(m) for m in r.matches]) for r in decontaminate(docs_of(spark, rows), benchmark).collect()), key=str)
    once = run()
    monkeypatch.setattr(decontaminate_module, "PASS_WORDS", 300)
    assert run() == once and len(once) == len(rows) and sum(len(m) >= 2 for _, _, m in once) > 20
    assert all([i for i, *_ in m] == sorted(i for i, *_ in m) for _, _, m in once)
    plans = decontaminate(docs_of(spark, rows), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plans  # each pass is a table of its own
