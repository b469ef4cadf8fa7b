"""Near copies of vectors, periodic runs and the manifest against plain Python, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lexicarta.llm import merkle
from lexicarta.llm.near_vectors import near_vectors
from lexicarta.llm.periodic_runs import analysed, bands, looped, periodic_runs, strongest, words_of

# --- near copies of vectors


def links_by_hand(rows, least):
    """(links, component) of each id; rows (vec_id, embedding, label), ids once."""
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (label, v)
    ids = sorted(usable)
    root, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    width = max((len(v) for _, v in usable.values()), default=1)
    full = {i: np.pad(np.array(v, float), (0, width - len(v))) for i, (_, v) in usable.items()}
    unit = {i: x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) for i, x in full.items()}
    for k, a in enumerate(ids):
        for c in ids[k + 1 :]:
            if usable[a][0] == usable[c][0] and float(unit[a] @ unit[c]) >= least:
                n[a], n[c] = n[a] + 1, n[c] + 1
                x, y = find(a), find(c)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in ids}


def clustered(rng, n, width=16):
    """Vectors of which a third lie together, a third are copies of each other or near them, and the rest anywhere."""
    centre, out = rng.standard_normal(width), []
    for i in range(n):
        if i % 3 == 0:
            v = centre + rng.standard_normal(width) * 0.12
        elif i % 3 == 1 and i > 30:
            v = np.array(out[rng.integers(0, len(out))]) + rng.standard_normal(width) * rng.choice([0.0, 0.1, 0.25])
        else:
            v = rng.standard_normal(width)
        out.append(v.tolist())
    return out


SCHEMA = "vec_id long, embedding array<double>, label int, size int, code long, v string"


def vectors_of(spark, rows):
    """Rows with columns that clash with the operator's own names."""
    return spark.createDataFrame([(i, v, k, 1, 2, "x") for i, v, k in rows], SCHEMA)


def test_forest_finds_the_links(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, int(i % 10 == 0)) for i, v in enumerate(clustered(rng, 900))]
    want = links_by_hand(rows, 0.9)
    out = near_vectors(vectors_of(spark, rows), least=0.9, leaf=64).collect()
    got = {r.row.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == 900 and sum(n for n, _ in want.values()) > 10_000
    assert all(n <= want[i][0] for i, (n, _, _) in got.items())
    assert sum(n for n, _, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97
    assert all(kept == (c == i) for i, (_, c, kept) in got.items())


def test_small_labels_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v, i % 4) for i, v in enumerate(clustered(rng, 400, 8))]
    got = {r.row.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors_of(spark, rows), least=0.93).collect()}
    assert got == links_by_hand(rows, 0.93)


def test_vectors_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 5), (2, [1e300, 0.0], 5), (3, [-0.0, 1.0], 5), (4, [0.0, 2.0], 5), (5, [1.0, 0.0], None), (6, None, 5), (7, [], 5), (8, [0.0, -0.0], 5),
        (9, [nan, 1.0], 5), (10, [None, 1.0], 5), (11, [inf, 1.0], 5), (12, [3.0], 5), (13, [1.0, 0.0], 6), (None, [1.0, 0.0], 5), (14, [1e-300, 1e-301], 5), (15, [1.0, 0.1], 5),
    ]
    out = near_vectors(vectors_of(spark, [*rows, (1, [1.0, 0.0], 5), (4, [9.0, 9.0], 9)])).collect()
    got = {r.row.vec_id: (r.n_links, r.component_id) for r in out}
    want = links_by_hand(rows, 0.93)
    assert len(out) == 18 and got[None] == (0, None)
    assert {i: x for i, x in got.items() if i is not None} == {i: want.get(i, (0, i)) for i in range(1, 16)}
    assert want[1] == (4, 1) and want[14][1] == 1 and want[3] == (1, 3)
    assert near_vectors(vectors_of(spark, [])).count() == 0
    assert near_vectors(vectors_of(spark, [(1, None, None)])).select("n_links", "component_id", "kept").first() == (0, 1, True)


def test_a_hot_copy_and_a_node_that_cannot_be_split(spark):
    rng = np.random.default_rng(2)
    tight = [(np.array([1.0, 1.0, 0.0, 0.0]) + rng.standard_normal(4) * 1e-4).tolist() for _ in range(200)]
    rows = [(i, v, 1) for i, v in enumerate(tight + [[0.0, 0.0, 1.0, 0.5]] * 300)]
    got = {r.row.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors_of(spark, rows), leaf=16).collect()}
    assert got == {i: (199, 0) if i < 200 else (299, 200) for i in range(500)}


# --- periodic runs


def runs_by_hand(w, shortest=6, repeats=4):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(shortest, repeats * q) and not any(all(w[x] == w[x + d] for x in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out)


def with_loops(rng):
    w = [b"w%d" % rng.randrange(rng.choice([1, 2, 2, 3, 30])) for _ in range(rng.randint(0, 120))]
    if w and rng.random() < 0.7:
        p, s = rng.randint(1, max(1, len(w) // 5)), rng.randrange(len(w))
        for i in range(s + p, min(len(w), s + p * rng.randint(3, 8))):
            w[i] = w[i - p]
    return w


def test_runs_by_hand():
    rng, seen = random.Random(1), 0
    for _ in range(700):
        lists = [with_loops(rng) for _ in range(rng.randint(1, 4))]
        shortest, repeats = rng.choice([(6, 4), (6, 4), (3, 3), (20, 3), (10, 5)])
        want = [runs_by_hand(w, shortest, repeats) for w in lists]
        assert analysed(lists, shortest, repeats) == want
        seen += sum(map(len, want))
    assert seen > 500


def test_bands_hold_every_period_once():
    for n in (5, 6, 100, 5000):
        own = list(bands(n, 6, 4))
        assert [q for low, high, _ in own for q in range(low, high + 1)][: n // 4] == list(range(1, n // 4 + 1)) if n >= 6 else own == []
        assert all(k >= high and all(max(6, 4 * q) - q >= k for q in range(low, high + 1)) for low, high, k in own)


def test_strongest_compares_exactly():
    assert strongest([(0, 9, 2), (3, 90, 20), (50, 8, 2)]) == (0, 9, 2)
    assert strongest([(0, 10**9, 3 * 10**8), (5, 10**9 + 1, 3 * 10**8)]) == (5, 10**9 + 1, 3 * 10**8)
    assert strongest([]) is None


def test_looped_words():
    for i in range(300):
        h = zlib.crc32(str(i).encode())
        w = [b"%d" % k for k in range(i % 37)]
        if h % 10 or not w:
            assert looped(i, w) == w
        else:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert looped(i, w) == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    assert looped(None, [b"a"]) == [b"a"] and looped(3, []) == []


def test_runs_of_documents(spark):
    rng = random.Random(6)
    texts = [b" ".join(with_loops(rng)).decode() for _ in range(120)] + [None, "", " \n\t", "a b " * 9, "É x\x0b" * 8]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 7), (3, "c " * 6), (3, "c " * 6)]
    df = spark.createDataFrame([(i, t, "r", 1, "k") for i, t in rows], "doc_id long, text string, runs string, best int, row string")
    out = periodic_runs(df).collect()
    assert len(out) == len(rows)
    for r in out:
        words = words_of(r.row.text)
        want = runs_by_hand(words)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert [tuple(x) for x in r.runs] == want and (r.best and tuple(r.best)) == strongest(want)
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, repeats=2)


def test_runs_of_very_long_texts(spark):
    one, block = "a " * 400_000, " ".join(str(k) for k in range(1000)) + " "
    df = spark.createDataFrame([(1, one), (2, block * 300), (3, " ".join(random.Random(1).choices("ab", k=200_000)))], "doc_id long, text string")
    got = {r.row.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "a"
    assert [tuple(x) for x in got[2].runs] == [(0, 300_000, 1000)] and got[2].collapsed == block.strip()
    assert len(got[3].runs) > 1000


# --- manifest


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([merkle.digest("".join(rows[-1][i : i + 8])) for i in range(0, len(rows[-1]), 8)])
    return rows


def path(rows, i):
    for level in rows[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def manifest_by_hand(rows):
    """rows (key, group, leaf, shown), in the order of their places within a group."""
    groups = sorted({g for _, g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in rows if r[1] == g]) for g in groups}
    top, out = tree([trees[g][-1][0] for g in groups]), []
    for k, g in enumerate(groups):
        for i, (key, _, leaf, shown) in enumerate(r for r in rows if r[1] == g):
            steps, up = [*path(trees[g], i), *path(top, k)], shown
            for left, right in steps:
                up = merkle.digest("".join([*left, up, *right]))
            siblings = [x for left, right in steps for x in left + right]
            out.append((key, g, leaf, trees[g][-1][0], top[-1][0], len(siblings), merkle.digest("".join(siblings)), up, up == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1, 64, 65], [4097, 3, 511, 600], [2] * 20])
def test_manifest_by_hand(spark, sizes):
    rows = []
    for g, n in enumerate(sizes):
        for i in range(n):
            leaf = merkle.digest(f"{g} {i}")
            rows.append((i * 3 - 50, None if g == 1 else f"é{g}", leaf, merkle.digest("other") if i % 5 == 2 else leaf))
    shuffled = random.Random(3).sample(rows, len(rows))
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in shuffled], "id long, grp string, leaf string, shown string, tree string, pos int, n int")
    got = [tuple(r) for r in merkle.manifest(df, "grp", "id", "leaf", "shown").collect()]
    assert sorted(got, key=str) == sorted(manifest_by_hand(rows), key=str)


def test_manifest_of_odd_keys(spark):
    rows = [(None, "a", "1" * 64, "1" * 64), (2**60 + 1, "a", "3" * 64, "3" * 64), (2**60 + 1, "a", "4" * 64, "4" * 64), (5, None, "2" * 64, "2" * 64), (5, "", "2" * 64, "2" * 64), (5, "", "2" * 64, "2" * 64)]
    df = spark.createDataFrame(rows[::-1], "key long, lang string, leaf string, shown string")
    got = [tuple(r) for r in merkle.manifest(df, "lang", "key", "leaf", "shown").collect()]
    assert sorted(got, key=str) == sorted(manifest_by_hand(rows), key=str) and all(r[-1] for r in got)
    assert merkle.manifest(df.limit(0), "lang", "key", "leaf").count() == 0


def test_leaves_of_nulls(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", None)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_of("a", "b", "c")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("1:1-2:é", "-0:-")]
