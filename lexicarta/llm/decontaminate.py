"""Benchmark decontamination: which documents hold a passage that is nearly a benchmark item.

Windows of each item's length in words slide over each document. Those whose shingles could reach the similarity
asked for (they hold enough shingles of any item; a window without can't) get a SimHash. Fingerprints are cut into
blocks: two that differ in RADIUS bits at most differ in NEAR_BITS at most in some block, which one random pair in 29
does, and then in half of that at most in one half of the block. Sorted tables of the items' halves, asked for all
values that near, give every item within the radius. The exact similarity of the shingles, weighted by how often each
occurs, decides. A document of fewer words than an item is one window, and meets by the exact similarity alone every
such item that it shares enough shingles with.
"""

import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import map_rows, shingled, word_hashes, worker_object, written

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits are two blocks of 32, which may differ in so many bits each; RADIUS is what that guarantees.
#: At the least similarity two fingerprints differ in 9.7 bits, by a deviation of 2.9.
NEAR_BITS = (10, 9)
RADIUS = sum(NEAR_BITS) + len(NEAR_BITS) - 1
#: Words of benchmark text in a pass over the documents: the bound on what a pass sends to the tasks.
PASS_WORDS = 2_000_000
#: Windows that get fingerprints at once.
STEP = 512
MATCHES = "array<struct<item_id:long,similarity:double,start_word:long,n_words:long>>"
#: All 16-bit values with half of NEAR_BITS set at most.
NEAR = np.array([sum(1 << b for b in bits) for n in range(max(NEAR_BITS) // 2 + 1) for bits in combinations(range(16), n)], np.uint16)
#: Items up to which blocks are read through, which is quicker than asking tables for all of NEAR; cells compared at once.
READ, CELLS = 1 << 17, 1 << 21


def enough(n: float, similarity: float) -> int:
    """Shingles that two windows must have in common which hold n shingles each, or on average."""
    return int(np.ceil(2 * n * similarity / (1 + similarity) - 1e-9))


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle, from its hash mixed once more."""
    h = shingles.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.unpackbits((h ^ (h >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def window_marks(shingles: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each run of width shingles, as its two blocks."""
    sums = np.cumsum(np.concatenate([np.zeros((1, 64), np.int32), signs(shingles)]), axis=0)
    return np.packbits(sums[width:] > sums[:-width], axis=1, bitorder="little").view(np.uint32)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts of each shingle over the sum of the larger."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(names)), np.bincount(at[len(a) :], minlength=len(names))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class ItemIndex:
    """Items of one length in words: their shingles, fingerprints and blocks."""

    def __init__(self, words: int, ids: list[int], hashes: list[np.ndarray], similarity: float):
        self.words, self.ids, self.size = words, ids, min(SHINGLE, words)
        self.sets = np.stack([shingled(h, SHINGLE) for h in hashes])
        self.width = words - self.size + 1
        self.need = enough(self.width, similarity)
        self.marks = np.concatenate([window_marks(s, self.width) for s in self.sets])
        halves = self.marks.view(np.uint16)
        self.order = np.argsort(halves, axis=0, kind="stable")
        self.sorted = np.take_along_axis(halves, self.order, axis=0)

    def candidates(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) with a block in which they differ in NEAR_BITS at most."""
        n = len(self.ids)
        if n <= READ:
            step, pairs = max(1, CELLS // n), []
            for at in range(0, len(marks), step):
                w, i = np.nonzero((np.bitwise_count(marks[at : at + step, None] ^ self.marks[None]) <= NEAR_BITS).any(axis=2))
                pairs.append((w + at) * n + i)
            return np.divmod(np.concatenate(pairs), n)
        pairs = []
        for half in range(self.sorted.shape[1]):
            block, table = half // 2, self.sorted[:, half]
            asked = marks.view(np.uint16)[:, half, None] ^ NEAR
            low, high = np.searchsorted(table, asked, "left"), np.searchsorted(table, asked, "right")
            window, probe = np.nonzero(high > low)
            first, held = low[window, probe], (high - low)[window, probe]
            item = self.order[np.repeat(first - (np.cumsum(held) - held), held) + np.arange(held.sum()), half]
            window = np.repeat(window, held)
            near = np.bitwise_count(marks[window, block] ^ self.marks[item, block]) <= NEAR_BITS[block]
            pairs.append(window[near] * n + item[near])
        return np.divmod(np.unique(np.concatenate(pairs)), n)

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of fingerprints within the radius."""
        w, i = self.candidates(marks)
        apart = np.bitwise_count(marks[w] ^ self.marks[i]).sum(1)
        return w[apart <= RADIUS], i[apart <= RADIUS]


class Benchmark:
    """The items of a pass, by length."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        by_length: dict[int, list] = {}
        for i, text in items:
            h = word_hashes(text)
            if len(h):
                by_length.setdefault(len(h), []).append((i, h))
        self.similarity = similarity
        self.indexes = [ItemIndex(n, [i for i, _ in v], [h for _, h in v], similarity) for n, v in sorted(by_length.items())]
        self.known = {k: np.unique(np.concatenate([s for x in self.indexes if x.size == k for s in x.sets])) for k in {x.size for x in self.indexes}}

    def matches(self, text: str | None) -> list[dict]:
        words, best = word_hashes(text), {}
        for size, known in self.known.items():
            if len(words) < size:
                continue
            shingles = shingled(words, size)
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hits = known[at] == shingles
            if not hits.any():
                continue
            held = np.concatenate([[0], np.cumsum(hits)])
            for index in self.indexes:
                if index.size == size and len(words) >= index.words:
                    starts = np.flatnonzero(held[index.width :] - held[: -index.width] >= index.need)
                    self.verify(index, shingles, starts, best)
                elif index.size == size:
                    need = enough((len(shingles) + index.width) / 2, self.similarity)
                    if held[-1] >= need:
                        self.verify_whole(index, shingles, need, len(words), best)
        return [{"item_id": i, "similarity": s, "start_word": a, "n_words": n} for i, (s, a, n) in sorted(best.items())]

    def verify(self, index: ItemIndex, shingles: np.ndarray, starts: np.ndarray, best: dict) -> None:
        while len(starts):
            first = int(starts[0])
            now, starts = starts[starts < first + STEP], starts[starts >= first + STEP]
            marks = window_marks(shingles[first : int(now[-1]) + index.width], index.width)[now - first]
            for w, i in zip(*index.near(marks), strict=True):
                at, item = int(now[w]), index.ids[i]
                worth = weighted_similarity(shingles[at : at + index.width], index.sets[i])
                if worth >= self.similarity and worth > best.get(item, (0,))[0]:
                    best[item] = (worth, at, index.words)

    def verify_whole(self, index: ItemIndex, shingles: np.ndarray, need: int, n_words: int, best: dict) -> None:
        """A document shorter than the items of index, as one window, against those with enough of its shingles."""
        own = np.unique(shingles)
        common = own[np.minimum(np.searchsorted(own, index.sets), len(own) - 1)] == index.sets
        for i in np.flatnonzero(common.sum(1) >= need):
            worth, item = weighted_similarity(shingles, index.sets[i]), index.ids[i]
            if worth >= self.similarity and worth > best.get(item, (0,))[0]:
                best[item] = (worth, 0, n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(row, matches) of each row of docs: matches is an array of (item_id, similarity, start_word, n_words), by item_id.

    Of each item the most similar window comes, the first of equals; a text shorter than the item is one window. Words are lower-cased A-Z and cut at ASCII white space.
    Items without an id, text or words match nothing, and neither do null texts; items of fewer words than a shingle
    count as one. Of items that repeat an id each row counts. A benchmark of more than PASS_WORDS words takes more
    than one pass over the documents, each row meeting all items; each pass writes what it finds by the row's key. Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes = -(-total // PASS_WORDS)
    rows = docs.select(F.struct("*").alias("row"))
    if passes > 1:
        rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")
    found: list = []
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()  # about PASS_WORDS words
        sent = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part))

        def match(texts, sent=sent, key=uuid.uuid4().hex):
            index = worker_object(key, lambda: Benchmark(sent.value, similarity))
            return [[index.matches(t) for t in texts]]

        if passes == 1:
            return map_rows(rows.select("row", F.col(f"row.{text}").alias("text")), match, f"matches {MATCHES}").select("row.row", "matches")
        # a table a pass: no task ever holds the indexes of two
        more = map_rows(rows.select("key", F.col(f"row.{text}").alias("text")), match, f"more {MATCHES}")
        found.append(written(more.select("row.key", F.explode("more").alias("m")), "matches"))
    none = F.array().cast(MATCHES)
    if not found:
        return rows.select("row", none.alias("matches"))
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    listed = together.groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    return rows.join(listed, "key", "left").select("row", F.coalesce("matches", none).alias("matches"))
