"""N-gram Jaccard join: which documents share nearly all their shingles, by prefix trees.

1. Each text becomes its set of shingle hashes. Texts of one set are one class.
2. A set that links shares all but few of its shingles with some other set. Shingles in a fixed part of the hash space are
   counted over all documents; classes with more shingles of their own than a link leaves are out. All shingles of
   those that are left are then counted among them likewise.
3. Shingles get one global order, by how many of the sets left hold them, and sets keep those that others hold too.
   Their prefixes (the rarest shingles, one of which each linked pair has in common) go to groups: that of the
   smallest document with that shingle in its prefix. Large groups are cut into blocks, and pairs of blocks meet.
4. In a task, sets in the global order (most frequent shingle first) form a prefix tree. Each set walks it to the sets that share
   enough of their rarest shingles with it, with overlaps shared along common paths; a subtree is left when the shingles
   that remain can't reach the overlap asked for, and so are sets that are already in the set's component.
5. The links found span each component; stars give the components.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import components, forget, map_rows, shingled, word_hashes, written

#: Of the hash space, the part whose shingles are counted over all documents. More than 1 - similarity is needed.
COUNTED = 1.35
#: Shingles in a block of a large group: the bound on a task's sets.
BLOCK = 2_000_000
#: Bits of a shingle's hash below those of its frequency, in a number whose order is the global one.
HASH_BITS = 57
#: Of their rarest shingles, so many more than could differ are looked up, and as many must be shared.
SHARED = 8
#: Rows below a node that are compared at once.
FEW = 256
#: Ids that are broadcast at most (8 bytes each); more of them meet the texts in a sorted join.
MOST_SENT = 1_000_000


def allowance(n, percent: int):
    """How many of n shingles a linked set may have for itself."""
    return n * (100 - percent) // 100


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingled(word_hashes(text), size))


def digests(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, n, h1, h2, low): size and digest of each set, and its shingles in the counted part of the hash space."""
    top = int((1 << 63) * min(1.0, COUNTED * (100 - percent) / 100))

    def both(texts):
        import xxhash

        sets = [shingle_set(t, size) for t in texts]
        marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        return [len(s) for s in sets], marks[:, 0], marks[:, 1], [s[: np.searchsorted(s, top)] for s in sets]

    return map_rows(docs, both, "n int, h1 long, h2 long, low array<long>")


class PrefixTree:
    """Sets as rows of places in the global order, the most frequent first; a node is a span of rows that share their first places.

    sets hold the numbers of shingles in the global order (rarest lowest), sizes how many shingles each set has in all.
    Sets that share too few of their shingles with the others to link with any are left out.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.percent = percent
        every = np.concatenate(sets) if sets else np.empty(0, np.int64)
        ends = np.cumsum([len(s) for s in sets])
        names, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        del every
        shared = counts[inverse] > 1  # what only one set holds adds to its size alone
        place = (len(names) - 1 - inverse).astype(np.int32)
        del inverse
        rows = [np.sort(r[k]) for r, k in zip(np.split(place, ends[:-1]), np.split(shared, ends[:-1]), strict=True)]
        del place, shared
        kept = [i for i, r in enumerate(rows) if 100 * len(r) >= percent * sizes[i]]
        self.at = sorted(kept, key=lambda i: rows[i].astype(">u4").tobytes())  # place in the tree to set
        self.rows = [rows[i] for i in self.at]
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.sizes = np.asarray(sizes, np.int64)[self.at]
        self.width = len(names)
        self.common = np.array([self.prefix(a, b) for a, b in zip(self.rows, self.rows[1:], strict=False)], np.int64)
        self.nodes: dict = {}
        # the rarest places of each row (its last ones), of which linked rows have some in common
        spare = self.sizes * (100 - percent) // 100 - (self.sizes - self.lengths)
        self.least_shared = np.minimum(SHARED, self.lengths - spare)
        long = np.minimum(spare + self.least_shared, self.lengths)
        row, place = np.repeat(np.arange(len(self.rows)), long), np.concatenate([r[len(r) - k :] for r, k in zip(self.rows, long, strict=True)] or [np.empty(0, np.int32)])
        order = np.lexsort((row, place))
        self.rare, self.holders = np.split(place, np.cumsum(long)[:-1]) if len(long) else [], row[order]
        self.held_from = np.searchsorted(place[order], np.arange(self.width + 1))

    @staticmethod
    def prefix(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(differ.argmax()) if differ.any() else n

    def node(self, lo: int, hi: int):
        """Where the path that rows lo to hi share ends, and the spans below with their least sizes and longest rows."""
        if (lo, hi) not in self.nodes:
            if hi - lo == 1:
                self.nodes[lo, hi] = int(self.lengths[lo]), None
            else:
                common = self.common[lo : hi - 1]
                end = int(common.min())
                starts = np.concatenate([[lo], np.flatnonzero(common == end) + lo + 1])
                least, longest = np.minimum.reduceat(self.sizes[lo:hi], starts - lo), np.maximum.reduceat(self.lengths[lo:hi], starts - lo)
                self.nodes[lo, hi] = end, (starts, np.append(starts[1:], hi), least, longest)
        return self.nodes[lo, hi]

    def needed(self, n, m):
        """The smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def links(self, apart: np.ndarray | None = None, every: bool = False):
        """(i, j, intersection) of linked sets, i walking and j found; without every, links that span each component.

        apart: the block of each set; only sets of different blocks meet.
        """
        n = len(self.rows)
        root, members = np.arange(n), {i: np.array([i]) for i in range(n)}
        block = None if apart is None else np.asarray(apart)[self.at]
        seen, alike = np.zeros(self.width + 1, bool), {}

        def join(i: int, j: int) -> None:
            """The smaller component takes the name of the larger."""
            small, large = sorted((int(root[i]), int(root[j])), key=lambda c: len(members[c]))
            root[members[small]] = large
            members[large] = np.concatenate([members[large], members.pop(small)])

        for i in range(n - 1):
            row, size = self.rows[i], int(self.sizes[i])
            lists = []
            for place in self.rare[i].tolist():
                if place in alike and root[alike[place]] == root[i]:
                    continue
                own = self.holders[self.held_from[place] : self.held_from[place + 1]]
                own = own[np.searchsorted(own, i, "right") :]
                if not every and len(own):
                    apart_from = own[root[own] != root[i]]
                    if not len(apart_from):
                        alike[place] = i  # from here on all holders are in one component, and stay so
                    own = apart_from
                lists.append(own)
            others = np.concatenate(lists) if lists else np.empty(0, np.int64)
            if block is not None:
                others = others[block[others] != block[i]]
            if not len(others):
                continue
            held = np.bincount(others)
            likely = np.flatnonzero(held)
            likely = likely[held[likely] >= np.minimum(self.least_shared[likely], self.least_shared[i])]
            if not len(likely):
                continue
            seen[row] = True
            stack = [(0, n, 0, 0, likely)]
            while stack:
                lo, hi, depth, overlap, own = stack.pop()
                if not every:
                    own = own[root[own] != root[i]]
                if len(own) <= FEW:
                    for j, both in self.overlaps(own, depth, overlap, seen):
                        if both >= self.needed(size, int(self.sizes[j])) and (every or root[i] != root[j]):
                            yield self.at[i], self.at[j], both
                            if not every:
                                join(i, j)
                    continue
                end, below = self.node(lo, hi)
                overlap += int(np.count_nonzero(seen[self.rows[lo][depth:end]]))
                # what remains of either can't exceed this; spans that don't reach the overlap asked for are left
                ahead = len(row) - int(np.searchsorted(row, self.rows[lo][end - 1], "right")) if end else len(row)
                starts, stops, least, longest = below
                worth = overlap + np.minimum(ahead, longest - end) >= self.needed(size, least)
                child = np.searchsorted(starts, own, "right") - 1
                for k in np.unique(child[worth[child]]).tolist():
                    stack.append((int(starts[k]), int(stops[k]), end, overlap, own[child == k]))
            seen[row] = False

    def overlaps(self, own: np.ndarray, depth: int, overlap: int, seen: np.ndarray):
        """(row, overlap) of rows below a node: what they share up to it, and what each has from there on."""
        if len(own):
            tails = [self.rows[j][depth:] for j in own.tolist()]
            counts = np.concatenate([[0], np.cumsum(seen[np.concatenate(tails)])])
            ends = np.cumsum([len(t) for t in tails])
            found = counts[ends] - counts[ends - np.array([len(t) for t in tails])] + overlap
            yield from zip(own.tolist(), found.tolist(), strict=True)


def links_of(groups: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b, n_a, n_b, both) of linked documents among the rows (leader, i, j, side, doc_id, n, shingles) of each (leader, i, j)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["a", "b", "n_a", "n_b", "both"]

    def solve(t: pa.Table) -> pa.Table:
        ids, sizes = t["doc_id"].to_numpy(), t["n"].to_numpy()
        lists = t["shingles"].combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        apart = None if t["i"][0].as_py() == t["j"][0].as_py() else t["side"].to_numpy()
        found = list(PrefixTree(sets, sizes, percent).links(apart, every))
        i, j, both = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(names, (ids[i], ids[j], sizes[i].astype(np.int64), sizes[j].astype(np.int64), both), strict=True)))

    return groups.groupBy("leader", "i", "j").applyInArrow(solve, "a long, b long, n_a long, n_b long, both long")


def own_shingles(counted: DataFrame, key: str) -> DataFrame:
    """(key, own): how many of the shingles (key, shingle) of each key no other key has. Copies under one key count once."""
    alone = counted.groupBy("shingle").agg(F.min(key).alias(key), F.max(key).alias("other")).where(f"{key} = other")
    return alone.groupBy(key).agg(F.count(F.lit(1)).alias("own"))


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows with one of the ids (key), which are broadcast while they are few."""
    ids = written(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, key, "left_semi")


def in_global_order(sets: DataFrame, percent: int) -> DataFrame:
    """Sets (set_id, doc_id, n, shingles) with their shared shingles as numbers in the global order, and the prefix of those.

    A shingle's number has the half-octave of how many sets hold it above the bits of its hash. Shingles of one set alone
    are left out; sets with more of them than a link leaves are as well.
    """
    rows = sets.select("set_id", F.explode("shingles").alias("shingle"))
    held = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    number = F.shiftleft(F.least(F.floor(2 * F.log2("held")), F.lit(63)).cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned("shingle", 63 - HASH_BITS))
    ordered = rows.join(held, "shingle").groupBy("set_id").agg(F.sort_array(F.collect_list(number)).alias("shingles"))
    joined = sets.select("set_id", "doc_id", "n").join(ordered, "set_id")
    spare = F.expr(f"n * {100 - percent} div 100") - (F.col("n") - F.size("shingles"))
    out = written(joined.withColumn("spare", spare.cast("int")).where("spare >= 0").select("doc_id", "n", "shingles", F.slice("shingles", 1, F.col("spare") + 1).alias("prefix")), "ordered")
    forget(held)
    return out


def candidate_groups(sets: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(leader, i, j, side, doc_id, n, shingles), and the tables that it reads: each linked pair of sets meets in a group, blocks of which hold so many shingles."""
    prefix = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("prefix").alias("shingle"))
    leaders = written(prefix.groupBy("shingle").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("held")).where("held > 1").select("shingle", "leader"), "leaders")
    members = written(prefix.join(leaders, "shingle").select("leader", "doc_id", "n").distinct(), "members")
    # a group is left out whose members all meet in the group of one smaller leader
    first = members.groupBy("doc_id").agg(F.min("leader").alias("first"))
    blocks = (
        members.join(first, "doc_id")
        .groupBy("leader")
        .agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size"), F.min("first").alias("low"), F.max("first").alias("high"))
        .where("size > 1 and (high = leader or low < high)")
    )
    blocks = written(blocks.select("leader", "blocks"), "blocks")
    placed = members.join(blocks, "leader").withColumn("side", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    met = placed.select("leader", "doc_id", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = met.select("leader", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id")
    return groups.join(sets.select("doc_id", "n", "shingles"), "doc_id"), [leaders, members, blocks]


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, every: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs (doc_id, text).

    members has a row for each row of docs: doc_id, n (size of the set of shingles of size words; of fewer words, one
    shingle; none without words), class_id (the smallest doc_id with the same set, null if the set is empty).
    links has (a, b, n_a, n_b, both) between class ids with 100 * intersection >= percent * union: links that span each
    component, or with every all of them, each once. Empty sets and null doc_ids link with nothing; rows that repeat
    a doc_id are one document.
    """
    docs = docs.select("doc_id", "text")
    marked = digests(docs, size, percent).select("row.doc_id", "n", "h1", "h2", "low")
    marked = written(marked, "sets")
    classes = written(marked.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n")), "classes")
    members = marked.join(classes.select("h1", "h2", "class_id"), ["h1", "h2"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    )
    counted = marked.where("doc_id is not null").select("h1", F.explode("low").alias("shingle"))
    likely = classes.join(own_shingles(counted, "h1"), "h1", "left").where(f"coalesce(own, 0) <= n * {100 - percent} div 100")
    texts = among(docs, likely.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id")

    def both(texts):
        sets = [shingle_set(t, size) for t in texts]
        return [len(s) for s in sets], sets

    sets = map_rows(texts, both, "n int, shingles array<long>").where("n > 0").select("row.doc_id", "n", "shingles")
    sets = written(sets.withColumn("set_id", F.xxhash64("shingles")), "likely")
    # the same again with all shingles of those that are left: most of them are near copies now
    counted = sets.select("set_id", F.explode("shingles").alias("shingle"))
    nearly = sets.select("set_id", "n").join(own_shingles(counted, "set_id"), "set_id", "left").where(f"coalesce(own, 0) <= n * {100 - percent} div 100")
    ordered = in_global_order(among(sets, nearly.select("set_id").distinct(), "set_id"), percent)
    groups, read = candidate_groups(ordered, block)
    found = links_of(groups, percent, every)
    if every:
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, n_a, n_b)").alias("n_a"), F.expr("if(a < b, n_b, n_a)").alias("n_b"), "both").distinct()
    links = written(found.where("a <> b"), "links")
    forget(sets, ordered, *read)
    return members, links


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n, class_id, component_id) of each row of docs: component_id is the smallest doc_id reachable by links."""
    members, links = jaccard_join(docs, size, percent)
    reached = components(links.select("a", "b")).withColumnRenamed("node", "class_id")
    out = members.join(reached, "class_id", "left")
    return out.select("doc_id", "n", "class_id", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
