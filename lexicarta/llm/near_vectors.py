"""Near copies among vectors of one label: a forest of random-projection trees.

1. Vectors that are equal are one class; all that follows works on classes.
2. Each label of more than 2 * LEAF classes gets TREES trees. A node splits at the median of a random projection, and both
   children get what lies near it (the spill), so that near pairs seldom part. A round grows LEVELS levels below each
   open node: their thresholds are fitted on a sample of SAMPLE classes a node, then every class walks down. A node stays
   whole where each projection tried would spill too much, and a label of up to 2 * LEAF classes is one leaf, so exact.
3. Each leaf compares all its pairs in blocks. A pair that shares several leaves counts in the first of them, which the
   codes of the leaves show that each class carries: so pairs are counted, not written. What leaves a task is a number of
   links for each class and links that span the leaf's components.
4. Stars give the components.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import components, forget, sent, small_batches, written

TREES, LEVELS = 8, 5
#: Classes of a leaf aimed at; nodes of more than twice as many are split (one that can't be is compared in blocks of LEAF).
LEAF = 1024
#: Classes a node on which its thresholds are fitted.
SAMPLE = 2048
#: On each side of a threshold, the spill: this part of the deviation of a projected pair that is just near enough.
SPILL = 0.25
#: A split that spills more of its node is not made; so many directions are tried.
MOST_SPILT, TRIED = 0.3, 3
#: Bytes of thresholds that are sent to all tasks at once; more take more passes. Also of small tables that are broadcast.
MOST_SENT = 32 << 20
#: Bits of a leaf's code below those of its tree.
NODE_BITS = 54
MODEL = "label long, tree int, node long, many long, alts binary, thresholds binary"


def units(column, width: int) -> np.ndarray:
    """Vectors as rows of length 1, in double precision, those shorter than width filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def directions(tree: int, level: int, width: int) -> np.ndarray:
    """The directions that the nodes of a tree's level may split along, one a row."""
    made = np.random.default_rng([11, tree, level]).standard_normal((TRIED, width))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def spill_of(least: float, width: int) -> float:
    return SPILL * np.sqrt(max(0.0, 2 - 2 * least) / max(1, width))


def depth_of(node: int) -> int:
    return node.bit_length() - 1


def fitted(x: np.ndarray, tree: int, node: int, levels: int, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each split of the levels below a node, as a heap, the direction and the threshold; not a number where it isn't made."""
    alts, thresholds = np.zeros(1 << levels, np.uint8), np.full(1 << levels, np.nan)
    held = {1: np.arange(len(x))}
    for h in range(1, 1 << levels):
        own = held.pop(h, None)
        if own is None or len(own) < 8:
            continue
        along = x[own] @ directions(tree, depth_of(node) + depth_of(h), x.shape[1]).T
        middle = np.median(along, axis=0)
        spilt = (np.abs(along - middle) <= spill).mean(axis=0)
        a = int(spilt.argmin())
        if spilt[a] <= MOST_SPILT:
            alts[h], thresholds[h] = a, middle[a]
            held[2 * h], held[2 * h + 1] = own[along[:, a] <= middle[a] + spill], own[along[:, a] >= middle[a] - spill]
    return alts, thresholds


def walked(x: np.ndarray, tree: int, node: int, levels: int, alts, thresholds, spill: float):
    """(row, node, open) of the nodes where rows end below a node: open ones may be split further."""
    rows, heap = np.arange(len(x)), np.ones(len(x), np.int64)
    ended: list = []
    for level in range(levels):
        along = x @ directions(tree, depth_of(node) + level, x.shape[1]).T
        limit = thresholds[heap]
        whole = np.isnan(limit)
        ended.append((rows[whole], heap[whole], False))
        rows, heap, limit = rows[~whole], heap[~whole], limit[~whole]
        p = along[rows, alts[heap]]
        left, right = p <= limit + spill, p >= limit - spill
        rows, heap = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * heap[left], 2 * heap[right] + 1])
    ended.append((rows, heap, True))
    below = lambda h: (node << np.floor(np.log2(h)).astype(np.int64)) + h - (1 << np.floor(np.log2(h)).astype(np.int64))
    return [(r, below(h), is_open) for r, h, is_open in ended if len(r)]


def coded(tree, node):
    return (np.int64(tree) << NODE_BITS) + node


def open_nodes(rows: DataFrame, leaf: int) -> DataFrame:
    """(label, tree, node, many, code) of the open nodes with more than twice leaf classes, as a written table."""
    at = rows.select("label", F.explode("open").alias("code")).groupBy("label", "code").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 2 * leaf)
    node = F.col("code").bitwiseAND((1 << NODE_BITS) - 1)
    return written(at.select("label", F.shiftright("code", NODE_BITS).cast("int").alias("tree"), node.alias("node"), "many", "code"), "open")


def grown(rows: DataFrame, nodes: DataFrame, width: int, spill: float, leaf: int) -> DataFrame:
    """The model of each of the nodes, fitted on about SAMPLE of its classes, as a written table."""
    import pandas as pd

    entries = rows.select("class_id", "label", "v", F.explode("open").alias("code"))
    share = F.pmod(F.xxhash64(F.lit(5), "class_id", "code"), F.lit(1 << 20)) * F.col("many") < F.lit(SAMPLE << 20)
    drawn = entries.join(sent(nodes, F.lit(64), MOST_SENT), ["label", "code"]).where(share)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        tree, node, many = (int(sample[c].iloc[0]) for c in ("tree", "node", "many"))
        levels = min(LEVELS, max(1, int(np.ceil(np.log2(many / leaf)))))
        alts, thresholds = fitted(units(sample.v.tolist(), width), tree, node, levels, spill)
        return pd.DataFrame({"label": sample.label.iloc[:1], "tree": [tree], "node": [node], "many": [many], "alts": [alts.tobytes()], "thresholds": [thresholds.tobytes()]})

    return written(drawn.groupBy("label", "tree", "node").applyInPandas(fit, MODEL), "models")


def descended(rows: DataFrame, models: DataFrame, passes: int, width: int, spill: float) -> DataFrame:
    """The rows, walked from their open nodes to those below. Nodes without a model become leaves. Models are sent a part of the hash space a pass."""
    import pyarrow as pa

    spark, schema = rows.sparkSession, rows.schema
    for k in range(passes):
        part = models.where(F.pmod(F.xxhash64("label", "tree", "node"), F.lit(passes)) == k)
        found = {(r.label, int(coded(r.tree, r.node))): (np.frombuffer(r.alts, np.uint8), np.frombuffer(r.thresholds)) for r in part.toLocalIterator()}
        shared, last = spark.sparkContext.broadcast(found), k == passes - 1

        def walk(batches, shared=shared, last=last):
            models = shared.value
            for batch in batches:
                labels, opened, closed = (batch.column(c).to_pylist() for c in ("label", "open", "closed"))
                asked: dict = {}
                for i, (label, codes) in enumerate(zip(labels, opened, strict=True)):
                    for code in codes:
                        asked.setdefault((label, code), []).append(i)
                x = units(batch.column("v").to_pylist(), width) if asked else None
                fresh: list = [[] for _ in labels]
                for (label, code), own in asked.items():
                    if (label, code) not in models:
                        continue
                    alts, thresholds = models[label, code]
                    tree, node, own = code >> NODE_BITS, code & ((1 << NODE_BITS) - 1), np.array(own)
                    for i in own.tolist():
                        opened[i].remove(code)
                    for at, nodes, is_open in walked(x[own], tree, node, depth_of(len(alts)), alts, thresholds, spill):
                        for i, c in zip(own[at].tolist(), coded(tree, nodes).tolist(), strict=True):
                            (fresh if is_open else closed)[i].append(c)
                for i, codes in enumerate(opened):
                    # nodes just made are negative until all passes are over, lest a later one looks for them
                    codes.extend(-c for c in fresh[i])
                    if last:  # what found no model in any pass holds few classes
                        closed[i].extend(c for c in codes if c > 0)
                        opened[i] = [-c for c in codes if c < 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "label", "size", "v")), *(pa.array(c, pa.list_(pa.int64())) for c in (opened, closed))], batch.schema.names)

        moved, before = written(rows.mapInArrow(walk, schema), "walked"), rows
        forget(before)
        rows = moved
    return rows


def earlier(codes: np.ndarray, i: np.ndarray, j: np.ndarray, code: int) -> np.ndarray:
    """Whether rows i and j share a code below code; codes are rows, filled up with -1."""
    out = np.zeros(len(i), bool)
    low = np.where(codes < code, codes, -1)
    low = -np.sort(-low, axis=1)[:, : max(1, int((low >= 0).sum(axis=1).max(initial=0)))]
    for at in range(0, len(i), 4096):
        a, b = low[i[at : at + 4096]], low[j[at : at + 4096]]
        out[at : at + 4096] = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by the links i, j."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def pairs_near(x: np.ndarray, raw: list, y: np.ndarray, raw_y: list, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose cosine is least or more; near that bound it is computed from the components as they are."""
    s = x @ y.T
    i, j = np.nonzero(s >= least - 1e-9)
    for k in np.flatnonzero(np.abs(s[i, j] - least) <= 1e-9).tolist():
        a, b = (np.ldexp(r, -int(np.frexp(np.abs(r).max())[1])) for r in (np.asarray(raw[i[k]]), np.asarray(raw_y[j[k]])))
        n = min(len(a), len(b))
        s[i[k], j[k]] = float(a[:n] @ b[:n]) / np.sqrt(float(a @ a) * float(b @ b))
    kept = s[i, j] >= least
    return i[kept], j[kept]


def leaf_links(rows: DataFrame, width: int, least: float, leaf: int) -> DataFrame:
    """(a, b, n): n links of class a in pairs that count here (counts), or that a reaches b (not counts), from each leaf's blocks."""
    import pandas as pd

    at = rows.select("class_id", "label", "size", "v", F.col("closed").alias("codes"), F.explode("closed").alias("code"))
    many = written(rows.select("label", F.explode("closed").alias("code")).groupBy("label", "code").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 2 * leaf), "many")
    blocks = F.coalesce(F.ceil(F.col("many") / leaf), F.lit(1)).cast("int")
    dealt = at.join(sent(many, F.lit(48), MOST_SENT), ["label", "code"], "left").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64(F.lit(7), "class_id"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class_id", "label", "size", "v", "codes", "code", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("class_id")
        code, two = int(t.code.iloc[0]), t.i.iloc[0] != t.j.iloc[0]
        raw, ids, size = t.v.tolist(), t.class_id.to_numpy(), t["size"].to_numpy()
        x, codes = units(raw, width), np.full((len(t), max(map(len, t.codes))), -1, np.int64)
        for k, c in enumerate(t.codes):
            codes[k, : len(c)] = c
        first, second = (np.flatnonzero((t.side == t.i).to_numpy()), np.flatnonzero((t.side == t.j).to_numpy())) if two else (np.arange(len(t)),) * 2
        links, found = np.zeros(len(t), np.int64), []
        for k in range(0, len(first), leaf):
            rows = first[k : k + leaf]
            i, j = pairs_near(x[rows], [raw[r] for r in rows], x[second], [raw[r] for r in second], least)
            i, j = rows[i], second[j]
            if not two:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
            new = ~earlier(codes, i, j, code)
            for a, b in ((i[new], j[new]), (j[new], i[new])):
                links += np.bincount(a, size[b], len(t)).astype(np.int64)
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        root, counted = spanning(len(t), i, j), np.flatnonzero(links)
        tied = np.flatnonzero(root != np.arange(len(t)))
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[counted], ids[tied]]),
                "b": np.concatenate([ids[counted], ids[root[tied]]]),
                "n": np.concatenate([links[counted], np.zeros(len(tied), np.int64)]),
                "counts": np.arange(len(counted) + len(tied)) < len(counted),
            }
        )

    return met.groupBy("label", "code", "i", "j").applyInPandas(compare, "a long, b long, n long, counts boolean")


def near_vectors(vectors: DataFrame, least: float = 0.93, leaf: int = LEAF) -> DataFrame:
    """(row, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and the cosine of their components, in double precision, is least or
    more; vectors of different lengths meet as if filled up with zeros. n_links counts the other vectors that a vector links
    with directly, component_id is the smallest vec_id reachable, itself included, kept whether that is its own. In labels of up to
    2 * leaf different vectors all links are found, beyond that nearly all (the forest); none below least is. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing, nor do those of a null label. Rows that repeat a vec_id are
    one vector: that of the smallest label and vector among those that can link. A row without vec_id has no links and a null
    component, and is kept. An empty table gives an empty one. row is the input row as a struct.
    """
    small_batches(vectors.sparkSession)
    x = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    whole = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(x, lambda x: x != 0)
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    known = written(usable.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), x.alias("v"))).alias("k")).select("vec_id", "k.*"), "vectors")
    marks = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(3), "label", "v").alias("h2")]
    classes = written(known.groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("size")).select("class_id", "label", "size", "v", *marks), "classes")
    width = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    spill = spill_of(least, width)

    big = written(classes.groupBy("label").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 2 * leaf).select("label", F.lit(TREES).alias("trees")), "labels")
    root = lambda trees: F.transform(F.sequence(F.lit(0), trees - 1), lambda t: F.shiftleft(t.cast("long"), NODE_BITS) + 1)
    empty = F.array().cast("array<long>")
    started = classes.join(sent(big, F.lit(48), MOST_SENT), "label", "left")
    rows = written(
        started.select("class_id", "label", "size", "v", F.when(F.col("trees").isNull(), empty).otherwise(root(F.col("trees"))).alias("open"), F.when(F.col("trees").isNull(), root(F.lit(1))).otherwise(empty).alias("closed")), "rooted"
    )
    while (n := (nodes := open_nodes(rows, leaf)).count()) > 0:
        models = grown(rows, nodes, width, spill, leaf)
        rows = descended(rows, models, max(1, -(-n * (200 + 9 * (1 << LEVELS)) // MOST_SENT)), width, spill)
        forget(nodes, models)
    rows = rows.withColumn("closed", F.concat("closed", "open"))  # what is open still holds few classes
    links = written(leaf_links(rows, width, least, leaf), "links")
    counts = links.where("counts").groupBy("a").agg(F.sum("n").alias("n"))
    reached = components(links.where("not counts").select("a", "b"))
    per_class = classes.select("class_id", "size", "h1", "h2").join(counts.withColumnRenamed("a", "class_id"), "class_id", "left").join(reached.withColumnRenamed("node", "class_id"), "class_id", "left")
    per_class = per_class.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    per_vector = known.select("vec_id", *marks).join(per_class, ["h1", "h2"]).select(F.col("vec_id").alias("its_id"), "n_links", "component_id")
    out = vectors.select(F.struct("*").alias("row")).join(per_vector, F.col("row.vec_id") == F.col("its_id"), "left")
    component = F.coalesce("component_id", F.col("row.vec_id").cast("long"))
    return out.select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("row.vec_id"), F.lit(True)).alias("kept"))
