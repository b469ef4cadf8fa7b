"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots, as many as the square root of the rows up to a bound, come from the rows and cut queries and data into cells.
Each query's k-th best score among the pivots is a floor for its answer, and so is what k rows of the cells nearby score
at least; summaries of the cells (sizes, radii, the least floor) bound what a row can score for any query of a cell. Cells of queries that lie together form groups; a row goes
only to the groups with a cell that it may serve, where queries meet rows in blocks. A block keeps k rows for each
query, and a last grouping by query keeps the best of those.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.llm.shared import forget, written

#: Pivots at most (more rows make larger cells), queries in a group, rows in a block.
MOST_PIVOTS, GROUP, BLOCK = 1024, 1024, 16384


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double.

    Rows take no part whose id is null or whose vector is null or holds a null or a non-finite component. Of rows
    that repeat an id the one with the smallest vector counts. Products are summed in 64 bits: scaled components of up to 2**28
    fit for 64 of them; beyond that sums wrap, so such vectors are to be scaled down first.
    """
    x = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return rows.groupBy("vec_id").agg(F.min(F.transform(x, lambda x: F.floor(x * scale))).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, those shorter than width filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: in doubles while they hold every sum, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot next to each row and the distance to it."""
    x = x.astype(np.float64)
    square = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    cell = square.argmin(1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, level[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def floors(x: np.ndarray, ids: np.ndarray, pivots: np.ndarray, pivot_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best score among the pivots (rows themselves) but its own; -inf where there are too few."""
    if len(pivots) <= k:
        return np.full(len(x), -np.inf)
    scores = np.where(ids[:, None] == pivot_ids[None, :], -np.inf, x @ pivots.T)
    return np.partition(scores, len(pivots) - k, axis=1)[:, len(pivots) - k]


def raised(pivots: np.ndarray, cells: dict, queries: dict, k: int) -> dict:
    """The summaries of the query cells, their floors raised to what the summaries of the data cells promise.

    A row within R of p, for a query within S of c, scores at least c.p - S |p| - |c| R - S R; each cell promises that
    for all its rows. One of k + 1 rows may be the query itself.
    """
    out, norm, dots = {}, np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    for g, (m, radius, floor) in queries.items():
        held = 0
        for low, n in sorted(((dots[g, j] - radius * norm[j] - (norm[g] + radius) * reach, n) for j, (n, reach, _) in cells.items()), reverse=True):
            held += n
            if held > k:
                floor = max(floor, low)
                break
        out[g] = (m, radius, floor)
    return out


def may_serve(pivots: np.ndarray, cells: dict, queries: dict) -> np.ndarray:
    """[data cell, query cell]: whether any row of the one may reach the floor of the other, by the summaries alone.

    A row within R of p, for a query within S of c, scores at most c.p + S |p| + |c| R + S R.
    """
    out = np.zeros((len(pivots), len(pivots)), bool)
    norm, dots = np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    for g, (_, radius, floor) in queries.items():
        for j, (_, reach, _) in cells.items():
            most = dots[g, j] + radius * norm[j] + norm[g] * reach + radius * reach
            out[j, g] = most >= floor - 1e-6 * (1 + abs(most))
    return out


def grouped(pivots: np.ndarray, queries: dict) -> dict[int, int]:
    """The group of each cell of queries: cells go to the nearest of so many of their pivots, one for each GROUP queries."""
    cells = sorted(queries)
    n = max(1, -(-sum(m for m, *_ in queries.values()) // GROUP))
    heads = pivots[cells[:: max(1, len(cells) // n)][:n]] if cells else pivots[:1]
    return dict(zip(cells, nearest(pivots[cells], heads)[0].tolist(), strict=True)) if cells else {}


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each query.

    Queries are the ids divisible by every; candidates all other rows. Ties go to the smaller id; where there are
    fewer candidates than k, all come. Vectors of different lengths meet as if filled up with zeros. An empty table, or
    one without queries, gives no rows.
    """
    return solved(*served_rows(vectors, k, every, scale), k)


def served_rows(vectors: DataFrame, k: int, every: int, scale: int = 256) -> tuple[DataFrame, DataFrame, int]:
    """(asking, served, width): queries and rows by (cell, part, block), cell being the group of queries."""
    data = written(quantized(vectors, scale), "vectors")
    n, width = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_pivots = min(MOST_PIVOTS, max(1, int(np.ceil(np.sqrt(n)))))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()  # at most MOST_PIVOTS rows
    pivots = matrix([r.v for r in sample], width).astype(np.float64) if sample else np.zeros((1, width))
    pivot_ids = np.array([r.vec_id for r in sample] or [0], np.int64)
    sent = data.sparkSession.sparkContext.broadcast((pivots, pivot_ids))

    def assign(batches):
        import pyarrow as pa

        pivots, pivot_ids = sent.value
        for batch in batches:
            x, ids = matrix(batch.column("v").to_pylist(), width), batch.column("vec_id").to_numpy()
            cell, radius = nearest(x, pivots)
            asks, floor = np.flatnonzero(ids % every == 0), np.full(len(ids), np.inf)
            floor[asks] = floors(x[asks].astype(np.float64), ids[asks], pivots, pivot_ids, k)
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "v": [r.tobytes() for r in x], "cell": pa.array(cell, pa.int32()), "radius": radius, "norm": norm, "floor": floor}
            )

    placed = written(data.mapInArrow(assign, "vec_id long, v binary, cell int, radius double, norm double, floor double"), "cells")
    forget(data)
    summary = lambda rows: {r.cell: (r.n, r.radius, r.floor) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.min("floor").alias("floor")).collect()}
    asked = placed.where(F.col("vec_id") % every == 0)
    cells = summary(placed)  # a row for each pivot, as of the queries
    queries = raised(pivots, cells, summary(asked), k)
    allowed, group = may_serve(pivots, cells, queries), grouped(pivots, queries)
    sizes: dict[int, int] = {}
    for g, (m, *_) in queries.items():
        sizes[group[g]] = sizes.get(group[g], 0) + m
    blocks = max(1, -(-n // BLOCK))

    def serve(batches):
        """Each row, once for each group with a cell of queries where it may be among the best."""
        import pyarrow as pa

        pivots = sent.value[0]
        asked_cells = np.array(sorted(queries), np.int64)
        centre, radius, floor = pivots[asked_cells], *(np.array([queries[g][i] for g in asked_cells.tolist()]) for i in (1, 2))
        groups = np.array([group[g] for g in asked_cells.tolist()], np.int64)
        for batch in batches:
            if not len(asked_cells):
                break
            raw, norm = batch.column("v").to_pylist(), batch.column("norm").to_numpy()
            x = np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), width).astype(np.float64)
            most = x @ centre.T + norm[:, None] * radius
            may = (most >= floor - 1e-6 * (1 + np.abs(most))) & allowed[batch.column("cell").to_numpy()][:, asked_cells]
            row, cell = np.nonzero(may)
            row, to = np.unique(np.stack([row, groups[cell]]), axis=1)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(to, pa.int32()), "vec_id": batch.column("vec_id").take(pa.array(row)), "v": batch.column("v").take(pa.array(row))})

    in_map = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.lit(None).cast("map<int,int>")
    n_parts = in_map({g: -(-m // GROUP) for g, m in sizes.items()})[F.col("cell")]
    served = placed.select("vec_id", "v", "norm", "cell").mapInArrow(serve, "cell int, vec_id long, v binary")
    served = served.select("cell", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    asking = asked.select(in_map(group)[F.col("cell")].alias("cell"), "vec_id", "v")
    asking = asking.select("cell", F.pmod(F.xxhash64(F.lit(3), "vec_id"), n_parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    return asking, served, width


def solved(asking: DataFrame, served: DataFrame, width: int, k: int) -> DataFrame:
    """The best rows of each query, from the blocks where they meet."""

    def solve(q, x):
        import pyarrow as pa

        rows = lambda t: np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(t.num_rows, width)
        x = x.sort_by("vec_id")
        ids, asked_ids = x["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        out: list = [[], [], []]
        if len(ids) and len(asked_ids):
            scores = products(rows(q), rows(x))
            for i, one in enumerate(asked_ids):
                others = ids != one
                own = scores[i][others]
                places = best(own, ids[others], k)
                for column, values in zip(out, ([one] * len(places), ids[others][places], own[places]), strict=True):
                    column.extend(values)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    keys = ["cell", "part", "block"]
    local = asking.groupBy(*keys).cogroup(served.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
