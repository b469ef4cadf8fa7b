"""Merkle manifest of a dataset: leaves, subtrees a group, one root, and for each row a proof that folds up to the root.

1. Rows become digests, and digests get their places: range-partitioned by (group, id), numbered in each partition,
   moved by the sizes of the partitions before. No window holds a group.
2. A superblock is SPAN = ARITY ** LEVELS consecutive nodes of a tree. It reduces to one node by itself; those nodes are the
   leaves of a tree SPAN times smaller, and so on. The roots of the groups are one more tree, in the order of the groups.
3. Downwards, nodes and the outer nodes that their superblock's proofs need (one row a superblock: the siblings of each level
   above) are cogrouped by superblock. A task reduces its superblock once more, joins the inner part of each proof with the
   outer one, and folds.
"""

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.llm.shared import forget, sent, written

ARITY, LEVELS = 8, 4
SPAN = ARITY**LEVELS
#: Bytes of a small table (sizes of partitions, places of groups) that are broadcast at most.
MOST_SENT = 32 << 20
STEPS = "array<struct<at:int,siblings:array<string>>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def field(value) -> Column:
    """A value as part of a leaf: `-` if null, else its bytes' number, a colon, and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values) -> Column:
    """The lowercase hex sha256 of the values' fields, one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def levels_above(n: int) -> int:
    """How many levels lie above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock and of each level above, so many levels."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def inner_path(rows: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """(place in its run, the others of the run) of node i's ancestors up to the superblock's top."""
    path = []
    for below in rows[:-1]:
        run = below[i - i % ARITY : i - i % ARITY + ARITY]
        path.append((i % ARITY, run[: i % ARITY] + run[i % ARITY + 1 :]))
        i //= ARITY
    return path


def folded(leaf: str, path) -> str:
    """The root that a leaf and its siblings make."""
    for at, siblings in path:
        leaf = digest("".join([*siblings[:at], leaf, *siblings[at:]]))
    return leaf


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, a written table, with their place `pos` in the order within their group and the group's size `n`.

    Null groups are one group; ids that are null come first, and of rows that repeat one those with the smaller digest.
    Also the table that must stay until the result is read.
    """
    at = F.monotonically_increasing_id()
    dealt = written(rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order).withColumn("at", at), "placed")
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(F.col(group), part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select(F.col(group).alias("its"), F.col("part").alias("its_part"), (before - F.col("low")).alias("shift"), F.sum("held").over(Window.partitionBy(group)).alias("n")), "sizes")
    met = dealt.join(sent(sizes, F.lit(64) + F.coalesce(F.octet_length(F.col("its").cast("string")), F.lit(0)), MOST_SENT), F.col(group).eqNullSafe(F.col("its")) & (part == F.col("its_part")))
    return met.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n"), dealt


def tops(nodes: DataFrame) -> DataFrame:
    """The superblocks of trees (tree, n, pos, node) as nodes themselves."""
    import pandas as pd

    def one(block: pd.DataFrame) -> pd.DataFrame:
        n = int(block.n.iloc[0])
        rows = reduced(block.sort_values("pos").node.tolist(), min(LEVELS, levels_above(n)))
        return pd.DataFrame({"tree": [block.tree.iloc[0]], "n": [-(-n // SPAN)], "pos": [int(block.pos.iloc[0]) // SPAN], "node": rows[-1]})

    return nodes.groupBy("tree", F.expr(f"pos div {SPAN}")).applyInPandas(one, "tree long, n long, pos long, node string")


def climbed(nodes: DataFrame) -> DataFrame:
    """(tree, pos, path, top) of the nodes (tree, n, pos, node) of trees, a written table: the steps up to each tree's top."""
    import pandas as pd

    if nodes.where("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.array().cast(STEPS).alias("path"), F.col("node").alias("top"))
    above = climbed(written(tops(nodes), "tops"))

    def join(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        rows = reduced(block.node.tolist(), min(LEVELS, levels_above(int(block.n.iloc[0]))))
        higher = [(s["at"], list(s["siblings"])) for s in outer.path.iloc[0]]
        paths = [[{"at": a, "siblings": s} for a, s in inner_path(rows, i) + higher] for i in range(len(block))]
        return pd.DataFrame({"tree": block.tree, "pos": block.pos, "path": paths, "top": outer.top.iloc[0]})

    return by_superblock(nodes).cogroup(by_superblock(above, 1)).applyInPandas(join, f"tree long, pos long, path {STEPS}, top string")


def by_superblock(rows: DataFrame, span: int = SPAN):
    return rows.groupBy("tree", F.expr(f"pos div {span}"))


def manifest(rows: DataFrame, group: str, key: str, leaf: str, shown: str | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, n_siblings, proof, folded_root, verified) of each row.

    In each group leaves ascend by key; while several nodes remain, each ARITY consecutive ones become their digest (the last
    run may be shorter, one node as well). What remains is the group's subroot (of one leaf, that leaf); the subroots, in the
    order of the groups, bytewise and null first, make the root likewise. proof is the digest of a row's siblings, level by level, left to
    right; folded_root is what the row's leaf as shown (its own leaf without shown) and those siblings make, and verified says
    whether that is the root. A null key comes first in its group; rows that repeat a key stand in the order of their leaves; a null group is a
    group; an empty table gives an empty one.
    """
    import pandas as pd

    kinds = dict(rows.dtypes)
    leaves = written(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("node"), F.col(shown or leaf).alias("shown")), "leaves")
    in_order, dealt = placed(leaves, "grp", [F.col("key").asc_nulls_first(), "node", "shown"])
    groups, dealt_groups = placed(written(leaves.select("grp", F.lit(0).alias("all")).distinct(), "groups"), "all", [F.col("grp").asc_nulls_first()])
    groups = written(groups.select(F.col("grp").alias("its_grp"), F.col("pos").alias("tree"), F.col("n").alias("n_groups")), "trees")
    numbered = in_order.join(sent(groups, F.lit(64) + F.coalesce(F.octet_length(F.col("its_grp").cast("string")), F.lit(0)), MOST_SENT), F.col("grp").eqNullSafe(F.col("its_grp")))
    # as text, since pandas has no integers beside nulls
    nodes = written(numbered.select("tree", "n", "pos", F.col("grp").cast("string").alias("grp"), F.col("key").cast("string").alias("key"), "node", "shown"), "nodes")
    forget(leaves, dealt, dealt_groups)
    inner = written(climbed(written(tops(nodes), "tops")), "inner")
    subroots = inner.where("pos = 0").join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("n_groups").alias("n"), F.col("tree").alias("pos"), F.col("top").alias("node"))
    last = written(climbed(written(subroots, "subroots")), "last").select(F.col("pos").alias("tree"), F.col("path").alias("last"), F.col("top").alias("root"))
    outer = inner.join(sent(last, F.lit(2000), MOST_SENT), "tree").select("tree", "pos", F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "root")

    def finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        above = reduced(block.node.tolist(), min(LEVELS, levels_above(int(block.n.iloc[0]))))
        higher = [(s["at"], list(s["siblings"])) for s in outer.path.iloc[0]]
        root = outer.root.iloc[0]
        proof, many, up = [], [], []
        for i, start in enumerate(block.shown):
            path = inner_path(above, i) + higher
            siblings = [x for _, s in path for x in s]
            proof.append(digest("".join(siblings)))
            many.append(len(siblings))
            up.append(folded(start, path))
        return pd.DataFrame(
            {"key": block.key, "grp": block.grp, "leaf": block.node, "subroot": outer.subroot.iloc[0], "root": root, "n_siblings": many, "proof": proof, "folded_root": up, "verified": [x == root for x in up]}
        )

    schema = "key string, grp string, leaf string, subroot string, root string, n_siblings int, proof string, folded_root string, verified boolean"
    done = by_superblock(nodes).cogroup(by_superblock(outer, 1)).applyInPandas(finish, schema)
    return done.select(F.col("key").cast(kinds[key]).alias(key), F.col("grp").cast(kinds[group]).alias(group), "leaf", "subroot", "root", "n_siblings", "proof", "folded_root", "verified")
