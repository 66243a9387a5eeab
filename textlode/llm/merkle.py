"""Merkle manifest of a table, with a witness for every row.

Leaves are appended in order to a tree per group, and the groups' roots to a tree of their own. An append keeps the complete
subtrees that are still open; every leaf holds a partial witness, the siblings on its way up to the top of its open subtree. When two
subtrees of one size stand side by side, each becomes the sibling of the other and extends the witnesses of its leaves.
Tasks append aligned blocks of BLOCK leaves; the roots of the blocks are appended in the same way, in blocks of their own,
until one node per group is left. Witnesses of block roots then extend those of the leaves, from the top down. No task sees more than a block.

A witness is an array of strings, one per level from the leaf up: L or R, for the side on which the sibling stands, and the sibling; empty where
a node has none and is hashed alone. Nodes are lowercase hex SHA-256.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import staged
from textlode.operators.scale import numbered, running_sums

BLOCK = 512


def leaf_of(*fields: Column) -> Column:
    """Hash of a row: each field as `-` if null, else its length in UTF-8 bytes, a colon and its text."""

    def part(value):
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""

    def up(node, step):
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        both = F.when(side == "L", F.concat(sibling, node)).when(side == "R", F.concat(node, sibling)).otherwise(node)
        return F.sha2(both, 256)

    return F.aggregate(witness, leaf, up)


def siblings(witness: Column) -> Column:
    """The siblings of a witness one after the other, from the leaf up."""
    return F.array_join(F.transform(witness, lambda x: F.substring(x, 2, 64)), "")


class Appender:
    """A tree that grows by appended leaves. Witnesses are those of the leaves appended so far, each up to its open subtree's top."""

    def __init__(self):
        self.witnesses: list[list[str]] = []
        #: Complete subtrees from the left: (height, first leaf, root).
        self.open: list[tuple[int, int, str]] = []

    def _join(self) -> None:
        height, begin, right = self.open.pop()
        _, first, left = self.open.pop()
        for witness in self.witnesses[first:begin]:
            witness.append("R" + right)
        for witness in self.witnesses[begin:]:
            witness.append("L" + left)
        self.open.append((height + 1, first, sha256((left + right).encode()).hexdigest()))

    def _join_equal(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def append(self, leaf: str) -> None:
        self.open.append((0, len(self.witnesses), leaf))
        self.witnesses.append([])
        self._join_equal()

    def close(self, height: int = 0) -> str:
        """Hash the last node of each level alone where it has no sibling, up to one root of at least this height."""
        while len(self.open) > 1 or self.open[0][0] < height:
            at, first, root = self.open.pop()
            for witness in self.witnesses[first:]:
                witness.append("")
            self.open.append((at + 1, first, sha256(root.encode()).hexdigest()))
            self._join_equal()
        return self.open[0][2]


def _appended(nodes: list[str], block: int, size: int) -> tuple[str, list[list[str]]]:
    """Root and witnesses of one block; blocks behind the first are as high as a full one, as they have siblings."""
    tree = Appender()
    for node in nodes:
        tree.append(node)
    return tree.close(size.bit_length() - 1 if block else 0), tree.witnesses


def _roots(nodes: DataFrame, size: int) -> DataFrame:
    """(grp, pos, node): the roots of the blocks of nodes (grp, pos, node); pos is the block's number."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        block = int(group["block"].iloc[0])
        root, _ = _appended(group["node"].tolist(), block, size)
        return pd.DataFrame({"grp": group["grp"].iloc[:1], "pos": [block], "node": [root]})

    return _in_blocks(nodes.select("grp", "pos", "node"), size).groupBy("grp", "block").applyInPandas(run, "grp string, pos bigint, node string")


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))


def _levels(nodes: DataFrame, size: int) -> list[DataFrame]:
    """Nodes (grp, pos, node, ...), the roots of their blocks, the roots of blocks of these, and so on up to one node per group."""
    levels = [nodes]
    while True:
        levels.append(staged(_roots(levels[-1], size), "roots"))
        if not levels[-1].agg(F.max("pos")).first()[0]:
            return levels


def _extended(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """Nodes with the columns witness, subroot and root: their witness in their block, extended by that of the block's root in `above`."""
    carried = [c for c in above.columns if c not in ("grp", "pos", "node", "witness")]
    out = nodes.schema
    for c in ("witness", *carried):
        out = out.add(above.schema[c])
    names = out.names

    def run(group: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=names)
        group = group.sort_values("pos").reset_index(drop=True)
        _, own = _appended(group["node"].tolist(), int(group["block"].iloc[0]), size)
        behind = list(root["witness"].iloc[0])
        group["witness"] = [x + behind for x in own]
        for c in carried:
            group[c] = root[c].iloc[0]
        return group[names]

    above = above.withColumnRenamed("pos", "block").select("grp", "block", "witness", *carried)
    return _in_blocks(nodes, size).groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInPandas(run, out)


def prove(rows: DataFrame, group_col: str, key_col: str, leaf_col: str = "leaf", size: int = BLOCK) -> DataFrame:
    """All columns of `rows`, and witness, subroot and root.

    The leaves of a group stand in order of the key (nulls first), equal keys in order of the leaf; repeated rows are leaves of
    their own. A subroot is a group's root, the lone leaf itself if it has one. The groups' subroots, the null group first, then by the bytes of the
    name, are the leaves of the last tree, whose root is the root. A witness leads from the leaf through the subroot to the
    root. `size`, a power of two, is the number of leaves a task holds at once. Columns witness, subroot and root are replaced; grp,
    pos, node and block must not be among the columns. An empty table gives an empty table.
    """
    rows = rows.drop("witness", "subroot", "root")
    # Names stay in order behind a mark that comes after that of null.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    rows = rows.withColumns({"grp": grp, "node": F.col(leaf_col), "_one": F.lit(1).cast("bigint")})
    nodes = running_sums(rows, ["grp"], [F.col(key_col).asc_nulls_first(), F.col(leaf_col)], {"pos": "_one"}).drop("_one")
    nodes = staged(nodes.withColumn("pos", F.col("pos").cast("bigint")), "leaves")
    levels = _levels(nodes, size)
    tops = numbered(levels[-1].select(F.col("grp").alias("name"), "node"), [F.col("name")], "pos")
    tops = _levels(tops.select("name", F.lit("").alias("grp"), F.col("pos").cast("bigint").alias("pos"), "node"), size)
    above = tops[-1].select("grp", "pos", F.array().cast("array<string>").alias("witness"), F.col("node").alias("root"))
    for level in reversed(tops[:-1]):
        above = staged(_extended(level, above, size), "witnesses")
    above = above.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "witness", F.col("node").alias("subroot"), "root")
    for level in reversed(levels[1:-1]):
        above = staged(_extended(level, above, size), "witnesses")
    return _extended(levels[0], above, size).drop("grp", "pos", "node")
