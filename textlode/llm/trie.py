"""Prefix trie of conversations with totals over its subtrees, by time-forward processing.

A node is a distinct sequence of first turns, named by its depth and a 128-bit running hash. What a node says about its members comes from
one aggregate; what it says about its subtree is passed from children to parents: nodes are sorted in reverse level order, and each
node sends its total to its parent through a priority queue ordered in the same way, so that a node finds all messages at the head of the
queue when its turn comes. The sort is Spark's, which spills; the queue spills sorted runs.

Shards hold whole subtrees. The turns behind a node, summed over its members, bound the nodes below it, so it is known before any pass
which nodes are light, with at most SHARD_TURNS below: a light node whose parent is heavy is a shard root, and its subtree goes to one task together
with others. The totals of shard roots, added up per parent, go to the heavy nodes above. These form chains (of nodes that have the
same longest member), few as each has a heavy subtree; the chains' totals go up in one more time-forward pass, from chain to
chain, and running sums along the chains give each heavy node its own. So neither a first turn that a third of all conversations share
nor a conversation of a third of all turns meets in one task.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import tempfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import staged
from textlode.operators.scale import running_sums

SHARD_TURNS = 1024
#: Messages that a queue holds in memory, and those it reads of a spilled run at a time.
QUEUE_ROOM, RUN_READ = 200_000, 2_000
#: Characters of conversation ids that a task puts into one row before they are hashed.
LIST_CHARS = 1 << 18
HASHES = ("h0", "h1", "h2", "h3")


class SpillingQueue:
    """A priority queue of tuples. Beyond `room` of them the larger half is written, sorted, to an unnamed file of the task."""

    def __init__(self, room: int = QUEUE_ROOM):
        self.room, self.heap, self.runs, self.spilled = room, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            self.heap.sort()
            keep = len(self.heap) // 2
            run = self._run(self.heap[keep:])
            del self.heap[keep:]
            heapq.heappush(self.runs, (next(run), self.spilled, run))
            self.spilled += 1

    @staticmethod
    def _run(items: list[tuple]):
        file = tempfile.TemporaryFile()
        for at in range(0, len(items), RUN_READ):
            pickle.dump(items[at : at + RUN_READ], file)
        parts = -(-len(items) // RUN_READ)
        del items
        file.seek(0)

        def read():
            with file:
                for _ in range(parts):
                    yield from pickle.load(file)

        return read()

    def pop(self, key: tuple) -> list[tuple]:
        """Take out all messages whose first elements are `key`, which no message in the queue is under."""
        out, n = [], len(key)
        while self.heap and self.heap[0][:n] == key:
            out.append(heapq.heappop(self.heap))
        while self.runs and self.runs[0][0][:n] == key:
            item, number, run = self.runs[0]
            out.append(item)
            after = next(run, None)
            if after is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, number, run))
        return out


def time_forward(nodes, queue: SpillingQueue):
    """(row, n_children, n_leaves, saved) of nodes (row, order, parent's order or None, leaves, saved), sorted by order.

    A parent's order comes after that of its children. A node without messages keeps its own leaves; n_children counts messages.
    """
    for row, order, parent, leaves, saved in nodes:
        found = queue.pop(order)
        leaves += sum(m[2] for m in found)
        saved += sum(m[3] for m in found)
        if parent is not None:
            queue.push((*parent, leaves, saved))
        yield row, len(found), leaves, saved


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, bytes): place from 1 in order of the turn number, nulls first, then role and hash of the text.

    digest names role and text, of which null is empty; bytes are those of the text. Rows without conversation id are left out, repeated rows
    are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    placed = running_sums(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], {"place": "_one"})
    return placed.select("conv_id", (F.col("place") + 1).cast("bigint").alias("place"), "digest", "bytes")


def _key(place, *sums):
    """Name of a node from its depth and the running hashes; the root's are 0."""
    return F.unhex(F.md5(F.concat_ws(",", place, *sums)))


def _members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, turns, place, key, parent, bytes): each conversation's way down the trie, place 0 the root's."""
    half = {h: F.xxhash64(F.lit(i), "place", "digest").bitwiseAND(F.lit(2**32 - 1)) for i, h in enumerate(HASHES)}
    turns = turns.select("conv_id", "place", "bytes", *[v.alias(h) for h, v in half.items()])
    before = running_sums(turns, ["conv_id"], [F.col("place")], {f"b{h}": h for h in HASHES})
    key = _key(F.col("place"), *[F.col(h) + F.col(f"b{h}") for h in HASHES])
    parent = _key(F.col("place") - 1, *[F.col(f"b{h}") for h in HASHES])
    rows = before.select("conv_id", "place", key.alias("key"), parent.alias("parent"), "bytes")
    top = _key(F.lit(0), *[F.lit(0)] * len(HASHES))
    nothing = F.lit(None).cast("binary")
    tops = convs.select("conv_id", F.lit(0).cast("bigint").alias("place"), top.alias("key"), nothing.alias("parent"), F.lit(0).cast("bigint").alias("bytes"))
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    rows = rows.unionByName(tops).join(sizes, "conv_id", "left")
    return staged(rows.withColumn("turns", F.coalesce("turns", F.lit(0).cast("bigint"))), "members")


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): hash of the ids, ascending and comma-joined, of the conversations that end at a node.

    Ranges of the sorted ids are joined to long strings first, as one node may be the end of very many conversations; a hash then
    reads a node's strings one after the other.
    """
    ended = members.where("place = turns").select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def lists(batches):
        key, first, parts, size = None, None, [], 0
        for batch in itertools.chain(batches, [None]):
            rows = zip(batch["key"], batch["conv_id"], strict=True) if batch is not None else [(None, 0)]
            done = []
            for k, conv in rows:
                if k != key or size >= LIST_CHARS:
                    if parts:
                        done.append((key, first, ",".join(parts)))
                    key, first, parts, size = k, conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            yield pd.DataFrame(done, columns=["key", "first", "ids"])

    def hashed(batches):
        from hashlib import sha256

        key, state = None, None
        for batch in itertools.chain(batches, [None]):
            done = []
            for k, ids in zip(batch["key"], batch["ids"], strict=True) if batch is not None else [(None, "")]:
                if k == key:
                    state.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])

    joined = ended.mapInPandas(lists, "key binary, first bigint, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "key binary, ends_sha256 string")


def _light_totals(light: DataFrame, room: int) -> DataFrame:
    """Totals of the nodes in light subtrees (shard, place, key, parent, below, n_convs, bytes): n_children, n_leaves, saved_tokens."""

    def run(batches):
        def rows(batch):
            for row in batch.itertuples(index=False):
                up = None if row.key == row.shard else (1 - row.place, row.parent)
                # A node has turns below it or is a leaf.
                yield row, (-row.place, row.key), up, int(row.below == 0), (row.n_convs - 1) * row.bytes

        queue = SpillingQueue(room)
        for batch in batches:
            done = time_forward(rows(batch), queue)
            out = [(r.key, r.parent, r.place, r.conv_id, r.n_convs, n, leaves, saved, r.key == r.shard) for r, n, leaves, saved in done]
            yield pd.DataFrame(out, columns=names)

    names = ["key", "parent", "place", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"]
    sorted_ = light.repartition("shard").sortWithinPartitions(F.desc("place"), "key")
    kinds = "key binary, parent binary, place bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, top boolean"
    return sorted_.mapInPandas(run, kinds)


def _chain_totals(chains: DataFrame, room: int) -> DataFrame:
    """(parent, n_leaves, saved_tokens): what each chain, with all chains below it, sends to the node it hangs on.

    chains: (chain, place, parent, up, up_place, n_leaves, saved_tokens), place that of its first node, up the chain it hangs on. They pass
    one task, in one more time-forward sweep.
    """

    def run(batches):
        def rows(batch):
            for row in batch.itertuples(index=False):
                up = None if row.parent is None else (-row.up_place, row.up)
                yield row, (-row.place, row.chain), up, row.n_leaves, row.saved_tokens

        queue = SpillingQueue(room)
        for batch in batches:
            done = time_forward(rows(batch), queue)
            out = [(r.parent, leaves, saved) for r, _, leaves, saved in done if r.parent is not None]
            yield pd.DataFrame(out, columns=["parent", "n_leaves", "saved_tokens"])

    one = chains.repartition(1).sortWithinPartitions(F.desc("place"), "chain")
    return one.mapInPandas(run, "parent binary, n_leaves bigint, saved_tokens bigint")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS, room: int = QUEUE_ROOM) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, place, digest, bytes), the places of a conversation 1, 2, 3 and so on; convs: (conv_id), distinct, with all ids of `turns`.
    The root (depth 0) is the node of all conversations, also of those without turns. conv_id: smallest member; parent_conv_id: that of the parent, null
    for the root; saved_tokens: summed over the subtree, bytes of a node's last turn times members beyond the first; ends_sha256: of the
    conversations that end here. Empty tables give an empty table. `shard_turns` bounds the subtrees that are not divided, `room` the messages in memory.
    """
    members = _members(turns, convs)
    nodes = members.groupBy("key").agg(
        F.first("place").alias("place"),
        F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("turns") - F.col("place")).alias("below"),
        # The longest member names the chain.
        (-F.max(F.struct("turns", (-F.col("conv_id")).alias("c")))["c"]).alias("chain"),
    )
    nodes = staged(nodes, "nodes")
    is_heavy = (F.col("below") > shard_turns) | (F.col("place") == 0)
    heavy = staged(nodes.where(is_heavy), "heavy")

    # The first node of a conversation's way that is not heavy is the shard root of all light nodes it passes.
    marks = heavy.select("key", F.lit(True).alias("is_heavy"))
    outside = members.where("place > 0").join(marks, "key", "left").where("is_heavy IS NULL")
    shards = outside.groupBy("conv_id").agg(F.min(F.struct("place", "key"))["key"].alias("shard"))
    light = nodes.where(~is_heavy).join(shards.withColumnRenamed("conv_id", "chain"), "chain")
    light = staged(_light_totals(light, room), "light")

    # Heavy nodes: what comes from shards, the node's own part, the chains' totals, and running sums along the chains.
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    below = light.where("top").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), *sums)
    inner = heavy.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("inner_children"))
    zero = F.lit(0).cast("bigint")
    own = heavy.select("key", "parent", "place", "conv_id", "n_convs", "chain", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    for side in (below, inner):
        own = own.join(side.withColumnRenamed("parent", "key"), "key", "left")
    children = F.coalesce("n_children", zero) + F.coalesce("inner_children", zero)
    own = own.select(
        "key", "parent", "place", "conv_id", "n_convs", "chain",
        children.alias("n_children"),
        # Only the root of conversations without turns is heavy and a leaf.
        F.when(children == 0, 1).otherwise(F.coalesce("n_leaves", zero)).cast("bigint").alias("n_leaves"),
        (F.col("own") + F.coalesce("saved_tokens", zero)).alias("saved_tokens"),
    )
    own = staged(own, "heavy-own")
    first = F.min(F.struct("place", "parent"))
    chains = own.groupBy("chain").agg(first["place"].alias("place"), first["parent"].alias("parent"), *sums)
    tops = own.groupBy("chain").agg(F.min("place").alias("up_place")).withColumnRenamed("chain", "up")
    hangs = own.select(F.col("key").alias("parent"), F.col("chain").alias("up")).join(tops, "up")
    # The root's chain hangs on none; without nulls the numbers stay integers.
    chains = chains.join(hangs, "parent", "left").fillna(0, ["up", "up_place"])
    sent = _chain_totals(chains, room)
    sent = staged(sent.groupBy("parent").agg(*sums).withColumnRenamed("parent", "key"), "sent")
    full = own.join(sent.select("key", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")), "key", "left")
    full = full.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", zero)})
    full = running_sums(full.drop("l", "s"), ["chain"], [F.desc("place")], {"_l": "n_leaves", "_s": "saved_tokens"})
    names = ["key", "parent", "place", "conv_id", "n_convs", "n_children"]
    full = full.select(*names, (F.col("n_leaves") + F.col("_l")).alias("n_leaves"), (F.col("saved_tokens") + F.col("_s")).alias("saved_tokens"))

    out = full.unionByName(light.select(*full.columns)).join(_ends(members), "key", "left")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return out.join(above, "parent", "left").select(
        "conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
