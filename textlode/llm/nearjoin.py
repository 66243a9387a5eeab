"""Similarity join of word-shingle sets by parity sketches.

A parity sketch has one bit per slot of a hash; each shingle flips its bit. Shingles that two sets share cancel, so
the Hamming distance of two sketches is at most the size of the sets' symmetric difference. Sets of a and b shingles whose Jaccard
similarity reaches num/den differ in at most (a + b) * (den - num) / (den + num) shingles, so their sketches differ in no more bits,
and of more parts than that, some must be equal.

1. Equal sets become one node, named by a hash of the set.
2. Pigeonhole join. A size band holds sets of BAND ** j to BAND ** (j + 1) - 1 shingles. A pair meets in the band of its
   larger set; a set that is nearly as large as the next band's smallest also takes part there. The band's sketch is cut into
   more parts than two of its sets may differ in. The sketch is wide and sparse (2 ** 64 bits a part), so a part is
   named by the XOR of its shingles' hashes. If at most D parts differ and parts are put in one order everywhere, the first equal
   part stands among the first D + 1 non-empty parts of either set: only those are keys. Parts of many shingles come first, as
   few sets share them. A set with too few non-empty parts for that argument names its empty parts too.
3. In each group of nodes with an equal key, every node is compared to the smallest one: first a dense parity sketch (Hamming
   distance over the bound: no link), then the sets themselves. Links give components; a node's first pair is looked at before
   the others, and of those only the ones between different components.
4. Nodes of one group that are still in different components are compared with each other in blocks inside tasks, by their dense
   sketches, and those that may be near another component by their sets. Every pair with an equal key has then been compared or
   joined, so no link between components is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlode.llm.common import staged

WORDS = 5
NUM, DEN = 75, 100
BAND = 4


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: `words` words each, or all words if there are fewer.

    Words are separated by ASCII white space; A-Z are lower-cased.
    """
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    span = min(n, words)
    h = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[j : n - span + 1 + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def node_of(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes()) - 2**63


def bands_of(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(band, parts, D) for each band in which a set of n shingles can meet another one.

    D bounds the difference from any partner: at most n * den / num shingles, and below the band's end.
    """
    j, low = 0, 1
    while n >= low * BAND:
        j, low = j + 1, low * BAND
    out = []
    for band, first in ((j, low), (j + 1, low * BAND)):
        if n >= first or n * den >= num * first:
            most = min(first * BAND - 1, n * den // num)
            widest = 2 * (first * BAND - 1) * (den - num) // (den + num)
            out.append((band, widest + widest // 8 + 8, (n + most) * (den - num) // (den + num)))
    return out


def keys_of(hashes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Join keys of a set: two sets that reach the similarity have at least one in common."""
    out = []
    for band, parts, most in bands_of(len(hashes), num, den):
        part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        where = part[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        size = np.diff(np.r_[first, len(where)])
        key = np.bitwise_xor.reduceat(hashes[order], first)
        salt = (where[first].astype(np.uint64) + np.uint64(parts * 7 + band)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        if len(key) > most:
            out.append(key[np.lexsort((key, -size))[: most + 1]])
        else:
            empty = np.setdiff1d(np.arange(parts), where).astype(np.uint64)
            out += [key, (empty + np.uint64(parts * 7 + band)) * np.uint64(0xC2B2AE3D27D4EB4F)]
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def dense_sketch(hashes: np.ndarray, bits: int | None = None) -> bytes:
    """Parity sketch of so many bits, a power of two and at least 64; by default of 2 to 4 bits a shingle."""
    bits = bits or max(64, 1 << (2 * len(hashes) - 1).bit_length())
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches; the longer one is folded, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, node, sketch) of (id, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_set(text or "", words)
                rows.append((len(h), node_of(h), dense_sketch(h)) if len(h) else (0, None, None))
            n, node, sketch = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "n": pd.array(n, "Int64"), "node": pd.array(node, "Int64"), "sketch": list(sketch)})

    return docs.mapInPandas(run, "id bigint, n bigint, node bigint, sketch binary")


def _keys(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, node): the join keys of every set, once per task for equal sets."""

    def run(batches):
        seen = set()
        for batch in batches:
            nodes, keys = [], []
            for text in batch["text"]:
                h = shingle_set(text or "", words)
                if len(h) and (node := node_of(h)) not in seen:
                    seen.add(node)
                    k = keys_of(h, num, den)
                    keys.append(k)
                    nodes.append(np.full(len(k), node, np.int64))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})

    return docs.select("text").mapInPandas(run, "key bigint, node bigint")


def _passing(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and dense sketches allow the similarity."""
    for side in "ab":
        own = nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
        pairs = pairs.join(own, side)

    def run(batches):
        for p in batches:
            low, high = np.minimum(p["n_a"], p["n_b"]), np.maximum(p["n_a"], p["n_b"])
            p = p[(low * den >= high * num).to_numpy()]
            most = ((p["n_a"] + p["n_b"]) * (den - num) // (den + num)).to_numpy()
            near = np.array([hamming(x, y) for x, y in zip(p["s_a"], p["s_b"], strict=True)], np.int64)
            yield p[near <= most][["a", "b"]]

    return pairs.mapInPandas(run, "a bigint, b bigint")


def _hashes(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the nodes in `wanted` (node). Reads their texts again."""
    wanted = wanted.distinct().join(nodes, "node").select("node", F.col("rep").alias("id"))
    texts = docs.join(wanted.hint("shuffle_hash"), "id")

    def sets(batches):
        for batch in batches:
            rows = [(node, h.tobytes()) for node, text in zip(batch["node"], batch["text"], strict=True) if node_of(h := shingle_set(text, words)) == node]
            yield pd.DataFrame(rows, columns=["node", "hashes"])

    # Rows that share an id may have other texts: only those of the node are left, once.
    found = texts.select("node", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(sets, "node bigint, hashes binary")
    return staged(found.dropDuplicates(["node"]), "sets")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""
    found = _hashes(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, words)
    for side in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("hashes").alias(f"h_{side}")), side)

    def compare(batches):
        for p in batches:
            sides = zip(p["h_a"], p["h_b"], strict=True)
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in sides]
            yield p[np.array(good, bool)][["a", "b"]]

    return pairs.mapInPandas(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of links (a, b), for nodes with links.

    Alternates large-star and small-star steps: neighbours are hung on the smallest neighbour until every tree is a star.
    The minima are pre-aggregated, and each round is written, so that lineage stays short.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        # Large star: larger neighbours of u go to u's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them. Each row has v < u.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = staged(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _distinct_groups(rows: DataFrame) -> DataFrame:
    """One of all groups (key, node, label) with the same nodes, if these are of several components."""
    groups = rows.groupBy("key").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(node))").alias("same")
    )
    groups = groups.where("x <> y").groupBy("size", "same").agg(F.min("key").alias("key")).select("key")
    return staged(rows.join(groups, "key"), "rest")


def _in_blocks(rows: DataFrame, most_rows: int, most_shingles: int) -> DataFrame:
    """Rows (key, node, n, ...) dealt to block pairs (key, i, j), in which every two rows of a key meet.

    Blocks are cut by hash; how many there are follows from the group's rows and shingles.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / most_rows), F.ceil(F.sum("n") / most_shingles)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "block", "other")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")


def _block_pairs(batches):
    """The frames of whole block pairs from batches in which they lie one after the other."""
    held = None
    for batch in itertools.chain(batches, [None]):
        held = batch if held is None else held if batch is None else pd.concat([held, batch], ignore_index=True)
        if held is None or not len(held):
            continue
        name = held[["key", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
        spans = [0, *cuts.tolist()] + ([len(held)] if batch is None else [])
        for a, b in itertools.pairwise(spans):
            yield held.iloc[a:b]
        held = None if batch is None else held.iloc[spans[-1] :].reset_index(drop=True)


def _near(n: np.ndarray, sketches: list[bytes], num: int, den: int):
    """(row, rows behind it that size and sketch leave possible) of rows sorted by n."""
    width = min(map(len, sketches)) // 8
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), 0) for x in sketches])
    ends = np.searchsorted(n, n * den // num, "right")
    for at in range(len(n)):
        other = np.arange(at + 1, ends[at])
        if len(other):
            distance = np.bitwise_count(folded[other] ^ folded[at]).sum(1)
            yield at, other[distance <= (n[other] + n[at]) * (den - num) // (den + num)]


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components which meet in a group.

    First the dense sketches say which nodes of a group may be near a node of another component. Then the sets of these nodes are compared in
    the same way; a task skips pairs that its own links have already joined, so it reports fewer links than it has nodes.
    """
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = _distinct_groups(rows).join(nodes.select("node", "n", "sketch"), "node")

    def marked(batches):
        for pair in _block_pairs(batches):
            label, found = pair["label"].to_numpy(), np.zeros(len(pair), bool)
            for at, other in _near(pair["n"].to_numpy(), pair["sketch"].tolist(), num, den):
                other = other[label[other] != label[at]]
                found[other] = True
                found[at] |= len(other) > 0
            if found.any():
                yield pair[found][["key", "node", "label", "n"]]

    rows = _in_blocks(rows.select("key", "node", "label", "n", "sketch"), 4096, 1 << 26)
    rows = staged(rows.mapInPandas(marked, "key bigint, node bigint, label bigint, n bigint").distinct(), "marked")
    rows = _distinct_groups(rows)
    rows = rows.join(_hashes(rows.select("node"), nodes, docs, words), "node")

    def linked(batches):
        for pair in _block_pairs(batches):
            n, node = pair["n"].to_numpy(), pair["node"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in pair["hashes"]]
            bits = max(64, 1 << (16 * int(n[0]) - 1).bit_length())
            sharp = [dense_sketch(h, bits) for h in sets]
            group = pd.factorize(pair["label"])[0]
            out = []
            for at, other in _near(n, sharp, num, den):
                for to in other:
                    if group[to] != group[at] and similar(sets[at], sets[to], num, den):
                        group[group == group[to]] = group[at]
                        out.append((node[at], node[to]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    rows = _in_blocks(rows.select("key", "node", "label", "n", "hashes"), 2048, 1 << 22)
    return rows.mapInPandas(linked, "a bigint, b bigint").distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components so far."""
    for side in "ab":
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"l_{side}", F.coalesce(f"l_{side}", side))
    return pairs.where("l_a <> l_b").select("a", "b")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.

    component_id is the smallest id that links lead to, the row's own id included; a link joins two texts whose shingle sets
    have a Jaccard similarity of at least num / den. Null, empty and blank texts have no shingles and no links. A row without id
    links with nothing and its component is null. Repeated rows are linked to each other. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = staged(_sets(docs, words), "nodes")
    docs = docs.where(F.col("id").isNotNull())
    named = rows.where(F.col("id").isNotNull() & F.col("node").isNotNull())
    nodes = named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes, "classes")
    group = Window.partitionBy("key")
    met = _keys(docs, words, num, den).withColumn("low", F.min("node").over(group)).withColumn("high", F.max("node").over(group))
    members = staged(met.where("low <> high").select("key", "node", "low").distinct(), "groups")
    star = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))

    def linked(pairs, name):
        pairs = staged(_passing(pairs, nodes, num, den), name)
        return _verified(pairs, nodes, docs, words, num, den) if not pairs.isEmpty() else pairs

    # One pair per node first: that joins most of a large group of near copies. Then the other nodes' smallest ones. Then the rest.
    rounds = (
        lambda: linked(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs"),
        lambda: linked(_apart(star.distinct(), labels), "more"),
        lambda: _rest(members.select("key", "node"), labels, nodes, docs, words, num, den),
    )
    links, labels = None, None
    for find in rounds:
        found = staged(find(), "found")
        links = found if links is None else links.unionByName(found)
        if labels is None or not found.isEmpty():
            labels = components(links)
    return _with_classes(rows, nodes, labels)


def _with_classes(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    reps = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = reps.groupBy("label").agg(F.min("rep").alias("component"))
    known = reps.join(least, "label").select("node", "component")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = rows.drop("sketch").join(known, "node", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns. Rows without id stay.

    Of repeated rows with one id one stays; which one is not fixed if they differ.
    """
    classes = similar_classes(docs, id_col, text_col)
    left = classes.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(left, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
