"""Packing documents into training sequences by vector best fit.

A piece of a document needs tokens, one place among the sequence's documents, and attention (its length squared, as attention
within a document grows). A sequence has a capacity of each. Pieces are packed from the largest down: among the open
sequences that can take a piece under every capacity, the one with the smallest weighted norm of what would remain, or the
largest weighted dot product of need and what remains, gets it. Pieces are dealt out evenly to tasks of PER_TASK pieces,
which pack on their own; each leaves about one sequence partly filled, under 0.1 % of its sequences.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import slots, staged

LENGTH = 2048
PER_TASK = 8192
#: Longer words are not kept in a task's table of words, and the table starts anew at this many.
CACHED_CHARS, CACHED_WORDS = 48, 500_000


def byte_bpe(path: str):
    """An encoder for a byte-level BPE file of the tokenizers library: text -> little-endian unsigned 32-bit ids.

    Ids of such a file are merge ranks, so tiktoken gives the ids that the tokenizers library gives, at several times its speed
    on one core. Words are cut at single spaces and looked up in a bounded table; texts in which a space stands beside other
    white space are encoded whole. The file's added tokens are found in texts first, as the library finds them, and have their own ids; what stands
    between them is encoded by itself.
    """
    import re

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    # How byte-level BPE files write bytes as printable characters.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in model.get("added_tokens", [])}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encode = tiktoken.Encoding("bytes", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text):
        return np.array(encode(text), "<u4").tobytes()

    class Words(dict):
        def __missing__(self, word):
            # Beside other white space a cut at a space may be wrong: None makes the join below fail.
            found = None if not word or word[0].isspace() or word[-1].isspace() else ids(" " + word)
            if len(word) <= CACHED_CHARS:
                if len(self) >= CACHED_WORDS:
                    self.clear()
                self[word] = found
            return found

    words = Words()

    def run(text: str) -> bytes:
        if any(token in text for token in special):
            return b"".join(special.get(part) or plainly(part) for part in cut(text) if part)
        return plainly(text)

    def plainly(text: str) -> bytes:
        first, *others = text.split(" ")
        if not first or first[-1].isspace():
            return ids(text)
        try:
            return ids(first) + b"".join(map(words.__getitem__, others))
        except TypeError:
            return ids(text)

    return run


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with one id 0 behind them, cut if they are too long.

    Only documents of more than `length` ids are cut, into pieces of `length` of which the first may be shorter. A null text
    counts as empty: one piece with the id 0. Repeated rows give repeated pieces.
    """

    def run(batches):
        import zlib

        encode = byte_bpe(tokenizer)
        end = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = memoryview((encode(text) if text else b"") + end)
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n, length), n] if n > length else [0, n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, by: str = "norm") -> tuple[np.ndarray, int]:
    """Sequence number of each item, and how many there are.

    needs: (items, constraints), none above the capacity. Items are taken by falling weighted size, ties in the given order.
    """
    scale = needs / capacity
    order = np.argsort(-(scale * weights).sum(1), kind="stable")
    least = scale.min(0)
    place = np.zeros(len(needs), np.int64)
    room = np.empty((len(needs), scale.shape[1]))
    name = np.empty(len(needs), np.int64)
    n_open = n_all = 0
    for item in order:
        need = scale[item]
        after = room[:n_open] - need
        fits = np.flatnonzero((after >= -1e-12).all(1))
        if len(fits):
            if by == "norm":
                value = -((after[fits] ** 2) @ weights)
            else:
                value = (room[fits] * need) @ weights
            at = fits[value.argmax()]
            room[at] -= need
        else:
            at, n_open, n_all = n_open, n_open + 1, n_all + 1
            room[at], name[at] = 1.0 - need, n_all - 1
        place[item] = name[at]
        if (room[at] < least - 1e-12).any():  # nothing fits any more
            n_open -= 1
            room[at], name[at] = room[n_open], name[n_open]
    return place, n_all


def pack(
    pieces: DataFrame,
    length: int = LENGTH,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01),
    by: str = "norm",
    per_task: int = PER_TASK,
) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    max_docs and max_attention (sum of squared lengths) bound a sequence further; without them `length` implies both. A piece
    must fit an empty sequence: a longer one raises. Full pieces are sequences of their own and are not moved. The pieces are
    staged and counted, as the number of tasks follows from the count. An empty table gives an empty table; repeated rows are
    packed as often as they occur.
    """
    max_docs, max_attention = max_docs or length, max_attention or length**2
    pieces = staged(pieces.drop("sequence_id", "offset"), "pieces")
    # Over written rows this number is the same in every run. Negative numbers are those of the full pieces' sequences.
    row = F.monotonically_increasing_id()
    full = pieces.where(F.col("length") == length).select("*", (-1 - row).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") != length)
    n = slots(rest.count(), per_task)
    dealt = rest.withColumn("_slot", F.pmod(F.xxhash64(row), F.lit(n)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        slot = int(group["_slot"].iloc[0])
        size = group["length"].to_numpy(float)
        if (size > length).any() or (size**2 > max_attention).any():
            raise ValueError("a piece is larger than a sequence")
        needs = np.stack([size, np.ones(len(size)), size**2], 1)
        place, _ = best_fit(needs, np.array([length, max_docs, max_attention], float), np.array(weights), by)
        # The slot in the high bits keeps numbers of different tasks apart.
        group["sequence_id"] = (np.int64(slot) << 40) | place
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="_slot")

    packed = dealt.groupBy("_slot").applyInPandas(run, full.schema)
    return packed.unionByName(full)
