"""SentencePiece encoding and decoding for models of the merge type, without merging whole texts.

A merge-type model joins the adjacent pair of the highest score, the leftmost of equals, until no pair is a piece. The same ids
come from a search: at each position the longest piece is tried first, then its shorter prefixes that are pieces; a piece may follow another
only if the two, merged anew on their own, give just these two; a position from which no piece fits is marked as failed in a
bitfield and the last piece is taken back. Every prefix of a text has one valid segmentation, so a failed position stays failed and the
search is linear. The longest pieces at all positions come from one Aho-Corasick scan.

Two characters that are never linked by neighbours within a piece are never merged, as letters and commas, so texts are cut between them, and
before space marks if no piece holds one behind another character; each word so found is searched once per worker's table of words.
Characters that no piece holds become byte pieces.
"""

from __future__ import annotations

import itertools
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

SPACE = "▁"
WHOLE = "(?s).+"
#: Types of pieces in model files.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in each table that a worker keeps, and pairs of pieces; longer words are not kept.
KEPT_WORDS, KEPT_PAIRS, KEPT_CHARS = 200_000, 400_000, 48
#: Characters encoded or decoded between two output batches.
BATCH_CHARS = 2_000_000


def _fields(data: bytes):
    """(field, value) of a protocol buffer message: integers, or the bytes of the other kinds."""

    def number(at):
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def merged(text: str, rank: dict[str, int]) -> list[str]:
    """The symbols that are left when adjacent pairs of `text` have been merged, best rank first, leftmost of equals."""
    parts, never = list(text), len(rank)
    ranks = [rank.get(a + b, never) for a, b in itertools.pairwise(parts)]
    while ranks and (best := min(ranks)) < never:
        i = ranks.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get(parts[i - 1] + parts[i], never)
        if i < len(ranks):
            ranks[i] = rank.get(parts[i] + parts[i + 1], never)
    return parts


@lru_cache(maxsize=4)
def read_model(path: str) -> dict:
    """The tables of a model file: plain dicts and lists, as long as its vocabulary.

    Merge-type models with byte pieces are read whose texts are taken as they are but for a space mark in front. Others raise.
    """
    with open(path, "rb") as file:
        top = list(_fields(file.read()))
    pieces = []
    for _, value in (x for x in top if x[0] == 1):
        entry = dict(_fields(value))
        score = struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0
        pieces.append((entry.get(1, b"").decode(), score, entry.get(3, NORMAL)))
    trainer = dict(x for field, value in top if field == 2 for x in _fields(value))
    normalizer = dict(x for field, value in top if field == 3 for x in _fields(value))
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("not a merge-type model with byte pieces")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("a model that changes texts before it encodes them")
    scores = sorted({s for p, s, kind in pieces if kind == NORMAL and len(p) > 1}, reverse=True)
    place = {s: i for i, s in enumerate(scores)}
    rank = {p: place[s] for p, s, kind in pieces if kind == NORMAL and len(p) > 1}
    # Pieces that merging never gives are never found.
    given = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL and (len(p) == 1 or merged(p, rank) == [p])}
    return {
        "rank": rank,
        "ids": given,
        "bytes": [next((i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE and int(p[1:-1], 16) == b), None) for b in range(256)],
        "pieces": [(p, kind) for p, _, kind in pieces],
        "surface": trainer.get(44, " ⁇ ".encode()).decode(),
        "mark_in_front": bool(normalizer.get(3, 1)),
        "cut": cut_of(rank),
    }


def cut_of(pieces) -> str:
    """A pattern whose matches are the stretches of a text that no piece links with what stands beside them.

    Characters that are neighbours in a piece are linked, and so are those that others link.
    """
    if any(a != SPACE and b == SPACE for p in pieces for a, b in itertools.pairwise(p)):
        return WHOLE
    first: dict[str, str] = {}

    def top(c):
        while first.setdefault(c, c) != c:
            first[c] = c = first[first[c]]
        return c

    for p in pieces:
        for a, b in itertools.pairwise(p.lstrip(SPACE)):
            first[top(a)] = top(b)
    linked: dict[str, list[str]] = {}
    for c in [*map(chr, range(128)), *first]:
        linked.setdefault(top(c), []).append(c)
    plain = [set(group) for group in linked.values() if min(group) < "\x80"]
    # Largest first; what has no group of its own here stays together.
    groups = ["".join(map(re.escape, sorted(group))) for group in sorted(plain, key=len, reverse=True)]
    return "|".join([f"{SPACE}*[{g}]+" for g in groups[:1]] + [f"{SPACE}*[^{SPACE}{''.join(groups)}]+"] + [f"{SPACE}*[{g}]+" for g in groups[1:]] + [f"{SPACE}+"])


class Kept(dict):
    """Results of a function, kept for a while: a full table becomes the old one, whose entries live on if they are asked for again."""

    def __init__(self, find):
        self.find, self.old = find, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.find(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Texts to ids, as little-endian 32-bit integers."""

    def __init__(self, model: dict):
        import ahocorasick

        self.rank, self.model = model["rank"], model
        self.alphabet = {c for p in [*self.rank, *model["ids"]] for c in p}
        self.ids = {p: struct.pack("<i", i) for p, i in model["ids"].items()}
        self.byte_ids = [struct.pack("<i", i) for i in model["bytes"]]
        for c in self.alphabet - self.ids.keys():
            # A character that only longer pieces hold.
            self.ids[c] = self.unknown(c)
        self.automaton = ahocorasick.Automaton()
        nodes: dict[str, tuple] = {}
        for p in sorted(self.ids, key=len):
            begin = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in nodes), None)
            nodes[p] = (len(p), self.ids[p], nodes.get(begin))
            self.automaton.add_word(p, nodes[p])
        self.automaton.make_automaton()
        self.pairs: dict[bytes, bool] = {}
        self.cut, self.apart = re.compile(model["cut"]).findall, model["cut"] != WHOLE
        self.words = Kept(self.word)
        self.parts = Kept(self.part)

    def unknown(self, text: str) -> bytes:
        return b"".join(self.byte_ids[b] for b in text.encode("utf-8", "replace"))

    def fits(self, key: bytes, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged anew."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        good = self.pairs[key] = merged(left + right, self.rank) == [left, right]
        return good

    def search(self, text: str) -> list[bytes]:
        """The ids of a text whose characters are all in some piece."""
        n, pairs, scan = len(text), self.pairs, self.automaton.iter_long
        failed, any_failed = bytearray(n // 8 + 1), False
        # Pieces that stand so far, each as (size, ids, the next shorter piece that begins it).
        out: list[tuple] = []
        at, last = 0, None
        # The scan gives the longest piece behind the one that it gave before; anywhere else it starts anew.
        matches = scan(text)
        ahead, node = next(matches)
        while True:
            while node:
                size, piece, shorter = node
                end = at + size
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    good = pairs.get(last + piece)
                    if good is None:
                        good = self.fits(last + piece, text[at - out[-1][0] : at], text[at:end])
                    if good:
                        break
                node = shorter
            if node:
                out.append(node)
                at, last = end, piece
                if at == n:
                    return [x[1] for x in out]
                if at != ahead + 1:
                    matches = scan(text, at)
                ahead, node = next(matches)
            else:
                any_failed = True
                failed[at >> 3] |= 1 << (at & 7)
                node = out.pop()
                at -= node[0]
                last = out[-1][1] if out else None
                node = node[2]

    def word(self, text: str) -> bytes:
        if self.alphabet.issuperset(text):
            return b"".join(self.search(text))
        out = []
        for known, run in itertools.groupby(text, self.alphabet.__contains__):
            part = "".join(run)
            out += self.search(part) if known else [self.unknown(part)]
        return b"".join(out)

    def part(self, text: str) -> bytes:
        """The ids of a text with a space mark in front."""
        if text.isalpha():
            return self.word(SPACE + text)
        return b"".join(map(self.words.__getitem__, self.cut(SPACE + text)))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        front = self.model["mark_in_front"]
        if front and self.apart and not (SPACE in text or "  " in text or text[0] == " " or text[-1] == " "):
            # Each word has one mark in front of it.
            return b"".join(map(self.parts.__getitem__, text.split(" ")))
        return b"".join(map(self.words.__getitem__, self.cut(SPACE * front + text.replace(" ", SPACE))))


class Decoder:
    """Ids to texts: marks become spaces, the one in front goes, byte pieces are read as UTF-8."""

    def __init__(self, model: dict):
        self.front = model["mark_in_front"]
        self.controls = {i for i, (_, kind) in enumerate(model["pieces"]) if kind == CONTROL}
        self.kinds = [kind for _, kind in model["pieces"]]
        said = {UNKNOWN: lambda p: model["surface"].encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.bytes = [said.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, kind in model["pieces"]]

    def _in_front(self, ids: list[int]) -> int:
        """Place of the piece whose space goes: the first that says anything, if it is an ordinary one; else -1."""
        for i, x in enumerate(ids):
            if self.kinds[x] != CONTROL:
                return i if self.kinds[x] == NORMAL and self.bytes[x][:1] == b" " else -1
        return -1

    def __call__(self, ids: list[int]) -> str:
        parts = [self.bytes[i] for i in ids]
        if self.front and (at := self._in_front(ids)) >= 0:
            parts[at] = parts[at][1:]
        try:
            if self.controls.isdisjoint(ids):
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        # Of a run of byte pieces every byte that belongs to no character counts alone.
        out = []
        for is_byte, run in itertools.groupby(zip(ids, parts, strict=True), lambda x: self.kinds[x[0]] == BYTE):
            data = b"".join(p for _, p in run)
            out.append(characters(data) if is_byte else data.decode())
        return "".join(out)


def characters(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in range(1, 5):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def _appended(df: DataFrame, source: str, out: str, kind: t.DataType, size, made) -> DataFrame:
    """All columns of `df` and `out`, made by `made(values) -> array` from pieces of `source` of some BATCH_CHARS in `size`."""
    df = df.drop(out) if out != source else df
    schema = t.StructType([*df.schema.fields, t.StructField(out, kind)])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(source))
            ends = np.cumsum(size(values)) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(values)]
            for a, b in itertools.pairwise(cuts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, made(values.slice(a, b - a))], names=names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of `docs` and `out`, the ids of the text as the model file's library gives them, without begin or end.

    Null and empty texts have no ids. Whole texts are encoded, whatever their length; rows stay as they are and as often as they occur. A
    column of the name `out` is replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def made(texts):
        # One encoder, with its table of words, for all tasks of a worker.
        encoder = shared.value.setdefault("encoder", None) or Encoder(shared.value)
        shared.value["encoder"] = encoder
        found = [encoder(x) if x else b"" for x in texts.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))

    def size(texts):
        return pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)

    import pyarrow.compute  # noqa: F401

    return _appended(docs, text_col, out, t.ArrayType(t.IntegerType()), size, made)


def decode(docs: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `docs` and `out`, the text of the ids; null ids give an empty text. An id out of the vocabulary raises."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def made(ids):
        decoder = shared.value.setdefault("decoder", None) or Decoder(shared.value)
        shared.value["decoder"] = decoder
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        return pa.array([decoder(flat[a:b].tolist()) for a, b in itertools.pairwise([0, *ends.tolist()])], pa.string())

    def size(ids):
        return 4 * pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    import pyarrow.compute  # noqa: F401

    return _appended(docs, ids_col, out, t.StringType(), size, made)


def digests(ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """Columns that sum up ids and decoded text: n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256."""
    ids = F.col(ids_col)
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    ]
