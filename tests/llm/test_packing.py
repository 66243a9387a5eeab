"""Packing: ids against the tokenizers library, capacities, completeness, edge rows."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from textlode.llm import packing
from textlode.llm.queries import best_fit_packing, tokenizer_path

SCHEMA = "doc_id bigint, text string, sequence_id string"
ODD = [
    "",
    " ",
    "a  b",
    "a \n b\n\n\nc ",
    "tab\tx \t y",
    "end <|endoftext|> here",
    "<|endoftext|>",
    " a  <|endoftext|>\n<|endoftext|> b <|endoftext| >",
    "é ñ 漢字 😀 x y z",
    "'s don't I'll  5 50 5,000",
    "\x1c \x85 x",
    "word " * 3000,
    "x" * 3000,
]


@pytest.fixture(scope="module")
def reference():
    own = Tokenizer.from_file(tokenizer_path())
    return lambda text: own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_tokenizers_library(reference, text):
    found = packing.byte_bpe(tokenizer_path())(text)
    assert list(np.frombuffer(found, "<u4")) == reference(text)


def held(rows, reference_rows, reference, length):
    """Every piece is as the contract says, and no sequence is overfull or has gaps."""
    by_doc = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in reference_rows:
        ids = [*reference(text or ""), 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // length)
        at = 0
        for i, r in enumerate(pieces):
            assert r["start"] == at
            assert r["length"] == length or i == 0
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for spans in places.values():
        end = 0
        for offset, size in sorted(spans):
            assert offset == end
            end += size
        assert end <= length
    return len(places)


def test_query_packs_every_document(spark, reference):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = best_fit_packing(spark, folder).collect()
    used = held(rows, docs, reference, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_odd_texts_and_clashing_columns(spark, reference):
    data = [(i, t, "clash") for i, t in enumerate([*ODD, None])]
    pieces = packing.pieces_of(spark.createDataFrame(data, SCHEMA), tokenizer_path(), length=512)
    rows = packing.pack(pieces, length=512, per_task=5).collect()
    held(rows, [(i, t) for i, t, _ in data], reference, 512)


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "same text", "")] * 30 + [(None, "x", "")], SCHEMA)
    rows = packing.pack(packing.pieces_of(docs, tokenizer_path(), length=16), length=16).collect()
    assert len(rows) == 31
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack(packing.pieces_of(docs.where("false"), tokenizer_path())).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by):
    rng = np.random.default_rng(1)
    size = rng.integers(1, 100, 500).astype(float)
    needs = np.stack([size, np.ones(500), size**2], 1)
    capacity = np.array([100.0, 4.0, 6000.0])
    needs = needs[needs[:, 2] <= 6000]
    place, used = packing.best_fit(needs, capacity, np.array([1.0, 0.2, 0.5]), by)
    total = np.zeros((used, 3))
    np.add.at(total, place, needs)
    assert (total <= capacity + 1e-6).all()
    assert used < len(needs) * 0.9


def test_too_large_a_piece_raises(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 90, 0)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack(pieces, length=64).collect()
