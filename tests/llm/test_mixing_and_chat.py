"""Poisson replication and chat formatting: definitions, target weights, edge rows."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from textlode.llm import chat, mixing


def test_cumulative_is_poisson():
    for mean in (0.01, 0.7, 3.0, 40.0, 64.0):
        steps = mixing.cumulative(mean)
        assert steps[0] == pytest.approx(math.exp(-mean))
        assert steps == sorted(steps) and steps[-1] == pytest.approx(1.0)
    assert mixing.cumulative(0) == [1.0]


def source_table(spark):
    rows = [(i, "text of ten", "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)


def test_shares_meet_the_weights(spark):
    docs = source_table(spark)
    weights = {"hot": 0.2, "s0": 0.5, mixing.REST: 0.3}
    found = Counter(r["source"] for r in mixing.mix(docs, weights).collect())
    n = sum(found.values())
    assert n == pytest.approx(6000, rel=0.08)
    assert found["hot"] / n == pytest.approx(0.2, abs=0.03)
    assert found["s0"] / n == pytest.approx(0.5, abs=0.04)


def test_same_draws_in_any_partitioning_and_text_kept(spark):
    docs = source_table(spark)
    weights = {"hot": 0.5, mixing.REST: 0.5}
    a, b = mixing.mix(docs, weights), mixing.mix(docs.repartition(11), weights)
    rows = sorted(tuple(r) for r in a.collect())
    assert rows == sorted(tuple(r) for r in b.collect())
    assert a.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    assert len({r[4] for r in rows}) == len(rows)


def test_high_rates_and_edge_rows(spark):
    rows = [(i, "x" * 100, "big", 1) for i in range(2000)] + [(5000, "y" * 100, "tiny", 1)]
    rows += [(None, "z" * 100, "tiny", 1), (6000, None, None, 1), (6000, None, None, 1), (6001, "", "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    found = mixing.mix(docs, {"tiny": 0.5, "big": 0.5, "absent": 0.2}).collect()
    tiny = sum(r["source"] == "tiny" for r in found)
    # Two documents share about half of 2,002: a mean beyond what one draw takes.
    assert 600 < tiny < 1100
    assert {r["source"] for r in found} == {"tiny", "big"}
    with_rest = mixing.mix(docs, {"big": 0.1, mixing.REST: 0.9}).collect()
    assert sum(r["source"] is None for r in with_rest) % 2 == 0
    assert mixing.mix(docs.where("false"), {"big": 1.0}).count() == 0
    assert mixing.mix(docs, {"big": 0.0, mixing.REST: 1.0}).where("source = 'big'").count() == 0


def turns_of(conv, *texts):
    return [(conv, i, ("user", "assistant")[i % 2], t, "x") for i, t in enumerate(texts)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"


def test_snapshots_and_copies_go(spark):
    rows = turns_of(1, "a") + turns_of(2, "a", "b") + turns_of(3, "a", "b", "c") + turns_of(4, "a", "b", "c") + turns_of(5, "a", "x")
    rows += turns_of(6, "b", "a") + turns_of(7, None, "") + turns_of(8, "")
    rows += turns_of(6, "b", "a") + [(None, 0, "user", "a", "x")]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert set(found) == {3, 5, 6, 7}
    assert found[3]["text"] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert found[6]["n_turns"] == 2
    assert found[7]["text"] == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"


def test_turn_numbers_with_gaps_and_ties(spark):
    rows = [(1, 5, "user", "b", ""), (1, 5, "user", "a", ""), (1, 9, None, "c", ""), (2, 0, "user", "a", ""), (2, 1, "user", "b", "")]
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["n_turns"], r["text"]) for r in found] == [(1, 3, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n<||>\nc<|end|>\n")]


def test_long_conversations_come_in_parts(spark):
    rows = [(1, i, "user", f"t{i}", "") for i in range(600)] + [(2, i, "user", f"t{i}", "") for i in range(599)]
    found = sorted(chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in found] == [(1, 0, 256), (1, 1, 256), (1, 2, 88)]
    assert "".join(r["text"] for r in found) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(600))
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_without_number_come_first(spark):
    rows = [(1, 0, "user", "b", ""), (1, None, "user", "z", ""), (1, None, "system", "y", ""), (2, None, "system", "y", ""), (2, 7, "user", "z", "")]
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    lines = "<|system|>\ny<|end|>\n<|user|>\nz<|end|>\n<|user|>\nb<|end|>\n"
    assert [(r["conv_id"], r["n_turns"], r["text"]) for r in found] == [(1, 3, lines)]


def test_a_long_conversation_is_cut_into_ranges(spark):
    """No window over a whole conversation: each is by range, too."""
    rows = [(1, i, "user", f"t{i % 3}", "") for i in range(3000)] + [(2, i, "user", f"t{i % 3}", "") for i in range(2999)] + [(3, 0, "user", "t0", "")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    hashed = chat.prefixes(chat.numbered_turns(turns.select("conv_id", "turn", "role", "text")))
    windows = [line for line in hashed._jdf.queryExecution().analyzed().toString().split("\n") if "windowspecdefinition" in line]
    assert windows and all("_range" in line for line in windows)
    assert [r["conv_id"] for r in chat.maximal(hashed).collect()] == [1]
    ends = {r["conv_id"]: (r["place"], r["h0"]) for r in hashed.where("place in (2999)").collect()}
    assert ends[1] == ends[2]
