import random
from hashlib import sha256

import pytest

from textlode.llm import queries, trie


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}, from sets of prefixes."""
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        totals[path] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        row = (min(own), len(path), parent, len(own), len(children.get(path, [])), *totals[path], sha256(ends.encode()).hexdigest())
        out.append(row)
    return sorted(out, key=str)


def trie_of(spark, convs, **options):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(4)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id bigint")
    return sorted(map(tuple, trie.prefix_trie(trie.turns_of(table), ids, **options).collect()), key=str)


def conversations(rng, n, words="abé", most=8):
    return {c * 7 % 1009: [("user", rng.choice(words) * rng.choice([1, 1, 3])) for _ in range(rng.randint(0, most))] for c in range(n)}


@pytest.mark.parametrize("shard_turns,room", [(0, 200_000), (3, 2), (40, 5), (1024, 200_000)])
def test_trie_equals_prefix_sets(spark, shard_turns, room):
    convs = conversations(random.Random(shard_turns), 120)
    assert trie_of(spark, convs, shard_turns=shard_turns, room=room) == brute(convs)


def test_one_long_conversation_copies_and_snapshots(spark):
    long = [("user", f"t{i}") for i in range(300)]
    convs = {2**60 + 1: long, 5: long, 6: long[:299], 7: long[:150] + [("user", "x")]}
    # Snapshots that grow with the id, and a hot first turn.
    convs |= {100 + i: [("a", "hot")] + [("a", str(j)) for j in range(i)] for i in range(40)}
    convs |= {500 + i: [("a", "hot")] for i in range(60)}
    assert trie_of(spark, convs, shard_turns=20) == brute(convs)


def test_conversations_without_turns_and_empty_tables(spark):
    assert trie_of(spark, {3: [], 4: []}) == brute({3: [], 4: []})
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert trie.prefix_trie(trie.turns_of(empty), empty.select("conv_id")).collect() == []


def test_turns_take_nulls_ties_repeats_and_other_columns(spark):
    rows = [
        (1, None, "u", "first", 0), (1, 2, "b", "x", 0), (1, 2, "a", None, 0), (1, 2, "a", None, 0), (1, 9, None, "é" * 50_000, 0), (None, 1, "u", "no", 0),
    ]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, place int")
    got = sorted(tuple(r) for r in trie.turns_of(table).select("conv_id", "place", "bytes").collect())
    assert got == [(1, 1, 5), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 100_000)]
    same = [bytes(r["digest"]) for r in trie.turns_of(table).where("place IN (2, 3)").collect()]
    assert same[0] == same[1]


def test_queue_spills_and_keeps_the_order():
    queue, rng = trie.SpillingQueue(room=50), random.Random(1)
    items = [(rng.randint(0, 300), i) for i in range(3000)]
    for item in items:
        queue.push(item)
    assert queue.spilled and len(queue.heap) <= 50
    out = []
    for key in range(301):
        out += sorted(queue.pop((key,)))
    assert out == sorted(items)


def test_ends_in_several_strings(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_CHARS", 20)
    convs = {i: [("u", "same")] for i in range(200)}
    assert trie_of(spark, convs) == brute(convs)


def rebuilt_plainly(convs):
    import zlib

    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % queries.SHARED_TURNS
        out[c] = convs.get(c - c % queries.FAMILY, [])[:h] + turns[h:]
    return out


def test_query_equals_plain_rebuilding(spark, tmp_path):
    rng = random.Random(8)
    convs = {c: [("u", rng.choice("pq")) for _ in range(rng.randint(1, 14))] for c in range(60) if c % 11}
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.conversation_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rebuilt_plainly(convs))
