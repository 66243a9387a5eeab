"""Toxicity and language identification: held-out accuracy, definitions, edge rows."""

from __future__ import annotations

import random
import zlib
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textlode.llm import language, toxicity

FOLDER = "/root/testdata/sf0.01"


def held(doc, folds, fold):
    return zlib.crc32(str(doc).encode()) % folds == fold


def test_toxicity_query_on_held_out_rows(spark):
    from textlode.llm.queries import toxicity_scores

    rows = toxicity_scores(spark, FOLDER).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 5, 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    own = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in own)
    assert right >= 0.85 * len(own)


def toxic_texts(n=600):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    texts = [[rng.choice(words) for _ in range(30)] for _ in range(n)]
    for i in range(0, n, 3):
        texts[i][rng.randrange(30)] = rng.choice(["dreadfulness", "despicable"])
    return [" ".join(t) for t in texts], np.array([int(i % 3 == 0) for i in range(n)])


def test_misspelt_words_are_caught(spark):
    texts, y = toxic_texts()
    model = toxicity.train(texts, y)
    clean = texts[1]
    rows = [(0, clean), (1, clean + " dreadfulness"), (2, clean + " dreadfulnes"), (3, clean + " despicabl"), (4, None), (5, ""), (6, "!!! ...")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert found[0] < 0.5 <= min(found[1], found[2], found[3])
    assert found[4] == found[5] == found[6]
    assert toxicity.score(docs, model).columns == docs.columns
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_slices_of_a_long_text_give_the_same_bag(monkeypatch):
    table = toxicity.letter_table()
    text = "Some wörds, of d1fferent kinds; 漢字 😀 end " * 50
    whole = np.sort(np.concatenate(list(toxicity.bags(text, table))))
    for size in (7, 64, 1000):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert np.array_equal(np.sort(np.concatenate(list(toxicity.bags(text, table)))), whole)


def test_fit_without_both_classes():
    assert toxicity.train([], np.empty(0, int)).bias == 0.0
    assert toxicity.train(["a"] * 5, np.zeros(5, int)).bias < 0 < toxicity.train(["a"] * 5, np.ones(5, int)).bias


def test_sample_is_bounded_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 3)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 5)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "x"), (7, "other"), (8, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (4, None), (6, 1)], "doc_id bigint, toxic int")
    texts, y = toxicity.sample(docs, labels)
    assert (y.sum(), len(y)) == (3, 8)
    again = toxicity.sample(docs.repartition(3), labels.repartition(2))
    assert again[0] == texts and (again[1] == y).all()
    assert toxicity.sample(docs, labels.where("false"))[0] == []


def test_language_query_on_held_out_rows(spark):
    from textlode.llm.queries import language_id

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = language_id(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in own) >= 0.98 * len(own)


def small_model():
    texts = {"a": "aba abab baab aabb", "b": "bcb cbcb ccbb bccb a"}
    table = language.letters()
    rows = []
    for lang, text in texts.items():
        keys, n = np.unique(np.concatenate(list(language.grams(text, table))), return_counts=True)
        rows += [(lang, int(np.uint64(k).view(np.int64)), int(c)) for k, c in zip(keys, n, strict=True)]
    return language.fit(pd.DataFrame(rows, columns=["lang", "gram", "n"]))


def test_probabilities_of_a_context_sum_to_one():
    """Over all characters seen and one for the rest, as the lowest order spreads its weight over these."""
    model = small_model()
    letters = [0, *map(ord, "abc")]
    for context in product([0, *map(ord, "abcx")], repeat=3):
        keys = np.array([sum(c << 16 * (3 - i) for i, c in enumerate((*context, last))) for last in [*letters, 0xFFFF]], np.uint64)
        total = np.exp(language.log_probs(model, keys).astype(float)).sum(0)
        assert np.allclose(total, 1.0, atol=1e-5), context


def test_slices_of_a_long_text_give_the_same_grams(monkeypatch):
    table = language.letters()
    text = "Some wörds -- of 12 kinds; 漢字 😀  end " * 40
    whole = np.concatenate(list(language.grams(text, table)))
    for size in (5, 64, 999):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.array_equal(np.concatenate(list(language.grams(text, table))), whole)


def test_language_edge_rows(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("der die und das " * 9, "de"), ("the and of with " * 9, "en")] * 12)]
    rows += [(100, None, "de", 1), (101, "12 !? \n", "en", 1), (102, "", None, 1), (None, "der das", None, 1), (103, "𐐀𐐁", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    model = language.train(docs)
    found = language.predict(docs, model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"]
    assert [got[i]["lang_pred"] for i in (0, 1, 100, 101, 102, None)] == ["de", "en", "und", "und", "und", "de"]
    assert got[103]["lang_pred"] in ("de", "en") and not got[103]["accepted"]
    assert got[100]["score"] == 0 and got[0]["score"] > 0.9 and got[0]["accepted"]
    empty = language.train(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).count() == 0


def test_no_ngram_is_cut_from_a_model_of_many_shards(spark, monkeypatch):
    """However small the shards: all counts stay, a language of few rows among them, and results are those of the whole model."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "big") for i in range(60)] + [(100, "żółw gęś jaźń", "rare")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = language.train(docs)
    monkeypatch.setattr(language, "SHARD_CELLS", 400)
    monkeypatch.setattr(language, "MODEL_ENTRIES", 200, raising=False)
    cut = language.train(docs)
    assert len(getattr(whole, "shards", [0])) == 1 and len(getattr(cut, "shards", [])) > 5
    counts = language.count_grams(docs).toPandas()
    table = language.letters()
    one = language.fit(counts)
    assert one.langs == cut.langs == ["big", "rare"]
    for text in (rows[0][1], rows[-1][1], "zupa aeio 12 gęsi"):
        keys = np.concatenate(list(language.grams(text, table)))
        want = -language.log_probs(one, keys).sum(0, dtype=float)
        total, n = np.zeros((1, 2)), np.zeros(1, int)
        for first, behind, shard in language.opened(cut.shards):
            language.add_nats(total, n, [text], first, behind, shard, table)
        assert n[0] == len(keys) and np.allclose(total[0], want, rtol=1e-4)
    held = sum(len(shard.grams[-1][0]) for _, _, shard in language.opened(cut.shards))
    assert held == counts["gram"].nunique()
    a, b = ({r["doc_id"]: r for r in language.predict(docs, m).collect()} for m in (whole, cut))
    assert a[100]["lang_pred"] == b[100]["lang_pred"] == "rare"
    assert all(a[i]["lang_pred"] == b[i]["lang_pred"] and abs(a[i]["score"] - b[i]["score"]) < 1e-3 for i in a)


def test_sample_skips_long_texts_and_finds_labels_of_given_documents(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, "x" * (500 if i % 5 == 0 else 10)) for i in range(100)], "doc_id bigint, text string")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1000)
    texts, y = toxicity.sample(docs, labels)
    # All 80 short texts, although long ones come between them in the order; what is left holds no other.
    assert len(texts) >= 80 and sum(map(len, texts)) <= 1000 and set(map(len, texts)) == {10} and 0 < y.sum() < len(y)
    first = docs.withColumn("text", F.when(F.xxhash64("doc_id", F.lit(1)) == docs.agg(F.min(F.xxhash64("doc_id", F.lit(1)))).first()[0], "y" * 2000).otherwise("z"))
    assert len(toxicity.sample(first, labels)[0]) == 99
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 5)
    monkeypatch.setattr(toxicity, "CLEAN_ROWS", 10)
    few = docs.where("doc_id >= 90 AND doc_id % 5 > 0")
    assert len(toxicity.sample(few, labels)[0]) == 8


def test_no_document_goes_without_a_model(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id bigint, text string")
    model = toxicity.train(*toxicity.sample(docs, spark.createDataFrame([], "doc_id bigint, toxic int")))
    assert toxicity.without_toxic(docs, model).count() == 2


def test_toxic_words_of_a_smaller_language_get_weight(spark):
    """Of 1,500 texts 36 are in the smaller language, 12 of them toxic: fewer than one in a hundred."""
    texts, y = toxic_texts(1464)
    rng = random.Random(3)
    words = ["".join(rng.choice("абвгдежзик") for _ in range(rng.randrange(3, 8))) for _ in range(60)]

    def small(bad):
        return " ".join([*(rng.choice(words) for _ in range(20)), *["мерзопуфыщ"] * bad])

    texts += [small(i % 3 == 0) for i in range(36)]
    model = toxicity.train(texts, np.r_[y, [int(i % 3 == 0) for i in range(36)]])
    docs = spark.createDataFrame([(i, small(i % 2)) for i in range(40)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum(found[i] >= 0.5 for i in range(1, 40, 2)) >= 15
    assert sum(found[i] < 0.5 for i in range(0, 40, 2)) >= 18


def plain_kneser_ney(texts, order=4):
    """Log probability of an n-gram by the textbook, with dictionaries of strings; a border is a blank."""
    from collections import Counter, defaultdict

    counts = {k: Counter() for k in range(1, order + 1)}
    for text in texts:
        words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
        row = " " * (order - 1) + " ".join(words) + " "
        counts[order].update(row[i : i + order] for i in range(len(row) - order + 1) if words)
    for k in range(order - 1, 0, -1):
        counts[k].update(gram[1:] for gram in counts[k + 1])
    cuts = {k: language.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for k, c in counts.items()}
    totals, kinds = defaultdict(int), defaultdict(int)
    for k, c in counts.items():
        for gram, n in c.items():
            totals[k, gram[:-1]] += n
            kinds[k, gram[:-1]] += 1

    def probability(gram, floor):
        if not gram:
            return floor
        k, context = len(gram), gram[:-1]
        below = probability(gram[1:], floor)
        if (k, context) not in totals:
            return below
        n = counts[k][gram]
        return (n - cuts[k] if n else 0) / totals[k, context] + cuts[k] * kinds[k, context] / totals[k, context] * below

    return probability, {gram for gram in counts[1]}


def test_probabilities_equal_plain_kneser_ney(spark):
    texts = {
        "en": ["The cat sat on the mat.", "the Hat; the bat, the rat", "a cat and a rat", "", "...", "sat"],
        "de": ["Die Katze saß auf der Matte", "der Hut, die Ratte", "ä ö ü", "die die die Katze"],
    }
    rows = [(text, lang) for lang, own in texts.items() for text in own]
    counts = language.count_grams(spark.createDataFrame(rows, "text string, lang string").repartition(3)).toPandas()
    model = language.fit(counts)
    plain = {lang: plain_kneser_ney(own) for lang, own in texts.items()}
    floor = 1.0 / (len(plain["en"][1] | plain["de"][1]) + 1)
    for gram in ["   t", "the ", "cat ", " the", "katz", "e ka", "zzzz", "hexe", "aß a", "q   ", "atte"]:
        key = 0
        for c in gram:
            key = key << 16 | (0 if c == " " else ord(c))
        got = language.log_probs(model, np.array([key], np.uint64))[0]
        for column, lang in enumerate(model.langs):
            assert got[column] == pytest.approx(np.log(plain[lang][0](gram, floor)), abs=1e-4), (gram, lang)


def test_long_texts_do_not_empty_the_calibration(spark, monkeypatch):
    """Wherever the order puts them: the longest give way, the others stay."""
    monkeypatch.setattr(language, "CALIBRATION_CHARS", 1000)
    rows = [(i, "word " * (1000 if i < 5 else 2), "en" if i % 2 else "de") for i in range(60)] + [(None, "no id", "en"), (None, "word " * 900, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    texts, truth = language.calibration(docs, "doc_id", "text", "lang")
    assert len(texts) == len(truth) == 56 and max(map(len, texts)) <= 10
    assert language.calibration(docs.where("doc_id < 5"), "doc_id", "text", "lang") == ([], [])
    assert language.train(docs.where("doc_id < 5")).langs == ["de", "en"]


def test_rounds_keep_every_batch():
    batches = [pd.Series(["abc", None]), pd.Series([], dtype=object), pd.Series(["x" * 10]), pd.Series(["y"])]
    for chars in (0, 3, 4, 14, 100):
        found = list(language.rounds(iter(batches), chars))
        assert [id(b) for held in found for b in held] == [id(b) for b in batches]
    assert len(list(language.rounds(iter(batches), 0))) == 4 and len(list(language.rounds(iter(batches), 100))) == 1


def test_calibration_reads_all_labelled_rows(spark, monkeypatch):
    """Temperature and limits are those of all labelled texts, copies among them, however small the sample of old was."""
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for lang, letters in (("a", "abcdefg"), ("b", "efghijk"))}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(1 + i % 9)), "ab"[i % 2]) for i in range(300)]
    rows += [(i, "abc bcd", "a") for i in range(300, 340)] + [(400, "zzz qqq", "b"), (401, "12", "a"), (402, None, "a"), (403, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    monkeypatch.setattr(language, "CALIBRATION_ROWS", 20, raising=False)
    monkeypatch.setattr(language, "CALIBRATION_CHARS", 300, raising=False)
    for cells in (language.SHARD_CELLS, 300):
        monkeypatch.setattr(language, "SHARD_CELLS", cells)
        model = language.train(docs)
        texts = [(text, "ab".index(lang)) for _, text, lang in rows if text and lang and text != "12"]
        total, n, table = np.zeros((len(texts), 2)), np.zeros(len(texts), int), language.letters()
        for first, behind, shard in language.opened(model.shards):
            language.add_nats(total, n, [text for text, _ in texts], first, behind, shard, table)
        h, y = total / n[:, None], np.array([own for _, own in texts])
        loss = [np.log(np.exp((h[np.arange(len(y)), y][:, None] - h) * t).sum(1)).mean() for t in language.TEMPERATURES]
        assert model.temperature == language.TEMPERATURES[int(np.argmin(loss))]
        assert np.allclose(model.limits, [np.quantile(h[y == i, i], language.ACCEPTED_SHARE) for i in (0, 1)], rtol=1e-9)
