"""Quality rules: counts against plain Python, the label model against a plain one, edge rows."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from textlode.llm import quality
from textlode.llm.queries import quality_rules

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c",
    "a b c d a b c",
    "x x x x",
    "line one\nline one\n\n\nline two\n line one\nline one",
    "nbsp is no\x0bblank #*$ %&|<>!",
    "😀 ñ é",
    "w " * 20000,
    " ".join(f"w{i}" for i in range(300)),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in rows.withColumn("s", quality.text_stats(F.col("text"))).collect():
        assert tuple(r["s"][c] for c in NAMES) == plain(r["text"]), r["text"]


def test_query_equals_plain_counts_and_base_test(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, repeated = want = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in NAMES) == want
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def plain_fit(counts, k):
    """The same expectation-maximisation, in plain Python."""
    votes = {p: [p // 3**i % 3 for i in range(k)] for p in counts}
    good, tables = quality.START_GOOD, {c: [list(quality.START[c]) for _ in range(k)] for c in ("good", "bad")}

    def posterior(p):
        odds = math.log(good) - math.log(1 - good)
        for i, v in enumerate(votes[p]):
            odds += math.log(tables["good"][i][v]) - math.log(tables["bad"][i][v])
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ITERATIONS):
        q = {p: posterior(p) * n for p, n in counts.items()}
        n, all_q = sum(counts.values()), sum(q.values())
        new = {"good": [], "bad": []}
        for c in new:
            mass = {p: q[p] if c == "good" else counts[p] - q[p] for p in counts}
            whole = sum(mass.values()) + quality.PRIOR_ROWS
            for i in range(k):
                new[c].append(
                    [(sum(m for p, m in mass.items() if votes[p][i] == v) + quality.PRIOR_ROWS * quality.START[c][v]) / whole for v in range(3)]
                )
        good = (all_q + quality.PRIOR_ROWS * quality.START_GOOD) / (n + quality.PRIOR_ROWS)
        tables = new
    return {p: posterior(p) for p in counts}


def test_label_model_equals_plain_one(spark):
    k = len(quality.RULES)
    clean = sum(quality.GOOD * 3**i for i in range(k))
    counts = {clean: 900, clean - 2: 80, clean - 1: 30, clean - 2 * 3: 12, clean - 2 * 3 - 2 * 9: 9, 0: 3, 1: 0}
    rows = quality.fit_votes(spark.createDataFrame(list(counts.items()), "pattern int, n bigint")).collect()
    want = plain_fit(counts, k)
    assert len(rows) == len(counts)
    for r in rows:
        assert math.isclose(r["posterior"], want[r["pattern"]], rel_tol=1e-6, abs_tol=1e-12)
        assert all(0 <= a <= 1 for a in r["accuracies"])


def test_junk_goes_and_clean_text_stays(spark):
    clean = [" ".join(f"word{(i * 7 + j * 13) % 997}{'.' if j % 9 == 8 else ''}" for j in range(120)) for i in range(60)]
    junk = [" ".join(f"w{(i * 5 + j * 11) % 991}###" for j in range(120)) for i in range(8)]
    rows = [(i, t, "x") for i, t in enumerate([*clean, *junk, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(60))


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}." for i in range(60)))] * 3, "doc_id bigint, text string")
    assert quality.quality_verdicts(docs).count() == 3
    assert quality.quality_verdicts(docs.where("false")).count() == 0


def test_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    plan = quality.quality_verdicts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
