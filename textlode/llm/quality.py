"""Quality rules by weak supervision: rules vote or abstain, a latent-class model weighs them.

Native: column expressions and one small aggregate only.

Each rule looks at one statistic of a text and votes bad, abstains or votes good. Documents are counted by their pattern
of votes, at most 3 ** len(RULES) patterns whatever the size of the corpus. Expectation-maximisation over that
table estimates, for each rule and each hidden class, how often it casts each vote, and with them the posterior probability
that a document is good. A document is kept if its posterior reaches `threshold`; no rule can reject it alone unless
the data show that the rule is accurate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import BLANKS, let, staged

SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Vote shares the model starts from and is drawn to by PRIOR_ROWS made-up rows of either class: rules are assumed to be right
#: more often than wrong, and a bad vote to be rarer among good texts than among bad ones.
START = {"bad": (0.4, 0.15, 0.45), "good": (0.01, 0.09, 0.9)}
START_GOOD = 0.8
PRIOR_ROWS = 2.0
ITERATIONS = 40


def _kept_chars(text: Column, dropped: str) -> Column:
    return F.length(F.translate(text, dropped, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more in the text, its first place included.

    Windows are compared by a 64-bit hash inside one text.
    """

    def windows(w):
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(places):
        # Each window covers three words, less what the next one covers too.
        new = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    def places(hashes):
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            order,
            lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hashes):
        alike = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(alike, let(places(hashes), covered)).otherwise(F.lit(0))

    return let(windows(words), count)


def text_stats(text: Column) -> Column:
    """Struct of counts of a whole text; a null or empty text has zero of everything.

    Words are runs of characters other than BLANKS; lines are separated by line feeds and count only with a word.
    """
    text = F.coalesce(text, F.lit(""))

    def stats(t):
        bare = F.btrim(t, F.lit(BLANKS))
        words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        return let(
            words,
            lambda w: let(
                lines,
                lambda rows: F.struct(
                    F.size(w).cast("bigint").alias("n_words"),
                    _kept_chars(t, BLANKS).cast("bigint").alias("word_chars"),
                    (F.length(t) - _kept_chars(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
                    (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint").alias("n_dup_lines"),
                    repeated_words(w).cast("bigint").alias("n_repeat_words"),
                    F.size(rows).cast("bigint").alias("n_lines"),
                    (F.length(t) - _kept_chars(t, MARKS)).cast("bigint").alias("n_marks"),
                    (F.length(t) - _kept_chars(t, "!")).cast("bigint").alias("n_exclaims"),
                ),
            ),
        )

    return let(text, stats)


def _vote(value: Column, bad: Column, good: Column) -> Column:
    """A rule without evidence (null value) abstains."""
    return F.when(value.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def _votes(s: Column) -> list[Column]:
    def share(part, whole):
        return F.when(s[whole] > 0, s[part] / s[whole])

    symbols, repeats = share("n_symbols", "word_chars"), share("n_repeat_words", "n_words")
    lines, letters = share("n_dup_lines", "n_lines"), share("word_chars", "n_words")
    marks, shouts = share("n_marks", "n_words"), share("n_exclaims", "n_words")
    return [
        _vote(symbols, symbols > 0.05, symbols < 0.01),
        _vote(repeats, repeats > 0.3, repeats < 0.1),
        _vote(lines, lines > 0.4, lines < 0.2),
        _vote(letters, (letters < 2.5) | (letters > 9.0), (letters > 3.5) & (letters < 7.0)),
        _vote(marks, (marks < 0.02) | (marks > 1.0), (marks > 0.04) & (marks < 0.5)),
        _vote(shouts, shouts > 0.5, shouts < 0.1),
    ]


RULES = ("symbols", "repeated_words", "repeated_lines", "word_length", "marks", "exclaims")


def pattern_of(stats: Column) -> Column:
    """The votes of all rules as one number in base 3, the first rule lowest."""
    total = F.lit(0)
    for i, vote in enumerate(_votes(stats)):
        total = total + vote * 3**i
    return total.cast("int")


def vote_of(pattern: Column, rule: int) -> Column:
    return F.pmod(F.floor(pattern / 3**rule), F.lit(3)).cast("int")


def fit_votes(counts: DataFrame) -> DataFrame:
    """(pattern, n) -> (pattern, n, posterior, accuracies). At most 3 ** len(RULES) rows in and out.

    accuracies[i] is the estimated probability that rule i is right when it does not abstain. No rows give no rows.
    """
    k = len(RULES)

    def log_share(shares, p, i):
        return F.log(F.get(F.get(shares, F.lit(i)), p["votes"][i]))

    def posterior(state, p):
        odds = F.log(state["good"]) - F.log(1.0 - state["good"])
        for i in range(k):
            odds = odds + log_share(state["if_good"], p, i) - log_share(state["if_bad"], p, i)
        return 1.0 / (1.0 + F.exp(-odds))

    def total(rows, value):
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

    def shares(rows, weight, start):
        whole = total(rows, weight) + PRIOR_ROWS
        return F.array(
            *[
                F.array(
                    *[
                        (total(rows, lambda x, i=i, v=v: F.when(x["votes"][i] == v, weight(x)).otherwise(0.0)) + PRIOR_ROWS * start[v])
                        / whole
                        for v in range(3)
                    ]
                )
                for i in range(k)
            ]
        )

    def step(state, _):
        scored = F.transform(
            "rows", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (posterior(state, p) * p["n"]).alias("q"))
        )
        return let(
            scored,
            lambda rows: F.struct(
                ((total(rows, lambda x: x["q"]) + PRIOR_ROWS * START_GOOD) / (total(rows, lambda x: x["n"]) + PRIOR_ROWS)).alias("good"),
                shares(rows, lambda x: x["q"], START["good"]).alias("if_good"),
                shares(rows, lambda x: x["n"] - x["q"], START["bad"]).alias("if_bad"),
            ),
        )

    def constant(start):
        return F.array(*[F.array(*[F.lit(float(x)) for x in start]) for _ in range(k)])

    first = F.struct(
        F.lit(START_GOOD).alias("good"), constant(START["good"]).alias("if_good"), constant(START["bad"]).alias("if_bad")
    )
    votes = F.array(*[vote_of(F.col("pattern"), i) for i in range(k)])
    row = F.struct(F.col("pattern"), votes.alias("votes"), F.col("n").cast("double").alias("n"))
    # In the order of the patterns, so that sums of doubles are the same in every run.
    model = counts.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    model = model.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), first, step))

    def accuracy(state, i):
        right = state["good"] * state["if_good"][i][GOOD] + (1.0 - state["good"]) * state["if_bad"][i][BAD]
        wrong = state["good"] * state["if_good"][i][BAD] + (1.0 - state["good"]) * state["if_bad"][i][GOOD]
        return right / (right + wrong)

    return model.select(
        "state", F.explode("rows").alias("p")
    ).select(
        F.col("p.pattern").alias("pattern"),
        F.col("p.n").cast("bigint").alias("n"),
        posterior(F.col("state"), F.col("p")).alias("posterior"),
        F.array(*[accuracy(F.col("state"), i) for i in range(k)]).alias("accuracies"),
    )


def quality_verdicts(docs: DataFrame, text_col: str = "text", keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """Documents with a struct `_quality`: the text's counts, votes, posterior, base_failed and kept.

    All columns of `docs` stay, but for the text if `keep_text` is false; only a column named `_quality` would be
    replaced. Every row gives one row, repeated ones too. A null or empty text has no words and fails the base test (fewer
    than 50 words, or more than half of the words in repeated windows of three). An empty table gives an empty table. Counts are
    made once and written to the shared folder, because fitting and judging both read them.
    """
    stats = docs.withColumn("_quality", text_stats(F.col(text_col)))
    stats = stats.withColumn("_pattern", pattern_of(F.col("_quality")))
    stats = staged(stats if keep_text else stats.drop(text_col), "quality")
    q = F.col("_quality")
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    # The base test comes first: the model learns from the documents that pass it, so that the copied lines which the base test
    # finds anyway don't define what bad is. Patterns of failed documents only count nothing.
    counts = stats.groupBy(F.col("_pattern").alias("pattern")).agg(F.sum(F.when(failed, 0).otherwise(1)).alias("n"))
    # At most 3 ** len(RULES) = 729 rows.
    model = fit_votes(counts).select(F.col("pattern").alias("_pattern"), F.col("posterior").alias("_posterior"))
    out = stats.join(F.broadcast(model), "_pattern")
    out = out.withColumn(
        "_quality",
        q.withField("pattern", F.col("_pattern"))
        .withField("posterior", F.col("_posterior"))
        .withField("base_failed", failed)
        .withField("kept", ~failed & (F.col("_posterior") >= threshold)),
    )
    return out.drop("_pattern", "_posterior")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their columns."""
    return quality_verdicts(docs, text_col, threshold=threshold).where(F.col("_quality.kept")).select(*docs.columns)
