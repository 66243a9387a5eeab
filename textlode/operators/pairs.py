"""Training pairs drawn from a labelled corpus.

Draws are rows of `spark.range`: each draw picks a class and positions in the class's random order,
which `rows_at` turns into row ids. No class is ever collected and no n^2 set of pairs is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.functions.keys import SEED, draw
from textlode.operators.cuts import keyed, range_lookup, rows_at
from textlode.operators.scale import running_sums, stage, with_sides
from textlode.operators.splits import share_out
from textlode.operators.tfidf import exploded, inverse_frequency, vectors


def class_table(df: DataFrame, label_col: str = "label") -> tuple[DataFrame, int]:
    """(label_id, label, n, start, everything) and the number of classes; `start` rows lie in earlier classes."""
    sizes = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = sizes.withColumn("_one", F.lit(1).cast("bigint"))
    table = stage(running_sums(sizes, [], ["label"], {"label_id": "_one", "start": "n"}).drop("_one"), "classes")
    facts = table.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")).first()
    return table.withColumn("everything", F.lit(facts["rows"]).cast("bigint")), facts["classes"]


def pick(df: DataFrame, id_col: str, label_col: str, wanted: DataFrame, seed: int) -> DataFrame:
    """Turn positions (grp, pos, total) into row ids."""
    return rows_at(keyed(df, id_col, label_col, "pair-order", seed), wanted)


def with_text(df: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add text_a and text_b to pairs."""
    return with_sides(pairs, df, ["pair_id"], id_col, text_col, "text")


def drawn_classes(df: DataFrame, label_col: str, draws: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(draw_id, label_id, label, n, start, everything): one class per draw, all classes alike likely.

    Classes with fewer than 2 rows give no draw. Also returns the class table and its size.
    """
    classes, count = class_table(df, label_col)
    ids = df.sparkSession.range(draws).withColumnRenamed("id", "draw_id")
    drawn = ids.withColumn("label_id", draw("draw_id", "label", seed) % F.lit(max(count, 1)))
    return drawn.join(classes, "label_id").where("n >= 2"), classes, count


def pair_positions(drawn: DataFrame, seed: int) -> DataFrame:
    """Add two different positions pos_a, pos_b within the drawn class."""
    shift = draw("draw_id", "second", seed) % (F.col("n") - 1)
    return drawn.withColumn("pos_a", draw("draw_id", "first", seed) % F.col("n")).withColumn(
        "pos_b", (F.col("pos_a") + 1 + shift) % F.col("n")
    )


def side(name: str, label: str, pos: str, total: str) -> Column:
    return F.struct(
        F.lit(name).alias("side"), F.col(label).alias("grp"), F.col(pos).alias("pos"), F.col(total).alias("total")
    )


def pivot_sides(picked: DataFrame, keys: list[str], sides: str) -> DataFrame:
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col("id"))).alias(f"id_{s}") for s in sides])


def positive_pairs(
    df: DataFrame,
    num_pairs: int = 10_000,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """Pairs of different rows of one class: (pair_id, label, id_a, id_b, text_a, text_b)."""
    drawn, _, _ = drawn_classes(df, label_col, num_pairs, seed)
    wanted = pair_positions(drawn, seed).select(
        F.col("draw_id").alias("pair_id"),
        F.col("label"),
        F.explode(F.array(side("a", "label", "pos_a", "n"), side("b", "label", "pos_b", "n"))).alias("s"),
    )
    picked = pick(df, id_col, label_col, wanted.select("pair_id", "label", "s.*"), seed)
    pairs = pivot_sides(picked, ["pair_id", "label"], "ab")
    return with_text(df, pairs, id_col, text_col)


def labelled_pairs(
    df: DataFrame,
    num_samples: int = 5_000,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str | None = "text",
    seed: int = SEED,
) -> DataFrame:
    """Each draw gives a positive pair (a, b, 1.0) and a negative pair (a, c, 0.0), c of another class.

    The other class is drawn uniformly over classes. Without `text_col` only ids are returned.
    """
    drawn, classes, count = drawn_classes(df, label_col, num_samples, seed)
    if count < 2:
        raise ValueError("negative pairs need at least 2 classes")
    others = classes.select(
        F.col("label_id").alias("other_id"), F.col("label").alias("other"), F.col("n").alias("other_n")
    )
    shift = draw("draw_id", "other", seed) % F.lit(max(count - 1, 1))
    drawn = pair_positions(drawn, seed).withColumn("other_id", (F.col("label_id") + 1 + shift) % F.lit(count))
    drawn = drawn.join(others, "other_id")
    drawn = drawn.withColumn("pos_c", draw("draw_id", "third", seed) % F.col("other_n"))
    sides = F.array(
        side("a", "label", "pos_a", "n"), side("b", "label", "pos_b", "n"), side("c", "other", "pos_c", "other_n")
    )
    wanted = drawn.select("draw_id", F.explode(sides).alias("s")).select("draw_id", "s.*")
    picked = pivot_sides(pick(df, id_col, label_col, wanted, seed), ["draw_id"], "abc")
    both = F.array(
        F.struct((F.col("draw_id") * 2).alias("pair_id"), F.col("id_b").alias("id_b"), F.lit(1.0).alias("label")),
        F.struct((F.col("draw_id") * 2 + 1).alias("pair_id"), F.col("id_c").alias("id_b"), F.lit(0.0).alias("label")),
    )
    pairs = picked.select("id_a", F.explode(both).alias("p")).select("p.pair_id", "id_a", "p.id_b", "p.label")
    return with_text(df, pairs, id_col, text_col) if text_col else pairs


def mixed_pairs(
    df: DataFrame,
    num_samples: int = 10_000,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str | None = "text",
    seed: int = SEED,
) -> DataFrame:
    """`labelled_pairs` from num_samples // 2 draws, in random order, at most num_samples rows."""
    pairs = labelled_pairs(df, num_samples // 2, id_col, label_col, text_col, seed)
    return pairs.orderBy(draw("pair_id", "shuffle", seed), "pair_id").limit(num_samples)


def distinct_draws(df: DataFrame, count: str, size: str, names: list[str], salt: str, seed: int, out: str) -> DataFrame:
    """Explode each row into `nth` = 0..count-1 and add `out`: different random numbers below `size`.

    The numbers are cut into `count` equal stretches and one is drawn from each, so all numbers are alike
    likely and none comes twice. `names` tells the rows apart. Decimals, as the number of pairs of a large class
    is beyond a bigint.
    """
    spread = df.where(F.col(count) > 0).withColumn(
        "nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count).cast("bigint") - 1))
    )
    parts = F.col(count).cast("decimal(14,0)")

    def edge(nth):
        product = nth.cast("decimal(14,0)") * F.col(size).cast("decimal(23,0)")
        # Divisible after the subtraction, so the quotient is exact.
        return ((product - product % parts) / parts).cast("decimal(23,0)")

    spread = spread.withColumns({"_low": edge(F.col("nth")), "_high": edge(F.col("nth") + 1)})
    roll = draw(F.concat_ws("-", *[F.col(c).cast("string") for c in [*names, "nth"]]), salt, seed)
    number = F.col("_low") + roll.cast("decimal(20,0)") % (F.col("_high") - F.col("_low"))
    return spread.withColumn(out, number.cast("decimal(23,0)")).drop("_low", "_high")


def outside_positions(drawn: DataFrame, candidates: int, seed: int) -> DataFrame:
    """Add nth and spot: up to `candidates` different positions outside the drawn class."""
    outside = F.col("everything") - F.col("n")
    sized = drawn.withColumns({"_outside": outside, "_count": F.least(F.lit(candidates), outside)})
    spread = distinct_draws(sized, "_count", "_outside", ["draw_id"], "candidate", seed, "spot")
    spot = F.col("spot").cast("bigint")
    # Step over the drawn class.
    spot = spot + F.when(spot < F.col("start"), 0).otherwise(F.col("n"))
    return spread.withColumn("spot", spot).drop("_outside", "_count")


#: Numbers of a draw's anchor and of its partner in the same class; candidates of other classes count from 0.
ANCHOR, PARTNER = -2, -1


def own_places(drawn: DataFrame) -> DataFrame:
    """(draw_id, nth, grp, pos, total): where the anchor and the partner of each draw stand in their class."""
    ends = [
        F.struct(F.lit(n).cast("bigint").alias("nth"), F.col("label").alias("grp"), F.col(pos).cast("bigint").alias("pos"), F.col("n").alias("total"))
        for n, pos in ((ANCHOR, "pos_a"), (PARTNER, "pos_b"))
    ]
    return drawn.select("draw_id", F.explode(F.array(*ends)).alias("e")).select("draw_id", "e.*")


def other_places(drawn: DataFrame, classes: DataFrame, candidates: int, seed: int) -> DataFrame:
    """(draw_id, nth, grp, pos, total): where the candidates of each draw stand in classes other than its own."""
    spots = outside_positions(drawn, candidates, seed).select("draw_id", "nth", "spot", "everything")
    ranges = classes.select(F.col("label").alias("grp"), "start", "n", F.col("n").alias("total"), "everything")
    found = range_lookup(spots, ranges, [], "spot", "everything").withColumnRenamed("_within", "pos")
    return found.select("draw_id", "nth", "grp", "pos", "total")


def hardest_of(df: DataFrame, members: DataFrame, candidates: int, id_col: str, text_col: str) -> DataFrame:
    """(draw_id, id_a, id_b, similarity): for each anchor the most similar of its candidates.

    `members` has (draw_id, nth, id) and is staged. Similarity is the TF-IDF cosine; ties go to the first candidate drawn. The
    term vectors of the documents wanted go to their draws once: a draw, which holds a bounded number of documents, is scored in place.
    """
    sought = members.where(F.col("nth") != PARTNER).select("draw_id", "nth", "id")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sought.select("id").distinct(), "id", "left_semi")
    found = vectors(stage(docs, "wanted"), stage(inverse_frequency(df, text_col), "idf")).join(sought, "id").select("draw_id", "nth", "length", "terms")
    terms = exploded(found.repartition("draw_id"), "draw_id", "nth")
    # A column a candidate: sums of products then need no lists.
    tries = range(candidates)
    met = terms.groupBy("draw_id", "term").agg(*[F.max(F.when(F.col("nth") == n, F.col("weight"))).alias(f"_{n}") for n in (ANCHOR, *tries)])
    products = [F.struct(F.lit(n).cast("bigint").alias("nth"), F.col(f"sum_{n}").alias("similarity")) for n in tries]
    scores = met.groupBy("draw_id").agg(*[F.sum(F.col(f"`_{ANCHOR}`") * F.col(f"_{n}")).alias(f"sum_{n}") for n in tries])
    scores = scores.select("draw_id", F.explode(F.array(*products)).alias("s")).select("draw_id", "s.*")
    scored = sought.join(scores, ["draw_id", "nth"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    # Sums come in any order, so equal texts may differ in the last digits: those must not decide.
    near = F.round("similarity", 9).alias("near")
    best = F.struct(near, (-F.col("nth")).alias("first"), F.col("id"), F.col("similarity"))
    anchor = F.col("nth") == ANCHOR
    found = scored.groupBy("draw_id").agg(F.max(F.when(anchor, F.col("id"))).alias("id_a"), F.max(F.when(~anchor, best)).alias("best"))
    return found.where("best IS NOT NULL").select("draw_id", "id_a", F.col("best.id").alias("id_b"), "best.similarity")


def hardest_negatives(
    df: DataFrame,
    anchors: DataFrame,
    classes: DataFrame,
    candidates: int,
    id_col: str,
    label_col: str,
    text_col: str,
    seed: int,
) -> DataFrame:
    """`hardest_of` for anchors already looked up: (draw_id, id_a, n, start, everything)."""
    found = pick(df, id_col, label_col, other_places(anchors, classes, candidates, seed), seed).select("draw_id", "nth", "id")
    known = anchors.select("draw_id", F.lit(ANCHOR).cast("bigint").alias("nth"), F.col("id_a").alias("id"))
    return hardest_of(df, stage(found.unionByName(known), "members"), candidates, id_col, text_col)


def hard_negative_pairs(
    df: DataFrame,
    num_samples: int = 10_000,
    candidates: int = 5,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """num_samples // 2 positive pairs (label 1), each with a hard negative of its anchor (label 0)."""
    draws = num_samples // 2
    drawn, classes, _ = drawn_classes(df, label_col, draws, seed)
    drawn = pair_positions(drawn, seed)
    # Anchors, partners and candidates are looked up at once.
    places = own_places(drawn).unionByName(other_places(drawn, classes, candidates, seed))
    members = stage(pick(df, id_col, label_col, places, seed).select("draw_id", "nth", "id"), "members")
    positives = ends_of(members)
    negatives = hardest_of(df, members, candidates, id_col, text_col)
    both = positives.select((F.col("draw_id") * 2).alias("pair_id"), "id_a", "id_b", F.lit(1).alias("label"))
    both = both.unionByName(
        negatives.select((F.col("draw_id") * 2 + 1).alias("pair_id"), "id_a", "id_b", F.lit(0).alias("label"))
    )
    return with_text(df, both, id_col, text_col)


def ends_of(members: DataFrame) -> DataFrame:
    """(draw_id, id_a, id_b): anchor and partner of each draw."""
    ends = {"id_a": ANCHOR, "id_b": PARTNER}
    found = members.where(F.col("nth") < 0).groupBy("draw_id")
    return found.agg(*[F.max(F.when(F.col("nth") == n, F.col("id"))).alias(name) for name, n in ends.items()])


def pair_of_number(df: DataFrame, number: str) -> DataFrame:
    """Add pos_a < pos_b: the pair of positions below n that a number below n(n-1)/2 stands for.

    Number r stands for the positions r mod n and, r div n + 1 places further on, going round.
    """
    first = F.expr(f"cast({number} % n as bigint)")
    second = F.expr(f"(cast({number} % n as bigint) + cast({number} div n as bigint) + 1) % n")
    return df.withColumns({"pos_a": F.least(first, second), "pos_b": F.greatest(first, second)})


def with_pair_counts(classes: DataFrame) -> DataFrame:
    """Add `pairs`, the number of unordered pairs of each class."""
    return classes.withColumn(
        "pairs", F.expr("cast(cast(n as decimal(18,0)) * cast(n - 1 as decimal(18,0)) / 2 as decimal(23,0))")
    )


def positive_combinations(
    df: DataFrame,
    num_samples: int = 1_000,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """Different unordered pairs of each class, min(all, num_samples // classes) of them."""
    classes, count = class_table(df, label_col)
    cap = num_samples // max(count, 1)
    quotas = with_pair_counts(classes).withColumn("take", F.least("pairs", F.lit(cap)).cast("bigint"))
    places = distinct_draws(quotas, "take", "pairs", ["label"], "combination", seed, "number")
    places = pair_of_number(places, "number")
    wanted = places.select(
        F.concat_ws("-", F.col("label").cast("string"), F.col("nth").cast("string")).alias("pair_id"),
        "label",
        F.explode(F.array(side("a", "label", "pos_a", "n"), side("b", "label", "pos_b", "n"))).alias("s"),
    )
    picked = pick(df, id_col, label_col, wanted.select("pair_id", "label", "s.*"), seed)
    pairs = pivot_sides(picked, ["pair_id", "label"], "ab")
    return with_text(df, pairs, id_col, text_col)


def validation_pairs(
    df: DataFrame,
    num_samples: int = 1_000,
    candidates: int = 5,
    id_col: str = "id",
    label_col: str = "label",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """A random sample of all positive pairs and of one hard negative for each of them.

    The full set is never formed: each class gets its share of the sample, and its share is drawn from the
    numbers of its pairs, an even number for the positive pair and an odd one for its negative.
    """
    classes, _ = class_table(df, label_col)
    items = with_pair_counts(classes).withColumns({"grp": F.col("label"), "items": F.col("pairs") * 2})
    wanted = F.least(F.col("_total"), F.lit(num_samples).cast("decimal(38,0)"))
    quotas = share_out(items, wanted, "items", "take").drop("grp")
    places = distinct_draws(quotas, "take", "items", ["label"], "validation", seed, "item")
    places = places.withColumns(
        {
            "draw_id": F.concat_ws("-", F.col("label").cast("string"), F.col("nth").cast("string")),
            "positive": F.col("item") % 2 == 0,
            "number": ((F.col("item") - F.col("item") % 2) / 2).cast("decimal(23,0)"),
        }
    )
    places = pair_of_number(places, "number")
    places = places.select("draw_id", "positive", "label", "pos_a", "pos_b", "n", "start", "everything")
    odd = other_places(places.where("not positive"), classes, candidates, seed)
    wanted = own_places(places.where("positive")).withColumn("positive", F.lit(True)).unionByName(
        own_places(places.where("not positive")).where(F.col("nth") == ANCHOR).unionByName(odd).withColumn("positive", F.lit(False))
    )
    members = stage(pick(df, id_col, label_col, wanted, seed).select("draw_id", "positive", "nth", "id"), "members")
    positives = ends_of(members.where("positive")).withColumn("label", F.lit(1))
    negatives = hardest_of(df, members.where("not positive"), candidates, id_col, text_col)
    negatives = negatives.select("draw_id", "id_a", "id_b", F.lit(0).alias("label"))
    both = positives.unionByName(negatives).withColumnRenamed("draw_id", "pair_id")
    return with_text(df, both, id_col, text_col)


def text_with_empty(df: DataFrame, id_col: str = "id", text_col: str = "text", label_id: str = "label_id") -> DataFrame:
    """Each text paired with the empty text, its class number as score."""
    return df.select(
        F.col(id_col).alias("pair_id"),
        F.col(text_col).alias("text_a"),
        F.lit("").alias("text_b"),
        F.col(label_id).cast("double").alias("label"),
    )
