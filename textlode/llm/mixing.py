"""Mixing sources to target weights by Poisson replication.

The size of each named source follows from one pre-aggregated count. A source that should make up the share w of the
mix is repeated at the rate w * total / size, on average. Each document draws its number of copies from a Poisson
distribution with that mean, by inverting the distribution at a number hashed from the seed and its id, so the draw is the same in
every run and needs no shuffle. Documents are exploded by their count and dealt to random places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Higher means are the sum of several draws, each with a mean up to this.
MEAN_PER_DRAW = 64.0
REST = None


def cumulative(mean: float) -> list[float]:
    """P(X <= k) of a Poisson variable for k = 0, 1, ..., until no 52-bit number lies beyond."""
    if mean <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while total < 1 - 2**-53 and k < mean + 16 * math.sqrt(mean) + 32:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def uniform(key: Column, salt: Column | str, seed: int) -> Column:
    """A number in [0, 1) of 52 bits hashed from the key."""
    salt = F.lit(salt) if isinstance(salt, str) else salt.cast("string")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), salt, key)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / float(2**52)


def poisson(key: Column, mean: float, seed: int) -> Column:
    """A Poisson draw with this mean, fixed by the key and the seed."""
    draws = max(1, math.ceil(mean / MEAN_PER_DRAW))
    steps = F.array(*[F.lit(x) for x in cumulative(mean / draws)])

    def add(total, draw):
        return total + F.size(F.filter(steps, lambda step: step <= uniform(key, draw, seed)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0), add)


def source_rates(docs: DataFrame, weights: dict, source_col: str = "source", size: Column | None = None) -> dict:
    """Mean number of copies of each named source; weights[REST] is that of all other sources together, null included.

    Weights need not sum to 1. Sources without rows have rate 0. The mix has about the size of the input.
    """
    named = [s for s in weights if s is not REST]
    group = F.when(F.col(source_col).isin(*named), F.col(source_col)) if named else F.lit(None).cast("string")
    size = F.lit(1) if size is None else size
    # One row per name in `weights` at most.
    found = docs.groupBy(group.alias("g")).agg(F.sum(F.coalesce(size, F.lit(0)).cast("bigint")).alias("size")).collect()
    sizes = {row["g"]: row["size"] or 0 for row in found}
    total, shares = sum(sizes.values()), sum(weights.values())
    return {s: (w / shares) * total / sizes[s] if sizes.get(s) else 0.0 for s, w in weights.items()}


def mix(
    docs: DataFrame, weights: dict, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 8
) -> DataFrame:
    """The documents repeated to the target weights and shuffled, with copy (from 1) and shuffle_key; clashing columns are replaced.

    weights: source -> share of the mix in characters of text; REST -> the share of all other sources, without which these
    are left out. Texts that are null count as empty, which weigh nothing but are repeated like their source. A row without id draws by its text.
    Repeated rows draw the same count. Rows of a partition are in the order of shuffle_key, and partitions are dealt by its hash.
    """
    rates = source_rates(docs, weights, source_col, F.length(text_col))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    copies = F.lit(0)
    for source, rate in rates.items():
        count = poisson(F.col("_key"), rate, seed)
        named = [s for s in rates if s is not REST]
        mine = F.col(source_col) == source if source is not REST else ~F.coalesce(F.col(source_col).isin(*named), F.lit(False))
        copies = F.when(mine, count).otherwise(copies)
    out = docs.drop("copy", "shuffle_key").withColumn("_key", key).withColumn("_copies", copies).where("_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.col("_key"), F.col("copy").cast("string")))
    out = out.withColumn("shuffle_key", place)
    # Rows that are alike share a key: their place in the input parts them.
    out = out.repartition(F.col("shuffle_key"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    return out.sortWithinPartitions("shuffle_key").drop("_key", "_copies")
