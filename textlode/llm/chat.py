"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation several times, each time with more turns. Every turn gets the hash of the conversation up to it: a
running sum of hashes of (place, role, text), 128 bits as four sums. A conversation whose last hash is the hash of a
proper prefix of another one is a snapshot of it; an anti-join drops it. Of equal conversations the smallest id stays. Only
the maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlode.llm.common import staged
from textlode.operators.scale import running_sums

#: Turns of a rendered part: longer conversations have several parts, so that no row grows without bound.
PART_TURNS = 256


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    out = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return out.where(F.col("conv_id").isNotNull())


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the distinct turns, place from 1 in the order of turn number (null first), role and text."""
    ones = turns.distinct().withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_sums(ones, ["conv_id"], ["turn", "role", "text"], {"_before": "_one"})
    return placed.select("conv_id", (F.col("_before") + 1).alias("place"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, h0 to h3) of numbered turns: the hashes are those of the conversation up to here.

    Running sums over ranges of the order, without the texts: a long conversation is no one task's work.
    """
    names = [f"h{i}" for i in range(4)]
    # Four sums of 32-bit hashes, 128 bits in all, which cannot overflow for 2 ** 31 turns.
    half = [F.xxhash64(F.lit(salt), "place", "role", "text").bitwiseAND(F.lit(2**32 - 1)).alias(f"_{h}") for salt, h in enumerate(names)]
    summed = running_sums(turns.select("conv_id", "place", *half), ["conv_id"], ["place"], {h: f"_{h}" for h in names})
    return summed.select("conv_id", "place", *[(F.col(h) + F.col(f"_{h}")).alias(h) for h in names])


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id): conversations that are no proper prefix of another one, and of equal ones that of the smallest id."""
    names = ["h0", "h1", "h2", "h3"]
    size = hashed.groupBy("conv_id").agg(F.max("place").alias("turns"))
    rows = hashed.select("conv_id", "place", *names).join(size, "conv_id")
    # A prefix is named by its length and hash; a hot first turn is one row per task before the shuffle.
    inner = rows.where("place < turns").select("place", *names).distinct()
    whole = rows.where("place = turns").groupBy("place", *names).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, ["place", *names], "left_anti").select("conv_id")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered in parts of PART_TURNS turns (part from 0).

    Turns are ordered by turn number (null first), then role and text (null as empty). Turns that occur twice count once; rows without
    conversation id are left out, other columns are not read. An empty table gives an empty table.
    """
    turns = staged(numbered_turns(_turns(turns, conv_col, turn_col, role_col, text_col)), "turns")
    hashed = staged(prefixes(turns), "prefixes")
    kept = turns.join(maximal(hashed), "conv_id", "left_semi")
    part = F.floor((F.col("place") - 1) / PART_TURNS).cast("int")
    kept = kept.select("conv_id", part.alias("part"), "place", render(F.col("role"), F.col("text")).alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    out = kept.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n_turns"), lines.alias("lines"))
    return out.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))
