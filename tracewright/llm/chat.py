"""Chat formatting of the maximal conversations of a log that also holds their earlier snapshots.

A conversation is its turns in order. Rolling hashes of its turn prefixes tell which logged conversations are prefixes
of longer ones; an anti-join keeps the others, one of each set of equal conversations (the smallest id), and renders
them. A prefix hash is two xors of 64-bit hashes of (position, role, text), so blocks of turns are hashed apart and
joined: no task sorts a whole hot conversation.

Nulls: rows without a conversation id belong to no conversation and go; a null turn sorts first, null roles and texts
are empty. Equal rows of a conversation count once; different rows with one turn number are ordered by role, then text.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turn numbers that one block spans.
BLOCK_TURNS = 256
SEEDS = ("prefix", "check")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct turns: conv_id, block, turn, role, text."""
    return conversations.where("conv_id is not null").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 40))).cast("long").alias("block"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, at, prefix, check): hashes of the first ``at`` turns, for every ``at`` from 1 to the length."""
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = turns.withColumn("nth", F.row_number().over(in_block)).join(sizes, ["conv_id", "block"]).withColumn("at", F.col("before") + F.col("nth"))
    hashed = placed.select("conv_id", "block", "at", *[F.xxhash64(F.lit(s), "at", "role", "text").alias(s) for s in SEEDS])
    whole = hashed.groupBy("conv_id", "block").agg(*[F.bit_xor(s).alias(s) for s in SEEDS]).select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in SEEDS])
    running = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "block", "at", *[F.bit_xor(s).over(running).alias(s) for s in SEEDS])
    return rolled.join(whole, ["conv_id", "block"]).select("conv_id", "at", *[F.col(s).bitwiseXOR(F.col(f"{s}_before")).alias(s) for s in SEEDS])


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that are no proper prefix of another; one of each equal set."""
    rolled = stored(prefix_hashes(turns_of(conversations)), "prefixes")
    length = rolled.groupBy("conv_id").agg(F.max("at").alias("n_turns"))
    flagged = rolled.join(length, "conv_id")
    distinct = flagged.where("at = n_turns").groupBy("at", *SEEDS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = flagged.where("at < n_turns").select("at", *SEEDS).distinct()
    return distinct.join(proper, ["at", *SEEDS], "left_anti").select("conv_id", F.col("at").alias("n_turns"), "n_equal")


def render(conversations: DataFrame, keep: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """The kept conversations, each as one string of its turns in order."""
    rows = turns_of(conversations).join(keep.select("conv_id"), "conv_id", "left_semi")
    turn = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", "text")
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit(opening), t["role"], F.lit("\n"), t["text"], F.lit(f"{closing}\n")))
    return joined.join(keep, "conv_id").select("conv_id", "n_turns", "n_equal", F.array_join(line, "").alias("rendered"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the maximal conversations."""
    keep = stored(maximal(conversations), "maximal")
    return render(conversations, keep)


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, row_number() OVER w AS pos,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), h AS (
  SELECT conv_id, pos, md5(prefix) AS prefix_md5, max(pos) OVER (PARTITION BY conv_id) AS n_turns, prefix FROM p
), d AS (
  SELECT pos, prefix_md5, min(conv_id) AS conv_id, count(*) AS n_equal, min(prefix) AS rendered FROM h WHERE pos = n_turns GROUP BY pos, prefix_md5
)
SELECT d.conv_id, CAST(d.pos AS BIGINT) AS n_turns, CAST(d.n_equal AS BIGINT) AS n_equal, d.rendered
FROM d WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pos < h.n_turns AND h.pos = d.pos AND h.prefix_md5 = d.prefix_md5)
"""
