"""Greedy choices made in rounds: what a loop over sorted rows would keep, decided for many rows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.checkpoint import dropped, kept


def independent(candidates: DataFrame, conflicts: DataFrame, rank: str, keys: Sequence[str] = ("floor",)) -> DataFrame:
    """The candidates (keys, rank, ...) that stay if they are taken by rank and each goes that meets one taken before, with ``round``.

    rank is unique within the keys; conflicts: (keys, a, b), two ranks that exclude each other, either way round.
    In a round a candidate stays if no open one of lower rank excludes it, and all that it excludes go. A round
    decides the lowest of every chain of conflicts, so rounds are as many as the longest chain of falling ranks."""
    keys = list(keys)
    ranks = candidates.select(*keys, rank)
    pairs = conflicts.where(F.col("a") != F.col("b")).select(*keys, F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    known = lambda df, c: df.join(ranks.withColumnRenamed(rank, c), [*keys, c], "left_semi")
    open_ = kept(known(known(pairs, "high"), "low"), "conflicts")
    gone, n = [], 0
    late: list[DataFrame] = []  # ranks and the round that decides them, where it is not the first
    while not open_.isEmpty():
        n += 1
        blocked = open_.select(*keys, F.col("high").alias("low")).distinct()
        first = open_.join(blocked, [*keys, "low"], "left_anti")  # nothing open excludes the low one: it stays
        out = kept(first.select(*keys, F.col("high").alias(rank)).distinct().withColumn("round", F.lit(n)), "gone")
        gone.append(out.drop("round"))
        went = out.drop("round")
        for c in ("high", "low"):
            open_ = open_.join(went.withColumnRenamed(rank, c), [*keys, c], "left_anti")
        before = open_
        open_ = kept(before, "conflicts")
        # What is still excluded by something is decided later.
        late.append(open_.select(*keys, F.col("high").alias(rank)).distinct())
    out = candidates
    for g in gone:
        out = out.join(g, [*keys, rank], "left_anti")
    rounds = None
    for k, x in enumerate(late):
        x = x.select(*keys, rank, F.lit(k + 2).alias("round"))
        rounds = x if rounds is None else rounds.unionByName(x)
    if rounds is None:
        return out.withColumn("round", F.lit(1))
    rounds = rounds.groupBy(*keys, rank).agg(F.max("round").alias("round"))
    return out.join(rounds, [*keys, rank], "left").withColumn("round", F.coalesce("round", F.lit(1)))
