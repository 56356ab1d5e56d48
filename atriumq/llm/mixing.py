"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size is taken floor(r) times, and a balanced sample of its
documents once more, each with chance r - floor(r). The flight phase moves these inclusion
probabilities through the null space of two constraints, tokens and documents, until they are 0 or
1: within blocks of a source first, then over what the blocks left undecided, so no group grows with
the input. At last at most two documents a source are undecided; that landing problem takes the
rounding that comes nearest to the token total, then to the document total, and exchanges documents
where a source is so small that this is still over a hundredth off.

Sources are ordered by code point, null last; their weights repeat. Targets share ``share`` of all
sizes by weight, none above ``cap`` times its source's size; what is above is shared again.

Defined results: null and empty texts have size 0 and are not taken; a null source is a source; an
empty table gives no rows; repeated rows are separate documents; a text of any length is one document
of its size; other columns of the input are ignored. The same rows give the same sample, however they are
partitioned, but that of over BLOCK equal rows other ones may be taken.
"""

from __future__ import annotations

import bisect
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, table, written

#: Documents a block.
BLOCK = 2000
#: Up to so many sources, a row of facts for each is broadcast; beyond, it is joined like any table.
FEW_SOURCES = 10_000
_EPS = 1e-9


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place ``k`` in order of code point, null last: ranges sorted apart, then numbered on."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    kept = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    # One row a partition, whose number is that of the session's shuffle partitions at most.
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for p, n in sizes:
        base += [F.lit(p), F.lit(total)]
        total += n
    offset = F.element_at(F.create_map(*base), part) if base else F.lit(0)
    return kept.withColumn("k", (offset + at).cast("long")).drop("_m")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Sources (source, total) with ``k`` and what each is to give, ``target``: ``share`` of all sizes by weight, at
    most ``cap`` times its size. Each round fixes those above their cap and shares the excess again."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = written(_numbered(sources).withColumn("w", weight), "sources")
    # What is over its cap at some level of words a weight stays so at any higher one, so a number is all a round leaves.
    most = share * (rows.agg(F.sum("total")).first()[0] or 0)
    level, n_over = 0.0, -1
    while True:
        over = F.col("w") * level > cap * F.col("total")
        fixed, free, n = rows.agg(F.coalesce(F.sum(F.when(over, cap * F.col("total"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if n == n_over or not free:
            break
        level, n_over = max(0.0, most - fixed) / free, n
    return rows.withColumn("target", F.when(over, cap * F.col("total")).otherwise(F.col("w") * level)).drop("w")


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Moves chances to 0 or 1, all but at most two, keeping the sums of chances and of sizes times chances."""
    p, active = list(chances), []
    for i in range(len(p)):
        if p[i] < _EPS or p[i] > 1 - _EPS:
            p[i] = round(p[i])
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            # The null space of three documents under two constraints is a line.
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip(active, u):
                p[k] += step * x
                if p[k] < _EPS or p[k] > 1 - _EPS:
                    p[k] = float(round(p[k]))
            active = [k for k in active if 0 < p[k] < 1]
    return p


def land(sizes: list[float], chances: list[float], wanted: float) -> list[float]:
    """The last two chances rounded together, nearest to ``wanted`` words; where that is still over a
    hundredth off, as with a few long documents, decided ones are exchanged while it helps."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    base, best = sum(s for s, p in zip(sizes, chances) if p == 1), None
    for bits in range(1 << len(open_)):
        pick = [(bits >> k) & 1 for k in range(len(open_))]
        off = base + sum(sizes[i] * x for i, x in zip(open_, pick)) - wanted
        docs = sum(x - chances[i] for i, x in zip(open_, pick))
        best = min(best, (abs(off), abs(docs), pick, off)) if best else (abs(off), abs(docs), pick, off)
    out = list(chances)
    for i, x in zip(open_, best[2]):
        out[i] = float(x)
    off = best[3]
    for _ in range(4):
        if abs(off) <= 0.01 * wanted:
            break
        outside = sorted((sizes[i], i) for i, p in enumerate(out) if p == 0)
        moves = [(abs(off + (sizes[i] if p == 0 else -sizes[i])), (i,)) for i, p in enumerate(out)]
        for i, p in enumerate(out):
            if p == 1:
                at = bisect.bisect(outside, (sizes[i] - off,))
                moves += [(abs(off + s - sizes[i]), (i, j)) for s, j in outside[max(0, at - 1) : at + 1]]
        gain, flips = min(moves)
        if gain >= abs(off):
            break
        for i in flips:
            off += sizes[i] if out[i] == 0 else -sizes[i]
            out[i] = 1 - out[i]
    return out


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target (its source's) and
    taken (words the mix takes of it), besides the columns in ``carry``."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), *carry)
    # Carried columns stay in the table and are joined to the sample by row number; the flight sees narrow rows.
    stored = written(rows.withColumn("_k", F.monotonically_increasing_id()), "sizes")
    rows = stored.drop(*carry)
    # Rows repeated so often that their hash alone would fill a block are told apart by their number.
    often = written(rows.groupBy("source", "h").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("h").distinct(), "often")
    if not often.isEmpty():
        # Copies are numbered part by part of the table and then across parts, so no task sees all of them; which copy
        # has which number is all the same, as they are equal.
        part, told = F.shiftright("_k", 33).alias("part"), ["source", "h"]
        again = rows.join(often.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h"), "left_semi").withColumn("part", part)
        within = again.withColumn("n", F.row_number().over(Window.partitionBy("part", *told).orderBy("_k")))
        before = Window.partitionBy(*told).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = again.groupBy("part", *told).agg(F.count("*").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
        begins = begins.select(F.col("part").alias("_part"), F.col("source").alias("_source"), F.col("h").alias("_h"), "base")
        numbered = within.join(begins, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h")))
        numbered = numbered.withColumn("h", F.xxhash64("h", (F.col("base") + F.col("n")).cast("long"))).select(*rows.columns)
        rows = rows.join(often, "h", "left_anti").select(*rows.columns).unionByName(numbered)
        rows = written(rows, "sizes_apart")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    ratio = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    whole = F.floor(ratio + _EPS)
    facts = targets(sizes, weights, share, cap).select("source", F.col("k").alias("source_no"), F.col("total").alias("source_size"), "target", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("chance"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    facts = written(facts, "facts")
    n_sources, most = facts.agg(F.count("*"), F.max("blocks")).first()
    few = F.broadcast if n_sources <= FEW_SOURCES else lambda df: df
    at = rows.join(few(facts.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Documents without words, and sources that are taken a whole number of times, have nothing to decide.
    at = at.withColumn("p", F.when(F.col("size") > 0, F.col("chance")).otherwise(0.0)).drop("chance")
    kept = [c for c in at.columns if c not in ("blocks",)]
    at, done, left = at.select(*kept), [], (most or 0) * BLOCK
    is_open = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    turn = 0
    while True:
        # Blocks of the documents that are still open: as many as the largest number a source can have left.
        last = left <= BLOCK
        blocks = facts.select("source_no", spread(F.col("blocks"), turn).alias("blocks"))
        closed = at.where(~is_open)
        dealt = at.where(is_open).join(few(blocks), "source_no").withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")).cast("int")).drop("blocks")

        moved = dealt.groupBy("source_no", "block").applyInPandas(_decide(turn, last), at.schema)
        done.append(closed)
        if last:
            done.append(moved)
            break
        at = written(moved.select(*at.columns), "flight")
        left, turn = -(-left // BLOCK) * 2, turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    taken = F.col("size") * (F.col("whole") + (F.col("p") > 0.5).cast("long"))
    out = out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "_k")
    return out.join(stored.select("_k", *carry), "_k").drop("_k") if carry else out.drop("_k")


def _decide(turn: int, last: bool):
    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "size"], kind="stable")
        rng = random.Random(f"{group['source_no'].iloc[0]}/{group['block'].iloc[0]}/{turn}")
        sizes = group["size"].astype(float).tolist()
        p = flight(sizes, group["p"].tolist(), rng)
        group["p"] = land(sizes, p, sum(s * x for s, x in zip(sizes, group["p"]))) if last else p
        return group.drop(columns="block")

    return decide


def spread(blocks: Column, turn: int) -> Column:
    """Blocks of a source in a turn: every turn leaves two documents a block at most."""
    out = F.greatest(F.lit(1), blocks)
    for _ in range(turn):
        out = F.ceil(2 * out / BLOCK)
    return out


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
