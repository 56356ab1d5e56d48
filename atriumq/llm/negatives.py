"""Hard negatives by a full score sort of each anchor.

Components become integers, floor(256 x), and a row's score is its integer inner product with the anchor.
Rows lie in blocks and anchors in packs; every pack meets every block. A first scan finds each anchor's
positives, its best rows of the same label. A second scan lexsorts all rows of other labels in a block
by score and id, finds by binary search where each positive's upper limit lies in that order, and reads
the next k entries down to the lower limit. The k first of all blocks are among the k first of each,
so what leaves a task is k rows for an anchor, a positive and a chunk of blocks, and the merge is exact.

Defined results: rows whose label, id or vector is null or whose vector holds a null or non-finite
component take no part, nor do vectors of another length than most (ties: the longer); of rows that
share an id the one of least label, then least integer components, stands; scores beyond 2**56 in size
are held there; ties go to the smaller id; an anchor without positives, and a positive without a
negative within its limits, have no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, table, written

#: Vectors of a block and anchors of a pack, at most and, to fill small clusters, at least; blocks that a task takes in a row.
BLOCK, LEAST_BLOCK, ANCHORS, LEAST_ANCHORS, CHUNK = 65_536, 4096, 4096, 64, 16
#: Anchors whose scores with a block stand in memory at once.
AT_ONCE = 32
#: Sizes of scores beyond this are held there.
MOST = 1 << 56
PACKED = "block int, ids binary, labels binary, kind string, x binary, more binary"


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows as int64, exact: in doubles where no sum can leave their 53 bits."""
    bound = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(x).T, -MOST, MOST).astype(np.int64)


def first(keys: tuple[np.ndarray, ...], score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k entries of each key, by score downwards and id upwards, in that order."""
    order = np.lexsort((ids, -score, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def positives_in(a_ids, a_labels, a, more, ids, labels, x, k: int, limits) -> list[np.ndarray]:
    """(anchor, anchor, row, score, score) of the first k rows of a block that share an anchor's label."""
    out = []
    for lo in range(0, len(a), AT_ONCE):
        near = scores(a[lo : lo + AT_ONCE], x)
        for i, row in enumerate(near, lo):
            other = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]))
            best = other[np.lexsort((ids[other], -row[other]))[:k]]
            out.append(np.stack([np.full(len(best), a_ids[i]), np.full(len(best), a_ids[i]), ids[best], row[best], row[best]]))
    return out


def negatives_in(a_ids, a_labels, a, more, ids, labels, x, k: int, limits) -> list[np.ndarray]:
    """(anchor, positive, row, positive's score, score) of the first k rows of a block within each positive's limits."""
    low, high = limits
    n, at, p_ids, p_scores = more
    out = []
    for lo in range(0, len(a), AT_ONCE):
        near = scores(a[lo : lo + AT_ONCE], x)
        for i, row in enumerate(near, lo):
            other = np.flatnonzero(labels != a_labels[i])
            order = other[np.lexsort((ids[other], -row[other]))]
            down = -row[order]  # ascending
            for p, ps in zip(p_ids[at[i] : at[i] + n[i]].tolist(), p_scores[at[i] : at[i] + n[i]].tolist()):
                most, least = high * ps // 100, -(-low * ps // 100)
                begin = int(np.searchsorted(down, -most, side="left"))
                read = order[begin : begin + k]
                read = read[row[read] >= least]
                m = len(read)
                out.append(np.stack([np.full(m, a_ids[i]), np.full(m, p), ids[read], np.full(m, ps), row[read]]))
    return out


def _packed(group: pa.Table) -> pa.Table:
    """One row of a group: ids ascending, labels, integer components in the narrowest kind, and positives where there are any."""
    ids, labels = group.column("vec_id").to_numpy(), group.column("label").to_numpy()
    x = np.floor(256.0 * group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
    order = np.lexsort((*x.T[::-1], labels, ids))
    order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
    reach = np.abs(x).max(initial=0)
    kind = "<i2" if reach < 2**15 else "<i4" if reach < 2**31 else "<f8"
    more = b""
    if "p" in group.column_names:
        lists = group.column("p").combine_chunks().take(pa.array(order))
        n, values = np.diff(lists.offsets.to_numpy()), lists.flatten()
        more = np.concatenate([n, np.cumsum(n) - n, values.field("vec_id").to_numpy(), -values.field("down").to_numpy()]).astype(np.int64).tobytes()
    cells = {"block": group.column("block").slice(0, 1), "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "kind": [kind], "x": [x[order].astype(kind).tobytes()], "more": [more]}
    return pa.table(cells)


def _met(packs: DataFrame, index: DataFrame, n_packs: int, n_chunks: int, dim: int, k: int, kernel: Callable, limits=None) -> DataFrame:
    """Every pack of anchors with every chunk of blocks: (anchor, positive, row, positive_score, score), the k first of each chunk."""
    heads = packs.withColumnRenamed("block", "pack").select("pack", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), F.lit(-1).alias("block"), "ids", "labels", "kind", "x", "more")
    bodies = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack"), (F.col("block") / CHUNK).cast("int").alias("chunk"), "block", "ids", "labels", "kind", "x", "more")
    met = heads.unionByName(bodies).repartition("pack", "chunk").sortWithinPartitions("pack", "chunk", "block")
    names = ["anchor_id", "positive_id", "vec_id", "positive_score", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = head = None
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            got = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
            found.clear()
            best = first((got[0], got[1]), got[4], got[2], k)
            return pa.RecordBatch.from_arrays([pa.array(c[best]) for c in got], names)

        for batch in batches:
            for pack, chunk, block, ids, labels, kind, x, more in zip(*(batch.column(c) for c in ("pack", "chunk", "block", "ids", "labels", "kind", "x", "more"))):
                ids, labels = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64)
                x = np.frombuffer(x.as_buffer(), kind.as_py()).reshape(-1, dim).astype(np.float64)
                if block.as_py() < 0:
                    if now is not None:
                        yield out()
                    now, extra, n = (pack, chunk), np.frombuffer(more.as_buffer(), np.int64), len(ids)
                    rest = extra[2 * n :]
                    head = ids, labels, x, (extra[:n], extra[n : 2 * n], rest[: len(rest) // 2], rest[len(rest) // 2 :])
                elif now == (pack, chunk):  # a pack without anchors has no head
                    found.extend(kernel(*head, ids, labels, x, k, limits))
        if now is not None:
            yield out()

    return met.mapInArrow(frugal(scan), ", ".join(f"{c} long" for c in names))


def hard_negatives(
    vectors: DataFrame, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for ids divisible by ``every``, the first k rows
    of other labels that score between ``low`` and ``high`` percent of each of the anchor's first ``positives`` rows of its label."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", number))
    sizes = sorted(((r["count"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect()), reverse=True)
    if not sizes or not sizes[0][1]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    total, dim = sizes[0]
    rows = rows.where(F.size("v") == dim)
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    cores = spark.sparkContext.defaultParallelism
    count = lambda n, most, least: max(1, -(-n // most), min(cores, -(-n // least)))
    n_blocks, n_packs = count(total, BLOCK, LEAST_BLOCK), count(anchors.count(), ANCHORS, LEAST_ANCHORS)
    n_chunks = -(-n_blocks // CHUNK)
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(_packed, PACKED)
    index = written(dealt(rows, n_blocks), "blocks")

    same = _met(dealt(anchors, n_packs), index, n_packs, n_chunks, dim, positives, positives_in)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    same = same.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    lists = same.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("p"))
    with_lists = anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _met(dealt(with_lists, n_packs), index, n_packs, n_chunks, dim, k, negatives_in, (low, high))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


ORACLE = """
WITH rows_ AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (SELECT p.anchor_id, p.positive_id, ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS n, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE n <= 5
"""
