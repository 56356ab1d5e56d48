"""Nearest neighbours by inner product with additive quantisation.

Every vector is the sum of one codeword of each codebook. Codebooks are full-dimensional and trained
on residuals; encoding searches them with a beam, scored by lookup. The index stores the codes and
the ratio of the vector's norm to its code's, nothing else. A query turns into one lookup table; a scan
adds table entries over all codes, block by block, and keeps a query's RERANK best of several blocks.
The RERANK best of all blocks are joined with their vectors by id and ranked again by the exact inner
product in double precision.

Queries and blocks of codes are packed rows: a pack of queries is sent once for every CHUNK of blocks, a
block of codes, some forty bytes a vector, once for every pack. All queries meet all blocks: with vectors
that fill their space evenly no coarse partition leaves out much, see README.

Equal vectors are indexed once, with the smallest ids that can be asked for: a query never needs
more than its k nearest and itself of one value. Equal queries are searched once.

Defined results: vectors that are null, zero, of another length than most, or holding null or
non-finite components take no part; with fewer candidates than k all are returned; ties go to the
smaller id; rows equal in id and vector count once, an id with several vectors takes part with each;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, table, written

#: Codebooks and codewords of each; beam width; vectors of the training sample.
BOOKS, WORDS, BEAM, SAMPLE = 32, 256, 4, 12_000
#: Codes of a block and queries of a pack, at most and, to fill small clusters, at least; blocks that a task scans in a row.
BLOCK, LEAST_BLOCK, QUERIES, LEAST_QUERIES, CHUNK = 65_536, 4096, 4096, 256, 16
#: Candidates of a query that are ranked exactly.
RERANK = 128


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means by Lloyd's steps from a random sample of the rows."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def fit(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, dimensions), each trained on what the ones before leave."""
    rng, rest, books = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(BOOKS):
        book = _means(rest, WORDS, rng)
        rest = rest - book[np.argmax(rest @ book.T - 0.5 * (book * book).sum(1), axis=1)]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, BOOKS) by beam search, and the norm ratio of each vector to its code."""
    n, d = x.shape
    x = x.astype(np.float32)
    rest, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x * x).sum(1)[:, None]
    for book in books:
        half = (book * book).sum(1)
        width = rest.shape[1]
        # Error of a beam after a codeword: its own less 2 <rest, word> plus the word's norm.
        after = (error[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, WORDS) + half).reshape(n, -1)
        keep = min(BEAM, after.shape[1])
        best = np.argpartition(after, keep - 1, axis=1)[:, :keep]
        beam, word = best // WORDS, best % WORDS
        at = np.arange(n)[:, None]
        error, rest = after[at, best], rest[at, beam] - book[word]
        codes = np.concatenate([codes[at, beam], word[:, :, None].astype(np.uint8)], axis=2)
    first = np.argmin(error, axis=1)
    codes, rest = codes[np.arange(n), first], rest[np.arange(n), first]
    norm = np.linalg.norm(x - rest, axis=1)
    return codes, np.where(norm > 0, np.linalg.norm(x, axis=1) / np.maximum(norm, 1e-30), 1.0).astype(np.float32)


def scan_block(queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, ratio: np.ndarray, books: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The (ids, scores) of the best codes seen so far for each query, after one more block."""
    have_ids, have = best
    keep, flat, out_ids, out = have.shape[1], books.reshape(-1, books.shape[2]), have_ids.copy(), have.copy()
    for a in range(0, len(queries), 64):
        part = slice(a, a + 64)
        lut = (queries[part].astype(np.float32) @ flat.T).reshape(-1, len(books), WORDS)
        near = np.zeros((len(lut), len(ids)), np.float32)
        for m in range(len(books)):
            near += lut[:, m].take(codes[:, m], axis=1)
        near *= ratio
        at = np.argpartition(-near, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), near.shape)
        score = np.concatenate([have[part], np.take_along_axis(near, at, 1)], 1)
        known = np.concatenate([have_ids[part], ids[at]], 1)
        pick = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        out_ids[part], out[part] = np.take_along_axis(known, pick, 1), np.take_along_axis(score, pick, 1)
    return out_ids, out


def _usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every`` its k nearest others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = sorted(((r["count"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect()), reverse=True)
    shape = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], shape)
    total, dim = sizes[0]
    rows = rows.where(F.size("v") == dim).withColumn("same", F.xxhash64("v")).withColumn("too", F.hash("v"))
    # A value's k + 1 smallest ids: nobody's k nearest can hold more of one value and not the query itself.
    least = Window.partitionBy("same", "too").orderBy("vec_id")
    ranked = rows.withColumn("n", F.dense_rank().over(least)).withColumn("again", F.lag("vec_id").over(least).eqNullSafe(F.col("vec_id")))
    firsts = written(ranked.where((F.col("n") <= k + 1) & ~F.col("again")).drop("again"), "vectors")
    values = firsts.where("n = 1").select("vec_id", "v", "same", "too")
    span = 1 << 30
    some = values.where(F.pmod(F.xxhash64("vec_id"), F.lit(span)) < min(span, 2 * SAMPLE * span // total + 1)).select("vec_id", "v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE)
    sample = np.array([r["v"] for r in sorted(some.collect(), key=lambda r: r["vec_id"])])
    books = fit(sample)

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    query_values = written(asked.groupBy("same", "too").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v")), "asked")
    cores = spark.sparkContext.defaultParallelism
    count = lambda n, most, least: max(1, -(-n // most), min(cores, -(-n // least)))
    n_blocks, n_packs = count(total, BLOCK, LEAST_BLOCK), count(query_values.count(), QUERIES, LEAST_QUERIES)
    n_chunks, keep = -(-n_blocks // CHUNK), RERANK

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                codes, ratio = encode(part.column("v").flatten().to_numpy().reshape(-1, dim), books)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio)], ["vec_id", "codes", "ratio"])

    def pack_codes(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        return pa.table({"block": group.column("block").slice(0, 1), "ids": [group.column("vec_id").to_numpy().tobytes()], "x": [b"".join(group.column("codes").to_pylist())], "ratio": [group.column("ratio").to_numpy().tobytes()]})

    def pack_queries(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        return pa.table({"block": group.column("block").slice(0, 1), "ids": [group.column("vec_id").to_numpy().tobytes()], "x": [group.column("v").combine_chunks().flatten().to_numpy().tobytes()], "ratio": [b""]})

    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    packed = "block int, ids binary, x binary, ratio binary"
    index = written(dealt(values.select("vec_id", "v").mapInArrow(frugal(coded), "vec_id long, codes binary, ratio float"), n_blocks).groupBy("block").applyInArrow(pack_codes, packed), "index")
    packs = dealt(query_values.select("vec_id", "v"), n_packs).groupBy("block").applyInArrow(pack_queries, packed)
    # A pack of queries heads every chunk of blocks that it meets.
    heads = packs.select(F.col("block").alias("pack"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), F.lit(-1).alias("block"), "ids", "x", "ratio")
    bodies = index.select(F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack"), (F.col("block") / CHUNK).cast("int").alias("chunk"), "block", "ids", "x", "ratio")
    met = heads.unionByName(bodies).repartition("pack", "chunk").sortWithinPartitions("pack", "chunk", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = q_ids = best = now = None

        def out() -> pa.RecordBatch:
            on = best[1] > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], on.shape)[on]), pa.array(best[0][on]), pa.array(best[1][on])], ["asked", "value", "near"])

        for batch in batches:
            for pack, chunk, block, ids, x, ratio in zip(*(batch.column(c) for c in ("pack", "chunk", "block", "ids", "x", "ratio"))):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                if block.as_py() < 0:
                    if now is not None:
                        yield out()
                    now, q_ids, q = (pack, chunk), ids, np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim)
                    best = np.zeros((len(q), keep), np.int64), np.full((len(q), keep), -np.inf, np.float32)
                elif now == (pack, chunk):  # a pack without queries has no head
                    best = scan_block(q, ids, np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, len(books)), np.frombuffer(ratio.as_buffer(), np.float32), books, best)
        if now is not None:
            yield out()

    found = met.mapInArrow(frugal(scan), "asked long, value long, near float")
    # The best by code, of all chunks, and then by the vectors themselves.
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("near"), "value"))).where(F.col("n") <= keep).select("asked", "value")
    found = found.join(values.select(F.col("vec_id").alias("value"), F.col("v").alias("x")), "value").join(query_values.select(F.col("vec_id").alias("asked"), F.col("v").alias("q")), "asked")
    exact = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    # The k + 1 best values of each asked value, then the ids that hold them.
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "value")
    found = found.select("asked", "value", exact.alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    holders = firsts.select("vec_id", "same", "too")
    named = values.select(F.col("vec_id").alias("value"), "same", "too")
    found = found.join(named, "value").join(holders, ["same", "too"]).select("asked", "vec_id", "score")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    # Every query takes the list of its value without itself; one row a value holds the list, so a value asked often costs no join.
    lists = found.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    keys = query_values.select(F.col("vec_id").alias("asked"), "same", "too")
    out = asked.select(F.col("vec_id").alias("query_id"), "same", "too").distinct().join(keys.join(lists, "asked"), ["same", "too"])
    out = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op3_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)
