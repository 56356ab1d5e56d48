"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets collapse to one class at once; a class is known by its
set, never by an id, so ids may repeat. Signatures of classes are banded; classes that share a band are
candidates. Candidates go through signature batches first: a pair is dropped as soon as the posterior
chance that it is similar enough falls under the chosen miss probability; whoever survives is verified
on the full sets.

No group emits all its pairs. First every bucket's members meet the bucket's smallest member; what is linked
then is one component and needs no further link. Where a bucket still holds several components, members of
different ones are compared pair by pair on their signatures, within the bucket, in blocks of bounded size; a
spanning forest of the pairs that pass tells which members may be similar at all. Each such cluster is then
verified on the full sets, in blocks too, and again only a forest of its links comes out. So no candidate of
a band is left out, nothing grows with the square of a group but comparisons inside a task, and documents
that merely share bands never meet with their sets.

Defined results: null texts and texts without words have empty sets and link with nothing; with
fewer words than a shingle the whole sequence is one; equal sets are linked; repeated ids keep
their rows, each with the class of its own text; rows without an id link with nothing; a text of any
length is read in slices; an empty table gives no rows; other columns of the input are ignored. Shingles are compared by 64-bit
hashes, sets are told apart by 128 bits and their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, buffers, drop_table, frugal, inverse_powers, mix, pieces, prefix_hash, slice_hash, table, written
from .graph import components

_U = np.uint64
#: Rows a band and bands: a pair of similarity 0.8 is missed with chance 6e-5, of 0.85 with 3e-7.
BAND_ROWS, BANDS = 6, 32
PERMUTATIONS = BAND_ROWS * BANDS
BATCH = 32
#: Chance that a pair as similar as asked is dropped before the exact comparison.
MISS = 1e-9
#: Members of a bucket or cluster that are compared pair by pair in a task; larger ones are dealt as pairs of blocks.
BLOCK = 1500
#: Partners that one set meets in a task.
PARTNERS = 2000

_rng = np.random.default_rng(20_031)
_MULT = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | _U(1)).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, ASCII lower-cased, and where each document's words begin among them."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and len(data) > 4 * PIECE_BYTES:  # one long text: in slices that end between words
        parts, start = [], 0
        while start < len(data):
            stop = min(len(data), start + PIECE_BYTES)
            while stop < len(data) and not _SPACE[data[stop : stop + PIECE_BYTES]].any():
                stop = min(len(data), stop + PIECE_BYTES)
            stop += int(np.argmax(_SPACE[data[stop : stop + PIECE_BYTES]])) if stop < len(data) else 0
            parts.append(_word_hashes(data[start:stop], np.array([0, stop - start]))[0])
            start = stop
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    return _word_hashes(data, offsets)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    stop = np.flatnonzero(~space & (after | edge[1:])) + 1
    return slice_hash(prefix_hash(data), start, stop, inverse_powers(len(data))), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every document."""
    words, ends = word_hashes(data, offsets)
    if len(words) >= k:
        n = len(words) - k + 1
        grams = words[:n]
        for j in range(1, k):
            grams = mix(grams * _U(0x9E3779B97F4A7C15) + words[j : n + j])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            h = np.array([b - a], _U)
            for j in range(a, b):
                h = mix(h * _U(31) ^ words[j : j + 1])
            yield h
        else:
            yield np.zeros(0, _U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of one set."""
    x = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        h = np.multiply(x[k : k + 256, None], _MULT)
        h += _PLUS
        np.minimum(best, h.min(0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; bands have different keys for equal minima."""
    rows = sig.reshape(BANDS, BAND_ROWS).astype(_U)
    out = mix(np.arange(BANDS, dtype=_U) + _U(77))
    for j in range(BAND_ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + rows[:, j])
    return out.view(np.int64)


def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """By number of hashes compared, a batch apart: the fewest matches with which a pair goes on.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1); its chance to
    reach t is that of at most m successes in n+1 trials of chance t."""
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _survives(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int, need: list[int]) -> np.ndarray:
    """Which rows of signatures a and b may be similar enough, batch after batch."""
    small, large = np.minimum(sizes_a, sizes_b), np.maximum(sizes_a, sizes_b)
    left = np.flatnonzero(small * 100 >= percent * large)
    matches = np.zeros(len(left), np.int64)
    for k, m in enumerate(need):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (a[left if len(a) > 1 else [0], part] == b[left, part]).sum(1)
        left, matches = left[matches >= m], matches[matches >= m]
        if not len(left):
            break
    return left


def _compared(pairs: DataFrame, nodes: DataFrame, payload: str, survivors) -> DataFrame:
    """The pairs (a, b) for which ``survivors(payload of a, [payloads of b], n of a, [n of b])`` holds.

    Every a is sent once to each task that holds partners of it, at most PARTNERS at a time."""
    pairs = written(pairs, "pairs")
    hot = written(pairs.groupBy("a").agg(F.count("*").alias("m")).where(f"m > {PARTNERS}").select("a", F.ceil(F.col("m") / PARTNERS).cast("int").alias("parts")), "hot")
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int").alias("part"))
    have = nodes.select("node", "n", F.col(payload).alias("x"))
    seconds = dealt.join(have.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "n", "x")
    firsts = dealt.select("a", "part").distinct().join(have.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "n", "x")
    met = firsts.unionByName(seconds).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            a, b, n, x = (batch.column(c) for c in ("a", "b", "n", "x"))
            a, n, heads = a.to_numpy(), n.to_numpy(), b.is_null().to_numpy(zero_copy_only=False)
            ids = b.fill_null(-1).to_numpy()
            found_a, found_b = [], []
            # A stretch of partners between two heads; the head before a batch's first may be in an earlier batch.
            edges = [0, *np.flatnonzero(heads).tolist(), len(a)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < len(a) and heads[lo]:
                    one, lo = (x[lo].as_buffer(), int(n[lo])), lo + 1
                for k in range(lo, hi, 256):
                    to = min(hi, k + 256)
                    good = survivors(one[0], [x[j].as_buffer() for j in range(k, to)], one[1], n[k:to])
                    found_a.append(a[k:to][good])
                    found_b.append(ids[k:to][good])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *found_a])), pa.array(np.concatenate([none, *found_b]))], ["a", "b"])

    out = written(met.mapInArrow(frugal(run), "a long, b long"), "survivors")
    drop_table(pairs)
    return out


def _sketches(texts: DataFrame, k: int, carry: list[str]) -> DataFrame:
    """Per row its set's size and digest, the band keys and the signature, a byte a hash: chance matches
    of bytes only raise counts, so the bound on misses holds."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            n, one, two, bands, sigs = [], [], [], [], []
            for s in shingle_sets(*buffers(batch.column("t")), k):
                n.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0)
                two.append(int(np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
                sig = signature(s) if len(s) else None
                bands.append(band_keys(sig) if len(s) else None)
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            new = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in carry), *new], ["doc_id", *carry, "n", "one", "two", "bands", "sig"])

    shape = "doc_id long, " + "".join(f"{c} {kinds[c]}, " for c in carry) + "n long, one long, two long, bands array<long>, sig binary"
    return written(texts.mapInArrow(frugal(sketch), shape), "sketches")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (the smallest id with an equal set),
    component_id (the smallest id reachable over links of ``percent`` or more) and group, a number that
    all rows of a component share (null for empty sets), besides the narrow columns in ``carry``."""
    names = [f"_{j}_" for j in range(len(carry))]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    seen = _sketches(texts, k, names)
    # Written, so that the joins read two tables and Spark may split the rows of a large class.
    classes = seen.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = _components(texts.select("doc_id", "t"), classes, k, percent)
    groups = classes.select("n", "one", "two", "class_id", "node").join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = groups.where("component IS NOT NULL").groupBy("group").agg(F.min("class_id").alias("c"))
    known = written(groups.join(least, "group", "left").select("n", "one", "two", "class_id", F.coalesce("c", "class_id").alias("component_id"), "group"), "known")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("n"))  # rows without an id are of no class
    out = seen.select("doc_id", *names, F.col("n").alias("n_shingles"), mine.alias("n"), "one", "two").join(known, ["n", "one", "two"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "group", *names)
    return out.withColumnsRenamed(dict(zip(names, carry)))


def _components(texts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = written(shared, "buckets")
    members = written(members.join(shared, "bucket"), "members")
    sets = _candidate_sets(texts, classes, members, k)
    sigs = classes.select("node", "n", "sig")
    need = least_matches(percent / 100)

    def by_signature(one, others, n, ns):
        b = np.frombuffer(b"".join(others), np.uint8).reshape(-1, PERMUTATIONS)
        return _survives(np.frombuffer(one, np.uint8)[None, :], b, np.full(len(b), n), ns, percent, need)

    def by_set(one, others, n, ns):
        one = np.frombuffer(one, _U)
        return np.array([j for j, x in enumerate(others) if _similar(one, np.frombuffer(x, _U), percent)], np.int64)

    verify = lambda pairs: _compared(_compared(pairs, sigs, "sig", by_signature), sets, "shingles", by_set)
    links = verify(members.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a < b").distinct())
    found = written(components(links), "found")
    still = _open(members, found)
    if still.isEmpty():
        return found
    # What may be similar at all, by signatures within buckets; then what is, by sets within those clusters.
    near = written(_in_blocks(still, "bucket", sigs, percent, need, False).distinct(), "near")
    inside = still.where("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b")).distinct()
    clusters = components(near.unionByName(inside)).withColumnRenamed("component", "cluster")
    mates = written(still.select("node", "component").distinct().join(clusters, "node").join(written(near.select("a").union(near.select("b")).distinct().join(clusters, F.col("a") == F.col("node")).select("cluster").distinct(), "live"), "cluster"), "mates")
    more = written(_in_blocks(mates, "cluster", sets.join(sigs.drop("n"), "node"), percent, need, True), "links")
    return found if more.isEmpty() else written(components(links.unionByName(more)), "found")


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, component) of buckets that hold several components."""
    own = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = written(own.select("bucket", "node", "component"), "labelled")
    several = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    return written(own.join(written(several, "several"), "bucket"), "open")


def _candidate_sets(texts: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node, n, shingles) of the classes that share a bucket, as a table."""
    wanted = written(classes.select("node", "n", "one", "two", F.col("class_id").alias("doc_id")).join(members.select("node").distinct(), "node"), "wanted")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            sets = list(shingle_sets(*buffers(batch.column("t")), k))
            one = [int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "one", "shingles"])

    # Ids may repeat with other texts, hence by set as well.
    rows = texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(frugal(shingled), "doc_id long, n long, one long, shingles binary")
    return written(rows.join(wanted.drop("two"), ["doc_id", "n", "one"]).select("node", "n", "shingles").dropDuplicates(["node"]), "sets")


def _in_blocks(members: DataFrame, key: str, payload: DataFrame, percent: int, need: list[int], exact: bool) -> DataFrame:
    """A spanning forest (a, b) of the pairs of different components within each group of ``key`` whose signatures
    pass and, if ``exact``, whose sets are similar. members: (key, node, component); payload: (node, n, sig) and the sets."""
    sizes = written(members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = members.select(key, "node", "component").join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Every pair of blocks of a group meets in one task.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(key, "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        node, block, n = (group[c].to_numpy() for c in ("node", "block", "n"))
        comp = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, PERMUTATIONS)
        sets = [np.frombuffer(x, _U) for x in group["shingles"]] if exact else None
        across, out = group["low"].iloc[0] != group["high"].iloc[0], []
        for i in range(len(node) - 1):
            other = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if across:
                other = other[block[other] != block[i]]
            if not len(other):
                continue
            other = other[_survives(sig[i : i + 1], sig[other], np.full(len(other), n[i]), n[other], percent, need)]
            while len(other):  # one link to each component; whoever is linked by it is skipped
                j, other = other[0], other[1:]
                if exact and not _similar(sets[i], sets[j], percent):
                    continue
                comp[comp == comp[j]] = comp[i]
                out.append((node[i], node[j]))
                other = other[comp[other] != comp[i]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.join(payload, "node").groupBy(key, "low", "high").applyInPandas(meet, "a long, b long")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")
