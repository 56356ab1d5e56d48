"""Removal of long repeated byte strings by threshold-bounded interval expansion on a BWT.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. Equal strings
choose the same anchor, the k-gram of smallest hash inside them, so consecutive strings with one
anchor travel together as one segment of text, keyed by it. Anchors that occur once are done.
Equal segments collapse to one with a weight. What remains is dealt out by anchor; each task
concatenates its segments, sorts their suffixes to the depth needed, and derives from the
Burrows-Wheeler transform which neighbours in suffix order share ``length`` bytes: breadth-first
backward extension of intervals sets common prefixes by increasing value and stops at ``length``, so
whatever is still unset is long enough (Beller, Gog, Ohlebusch and Schnattinger, 2013). An anchor
with over HOT different segments, as where many texts share the end of a passage, would be one
unbounded task: its segments are split by where the anchor stands in a string, each part keyed by the
bytes that all its strings share, so that equal strings still meet and all but the part at the
passage's very end fall apart into small groups or equal parts; that one is split once more.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all bytes; rows
that are equal in id and text are copies of each other, hence both lose what they share; a text of
any length is read in slices; an empty table gives no rows; other columns of the input are ignored. Segments are told apart by 64-bit
hashes within an anchor, rows by 88 bits of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, buffers, drop_table, frugal, inverse_powers, long_slices, mix, pieces, prefix_hash, slice_hash, table, written

_U = np.uint64
GRAM = 64
#: Bytes of segments that a BWT holds at a time, and the different segments of an anchor beyond which they are split.
TEXT_BYTES, HOT = 3 << 18, 4096
#: Distances between string and anchor of a part when a hot anchor's segments are split, level by level.
WIDTHS = (16, 1)


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of key[i : i + width] for every i where it fits."""
    done, now = 1, key
    while done * 2 <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    return np.minimum(now[: len(key) - width + 1], now[width - done :]) if width > done else now


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, size, anchor, place of the anchor, content) of the segments of all documents:
    runs of strings of ``length`` bytes with the same anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    prefix, inverse = prefix_hash(data), inverse_powers(len(data))
    grams = len(data) - GRAM + 1
    at = np.arange(grams)
    h = slice_hash(prefix, at, at + GRAM, inverse)
    shift = _U(len(data).bit_length())
    place = (_U(1) << shift) - _U(1)
    anchor = (_sliding_min((h >> shift << shift) | at.astype(_U), length - GRAM + 1) & place).astype(np.int64)
    # Places fill the low bits of the hash: where grams tie but for these, the whole hash decides, leftmost on ties.
    for s in np.flatnonzero(h[anchor] != _sliding_min(h, length - GRAM + 1)):
        anchor[s] = s + np.argmin(h[s : s + length - GRAM + 1])
    starts = np.arange(len(anchor))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    fits = starts + length <= offsets[doc + 1]
    starts, doc, anchor = starts[fits], doc[fits], anchor[fits]
    if not len(starts):
        return none, none, none, none, none, none
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    begin, stop = starts[first], starts[last] + length
    content = slice_hash(prefix, begin, stop, inverse)
    return doc[first], begin - offsets[doc[first]], stop - begin, h[anchor[first]].view(np.int64), anchor[first] - begin, content.view(np.int64)


def long_segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """segments() of a batch; a text that stands alone because it is long is read in slices, which share
    ``length`` - 1 bytes, so that every string is whole in one and memory stays bounded."""
    if len(offsets) != 2 or len(data) <= 4 * PIECE_BYTES:
        yield segments(data, offsets, length)
        return
    for base, part in long_slices(data, PIECE_BYTES, length - 1):
        doc, start, *rest = segments(part, np.array([0, len(part)]), length)
        yield doc, start + base, *rest


def split_segments(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(segment, offset, size, key, content) of the parts of segments: their strings by how far the
    anchor stands behind a string's start, ``width`` distances a part.

    All strings of a part hold the same bytes around the anchor but for width - 1 at the ends; these
    bytes are the part's key, so equal strings still meet."""
    prefix, inverse = prefix_hash(data), inverse_powers(len(data))
    most = np.diff(offsets) - length  # the last string's offset in the segment
    groups = (length - GRAM) // width + 1
    which, near = np.repeat(np.arange(len(at)), groups), np.tile(np.arange(groups) * width, len(at))
    # Strings whose anchor is near .. near + width - 1 behind their start begin at these offsets.
    low, high = np.maximum(0, at[which] - near - width + 1), np.minimum(most[which], at[which] - near)
    some = low <= high
    which, near, low, high = which[some], near[some], low[some], high[some]
    begin, stop = offsets[which] + low, offsets[which] + high + length
    anchor = offsets[which] + at[which]
    core = slice_hash(prefix, anchor - near, anchor - near + length - width + 1, inverse)
    key = mix(core ^ mix(near.astype(_U) + _U(width) * _U(1 << 20)))
    return which, low, stop - begin, key.view(np.int64), slice_hash(prefix, begin, stop, inverse).view(np.int64)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols or more, ties by place."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(_U), np.zeros(8, _U)))
    key = np.zeros(n, _U)
    for j in range(8):
        key = (key << _U(8)) | padded[j : n + j]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        if reach >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, np.int64)
        if reach < n:
            behind[:-reach] = rank[reach:] + 1
        key = (rank.astype(_U) << _U(32)) | behind.astype(_U)
        reach *= 2


def long_neighbours(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For every place in suffix order but the first: whether it shares ``length`` symbols with the place before.

    Intervals hold the suffixes that begin with one string. Extending all of a level by the symbol
    before them gives the strings one longer; where such an interval ends, the common prefix with
    the next suffix is as long as the strings of the level, unless it was set at a lower one."""
    n = len(order)
    bwt = symbols[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)  # place of each suffix once it is extended
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    left, right = np.array([0]), np.array([n])
    owner, symbol = np.full(n + 1, -1, np.int64), np.empty(n + 1, symbols.dtype)
    symbol[:n], symbol[n] = np.sort(bwt), 0
    for _ in range(length):
        if not len(left):
            break
        sizes = right - left
        which = np.repeat(np.arange(len(left)), sizes)
        into = back[np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)]
        owner[into] = which
        ends = into[(owner[into + 1] != which) | (symbol[into + 1] != symbol[into])]  # last of an extended interval
        begins = into[(owner[into - 1] != which) | (symbol[into - 1] != symbol[into])]
        ends, begins = np.sort(ends) + 1, np.sort(begins)
        owner[into] = -1
        new = unset[ends]
        unset[ends] = False
        left, right = begins[new], ends[new]
    return unset[:n]


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For every text, the starts of strings of ``length`` bytes that start elsewhere in the texts too."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    used = np.zeros(256, bool)
    used[flat] = True
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, int(used.sum()) + 1)  # UTF-8 leaves byte values over, so 0 parts the texts
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes
    symbols = np.zeros(int(sizes.sum()) + len(texts) + 1, np.uint8)
    symbols[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = code[flat]
    order = suffix_order(symbols, length + 1)
    near = long_neighbours(symbols, order, length)
    hit = np.zeros(len(symbols), bool)
    hit[order[near | np.concatenate((near[1:], [False]))]] = True
    return [np.flatnonzero(hit[b : b + max(0, n - length + 1)]) for b, n in zip(begin.tolist(), sizes.tolist())]


def _spans(starts: np.ndarray, length: int) -> list[int]:
    """[from, to, from, to, ...] of the bytes that strings at these sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + length], 1).ravel().tolist()


def _expanded(texts: DataFrame, length: int) -> DataFrame:
    """(key, content, spans) of what the BWT finds repeated in segments of weight 1 (key, content, weight, bytes);
    a key's segments meet in one task."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out(group: list[tuple]) -> pa.RecordBatch:
            found = repeated_starts([g[3] for g in group], length)
            spans = [[] if g[2] > 1 else _spans(f, length) for g, f in zip(group, found)]  # copies are repeated whole
            keep = [k for k, s in enumerate(spans) if s]
            return pa.RecordBatch.from_arrays([pa.array([group[k][0] for k in keep], pa.int64()), pa.array([group[k][1] for k in keep], pa.int64()), pa.array([spans[k] for k in keep], pa.list_(pa.int32()))], ["key", "content", "spans"])

        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "weight", "bytes"))):
                if total >= TEXT_BYTES and item[0] != held[-1][0]:
                    yield out(held)
                    held, total = [], 0
                held.append(item)
                total += len(item[3])
        if held:
            yield out(held)

    cold = texts.select("key", "content", "weight", "bytes").repartition("key").sortWithinPartitions("key")
    return cold.mapInArrow(frugal(expand), "key long, content long, spans array<int>")


def _split(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Parts (key, content, weight, bytes, at, parent_key, parent, low) of segments, see split_segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                data, offsets = _binary(part.column("bytes"))
                at = part.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
                which, low, size, key, content = split_segments(data, offsets, at, length, width)
                raw, begin = data.tobytes(), (offsets[which] + low).tolist()
                get = lambda c, part=part, which=which: pa.array(part.column(c).to_numpy(zero_copy_only=False)[which], pa.int64())
                new = [pa.array(key), pa.array(content), get("weight"), pa.array([raw[b : b + n] for b, n in zip(begin, size.tolist())], pa.binary()), pa.array(at[which] - low, pa.int32()), get("key"), get("content"), pa.array(low, pa.int32())]
                yield pa.RecordBatch.from_arrays(new, ["key", "content", "weight", "bytes", "at", "parent_key", "parent", "low"])

    return texts.select("key", "content", "weight", "bytes", "at").mapInArrow(frugal(run), "key long, content long, weight long, bytes binary, at int, parent_key long, parent long, low int")


def _judged(texts: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """(key, content, spans) of segments (key, content, weight, n_kinds, bytes, at): by the BWT where a key has
    at most HOT of them, else by that of their parts."""
    if not widths:  # a part is one string: its segments are all equal
        return _expanded(texts, length)
    found = _expanded(texts.where(F.col("n_kinds") <= HOT), length)
    hot = written(texts.where(F.col("n_kinds") > HOT), "hot")
    if hot.isEmpty():
        return found
    parts = written(_split(hot, length, widths[0]), "parts")
    kinds = parts.groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.first("bytes").alias("bytes"), F.first("at").alias("at"))
    kinds = written(kinds, "part_kinds")
    several = written(kinds.groupBy("key").agg(F.count("*").alias("n_kinds"), F.count_if(F.col("weight") == 1).alias("single")).where("n_kinds > 1 AND single > 0").drop("single"), "several")
    whole = kinds.where("weight > 1").select("key", "content", F.array(F.lit(0), F.length("bytes")).alias("spans"))
    below = written(whole.unionByName(_judged(kinds.join(several, "key"), length, widths[1:])), "part_spans")
    # Spans of a part, moved to where it lies in its segment.
    moved = F.transform("spans", lambda x: (x + F.col("low")).cast("int"))
    up = parts.where("weight = 1").select("key", "content", "parent_key", "parent", "low").join(below, ["key", "content"])
    up = up.groupBy(F.col("parent_key").alias("key"), F.col("parent").alias("content")).agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return found.unionByName(up)


def repeated_bytes(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of from, to, from, to, ... in bytes) and
    kept (the bytes outside them), besides the columns in ``carry``."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row is known by 64 bits of its id and text and 24 more of its text.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(F.col(id_col), text).alias("row"), F.pmod(F.hash(text), F.lit(1 << 24)).cast("int").alias("check"), *(F.col(c).alias(f"_{k}_") for k, c in enumerate(carry)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            row, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "check"))
            for doc, start, size, anchor, at, content in long_segments(*buffers(batch.column("t")), length):
                wide, slim = (row[doc], anchor, content), (start, size, at, check[doc])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in wide), *(pa.array(x, pa.int32()) for x in slim)], ["row", "anchor", "content", "start", "size", "at", "check"])

    cut_up = written(rows.select("t", "row", "check").mapInArrow(frugal(cut), "row long, anchor long, content long, start int, size int, at int, check int"), "segments")
    # Written, so that the join reads two tables and Spark may split a hot anchor's rows; so below.
    twice = written(cut_up.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    shared = written(cut_up.join(twice, "anchor"), "shared")
    drop_table(cut_up)
    drop_table(twice)
    first = F.first(F.struct("row", "check", "start", "size", "at")).alias("f")
    kinds = written(shared.groupBy("anchor", "content").agg(F.count("*").alias("weight"), first).select("anchor", "content", "weight", "f.*"), "kinds")
    # The text of one segment of each kind, for anchors with several kinds, unless all have copies.
    several = written(kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds"), F.count_if(F.col("weight") == 1).alias("single")).where("n_kinds > 1 AND single > 0").drop("single"), "several")
    wanted = kinds.join(several, "anchor")
    by_row = wanted.groupBy("row", "check").agg(F.collect_list(F.struct("anchor", "content", "weight", "n_kinds", "start", "size", "at")).alias("wanted"))
    fetched = rows.select("t", "row", "check").join(by_row, ["row", "check"]).select(F.encode("t", "UTF-8").alias("t"), F.explode("wanted").alias("w"))
    texts = fetched.select(F.col("w.anchor").alias("key"), "w.content", "w.weight", "w.n_kinds", "w.at", F.substring(F.col("t"), F.col("w.start") + 1, F.col("w.size")).alias("bytes"))
    texts = written(texts.dropDuplicates(["key", "content"]), "texts")
    # Equal segments of one kind only, or of a kind with copies, are repeated as they stand.
    whole = kinds.where("weight > 1").select("anchor", "content", F.array(F.lit(0), F.col("size")).alias("spans"))
    verdicts = written(whole.union(_judged(texts, length, WIDTHS)), "verdicts")
    moved = F.transform("spans", lambda x: (x + F.col("start")).cast("int"))
    by_row = shared.join(verdicts, ["anchor", "content"]).groupBy("row", "check").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    names = [f"_{k}_" for k in range(len(carry))]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 8 << 20):
            data, offsets = buffers(batch.column("t"))
            raw, ends = data.tobytes(), offsets.tolist()
            spans, kept = [], []
            for a, b, s in zip(ends, ends[1:], batch.column("spans")):
                s = s.values
                if s is None or not len(s):
                    spans.append([])
                    kept.append(raw[a:b])
                    continue
                pairs = s.to_numpy().reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                first = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
                start, stop = pairs[first, 0], reach[np.concatenate((first[1:] - 1, [len(reach) - 1]))]
                spans.append(np.stack([start, stop], 1).ravel().tolist())
                kept.append(b"".join(raw[a + x : a + y] for x, y in zip([0, *stop.tolist()], [*start.tolist(), b - a])))
            new = [pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new, *(batch.column(c) for c in names)], ["doc_id", "n_bytes", "spans", "kept", *names])

    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = f"doc_id {kinds_of['doc_id']}, n_bytes long, spans array<int>, kept binary" + "".join(f", {n} {kinds_of[n]}" for n in names)
    out = rows.join(by_row, ["row", "check"], "left").select("doc_id", "t", "spans", *names).mapInArrow(frugal(remove), shape)
    return out.withColumnsRenamed(dict(zip(names, carry)))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"), 200)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
