"""Alignment of two tokenizers by distinct segments.

Texts are cut before runs of white space, where neither vocabulary has an entry that reaches across: the
sets of bytes and pieces are checked for it, and of white space that fails the check no run is a cut.
A segment's tokens are then the same in every text. All distinct segments of the corpus are tokenised and
aligned once, in one table; alignments go back to the texts by join, and a text's groups, links and
pairs are those of its segments, one after another.

How the join back is dealt: the most frequent segments, HOT at most, go to the tasks by broadcast; every
other one is rare, so its rows spread evenly over a shuffle by segment. Equal texts are composed once and
stand for all their rows. Texts are dealt in packs, once, with the rare segments that they hold, one row
for a pack and a segment. An alignment travels as the text of its groups, which holds all the rest. Counts of
id pairs are split alike: HOT of them at most are broadcast, the rest meet by shuffle.

Defined results: null and empty texts, and texts whose joined tokens of either side are not the text
behind a blank, have no tokens (zeros and empty groups) and hold no links; special tokens' strings are plain
text; repeated rows count as documents each; very long texts are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, pieces, table, written

#: Segments, and id pairs, that are broadcast, at most.
HOT = 262_144
#: Bytes of a broadcast segment, at most; longer ones are dealt as rare.
HOT_BYTES = 64
#: Text bytes of a pack, about.
PACK_BYTES = 4 << 20
#: Distinct segments that a task counts before it hands them on.
COUNTED = 400_000
_BLANK = "▁"


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies, read backwards: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Two:
    """Both tokenizers, the bytes of their entries, and where texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, size = byte_letters(), self.b.get_piece_size()
        self.a_bytes = {i: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode() for piece, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.blank = self.b.piece_to_id(_BLANK)
        normal = [self.b.id_to_piece(i) for i in range(size) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        self.cuts = self._cuts(normal)
        w = "".join(map(re.escape, self.cuts))
        #: A run of white space with what follows it, up to the next run that begins with a character of ``cuts``.
        self._split = re.compile(rf"\s*\S+(?:[^\S{w}]\s*\S*)*|\s+").findall if w else re.compile(r"(?s).+").findall
        #: Texts in which some run of white space is longer than one character, or begins with another one.
        self._odd = re.compile(rf"\s\s|[^\S{w}]| \Z").search if w else re.compile("").search

    def split(self, text: str) -> list[str]:
        """Names of the segments of a blank and the text: a segment of a blank and a word goes by the word, others by themselves."""
        text = " " + text
        if self._odd(text):
            return [s[1:] if s[0] == " " and len(s) > 1 and not s[1].isspace() else s for s in self._split(text)]
        for c in self.cuts[1:]:
            text = text.replace(c, " " + c)
        return text[1:].split(" ")

    def _cuts(self, normal: list[str]) -> str:
        """White space before which both vocabularies end: no entry holds it behind another character than white space."""
        out = ""
        for c in " \t\n\r":
            mark = _BLANK if c == " " else c
            # On side A behind what is no white space (parts of characters included), on side B behind any character (but blanks behind blanks).
            joined_a = re.compile(rf"\S{re.escape(c)}")
            joined_b = re.compile(f"(?s)[^{_BLANK}]{_BLANK}" if c == " " else f"(?s).{re.escape(mark)}")
            if not any(joined_a.search(x.decode(errors="replace")) for x in self.a_bytes.values()) and not any(joined_b.search(p) for p in normal):
                out += c
        return out if " " in out else ""

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """Side B of segments inside a text: the library puts a blank before every text, so one is taken off first or last."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [([self.blank] if s == " " else ids) if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]

    def align(self, segments: list[str]) -> list[str]:
        """The groups of every segment, given by name, as text; empty where the tokens of a side are not the segment."""
        out, segments = [], [s if s[0].isspace() else " " + s for s in segments]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for seg, a, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self.b_ids(segments)):
            a, raw = a.ids, seg.encode()
            x, y = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
            out.append(grouped(a, b, list(map(len, x)), list(map(len, y))) if b"".join(x) == raw == b"".join(y) else "")
        return out


def grouped(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> str:
    """Groups of two token rows over the same bytes, as ``a1,a2|b1;a3|b2,b3``."""
    said, last = [], len(a) - 1
    i = j = i0 = j0 = 0
    x, y = a_sizes[0], b_sizes[0]
    while True:
        if x < y:
            i += 1
            x += a_sizes[i]
        elif y < x:
            j += 1
            y += b_sizes[j]
        else:
            said.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0 : j + 1]))}")
            if i == last:
                return ";".join(said)
            i, j = i + 1, j + 1
            i0, j0, x, y = i, j, a_sizes[i], b_sizes[j]


@functools.lru_cache(2)
def two(a_path: str, b_path: str) -> Two:
    return Two(a_path, b_path)


class Aligned:
    """Alignments by segment, with statistics and pairs as arrays."""

    def __init__(self, segments: list[str], groups: list[str]):
        self.index, self.groups = {s: k for k, s in enumerate(segments)}, groups
        stats, pairs, times, counts = [], [], [], []
        for said in groups:
            if not said:
                stats.append((-1, 0, 0, 0))
                counts.append(0)
                continue
            n_a = n_b = links = 0
            had, parts = len(pairs), said.split(";")
            for part in parts:
                left, _, right = part.partition("|")
                left, right = [int(x) << 32 for x in left.split(",")], [int(x) for x in right.split(",")]
                n_a, n_b, links = n_a + len(left), n_b + len(right), links + len(left) * len(right)
                if len(left) * len(right) <= 64:
                    pairs += [x | y for x in left for y in right]
                else:  # ids that repeat count once, with how often they meet
                    many = Counter(right)
                    for x, n in Counter(left).items():
                        for y, m in many.items():
                            times.append((len(pairs), n * m))
                            pairs.append(x | y)
            stats.append((n_a, n_b, len(parts), links))
            counts.append(len(pairs) - had)
        self.stats, self.pairs, self.counts = np.array(stats, np.int64).reshape(-1, 4), np.array(pairs, np.int64), np.array(counts, np.int64)
        self.times = np.ones(len(pairs), np.int64)
        for k, n in times:
            self.times[k] = n


class Composer:
    """Texts from broadcast alignments and a pack's own."""

    def __init__(self, known: Aligned, more: Aligned):
        self.known, self.more, self.n = known.index, more.index, len(known.groups)
        self.groups = known.groups + more.groups
        self.stats, self.pairs, self.times, self.counts = (np.concatenate([getattr(known, c), getattr(more, c)]) for c in ("stats", "pairs", "times", "counts"))
        self.begins = np.cumsum(self.counts) - self.counts

    def compose(self, segments: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links), the digest of the groups, distinct pairs and times of one text."""
        at = list(map(self.known.get, segments))
        if None in at:
            at = [k if k is not None else self.n + self.more[s] for k, s in zip(at, segments)]
        distinct, often = np.unique(np.array(at, np.int64), return_counts=True)
        stats = self.stats[distinct]
        if (stats[:, 0] < 0).any():
            return [0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        digest = hashlib.sha256(";".join(map(self.groups.__getitem__, at)).encode()).hexdigest()
        n = self.counts[distinct]
        within = np.repeat(self.begins[distinct] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, back = np.unique(self.pairs[within], return_inverse=True)
        times = np.bincount(back, weights=self.times[within] * np.repeat(often, n), minlength=len(pairs)).astype(np.int64)
        return (often @ stats).tolist(), digest, pairs, times


#: What this worker has made of the broadcast alignments.
_KNOWN: dict[str, Aligned] = {}


def _known(token: str, hot) -> Aligned:
    """The broadcast alignments, read once in a worker."""
    if token not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[token] = Aligned(*hot.value)
    return _KNOWN[token]


def _level(n: str):
    """Step of a count on a scale of sixteenths of powers of two."""
    return F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")


def _least_level(rows: DataFrame, most: int) -> int:
    """The lowest level from which on there are at most ``most`` rows; a level is one of about a thousand."""
    total, least = 0, 1 << 30
    for r in sorted(rows.where("level >= 0").groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return least


def align_texts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a_path, b_path = a_path or paths()[0], b_path or paths()[1]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    told = rows.where(F.col("t") != "").select("t")
    key = F.unhex(F.md5("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = two(a_path, b_path).split, Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["segment", "n"])
            seen.clear()
            return made

        for batch in pieces(batches, "t"):
            for t in batch.column("t").to_pylist():
                seen.update(split(t))
            if len(seen) > COUNTED:
                yield out()
        yield out()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two(a_path, b_path)
        for batch in pieces(batches, "segment", 1 << 17):
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(both.align(batch.column("segment").to_pylist()), pa.string())], ["segment", "groups"])

    segments = told.mapInArrow(frugal(counted), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    segments = written(segments.withColumn("level", F.when(F.octet_length("segment") <= HOT_BYTES, _level("n")).otherwise(-1)), "segments")
    size = segments.agg(F.sum(F.col("n") * F.octet_length("segment"))).first()[0] or 0
    made = written(segments.select("segment", "level").repartition("segment").mapInArrow(frugal(aligned), "segment string, groups string"), "alignments")
    hot_names = segments.where(F.col("level") >= _least_level(segments, HOT)).select("segment")
    # HOT rows of HOT_BYTES bytes at most.
    hot = spark.sparkContext.broadcast([c.to_pylist() for c in made.join(F.broadcast(hot_names), "segment").toArrow().columns])
    n_packs = max(1, -(-size // PACK_BYTES))
    pack = F.pmod(F.xxhash64("key"), F.lit(n_packs)).alias("pack")
    token = uuid.uuid4().hex

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, common = two(a_path, b_path).split, _known(token, hot).index
        for batch in pieces(batches, "t"):
            found = {(p, s) for t, p in zip(batch.column("t").to_pylist(), batch.column("pack").to_pylist()) for s in set(split(t)).difference(common)}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())], ["pack", "segment"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text where a task first meets it, and at the end how often more it came: copies do not travel."""
        seen: dict[tuple[int, bytes], int] = {}
        names = ["pack", "key", "copies", "t"]
        for batch in batches:
            ids = list(zip(batch.column("pack").to_pylist(), batch.column("key").to_pylist()))
            new = []
            for k, x in enumerate(ids):
                if x not in seen:
                    new.append(k)
                seen[x] = seen.get(x, 0) + 1
            some = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("pack"), some.column("key"), pa.array([1] * len(new), pa.int64()), some.column("t")], names)
        more = [(*x, n - 1) for x, n in seen.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in more], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))] + [pa.nulls(len(more), pa.string())], names)

    keyed = told.select(key.alias("key"), "t").select(pack, "key", "t")
    wanted = keyed.select("t", "pack").mapInArrow(frugal(missing), "pack long, segment string")
    brought = wanted.join(made, "segment").dropDuplicates(["segment", "pack"])
    texts = keyed.mapInArrow(frugal(once), "pack long, key binary, copies long, t string")

    def composed(group: tuple, some: pa.Table, more: pa.Table) -> pa.Table:
        split, rest = two(a_path, b_path).split, Aligned(more.column("segment").to_pylist(), more.column("groups").to_pylist()) if more.num_rows else Aligned([], [])
        both = Composer(_known(token, hot), rest)
        texts, copies = {}, Counter()
        for k, n, t in zip(some.column("key").to_pylist(), some.column("copies").to_pylist(), some.column("t").to_pylist()):
            copies[k] += n
            if t is not None:
                texts[k] = t
        stats, digests, pairs, times = [], [], [], []
        for t in texts.values():
            for to, x in zip((stats, digests, pairs, times), both.compose(split(t))):
                to.append(x)
        n = np.array(stats, np.int64).reshape(-1, 4)
        ends = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
        flat = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, np.int64)])))
        keys = list(texts)
        counts = {c: pa.array(n[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        return pa.table({"key": pa.array(keys, pa.binary()), "copies": pa.array([copies[k] for k in keys], pa.int64()), **counts, "groups_sha256": pa.array(digests, pa.string()), "pairs": flat(pairs), "times": flat(times)})

    shape = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    done = written(texts.groupBy("pack").cogroup(brought.groupBy("pack")).applyInArrow(composed, shape), "composed")

    held = done.select("key", "copies", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", "copies", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    a_id = F.shiftright("pair", 32)
    counts = written(held.groupBy("pair").agg(F.sum("copies").alias("n")), "pairs")
    # One row for an id of A: the vocabulary bounds it.
    most = F.broadcast(counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most")))
    least = _least_level(counts.select(_level("n").alias("level")), HOT)
    counts = counts.join(most, a_id == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"), _level("n").alias("level"))
    common, uncommon = F.broadcast(counts.where(F.col("level") >= least)), counts.where(F.col("level") < least)
    summed = lambda x: x.groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
    links = held.select("key", "pair", "times")
    parts = summed(links.join(common, "pair")).unionByName(summed(links.join(common.select("pair"), "pair", "left_anti").join(uncommon, "pair")))
    parts = parts.groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    result = done.drop("pairs", "times", "copies").join(parts, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = rows.select("doc_id", F.when(F.col("t") != "", key).alias("key")).join(result, "key", "left")
    return out.select("doc_id", *(zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_texts(table(spark, sf_dir, "documents"))
