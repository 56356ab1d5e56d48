"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda of adjacent symbol pairs: the pair whose union has the best score, leftmost
on ties, is merged until no union is in the vocabulary; characters left outside the vocabulary fall
back to byte pieces. Texts are cut where no piece of the vocabulary can reach across, so equal
chunks are merged once. Short chunks run through the agenda together, one merge of each at a time,
as numpy arrays; long ones use a heap. The agenda's ids are what is returned, and the text is read
back from them; the sentencepiece library encodes every text too, only to tell whether it ``agrees``.

Defined results: null counts as empty and gives no ids; repeated rows give repeated results; a text of any
length is encoded whole, chunk by chunk; equal scores go to the leftmost pair; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as cut
from .common import frugal, table

#: Longer chunks use the heap: an array round costs as much as the chunk is long.
LONG = 48
#: Chunks kept in a task; all are forgotten when it is full.
CACHE = 400_000
BLANK = "▁"
_NONE = np.int64(1) << 62


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Agenda:
    """The merges of one vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.id_of = {lib.id_to_piece(i): i for i in normal}
        self.score = {i: lib.get_score(i) for i in normal}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        #: Single characters outside the vocabulary that pieces hold get symbols after its end.
        self.symbol = dict(self.id_of)
        for piece in self.id_of:
            for c in piece:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.symbol[" "] = self.symbol[BLANK]
        self.rank = np.full(max(self.symbol.values()) + 2, _NONE, np.int64)
        for i, s in self.score.items():
            self.rank[i] = ranks[s]
        found = {(self.symbol[p[:k]], self.symbol[p[k:]]): i for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol}
        self._table(found)
        inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        # A cut before every run of blanks, and around single characters that no piece joins to anything.
        alone = [c for c in map(chr, range(128)) if c != BLANK and not any(c in pair for pair in inside)]
        if any(a != BLANK and b == BLANK for a, b in inside):
            self.chunks = re.compile(r"(?s).+").findall  # a piece reaches across: no cut is safe
        else:
            # Blanks stay as they are here: most texts are then one byte a character.
            lone = "".join(map(re.escape, (c for c in alone if c in "\n\t\r")))
            mark = "".join(map(re.escape, sorted(self._marks(inside))))
            word = f" *[{mark}]+[^ {lone}{mark}]*| *[^ {lone}{mark}]+| +" if mark else f" *[^ {lone}]+| +"
            self.chunks = re.compile(f"{word}|[{lone}]" if lone else word).findall
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _marks(inside: set[str]) -> set[str]:
        """Punctuation that no piece holds behind anything else than blanks and such punctuation, so that
        a text may be cut between a word and the marks that follow it."""
        marks, barred = {c for c in map(chr, range(33, 127)) if not c.isalnum()}, set()  # ASCII first
        while True:
            wrong = [(a, b) for a, b in inside if b in marks and a not in marks and a != BLANK]
            if not wrong:
                return marks
            for a, b in wrong:
                if a.isalpha() or a.isdecimal() or a in barred:
                    marks.discard(b)
                    barred.add(b)
                else:
                    marks.add(a)

    def _table(self, found: dict[tuple[int, int], int]) -> None:
        """Open addressing: pair to the symbol of its union."""
        self.bits = max(10, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.unions = np.full(1 << self.bits, -1, np.int64)
        left = np.array([(a << 24) | b for a, b in found], np.int64)
        value, self.probes = np.array(list(found.values()), np.int64), 0
        while len(left):
            at = self._slot(left, self.probes)
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]  # of several the last stays
            mine = self.keys[at] == left
            self.unions[at[mine]] = value[mine]
            left, value, self.probes = left[~mine], value[~mine], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        spread = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (spread.astype(np.int64) + probe * 7) & ((1 << self.bits) - 1)

    def _union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol of a+b, -1 where the vocabulary has none."""
        keys = (a << 24) | b
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        for probe in range(self.probes):
            at = self._slot(keys[left], probe)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.unions[at[hit]]
            left = left[~hit & (found >= 0)]  # an empty slot ends the search
            if not len(left):
                break
        return out

    def _ids(self, symbols: list[int], chunk: str) -> bytes:
        """Symbols to ids: those outside the vocabulary as bytes of their characters."""
        out, at = array("i"), 0
        for s in symbols:
            piece = self._text.get(s) if s >= 0 else None
            width = len(piece) if piece else 1
            if s in self.score:
                out.append(s)
            else:
                out.extend(self.bytes[b] for b in chunk[at : at + width].encode())
            at += width
        return out.tobytes()

    @functools.cached_property
    def _text(self) -> dict[int, str]:
        return {i: p for p, i in self.symbol.items() if p != " "}

    def merge_long(self, chunk: str) -> bytes:
        """One chunk through a heap of (rank, position)."""
        sym = [self.symbol.get(c, -1) for c in chunk]
        n = len(sym)
        before, after, union = list(range(-1, n - 1)), list(range(1, n + 1)), self._pairs
        rank, heap = self.rank, []

        def add(i: int, j: int) -> None:
            if i >= 0 and j < n and (u := union.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(rank[u]), i, j, sym[i], sym[j], u))

        for i in range(n - 1):
            add(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, j, a, b, u = heapq.heappop(heap)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], gone[j], after[i] = u, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            add(before[i], i)
            add(i, after[i])
        return self._ids([s for s, g in zip(sym, gone) if not g], chunk)

    @functools.cached_property
    def _pairs(self) -> dict[tuple[int, int], int]:
        full = self.keys >= 0
        return {(k >> 24, k & 0xFFFFFF): u for k, u in zip(self.keys[full].tolist(), self.unions[full].tolist())}

    def merge_short(self, chunks: list[str]) -> list[bytes]:
        """All chunks at once: each round merges the best pair of every chunk that still has one."""
        get = self.symbol.get
        sym = np.array([get(c, -1) for c in "".join(chunks)], np.int64)
        counts = np.array([len(c) for c in chunks], np.int64)
        alive = np.arange(len(chunks))
        union = np.full(len(sym), -1, np.int64)
        union[:-1] = self._union(sym[:-1], sym[1:])
        union[np.cumsum(counts) - 1] = -1
        key = np.where(union >= 0, self.rank[union] << 24, _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pair(at: np.ndarray) -> None:
            union[at] = found = self._union(sym[at], sym[at + 1])
            key[at] = np.where(found >= 0, self.rank[found] << 24, _NONE)

        while len(alive):
            first = np.cumsum(counts) - counts
            best = np.minimum.reduceat(key | np.arange(len(key)), first)
            at, on = best & 0xFFFFFF, best < _NONE
            keep = np.ones(len(sym), bool)
            if not on.all():
                rest = np.repeat(~on, counts)
                done.append((np.repeat(alive[~on], counts[~on]), sym[rest]))
                keep = ~rest
                at, first, alive, counts = at[on], first[on], alive[on], counts[on]
            sym[at], keep[at + 1] = union[at], False
            sym, union, key = sym[keep], union[keep], key[keep]
            within, counts = at - first, counts - 1
            at = np.cumsum(counts) - counts + within
            union[at], key[at] = -1, _NONE
            pair(at[within < counts - 1])
            pair(at[within > 0] - 1)
        order = np.argsort(np.concatenate([w for w, _ in done]), kind="stable")
        words, symbols = np.concatenate([w for w, _ in done])[order], np.concatenate([s for _, s in done])[order]
        ends = np.searchsorted(words, np.arange(len(chunks) + 1))
        plain = np.zeros(len(self.rank) + 1, bool)
        plain[list(self.score)] = True
        fine, raw = plain[symbols], symbols.astype(np.int32).tobytes()
        odd = np.concatenate(([0], np.cumsum(~fine)))
        odd = (odd[ends[1:]] > odd[ends[:-1]]).tolist()
        ends = ends.tolist()
        return [raw[4 * a : 4 * b] if not o else self._ids(symbols[a:b].tolist(), c) for a, b, o, c in zip(ends, ends[1:], odd, chunks)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        cut_up = [self.chunks(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        cache = self.cache
        new = list(set().union(*cut_up).difference(cache)) if cut_up else []
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list(set().union(*cut_up))
        short = [c for c in new if len(c) <= LONG]
        for k in range(0, len(short), 8_000):
            cache.update(zip(some := short[k : k + 8_000], self.merge_short(some)))
        for c in new:
            if len(c) > LONG:
                cache[c] = self.merge_long(c)
        return [b"".join(map(cache.__getitem__, c)) for c in cut_up]


@functools.lru_cache(2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def tokenised(own: Agenda, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ids, the text read back from them and whether the library agrees, of the texts in ``t``."""
    texts = [t or "" for t in batch.column("t").to_pylist()]
    found = own.encode(texts)
    agrees = [array("i", ids).tobytes() == raw for ids, raw in zip(own.library.encode(texts, num_threads=1), found)]
    decoded = [own.library.decode(array("i", raw).tolist()) for raw in found]
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
        ["doc_id", "ids", "decoded", "agrees"],
    )


def encode_decode(docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, decoded string, agrees boolean."""
    path = path or model_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(path)
        for batch in cut(batches, "t", 1 << 20):
            yield tokenised(own, batch)
        own.cache.clear()  # a worker that waits holds no chunks

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    made = encode_decode(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "agrees",
    )
