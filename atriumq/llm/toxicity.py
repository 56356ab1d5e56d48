"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words is the gap-weighted count of their common subsequences of three letters,
normalised; it falls only a little when letters are inserted, dropped or parted by signs. A word is
compared at every offset and over every length: its best span counts, so beginnings, endings and glued
words do not dilute it. Words that lack more than one letter of a landmark in its order have kernel 0. A sentence is the sum of
its words, so its kernel with a landmark is the sum of the words' kernels; landmarks are words that
tell labelled toxic documents from clean ones and the clean words most like them. The machine is
trained on sentences: those of clean documents against those of toxic ones that hold a landmark, and
against landmarks with a letter inserted, dropped or doubled. A document scores as its worst
sentence, calibrated on the training documents so that CUT is the cut that parts them best.

Defined results: null and empty texts have no sentence and get the score of a text without a hit;
without labels of both kinds every score is 0; equal texts have equal scores; an empty table gives no rows; a
text of any length is read whole; other columns of the input are ignored. Training reads at most SAMPLE
documents of either label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, pieces, remainder, table

#: Bounds of the training sample: documents of each label, and characters of a document in it; of longer ones a stretch is taken.
SAMPLE, SAMPLE_CHARS = {1: 1500, 0: 3000}, 12_000
#: Landmarks from toxic documents, and like words from clean ones.
TOXIC_MARKS, CLEAN_MARKS = 64, 32
#: A landmark's z of the difference of its shares, and a sentence's kernel with a landmark that makes it a positive one.
LEAST_Z, STRONG = 6.0, 0.8
#: The share of landmarks with a letter inserted, doubled or dropped, in the machine and in its calibration.
HIDDEN = 0.25
#: Subsequences of ORDER letters; each letter that a subsequence spans costs a factor DECAY.
ORDER, DECAY, POWER = 3, 0.85, 2
#: The share of the span's own kernel in the norm, the rest being the landmark's. With a half, letters between those of
#: the landmark would count against a span twice, as gaps and as subsequences of its own.
SPAN = 0.35
#: The score from which a document counts as toxic.
CUT = 0.7
#: The longest landmark.
WIDE = 24
#: Longer words are taken in windows of WINDOW letters, every half of one, so that all spans of half a window are seen whole.
WINDOW = 64
#: Words of like length are compared together.
LENGTHS = (6, 8, 10, 13, 17, WIDE, WINDOW)
SEEN = 400_000

_JUNK = re.compile(r"[\W\d_]+")
_SPELT = re.compile(r"(?:\s\w[^\w\s]?){3,}(?=\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def _codes(words: list[str], wide: int = WIDE) -> np.ndarray:
    """Letters as numbers, one column a word; 0 behind the end."""
    if not words:
        return np.zeros((wide, 0), np.int64)
    return np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide).T.astype(np.int64)


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weight of the common subsequences of ORDER letters that end at letter i of a and j of b, column by column."""
    n = a.shape[1]
    rows, cols = int((a > 0).sum(0).max(initial=0)), int((b > 0).sum(0).max(initial=0))
    same = ((a[:rows, None] == b[None, :cols]) & (a[:rows, None] > 0)).astype(np.float64)
    before = np.ones((rows + 1, cols + 1, n))
    for _ in range(ORDER - 1):
        now = np.zeros_like(before)
        for i in range(rows):
            step = DECAY**2 * same[i] * before[i, :cols]
            run = np.zeros(n)
            for j in range(cols):
                run = DECAY * run + step[j]
                now[i + 1, j + 1] = DECAY * now[i, j + 1] + run
        before = now
    return DECAY**2 * same * before[:rows, :cols]


def ssk(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of ORDER letters, column by column."""
    return _ends(a, b).sum((0, 1))


class Landmarks:
    """Words to their kernel with each landmark."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.codes = _codes(marks)
        self.size = np.array([len(m) for m in marks], np.int64)
        self.own = np.sqrt(ssk(self.codes, self.codes)) if marks else np.zeros(0)
        #: Letters of landmarks, numbered from 1, and where in each landmark they stand.
        letters = sorted(set("".join(marks)))
        self.index = np.zeros(0x110000, np.int16)
        self.index[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = np.zeros((len(marks), len(letters) + 1), np.uint32)
        for k, m in enumerate(marks):
            for j, c in enumerate(m):
                self.bits[k, self.index[ord(c)]] |= np.uint32(1 << j)
        self.letters = self._letters(self.codes)
        self.distinct = np.bitwise_count(self.letters).astype(np.int64)

    @staticmethod
    def _letters(codes: np.ndarray) -> np.ndarray:
        bit = np.left_shift(np.uint64(1), (codes % 61).astype(np.uint64))
        return np.bitwise_or.reduce(np.where(codes > 0, bit, np.uint64(0)), axis=0)

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) of all kernels that are not 0, of words of up to WINDOW letters."""
        lengths = np.array([len(w) for w in words], np.int64)
        ws, ms, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for low, high in zip((ORDER - 1, *LENGTHS), LENGTHS):
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            codes = _codes([words[k] for k in some], high)
            w, m = self._near(codes, lengths[some])
            much = max(16, (1 << 20) // high**2)
            for k in range(0, len(w), much):
                values.append(self._best(codes, w[k : k + much], m[k : k + much]))
            ws.append(some[w])
            ms.append(m)
        return np.concatenate(ws), np.concatenate(ms), np.concatenate(values)

    def _near(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of word and landmark that have all letters of the landmark but one in its order, wherever they stand."""
        letters, which = self._letters(codes), self.index[codes]
        ws, ms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, size in enumerate(self.size):
            near = np.flatnonzero((np.bitwise_count(letters & self.letters[k]) + 1 >= self.distinct[k]) & (lengths >= max(ORDER, size - 1)))
            if not len(near):
                continue
            open_ = np.full(len(near), 0xFFFFFFFF, np.uint32)  # common subsequence by bits
            for row in which[:, near]:
                hit = open_ & self.bits[k][row]
                open_ = (open_ + hit) | (open_ - hit)
            common = np.bitwise_count(~open_ & np.uint32((1 << int(size)) - 1))
            near = near[common >= max(ORDER, size - 1)]
            ws.append(near)
            ms.append(np.full(len(near), k))
        return np.concatenate(ws), np.concatenate(ms)

    def _best(self, codes: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The best over all spans of each word. It begins with a letter of the landmark: others before it only add to the span's own kernel."""
        best = np.zeros(len(w))
        known, place = self.bits > 0, self.index[codes]
        for start in range(len(codes) - ORDER + 1):
            on = np.flatnonzero(known[m, place[start, w]] & (codes[start + ORDER - 1, w] > 0))
            if not len(on):
                continue
            raw = _ends(codes[start:, w[on]], self.codes[:, m[on]]).sum(1).cumsum(0)
            # The same word often meets several landmarks; its own kernel up to each letter is taken once.
            one, which = np.unique(w[on], return_inverse=True)
            ends = _ends(codes[start:, one], codes[start:, one])
            own = ends.cumsum(0).cumsum(1)[np.arange(len(ends)), np.arange(len(ends))][:, which]
            best[on] = np.maximum(best[on], (raw / np.maximum(own**SPAN * self.own[m[on]] ** (2 - 2 * SPAN), 1e-12)).max(0))
        return np.clip(best, 0, 1) ** POWER


def units(token: str) -> list[str]:
    """The letters of a token, in windows if there are many."""
    word = _JUNK.sub("", token)
    if len(word) < ORDER:
        return []
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


class Reader:
    """Texts to the landmark sums of their sentences that have any; remembers words."""

    def __init__(self, marks: Landmarks):
        self.marks, self.seen, self.hot = marks, set(), {}

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens - self.seen)
        if len(self.seen) + len(new) > SEEN:
            self.seen.clear()
            self.hot.clear()
            new = list(tokens)
        self.seen.update(new)
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            pairs = [(t, u) for t in part for u in units(t)]
            if not pairs:
                continue
            w, m, value = self.marks.kernel([u for _, u in pairs])
            for x, y, z in zip(w.tolist(), m.tolist(), value.tolist()):
                row = self.hot.setdefault(pairs[x][0], {})
                row[y] = max(row.get(y, 0.0), z)

    def sentences(self, text: str, spelt: list[str]) -> list[dict[int, float]]:
        out: list[dict[int, float]] = []
        for tokens in [*map(str.split, _SENTENCE.split(text)), *([x] for x in spelt)]:
            if self.hot.keys().isdisjoint(tokens):
                continue
            now: dict[int, float] = {}
            for token in tokens:
                if token in self.hot:
                    for m, v in self.hot[token].items():
                        now[m] = now.get(m, 0.0) + v
            out.append(now)
        return out

    def read(self, texts: list[str]) -> list[list[dict[int, float]]]:
        lower = [t.lower() for t in texts]
        tokens = [t.split() for t in lower]
        spelt = [[_JUNK.sub("", m) for m in _SPELT.findall(f" {t}")] for t in lower]
        sets = [set(x).union(s) for x, s in zip(tokens, spelt)]
        self.learn(set().union(*sets))
        out = []
        for t, s, words in zip(lower, spelt, sets):
            if self.hot.keys().isdisjoint(words):
                out.append([])
                continue
            out.append(self.sentences(t, s))
        return out


class Machine:
    """Weights over landmarks: kernel sums times Nyström's inverse root times the machine's own."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.marks, self.weights, self.bias, self.slope, self.shift = marks, weights, bias, slope, shift

    def decide(self, sentences: list[dict[int, float]]) -> float:
        w = self.weights
        return self.bias + max((sum(w[m] * v for m, v in s.items()) for s in sentences), default=0.0)

    def score(self, decision: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30))))


def _separate(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 20.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        xs, cs = x1[on], (c * cost[on])[:, None]
        grad = ridge @ w - (xs * cs * (y[on] * slack[on])[:, None]).sum(0)
        step = np.linalg.solve(ridge + xs.T @ (xs * cs), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _platt(d: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the chance of label 1, with Platt's smoothed targets; c weighs the rows."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, w = np.where(y > 0, hi, lo), np.zeros(2)
    x = np.stack([d, np.ones_like(d)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (c * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (c * (p - t)) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def _best_cut(d: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """The decision above which to call rows toxic for the best F1, midway to the next lower one."""
    order = np.argsort(-d, kind="stable")
    d, right, taken = d[order], np.cumsum((y * c)[order]), np.cumsum(c[order])
    f1 = np.where(np.append(d[1:], -np.inf) < d, 2 * right / (taken + (y * c).sum()), 0.0)
    k = int(np.argmax(f1))
    return float(d[k] + d[k + 1]) / 2 if k + 1 < len(d) else float(d[k])


def choose(toxic: list[str], clean: list[str]) -> tuple[Landmarks, int]:
    """Landmarks: words and beginnings of words that toxic documents have and clean ones lack, then
    the clean words most like them; and how many are of the first kind."""

    def words(t: str) -> set[str]:
        return {u[:WIDE] for x in set(t.lower().split()) for u in units(x) if len(u) > ORDER}

    def starts(t: str) -> set[str]:
        found = words(t)
        return found | {w[:k] for w in found for k in range(ORDER + 1, 8)}

    pos, neg, plain = Counter(), Counter(), Counter()
    for t in toxic:
        pos.update(starts(t))
    for t in clean:
        neg.update(starts(t))
        plain.update(words(t))
    np_, nn = len(toxic), len(clean)

    def contrast(w: str) -> float:  # z of the difference of two shares
        a, b = pos[w] / np_, neg[w] / nn
        p = (pos[w] + neg[w]) / (np_ + nn)
        return (a - b) / (p * (1 - p) * (1 / np_ + 1 / nn)) ** 0.5 if 0 < p < 1 else 0.0

    best = sorted((-contrast(w), -len(w), w) for w, n in pos.items() if n >= 3 and n / np_ > 8 * neg[w] / nn)
    marks: list[str] = []
    for z, _, w in best:
        if len(marks) >= TOXIC_MARKS or (z > -LEAST_Z and len(marks) >= 4):
            break
        if not any(w.startswith(x) or x.startswith(w) for x in marks):
            marks.append(w)
    marks = [w[:WIDE] for w in marks]
    if not marks:
        return Landmarks([]), 0
    others = sorted(w for w in plain if w not in marks)
    w, _, value = Landmarks(marks).kernel(others)
    like: dict[str, float] = {}
    for x, v in zip(w.tolist(), value.tolist()):
        like[others[x]] = max(like.get(others[x], 0.0), v * min(plain[others[x]], 3))
    return Landmarks(marks + sorted(like, key=lambda x: (-like[x], x))[:CLEAN_MARKS]), len(marks)


def spoilt(word: str) -> list[str]:
    """A landmark as it is hidden: a letter inserted, doubled or dropped."""
    inner = range(1, len(word))
    return [word[:k] + c + word[k:] for k in inner for c in (word[k], "x", "h")] + [word[:k] + word[k + 1 :] for k in inner if len(word) > 4]


def unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones, which would vote for whatever word they share.
    Two texts count as copies if they share a third of the smallest hashes of their words."""
    kept, by = [], {}
    for t in texts:
        sketch = sorted(zlib.crc32(w.encode()) for w in set(t.lower().split()))[:24]
        votes = Counter(k for h in sketch for k in by.get(h, ()))
        if votes and 3 * max(votes.values()) >= len(sketch):
            continue
        for h in sketch:
            by.setdefault(h, []).append(len(kept))
        kept.append(t)
    return kept


def fit(toxic: list[str], clean: list[str]) -> Machine | None:
    toxic, clean = unlike(toxic), unlike(clean)
    if not toxic or not clean:
        return None
    marks, n_toxic = choose(toxic, clean)
    m = len(marks.marks)
    if not m:
        return None
    reader = Reader(marks)
    bags, others = reader.read(toxic), reader.read(clean)
    dense = lambda rows: np.array([[s.get(k, 0.0) for k in range(m)] for s in rows]).reshape(-1, m)
    w, k, v = marks.kernel(marks.marks)
    gram = np.zeros((m, m))
    gram[w, k] = v
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    found = [[s for s in b if max((v for k, v in s.items() if k < n_toxic), default=0.0) >= STRONG] for b in bags]
    hits = dense([s for b in found for s in b])
    if not len(hits):
        return None
    hidden = [(x, i) for i, x in enumerate(marks.marks[:n_toxic]) for x in spoilt(x)]
    w, k, v = marks.kernel([x for x, _ in hidden])
    fake = np.zeros((len(hidden), m))
    fake[w, k] = v
    rest = dense([s for b in others for s in b])
    x = np.vstack([hits, fake, rest, np.zeros((1, m))]) @ root
    y = np.concatenate([np.ones(len(hits) + len(fake)), -np.ones(len(rest) + 1)])
    share = hits[:, :n_toxic].max(0) >= STRONG
    # Every landmark weighs alike among the real positives, whatever its frequency.
    by = np.array([max(1, int((hits[:, j] >= STRONG).sum())) for j in range(n_toxic)])
    first = np.argmax(hits[:, :n_toxic] >= STRONG, axis=1)
    cost = np.concatenate([1 / by[first] / max(1, share.sum()), np.full(len(fake), 0.5 / max(1, len(fake))), np.full(len(rest), 1.0 / max(50, len(rest))), [1.0]]) * 1000
    weights, bias = _separate(x, y, cost)
    out = Machine(marks, root @ weights, bias, 1.0, 0.0)
    # Hidden insults count as toxic documents too, together as much as HIDDEN of the real ones.
    decisions = np.array([out.decide(b) for b in bags] + [out.decide(b) for b in others] + (fake @ out.weights + bias).tolist())
    label = np.concatenate([np.ones(len(bags)), np.zeros(len(others)), np.ones(len(fake))])
    weight = np.concatenate([np.ones(len(bags) + len(others)), np.full(len(fake), HIDDEN * len(bags) / max(1, len(fake)))])
    out.slope, out.shift = _platt(decisions, label, weight)
    # The score at the cut that parts the training documents best is CUT.
    out.shift = float(np.log(CUT / (1 - CUT)) - out.slope * _best_cut(decisions, label, weight))
    return out


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Machine | None:
    """A machine from at most SAMPLE rows of either label: those with the smallest hash of their id; of a text
    of more than SAMPLE_CHARS characters so many from a place that the hash chooses."""
    rows = labelled.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col)).alias("h"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("t").isNotNull())
    at = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = rows.withColumn("t", F.substring(F.col("t"), at, F.lit(SAMPLE_CHARS)))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    span = 1 << 30
    few = [(F.col("y") == y) & (F.pmod("h", F.lit(span)) < min(span, SAMPLE[y] * span // n + 1)) for y, n in counts.items()]
    if len(few) < 2:
        return None
    found = sorted((r["y"], r["h"], r["t"]) for r in rows.where(few[0] | few[1]).collect())
    pick = {y: [t for z, _, t in found if z == y][: SAMPLE[y]] for y in (0, 1)}
    return fit(pick[1], pick[0])


def score_toxicity(docs: DataFrame, machine: Machine | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = machine and Reader(machine.marks)
        for batch in pieces(batches, "t", 8 << 20):
            if reader is None:
                scores = [0.0] * batch.num_rows
            else:
                scores = [machine.score(machine.decide(s)) for s in reader.read([t or "" for t in batch.column("t").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(frugal(run), f"doc_id {kind}, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where((remainder("doc_id", 3) != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    machine = train(docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text").join(known, "doc_id"))
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
