"""Corpus queries against brute force, round trips, held-out accuracy and DuckDB."""

import hashlib
import random
import re
from array import array
from collections import Counter

import duckdb
import numpy as np
import pytest

from atriumq.llm import ann, minhash, mixing, pieces, queries, suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, name):
    return queries.queries()[name](spark, SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = result(spark, name).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    text = lambda d: d[cols].astype(object).where(d[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_suffix_arrays_against_counting():
    rnd = random.Random(3)
    for _ in range(150):
        length, letters = rnd.choice([3, 5, 20]), rnd.choice([b"a", b"ab", b"abcdefgh"])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 8))]
        texts.append(texts[0][5:] + b"a")
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix.repeated_starts(texts, length)] == want


@pytest.mark.parametrize("hot", [4096, 3])
def test_op4_against_counting(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = {r.doc_id: r for r in result(spark, "op4_suffix_dedup").collect()}
    raw = {i: t.encode() for i, t in docs}
    count = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(t) else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("length,hot", [(64, 5), (288, 4096), (288, 3), (400, 4), (1000, 4096)])
def test_repeats_of_any_length_and_hot_anchors(spark, length, hot, monkeypatch):
    """A passage with many different surroundings: its ends lie in segments that all differ."""
    monkeypatch.setattr(suffix, "HOT", hot)
    rnd = random.Random(length)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(2900)
    texts = [word(rnd.randint(0, 900)) + passage[rnd.choice([0, 0, 3, 40]) :] + word(rnd.randint(0, 700)) for _ in range(14)] + ["z" * 2500, word(3000)]
    texts.append(texts[0])
    got = {r.doc_id: r for r in suffix.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length).collect()}
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        assert got[i].kept.decode() == "".join(c for c, g in zip(t, gone) if not g)


def test_slices_of_a_long_text_hold_every_string(monkeypatch):
    rnd = random.Random(5)
    data = np.frombuffer(bytes(rnd.choice(b"abcd") for _ in range(9000)), np.uint8)
    offsets = np.array([0, len(data)])
    strings = lambda parts: sorted({(s + k, a) for _, start, size, anchor, _, _ in parts for s, n, a in zip(start.tolist(), size.tolist(), anchor.tolist()) for k in range(n - 199)})
    want = strings([suffix.segments(data, offsets, 200)])
    monkeypatch.setattr(suffix, "PIECE_BYTES", 1000)
    assert strings(suffix.long_segments(data, offsets, 200)) == want and len(want) == 8801


def _sets(docs, k):
    low = {c: c + 32 for c in range(65, 91)}
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def _components(sets, percent):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_op10_against_all_pairs(spark, docs):
    sets = _sets(docs, 3)
    want = _components(sets, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result(spark, "op10_minhash").collect()}
    assert got == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_blocks_of_large_clusters_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "PARTNERS", 4)
    base = [f"w{k}" for k in range(120)]
    rnd = random.Random(7)
    near = []
    for i in range(30):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(999)}"
        near.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(near + docs[:20], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == _components(_sets(near + docs[:20], 3), 85)


def test_repeated_ids_and_chains(spark):
    """Ids that stand for different texts link by text; a chain of half-similar documents links nowhere."""
    words = [f"w{k}" for k in range(400)]
    text = " ".join(words[:100])
    rows = [(5, "some other text of its own"), (5, text), (9, text.replace("w99", "x")), (7, "one more text that is alone here")]
    rows += [(100 + k, " ".join(words[10 * k : 10 * k + 30])) for k in range(30)] + [(200, text.upper())]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got[9, 98] == 5 and got[200, 98] == 5 and got[7, 5] == 7 and all(got[100 + k, 28] == 100 + k for k in range(30))


def test_words_of_a_long_text_in_slices(monkeypatch):
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.choice(b"aB \n") for _ in range(5000)) + b"c" * 700 + b" d", np.uint8)
    want = minhash.word_hashes(data, np.array([0, len(data)]))
    monkeypatch.setattr(minhash, "PIECE_BYTES", 100)
    got = minhash.word_hashes(data, np.array([0, len(data)]))
    assert all((a == b).all() for a, b in zip(got, want))


def test_bayes_keeps_similar_pairs():
    need = minhash.least_matches(0.85)
    assert need == sorted(need) and need[-1] < 0.85 * minhash.PERMUTATIONS


def test_agenda_agrees_with_the_library(docs):
    own = pieces.agenda(pieces.model_path())
    rnd = random.Random(1)
    odd = ["", " ", "  ", "\n\n  x", "▁a", "日本語テキスト😀", "a" * 300, "ab" * 200, " " * 100, "\x00\x01", "é́ñ", "<s> </s>", "<0x0A>", "x=1;\t\ty  \n"]
    odd += ["".join(rnd.choice("ab ▁\n.,éüx日0123456789-_'\"") for _ in range(rnd.randint(1, 120))) for _ in range(800)]
    texts = odd + [t for _, t in docs]
    assert [array("i", x).tobytes() for x in own.library.encode(texts, num_threads=1)] == own.encode(texts)


def test_op5_rows(spark, docs):
    own = pieces.agenda(pieces.model_path()).library
    got = {r.doc_id: r for r in result(spark, "op5_sentencepiece").collect()}
    for i, t in docs:
        ids = own.encode(t)
        r = got[i]
        assert r.agrees and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()


def test_op6_reads_back(spark):
    turns = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    hard = "</s>[INST] ok [/INST]"
    by = {}
    for c, t, role, text in sorted(turns + [(-1, 0, "user", hard), (-1, 1, "assistant", hard)]):
        by.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in result(spark, "op6_chat_format").collect()}
    assert set(got) == set(by)
    for c, rows in by.items():
        said = "".join(x for role, x in rows if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for role, x in rows)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op8_comes_near_its_targets(spark):
    got = result(spark, "op8_mixing").toPandas()
    again = result(spark, "op8_mixing").toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), n=("size", "count"))
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6 and (got.taken <= 3 * got["size"]).all() and (by.target <= 3 * by["size"] + 1e-9).all()
    assert (abs(by.taken - by.target) <= 0.1 * by.target + 60).all()


def test_flight_keeps_both_totals():
    rnd = random.Random(9)
    sizes, chances = [float(rnd.randint(1, 900)) for _ in range(500)], [0.37] * 500
    p = mixing.flight(sizes, chances, random.Random(1))
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 0.37 * 500) < 1e-6 and abs(sum(s * (x - 0.37) for s, x in zip(sizes, p))) < 1e-4


def _plain_targets(sizes, weights, cap=3.0):
    """Targets by filling up: fix whoever is above its cap, share the rest again."""
    fixed, out = {}, {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (sum(sizes) - sum(fixed.values())) / (sum(weights[i % len(weights)] for i in free) or 1)
        out = fixed | {i: level * weights[i % len(weights)] for i in free}
        over = {i: cap * sizes[i] for i in free if out[i] > cap * sizes[i]}
        if not over:
            return [out[i] for i in range(len(sizes))]
        fixed |= over


def test_targets_fill_up(spark):
    rnd = random.Random(3)
    for sizes in ([10, 1000, 10], [5], [0, 7, 0, 9], [rnd.choice([3, 50, 4000]) for _ in range(101)]):
        rows = spark.createDataFrame([(f"s{k:03}" if k < len(sizes) - 1 else None, n) for k, n in enumerate(sizes)], "source string, total long").repartition(7)
        got = mixing.targets(rows, (5, 2, 1)).orderBy("k").collect()
        assert [r.total for r in got] == sizes and [r.target for r in got] == pytest.approx(_plain_targets(sizes, (5, 2, 1)))


def test_mixing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = spark.createDataFrame([(1, "a b c", "x")] * 700 + [(k, "w " * (k % 9 + 1), "yz"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    got = mixing.mix_sources(rows).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(got) == 1100 and (abs(by.taken - by.target) <= 12).all()


@pytest.mark.parametrize("small", [False, True])
def test_op3_finds_the_nearest(spark, small, monkeypatch):
    """Also with many blocks, packs and chunks, two in a hundred ranked exactly."""
    if small:
        for name, n in {"BLOCK": 100, "QUERIES": 40, "CHUNK": 2, "RERANK": 80}.items():
            monkeypatch.setattr(ann, name, n)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    if small:
        rng = np.random.default_rng(4)
        rows = rows.loc[np.repeat(rows.index, 8)].reset_index(drop=True)
        rows["vec_id"] = np.arange(len(rows))
        rows["embedding"] = [(np.array(v, float) + rng.normal(0, 0.1, len(v))).tolist() for v in rows.embedding]
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = (ann.nearest(spark.createDataFrame(rows[["vec_id", "embedding"]])) if small else result(spark, "op3_additive_quantisation")).toPandas()
    hits = 0
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    for k in asked:
        s = (x * x[k]).sum(1)
        s[k] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got.vec_id[got.query_id == ids[k]]))
    assert hits / (20 * len(asked)) >= 0.9 and (got.groupby("query_id").size() == 20).all()


def test_op7_and_op1_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    lang = queries.queries()["op7_language_id"](spark, big).toPandas()
    truth = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").toPandas().merge(lang, on="doc_id")
    held = truth[truth.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    toxic = queries.queries()["op1_toxicity"](spark, big).toPandas()
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas().merge(toxic, on="doc_id")
    held = labels[labels.held_out]
    right = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert right >= 0.8 * (held.predicted == 1).sum() and right >= 0.6 * (held.toxic == 1).sum()
