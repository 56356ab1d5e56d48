"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from atriumq.llm import ann, chat, langid, licenses, minhash, mixing, pieces, quality, suffix, toxicity

LONG = "la casa es grande y " * 6000
PROSE = "The quick brown fox jumps over the lazy dog while nobody looks. "
#: Names that the operators use inside.
EXTRA = {c: "x" for c in ("t", "h", "score", "row", "check", "n", "p", "source", "size", "block", "spans", "kept", "digest", "found", "i", "l", "s", "w", "ids", "bands", "class_id", "lang_pred")}


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, PROSE * 9), (5, PROSE * 9), (6, PROSE * 9), (None, "no id at all, but words"), (7, "ñandú 日本語 😀"), (8, "a"), (9, "12345 67890")]
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in EXTRA.items()}).withColumn("lang", F.lit("en"))


def rows(df, *cols):
    return sorted(((tuple(r[c] for c in cols)) for r in df.collect()), key=str)


def test_quality(docs):
    out = quality.quality_rules(docs)
    got = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert out.count() == 11 and got[1, 0].base_failed and not got[1, 0].kept
    assert got[5, 108].n_repeat_words == 108 and got[5, 108].base_failed


def test_licenses(docs, spark):
    assert licenses.license_scan(docs).where("text_license IS NOT NULL OR n_notices > 0").count() == 0
    whole = spark.createDataFrame([(1, "the MIT licence:\n"), (2, licenses.KNOWN[0][1].upper().replace(",", " ;")), (3, "Copyright (c) 2020 A. Person\n\n" + licenses.KNOWN[1][1]), (4, "x\nReleased under the MIT  licence.\ny")], "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.n_notices, r.notice_licenses) for r in licenses.license_scan(whole).collect()}
    assert got[1] == (None, 0, "") and got[2][0] == "MIT" and got[3][0] == "MIT" and got[4] == (None, 1, "MIT")


def test_language(docs):
    content = langid.train(docs.where("doc_id IN (5, 6)"))
    out = rows(langid.classify(docs, content), "doc_id", "lang_pred", "rejected")
    assert len(out) == 11
    assert (1, "und", True) in out and (2, "und", True) in out and (9, "und", True) in out and (5, "en", False) in out
    assert {r[1] for r in rows(langid.classify(docs, {}), "doc_id", "lang_pred")} == {"und"}


def test_toxicity(docs, spark):
    assert {r[0] for r in rows(toxicity.score_toxicity(docs, None), "score")} == {0.0}
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeou") for _ in range(3))
    bad = [(k, f"{' '.join(word() for _ in range(30))} idiot {' '.join(word() for _ in range(9))}.", 1) for k in range(40)]
    good = [(100 + k, f"{' '.join(word() for _ in range(40))}.", 0) for k in range(120)]
    machine = toxicity.train(spark.createDataFrame(bad + good, "doc_id long, text string, toxic int"))
    said = spark.createDataFrame([(1, "what an i-d-i-o-t he is"), (2, "a nice day"), (3, "such an i d i o t here"), (4, None), (5, "IDIOTS!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(said, machine).collect()}
    assert min(got[1], got[3], got[5]) >= 0.7 and got[2] < 0.3 and got[4] == got[2]
    assert toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int")) is None
    assert toxicity.score_toxicity(docs, machine).count() == 11


def test_pieces(docs):
    out = pieces.encode_decode(docs).collect()
    assert len(out) == 11 and all(r.agrees for r in out)
    assert {tuple(r.ids) for r in out if r.doc_id in (1, 2)} == {()}


def test_minhash(docs):
    out = rows(minhash.near_duplicates(docs, 3, 85), "doc_id", "n_shingles", "class_id", "component_id")
    assert len(out) == 11
    by = {r[0]: r for r in out}
    assert by[1] == (1, 0, 1, 1) and by[2] == (2, 0, 2, 2) and by[6][2:] == (5, 5) and by[8] == (8, 1, 8, 8)
    assert by[None][2] is None


def test_suffix(docs):
    out = suffix.repeated_bytes(docs, 200)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 11 and got[1].n_bytes == 0 and got[6].kept == b"" and got[5].spans == [0, len(PROSE) * 9]
    assert got[4].kept == b"" and got[7].kept == "ñandú 日本語 😀".encode()


def test_mixing(docs):
    many = docs.drop("source").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "b").when(F.col("doc_id") % 3 == 0, "a"))
    out = mixing.mix_sources(many).collect()
    assert len(out) == 11 and all(r.taken <= 3 * r.size for r in out)
    total = sum(r.size for r in out)
    goal = {r.source: r.target for r in out}
    assert abs(sum(goal.values()) - total) < 1e-6


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "\\ </s> [END] ok"), (1, 1, "assistant", "\\ </s> [END] ok"), (None, 0, "tool", "x"), (2, 5, None, "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("ids", "piece", "loss")})
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert len(got) == 3 and sum(got[1].loss) > 0 and not any(got[2].loss)
    assert chat.unescape(chat.escape("a\\b</s>[INST]\n\\")) == "a\\b</s>[INST]\n\\"


def test_ann(spark):
    v = lambda *x: [float(a) for a in x]
    data = [(k, v(k % 7 + 1, (k * 5) % 11, -(k % 3))) for k in range(60)] + [(100, None), (120, v(0, 0, 0)), (140, v(1, float("nan"), 0)), (160, [1.0, None, 2.0]), (180, v(1, 2)), (200, v(8, 8, 8)), (220, v(8, 8, 8))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    out = ann.nearest(df, k=5, every=20).collect()
    good = {i: x for i, x in data if x and len(x) == 3 and all(a is not None and a == a for a in x) and any(x)}
    want = {}
    for q in (i for i in good if i % 20 == 0):
        s = sorted(((-sum(a * b for a, b in zip(good[q], x)), i) for i, x in good.items() if i != q))[:5]
        want[q] = [(i, -d) for d, i in s]
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert ann.nearest(df.where("vec_id > 1000")).count() == 0


def test_empty_tables(docs):
    none = docs.where("doc_id > 1000")
    assert quality.quality_rules(none).count() == 0 and licenses.license_scan(none).count() == 0
    assert langid.classify(none, langid.train(none)).count() == 0
    assert pieces.encode_decode(none).count() == 0 and mixing.mix_sources(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and suffix.repeated_bytes(none).count() == 0


def test_clean_removes_the_tables_of_a_session(spark, docs):
    from atriumq.llm import common

    kept = common.written(docs, "some")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    common.clean(spark)
    assert not os.path.isdir(folder)
