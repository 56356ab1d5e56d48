"""Rules that must not turn on a phrase, a line break, a number of languages, a batch or a partitioning."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from atriumq.llm import langid, licenses, mixing, quality, suffix

PROSE = "The mill by the river was {} and the people of the valley spoke of it for many years, since nobody there had seen such a thing before."
SAYS = ["powered by water", "known to read more into things", "under the terms of use of the abbey", "a house with a privacy policy of sorts", "easy to click here and there", "one to skip to content hearts", "spread more by talk than by print", "a place to go back to top form", "said to be lorem ipsum in stone", "where all rights reserved for monks were kept"]


def _twin(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.execute(f"CREATE TABLE {name} (doc_id BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return {r[names.index("doc_id")]: dict(zip(names, r)) for r in found.fetchall()}


def test_running_prose_keeps_its_phrases(spark):
    rows = [(k, PROSE.format(s) + "\n" + " ".join(f"word{k}x{j}" for j in range(30)) + ".") for k, s in enumerate(SAYS)]
    rows += [(100, "\n".join(["Read more", "Click here >>", "Privacy Policy | Terms of Use", "weiterlesen", "Back to top", "[Cookie-Richtlinie]"] * 6 + [PROSE.format("old")]))]
    rows += [(101, "これは長い文です。" * 3 + "\n" + " ".join(f"w{k}" for k in range(60)) + "。")]
    out = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k].kept and out[k].n_kept_words == out[k].n_words for k in range(len(SAYS))) and not out[100].kept and out[101].kept
    assert out[100].n_kept_words == len(PROSE.format("old").split())
    twin = _twin(quality.ORACLE, documents=rows)
    assert all((r["kept"], r["n_kept_words"]) == (out[k].kept, out[k].n_kept_words) for k, r in twin.items())


def test_unwrapped_licences(spark):
    name, text = next((n, t) for n, t in licenses.KNOWN if n == "MIT" and len(t.split()) > 100)
    flat = " ".join(text.split())
    at = flat.lower().index("permission is hereby")
    body = flat[at:]
    essay = "Copyright Clearance is a company that licenses texts of others to people who copy them, and this essay says at some length how it came about and why it stayed."
    rows = [(1, "Copyright (c) 2020 Jane Doe. " + body), (2, "MIT License Copyright (c) 2020 Jane Doe " + body), (3, "Copyright (c) 2020 Jane Doe\n\n" + text[text.lower().index("permission is hereby"):]), (4, essay), (5, "Copyright 2019 by A. B. Carter and others " + body), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert out[1].text_digest == out[3].text_digest == out[5].text_digest and out[4].text_digest != out[6].text_digest
    known = {r.text_license for r in (out[1], out[3])}
    assert known == {out[1].text_license} and out[2].text_license in ("MIT", out[1].text_license)
    twin = _twin(licenses.ORACLE, documents=rows)
    assert all(r["text_digest"] == out[k].text_digest and r["text_license"] == out[k].text_license for k, r in twin.items())


def test_any_number_of_languages(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.selectExpr("doc_id + 10000 AS doc_id", "text", "concat(lang, doc_id % 3) AS lang"))
    want = sorted(langid.classify(docs, langid.train(docs)).collect(), key=str)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    content = langid.train(docs)
    assert len(content) > 9 and sorted(langid.classify(docs, content).collect(), key=str) == want


def test_copies_are_sampled_alike_in_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rows = [(1, "same words here", "a")] * 150 + [(k, "w " * (k % 30 + 1), "ab"[k % 2]) for k in range(2, 200)] + [(900, "none", None)] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [sorted((r.doc_id, r.taken) for r in mixing.mix_sources(d).select("doc_id", "taken").collect()) for d in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)))]
    assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)


@pytest.mark.parametrize("bits", [2, 6, 12])
def test_anchors_are_the_least_whole_hashes(monkeypatch, bits):
    """Grams whose hashes tie but for a few low bits choose the same anchors whatever the batch."""
    real = suffix.slice_hash
    monkeypatch.setattr(suffix, "slice_hash", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 900).astype(np.uint8)
    big = np.concatenate([rng.integers(97, 123, 70_000).astype(np.uint8), text])
    alone = suffix.segments(text, np.array([0, 900]), 200)
    among = suffix.segments(big, np.array([0, 70_000, 70_900]), 200)
    own = among[0] == 1
    for a, b in zip(alone[1:5], among[1:5]):
        assert a.tolist() == b[own].tolist()
