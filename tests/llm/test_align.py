"""Cross-tokenizer alignment against a plain one: whole texts through both libraries, all pairs, all counts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from atriumq.llm import align

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb", "a\n\n b\t c ", "\ta", "x\r\ny;\r z", "don't we'll I'D", "<|endoftext|> </s> <unk> <0x41>", "a▁b", "▁", "ñandú 日本語 😀 é", "a  b   c", "a　b   c", "a\x1c b\x1d  c \x1e", "a\x00b", " ", "x  ", "====" * 50, "a" * 5000, "word " * 3000, "12345 67890,111", "if (x)\n{\n    return  1;\n}\n", "ﬁ ﷺ Å", "﻿a b", "a\x85b \x0b\x0c c"]


def plain(rows):
    """(doc_id, n_a, ..., groups_sha256) of (doc_id, text) rows, by brute force."""
    a_path, b_path = align.paths()
    both = align.Two(a_path, b_path)
    made = []
    for doc_id, t in rows:
        groups = []
        if t:
            a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
            x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                i = j = u = v = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if u <= v and i < len(a):
                        left.append(a[i])
                        u, i = u + len(x[i]), i + 1
                    else:
                        right.append(b[j])
                        v, j = v + len(y[j]), j + 1
                    if u == v:
                        groups.append((left, right))
                        left, right = [], []
        made.append((doc_id, groups))
    links = [Counter((p, q) for left, right in groups for p in left for q in right) for _, groups in made]
    count = Counter(pair for x in links for pair in x)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (doc_id, groups), x in zip(made, links):
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(x.values()), sum(n for pair, n in x.items() if count[pair] == best[pair[0]]), sum(n * count[pair] for pair, n in x.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def test_cuts_are_checked_against_both_vocabularies():
    both = align.two(*align.paths())
    assert " " in both.cuts and "\r" not in both.cuts  # ";\r" is a piece
    whole = lambda names: "".join(s if s[0].isspace() else " " + s for s in names)
    assert both.split("ab c\nd") == ["ab", "c", "\nd"] and both.split("ab  c\u00a0 d ") == ["ab", "  c\u00a0 d", " "]
    assert all(whole(both.split(t)) == " " + t for t in ODD if t)


@pytest.mark.parametrize("hot", [align.HOT, 30, 0])
def test_odd_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT", hot)
    monkeypatch.setattr(align, "PACK_BYTES", 3000)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a  b"), (3, "a  b"), (None, "no id, same words: a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("t", "key", "pack", "segment", "n", "pairs", "times", "copies", "n_a")})
    assert got(align.align_texts(df)) == plain(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(align.align_texts(none)) == []
    assert got(align.align_texts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()])
    assert got(align.op13_token_alignment(spark, "/root/testdata/sf0.01")) == want
