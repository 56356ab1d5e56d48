"""Cases that shortened forms of the corpus operators lost."""

import itertools
import os
import random
import textwrap
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
import zstandard

from pyspark.sql import functions as F

from atriumq.llm import langid, licenses, pieces, quality, toxicity


def test_op9_judges_every_shouting_and_boilerplate_line(spark):
    bad = ["B U Y N O W", "SALE 10 20 30 40 50", "[Privacy Policy]", "“Click here”", "•Back to top", "—Powered by X", "now click here.", "(read more)", "Read more"]
    good = ["A line of running text.", "Nobody powered it. By the way, no.", "I AM", "Policy of privacy."]
    texts = [(k, line) for k, line in enumerate(bad + good)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.n_kept_words for r in quality.quality_rules(docs).collect()}
    assert got == {k: 0 if k < len(bad) else len(line.split()) for k, line in texts}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    names = [c[0] for c in con.execute(quality.ORACLE).description]
    assert {r["doc_id"]: r["n_kept_words"] for r in (dict(zip(names, x)) for x in con.fetchall())} == got


def test_op9_every_phrase_holds_a_stem():
    # Also what follows a beginning may hold it: "aceptar (las )?cookies".
    assert all(any(stem in a or stem in b for stem in quality.STEMS) for a, b in quality.PHRASES)


def test_op5_returns_the_ids_of_the_agenda():
    right = pieces.agenda(pieces.model_path())

    class Wrong:
        """Reads one text as another, which the library must not paper over."""

        library = right.library

        def encode(self, texts):
            return right.encode(["as it was" if t == "so it is" else t for t in texts])

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "t": ["so it is", "as it was", None]})
    got = pieces.tokenised(Wrong(), batch).to_pylist()
    assert [(r["decoded"], r["agrees"]) for r in got] == [("as it was", False), ("as it was", True), ("", True)]
    assert got[0]["ids"] == got[1]["ids"] == right.library.encode("as it was") and got[2]["ids"] == []


def test_op1_compares_every_span_of_a_token():
    marks = toxicity.Landmarks(["idiot", "stupid"])
    rnd = random.Random(2)

    def kernel(a, b):  # by listing all subsequences of three letters
        def weights(x):
            out = Counter()
            for p in itertools.combinations(range(len(x)), 3):
                out["".join(x[k] for k in p)] += toxicity.DECAY ** (p[-1] - p[0] + 1)
            return out

        u, v = weights(a), weights(b)
        return sum(u[k] * v[k] for k in u)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda last, j: max(last, row[j + 1], row[j] + (x == b[j])), initial=0)][1:]
        return row[-1]

    def best(a, b):
        if common(a, b) < len(b) - 1:
            return 0.0
        spans = [a[i:j] for i in range(len(a)) for j in range(i + 3, len(a) + 1)]
        norm = lambda x: kernel(x, x) ** toxicity.SPAN * kernel(b, b) ** (1 - toxicity.SPAN)
        return min(1.0, max((kernel(x, b) / norm(x) for x in spans), default=0.0)) ** toxicity.POWER

    assert toxicity.ssk(toxicity._codes(["idxiot"]), toxicity._codes(["idiot"]))[0] == pytest.approx(kernel("idxiot", "idiot"))
    gapped = ["id" + c * n + "iot" for c in "xqi" for n in (3, 4, 5, 6)] + ["st" + "u" * 7 + "pid", "stuxxxxpxxxid"]
    glued = ["xxxxidiot", "megaidiot", "idiotic", "#idiotforever", "thisisanidiotandafoolforever", "a" * 50 + "idiot" + "b" * 70, "b" * 100 + "stupid"]
    noise = ["".join(rnd.choice("idotsup") for _ in range(rnd.randint(3, 14))) for _ in range(60)]
    for token in gapped + glued + noise:
        got = [0.0, 0.0]
        pairs = toxicity.units(token)
        for _, m, v in zip(*(x.tolist() for x in marks.kernel(pairs))):
            got[m] = max(got[m], v)
        if len(token) < 30:
            assert got == pytest.approx([best(toxicity._JUNK.sub("", token), b) for b in marks.marks])
        assert token in noise or max(got) > 0
        assert token not in glued or max(got) == pytest.approx(1)


def test_op1_tells_scripts_apart_and_reads_long_texts(spark):
    marks = toxicity.Landmarks(["idiot"])
    shifted = "".join(chr(ord(c) + 1024) for c in "idiot")  # letters that differ by a multiple of 1024
    assert not len(marks.kernel([shifted])[0]) and len(marks.kernel(["idiot"])[0])
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeou") for _ in range(3))
    long_ = lambda n, w="": " ".join(f"{word()} {word()} {w if k % 20 == 0 else word()}." for k in range(n))
    rows = [(k, long_(2000, "idiot"), 1) for k in range(30)] + [(100 + k, long_(30), 0) for k in range(90)]
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    said = spark.createDataFrame([(1, long_(3000) + " you idiot."), (2, long_(3000)), (3, "iiddiioott!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(said, machine).collect()}
    assert got[1] >= 0.7 and got[3] >= 0.7 and got[2] < 0.7
    assert toxicity.score_toxicity(said.limit(0), machine).count() == 0


def test_op7_against_plain_zstandard():
    content = {"a": b" the cat sat on the mat and then it ran " * 40, "b": b" el gato se fue de la casa y no volvio " * 40}
    decide = langid.Classifier(content)

    def plain(text):
        sizes = {}
        for lang, raw in content.items():
            made = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(raw), source_size=langid.PIECE, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=made, dict_data=known).compress(text[k : k + langid.PIECE])) for k in range(0, len(text), langid.PIECE))
        low, high = sorted(sizes.values())
        return min(sizes, key=lambda x: (sizes[x], x)), (high - low) / high

    for text in (b" the mat ", b" la casa ", b" cat casa ", b" the cat sat on the mat " * 300, b" no volvio el gato " * 70):
        best = decide(text)
        assert (best[0][1], langid.margin(best)) == plain(text)


def test_op2_knows_licences_however_they_are_set(spark):
    text = {name: t for name, t in reversed(licenses.KNOWN)}
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    whole = [("MIT", f"{line}\n\n{mit}") for line in ("Copyright (c) Microsoft Corporation.", "Copyright Jane Doe 2020", "Copyright, 2020 X", "Copyright Jane Doe", "COPYRIGHT JANE DOE", "# © 2019-2021 Zoë", "Copyright by J. Doe", "(c) 2020 J. Doe")]
    whole += [("BSD-3-Clause", "\n".join(textwrap.wrap(bsd, n))) for n in (40, 57, 72, 80, 100)] + [("Unlicense", text["Unlicense"].upper()), ("BSL-1.0", text["BSL-1.0"].replace(" ", "  "))]
    at = "/usr/share/common-licenses/"
    whole += [(name, open(at + f).read().lower()) for name, f in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")) if os.path.exists(at + f)]
    lines = ["Released  under CC0 1.0.", "**Released** under CC0 1.0.", "-- SPDX-License-Identifier: MIT --", "LICENSED under the Apache Licence, version 2.0", "Released under\tCC0 1.0"]
    other = ["Released 日本 under CC0 1.0.", "Copyright notice", "released under no terms", None, ""]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(whole)] + [(100 + k, f"x\n{t}\ny") for k, t in enumerate(lines)] + [(200 + k, t) for k, t in enumerate(other)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert [got[k].text_license for k in range(len(whole))] == [name for name, _ in whole]
    assert [got[100 + k].n_notices for k in range(len(lines))] == [1] * len(lines)
    assert all(got[200 + k].n_notices == 0 and got[200 + k].text_license is None for k in range(len(other)))
    known = [r.c for r in spark.createDataFrame(licenses.KNOWN, "license string, text string").select(licenses.canonical(F.col("text")).alias("c")).where(~F.col("c").rlike(licenses.HINT)).collect()]
    assert not known
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in docs.collect()])
    con.execute(licenses.ORACLE)
    names = [c[0] for c in con.description]
    assert {r["doc_id"]: r for r in (dict(zip(names, x)) for x in con.fetchall())} == {k: r.asDict() for k, r in got.items()}
