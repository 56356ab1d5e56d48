"""Repeated rows, ties, empty tables and very long texts of the operators that other tests leave out, and values of the pipeline."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from atriumq.llm import ann, chat, toxicity


def test_op6_empty_table_and_a_very_long_turn(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], shape)).count() == 0
    long = "\\ </s> [INST] palabra ñ " * 20_000
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", long), (2, 0, "assistant", "")], shape)).collect()}
    assert len(got) == 2 and sum(map(bool, got[1].loss)) > 100_000 // 8


def test_op3_repeated_rows_and_ids(spark):
    rows = [(k, [float(k % 5 + 1), float(k % 3)]) for k in range(30)]
    df = spark.createDataFrame(rows + rows[:7] + [(20, [9.0, 9.0])], "vec_id long, embedding array<double>")
    out = ann.nearest(df, k=4, every=20).collect()
    assert {r.query_id for r in out} == {0, 20}
    zero = [(r["rank"], r.vec_id) for r in out if r.query_id == 0]
    assert len(zero) == len(set(zero)) == 4 and len({v for _, v in zero}) == 4  # rows given twice count once
    best = sorted((-r.score, r.vec_id) for r in out if r.query_id == 0)[0]
    assert best == (-9.0 * 1.0, 20)  # the other vector of id 20


def test_op1_repeated_rows_and_ties(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeou") for _ in range(3))
    bad = [(k, f"{' '.join(word() for _ in range(30))} idiot {' '.join(word() for _ in range(9))}.", 1) for k in range(40)]
    good = [(100 + k, f"{' '.join(word() for _ in range(40))}.", 0) for k in range(120)]
    rows = bad + good
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    said = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (2, "you idiot"), (3, "a day")], "doc_id long, text string")
    got = sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(said, machine).collect())
    assert len(got) == 4 and got[0] == got[1] and got[0][1] == got[2][1]


def test_pipeline_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    prose = docs.where("length(text) > 1200").first()
    extra = spark.createDataFrame([(90_001, None), (90_002, prose.text), (90_003, prose.text), (90_003, prose.text)], "doc_id long, text string")
    odd = docs.unionByName(extra, allowMissingColumns=True)
    first = corpus_pipeline.identify_language(spark, odd, None)
    ids = [r.doc_id for r in first.collect()]
    assert 90_001 not in ids and ids.count(90_003) == 2
    second = corpus_pipeline.remove_near_duplicates(spark, first, None)
    left = [r.doc_id for r in second.where(F.col("text") == prose.text).collect()]
    assert left == [prose.doc_id] and second.columns == docs.columns
