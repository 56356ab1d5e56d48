"""Every stage of the corpus pipeline against a plain version of it, on its own input."""

from collections import Counter

import corpus_pipeline as P

from .test_exact import _components, _sets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [len(x) for x in P.STAGES] == [2] * 5 and P.ORACLE_SQL is None

    one = {r.doc_id: r for r in P.identify_language(spark, docs, SF).collect()}
    assert set(one) <= set(kept) and len(one) >= 0.98 * len(kept)
    assert sum(one[i].lang == kept[i].lang for i in one) >= 0.97 * len(one)

    after = spark.createDataFrame(list(one.values()), docs.schema)
    two = {r.doc_id: r for r in P.remove_near_duplicates(spark, after, SF).collect()}
    groups = _components(_sets([(i, r.text) for i, r in one.items()], 5), 80)
    assert set(two) == {i for i, c in groups.items() if i == c}

    after = spark.createDataFrame(list(two.values()), docs.schema)
    three = {r.doc_id: r for r in P.remove_repeats(spark, after, SF).collect()}
    raw = {i: r.text.encode() for i, r in two.items()}
    count = Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    for i, t in raw.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(t, gone) if not g).decode(errors="ignore")
        if i in three:
            assert three[i].text == left and three[i].n_chars == len(left)
        else:
            assert not left.strip()

    after = spark.createDataFrame(list(three.values()), docs.schema)
    four = P.mix_to_weights(spark, after, SF)
    assert four.columns == columns
    copies = Counter(r.doc_id for r in four.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(three)

    five = P.tokenize(spark, four, SF).collect()
    assert len(five) == sum(copies.values()) and all(r.agrees and r.decoded == three[r.doc_id].text for r in five)


def test_run_and_odd_rows(spark):
    assert P.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars")).unionByName(docs.limit(1).selectExpr("doc_id + 9000 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    for rows in (odd.withColumn("size", odd.doc_id).withColumn("_row", odd.doc_id), docs.limit(0)):
        now = rows
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == rows.columns
            now = spark.createDataFrame(now.collect(), rows.schema)
        P.tokenize(spark, now, SF).count()
