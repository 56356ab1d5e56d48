"""The corpus pipeline: language identification, near-duplicate removal, removal of repeated passages,
mixing to target weights and tokenisation. Every stage takes the documents that the stage before it
kept, as (spark, docs, sf_dir), and all but the last return the columns of ``documents``.

A stage ignores rows it cannot read rather than failing: null texts have no language and go in the
first stage; an empty table passes through all stages as an empty table; ties in near-duplicate groups go
to the smallest id, then to the smallest row; equal rows are one from the second stage on; columns of any name pass
through as they are; texts of any length pass, the operators read long ones in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atriumq.llm import langid, minhash, mixing, pieces, suffix
from atriumq.llm.common import drop_table, remainder, written


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one value, whatever its columns are called, beside what the operators read of it."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("_doc.*").select(*columns)


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly, with that language."""
    content = langid.train(docs.where(remainder("doc_id", 5) != 0))
    found = langid.classify(_packed(docs), content, carry=("_doc",)).where("NOT rejected")
    return _unpacked(found.select(F.col("_doc").withField("lang", F.col("lang_pred")).alias("_doc")), docs.columns)


def remove_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: shingles of five words,
    similarity 0.8. Rows are told apart by 96 bits of all their columns; equal rows stay once, with or without
    words; rows of one id only go if their texts are alike."""
    row = F.struct(*docs.columns)
    keyed = docs.select(row.alias("_doc"), F.xxhash64(row).alias("_one"), F.hash(row).alias("_two"))
    found = minhash.near_duplicates(keyed.select("_doc.doc_id", "_doc.text", "_one", "_two"), k=5, percent=80, carry=("_one", "_two"))
    seen = written(found.select("group", F.struct("doc_id", "_one", "_two").alias("r")), "grouped")
    kept = seen.where("group IS NOT NULL").groupBy("group").agg(F.min("r").alias("r")).select("r").union(seen.where("group IS NULL").select("r"))
    times = written(seen.groupBy("r").agg(F.count("*").alias("n")).join(kept.distinct(), "r").select("r._one", "r._two", "n"), "kept")
    both = keyed.join(times, ["_one", "_two"])
    once = both.where("n > 1").dropDuplicates(["_one", "_two"])
    return _unpacked(both.where("n = 1").select("_doc").unionByName(once.select("_doc")), docs.columns)


def remove_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes and more that occur elsewhere; those left empty by it go."""
    found = suffix.repeated_bytes(_packed(docs), 200, carry=("_doc",))
    # A cut may fall inside a character, whose other bytes then mean nothing.
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    cleaned = F.when(F.contains("_doc.text", F.lit("\ufffd")), valid).otherwise(F.replace(valid, F.lit("\ufffd"), F.lit("")))
    new = F.col("_doc").withField("text", cleaned)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(cleaned).cast(docs.schema["n_chars"].dataType))
    cut = F.size("spans") > 0
    out = found.select(F.when(cut, new).otherwise(F.col("_doc")).alias("_doc"), cut.alias("_cut"))
    return _unpacked(out.where("NOT _cut OR _doc.text RLIKE '[^ \\\\t\\\\n\\\\r]'"), docs.columns)


def mix_to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))
    mixed = mixing.mix_sources(rows, carry=("_doc",))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return _unpacked(mixed.select("_doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")), docs.columns)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its text read back from them."""
    made = pieces.encode_decode(docs)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", "agrees")


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", remove_near_duplicates),
    ("repeated passages", remove_repeats),
    ("mixing", mix_to_weights),
    ("tokenisation", tokenize),
]
#: Compression, sampling and a tokenizer's merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written before the next reads it, and its input removed then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
        if 0 < k < len(STAGES) - 1:
            drop_table(before)
    return docs
