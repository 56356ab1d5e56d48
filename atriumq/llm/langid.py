"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text known to be in it. A text is compressed
in pieces with every dictionary; the language whose dictionary leaves the fewest bytes wins, at every
length. A prediction is rejected when the runner-up is within ``min_margin`` of the winner.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; with no
labelled row at all everything is ``und``; equal sizes go to the language first in code point order and
are rejected; every label is learned, however many there are; a text of any length is
compressed piece by piece; repeated rows give repeated results; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, frugal, remainder, table

#: Bounds of the training sample: documents a language, characters of each, bytes of a dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 240, 1500, 1 << 16
#: Languages whose dictionaries a task holds; further ones are tried by further steps of the same stage.
AT_ONCE = 200
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts all along.
PIECE = 1024


def letters(text: Column) -> Column:
    """Lower-case letters, everything between them one blank, a blank at either end; null without letters."""
    out = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(out.rlike(r"\p{L}"), F.concat(F.lit(" "), out, F.lit(" ")))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Language to dictionary content, from a sample of at most SAMPLE_DOCS documents a language.

    The sample is the rows with the smallest hash of their id, and of each a slice at a place that
    the hash chooses; it is the same at every size and partitioning of the input.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("i"))
    counts = sorted((r["l"], r["count"]) for r in rows.groupBy("l").count().collect())
    span, sample = 1 << 30, []
    for k in range(0, len(counts), AT_ONCE):
        share = F.create_map(*[x for lang, n in counts[k : k + AT_ONCE] for x in (F.lit(lang), F.lit(min(span, 2 * SAMPLE_DOCS * span // n + 1)))])
        some = rows.where(F.pmod("h", F.lit(span)) < F.element_at(share, F.col("l"))).withColumn("t", letters(F.col("t"))).where("t IS NOT NULL")
        at = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
        sample += sorted((r["l"], r["h"], r["i"], r["s"]) for r in some.select("l", "h", "i", F.substring(F.col("t"), at, F.lit(SAMPLE_CHARS)).alias("s")).collect())
    out: dict[str, bytes] = {}
    for lang, found in itertools.groupby(sample, key=lambda x: x[0]):
        texts = [x[3].encode() for x in found][:SAMPLE_DOCS]
        # Every text of the sample gives alike; what short ones leave over goes to the longer ones.
        left, parts = DICT_BYTES, []
        for k, text in enumerate(sorted(texts, key=len)):
            parts.append(text[: left // (len(texts) - k)])
            left -= len(parts[-1]) + 1
        random.Random(0).shuffle(parts)
        out[lang] = b" " + b" ".join(parts) + b" "
    return out


class Classifier:
    """Compressors of all languages, made once in a worker."""

    def __init__(self, content: dict[str, bytes]):
        self.by = {}
        for lang, raw in sorted(content.items()):
            made = zstandard.ZstdCompressionParameters.from_level(
                3, dict_size=len(raw), source_size=PIECE, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=made)
            self.by[lang] = zstandard.ZstdCompressor(compression_params=made, dict_data=known).compress

    def __call__(self, text: bytes) -> list[tuple[int, str]]:
        """(bytes, language) of the two languages that leave the fewest bytes, equal ones in code point order."""
        if not text or not self.by:
            return []
        parts = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
        return sorted((sum(len(pack(p)) for p in parts), lang) for lang, pack in self.by.items())[:2]


def margin(sizes: list[tuple[int, str]]) -> float:
    """By what share of its own size the runner-up is larger."""
    return 1.0 if len(sizes) < 2 else (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])


def classify(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", id_col: str = "doc_id", min_margin: float = 0.005, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, margin, rejected, besides the columns in ``carry``."""
    names = [f"_{k}_" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("doc_id"), letters(F.col(text_col)).alias("t"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    langs = sorted(content)
    groups = [{x: content[x] for x in langs[k : k + AT_ONCE]} for k in range(0, len(langs), AT_ONCE)] or [{}]
    best = "array<struct<size:long,lang:string>>"
    pair = pa.list_(pa.struct([("size", pa.int64()), ("lang", pa.string())]))

    def sized(batch: pa.RecordBatch, decide: Classifier) -> list[list[tuple[int, str]]]:
        data, offsets = buffers(batch.column("t"))
        raw, ends = data.tobytes(), offsets.tolist()
        return [decide(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def known(batch: pa.RecordBatch) -> list[list[tuple[int, str]]]:
        return [[(x["size"], x["lang"]) for x in b] for b in batch.column("best").to_pylist()] if "best" in batch.schema.names else [[]] * batch.num_rows

    def tried(group: dict[str, bytes]):
        """A step that leaves the two best languages so far beside every text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decide = Classifier(group)
            for batch in batches:
                found = [[dict(zip(("size", "lang"), x)) for x in sorted(a + b)[:2]] for a, b in zip(known(batch), sized(batch, decide))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *(batch.column(n) for n in names), pa.array(found, pair)], ["doc_id", "t", *names, "best"])

        return run

    for group in groups[:-1]:
        rows = rows.mapInArrow(frugal(tried(group)), ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "t", *names)) + f", best {best}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Classifier(groups[-1])
        for batch in batches:
            found = [sorted(a + b)[:2] for a, b in zip(known(batch), sized(batch, decide))]
            told = [x[0][1] if x else "und" for x in found]
            margins = [margin(x) if x else 0.0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(told, pa.string()),
                    pa.array([m / (m + 0.02) if x else 0.0 for x, m in zip(found, margins)], pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array([not x or m < min_margin for x, m in zip(found, margins)], pa.bool_()),
                    *(batch.column(n) for n in names),
                ],
                ["doc_id", "lang_pred", "score", "margin", "rejected", *names],
            )

    shape = f"doc_id {kinds['doc_id']}, lang_pred string, score double, margin double, rejected boolean" + "".join(f", {n} {kinds[n]}" for n in names)
    return rows.mapInArrow(frugal(run), shape).withColumnsRenamed(dict(zip(names, carry)))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = train(docs.where(remainder("doc_id", 5) != 0))
    found = classify(docs, content)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
