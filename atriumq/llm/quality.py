"""Line-first cleaning of documents, native: only DataFrame functions.

Every line is judged by itself: does it look like running text (punctuation), like navigation,
like boilerplate (phrases that make up a third of its words), like shouting or like a few words over and over? Failing lines go; a document that loses too
many words with them goes as a whole. Base counts of the whole text stand beside the verdict.

Defined results: a null or empty text has no words, hence fails the base rule; ties do not arise; a text
of any length is judged whole; repeated rows give repeated results; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

SYMBOLS = "#*$%&|<>"
#: A line of running text ends with one of these.
FINAL = r"[.!?:;…。！？\"'”’)\]»][\x20\x09-\x0D]*$"
#: (beginning, pattern) of what lines of a page's furniture say.
PHRASES = [
    ("all rights reserved", ""), ("cookie policy", ""), ("we use cookies", ""), ("accept cookies", ""), ("privacy policy", ""), ("terms of ", "(use|service)"),
    ("enable javascript", ""), ("javascript is ", "(disabled|required)"), ("subscribe to our", ""), ("sign up for our", ""), ("click here", ""), ("read more", ""),
    ("lorem ipsum", ""), ("skip to ", "(main )?content"), ("back to top", ""), ("powered by", ""), ("share on ", "(facebook|twitter)"),
    ("alle rechte vorbehalten", ""), ("datenschutzerkl", ""), ("cookie-richtlinie", ""), ("wir verwenden cookies", ""), ("mehr lesen", ""), ("weiterlesen", ""), ("hier klicken", ""), ("nach oben", ""),
    ("todos los derechos reservados", ""), ("aviso legal", ""), ("usamos cookies", ""), ("aceptar ", "(las )?cookies"), ("haga clic", ""), ("seguir leyendo", ""), ("volver arriba", ""),
    ("tous droits r", ""), ("mentions l", "[eéÉ]gales"), ("nous utilisons des cookies", ""), ("accepter les cookies", ""), ("cliquez ici", ""), ("lire la suite", ""), ("en savoir plus", ""), ("haut de page", ""),
]
#: What every phrase holds one of: few enough to look for in whole texts.
STEMS = [
    "cookie", "javascript", "reserv", "policy", "terms of ", "subscribe", "sign up", "clic", "read more", "lorem", "skip to ", "back to top", "powered by", "share on ",
    "vorbehalten", "datenschutz", "lesen", "klick", "nach oben", "aviso legal", "leyendo", "volver arriba", "tous droits", "mentions l", "cliquez", "lire la suite", "en savoir", "haut de page",
]
BOILERPLATE = "(?i)(" + "|".join(a + b for a, b in PHRASES) + ")"
#: The same in a line's normal form, where every word stands between two blanks of its own; words may go on behind a phrase that ends within one.
_ENDINGS = {"datenschutzerkl": r"\p{L}*", "tous droits r": r"\p{L}*"}
WHOLE = " (" + "|".join((a + (b.lower() or _ENDINGS.get(a, ""))).replace("-", " ").replace(" ", "  ") for a, b in PHRASES) + ") "
#: A phrase condemns its line if its words are at least this share of the line's, as one in so many.
PHRASE_SHARE = 3
MIN_WORDS = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the list, the first included."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(starts: Column) -> Column:  # sorted window starts: each adds what the next leaves of its three words
        return F.aggregate(
            F.sequence(F.lit(0), F.size(starts) - 1),
            F.lit(0),
            lambda n, i: n + F.coalesce(F.least(F.lit(3), F.get(starts, i + 1) - F.get(starts, i)), F.lit(3)),
        )

    def repeated(w: Column) -> Column:
        rows = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"),
                    i.alias("p"),
                ),
            )
        )

        def starts(s: Column) -> Column:
            same = lambda a, b: (a["h"] == b["h"]) & (a["t"] == b["t"])
            found = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["p"]))

        return let(rows, lambda s: let(starts(s), lambda p: F.when(F.size(p) > 0, covered(p)).otherwise(0)))

    def counted(w: Column) -> Column:
        # Different hashes prove different windows, so most texts end here.
        any_twice = let(windows(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 4, 0).otherwise(F.when(any_twice, repeated(w)).otherwise(0))

    return let(words, counted)


def has_phrases(text: Column) -> Column:
    """Whether a text holds a stem of the phrases of BOILERPLATE, so that its lines are worth a look."""
    return let(F.lower(text), lambda low: reduce(lambda x, y: x | y, [F.contains(low, F.lit(stem)) for stem in STEMS]))


def _phrase_words(line: Column) -> Column:
    """Words of a line that belong to phrases of page furniture, whole words only."""
    normal = F.concat(F.lit("  "), F.regexp_replace(F.lower(line), r"[^\p{L}]+", "  "), F.lit("  "))
    return F.size(F.filter(F.split(F.array_join(F.regexp_extract_all(normal, F.lit(WHOLE), F.lit(1)), " "), " +"), lambda w: w != ""))


def line_fails(line: Column, phrases: Column) -> Column:
    """Whether a line is no running text; a boolean, never null for a line that is not null. ``phrases``: has_phrases() of its text."""
    # What is between is replaced, not what is counted: far fewer matches. All signs are gathered in one pass.
    signs = F.regexp_replace(line, f"[^{SYMBOLS}»!]+", "")
    caps = F.length(F.regexp_replace(line, r"[^A-Z\x{00C0}-\x{00DE}]+", ""))
    letters = F.length(F.regexp_replace(line, r"[^A-Za-z\x{00C0}-\x{024F}]+", ""))

    def judged(words: Column, marks: Column) -> Column:
        n = F.size(words)
        return (
            (_count(marks, SYMBOLS) * 4 > n)  # symbols instead of punctuation
            | ((n > 8) & ~line.rlike(FINAL))  # a long line that does not end
            | (_count(marks, "|>»") * 6 > n + 3)  # separators of a navigation bar
            | (phrases & line.rlike(BOILERPLATE) & (_phrase_words(line) * PHRASE_SHARE >= n))
            | (_count(marks, "!") * 3 > n + 3)
            | ((n > 2) & (caps * 2 > letters))  # shouting
            | ((F.size(F.array_distinct(words)) * 3 < n) & (n > 8))  # a few words over and over
        )

    return let(_words(line), lambda words: let(signs, lambda marks: judged(words, marks)))


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_loss: float = 0.4) -> DataFrame:
    """One row per row of ``docs``: id, base counts, the words that failing lines hold, the cleaned text and the verdict.

    A document goes if it has under 50 words, if over half of them stand in repeated three-word
    windows, or if failing lines hold over ``max_loss`` of its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spaceless = F.length(F.regexp_replace("text", f"[{SPACE}]+", ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    judged = let(
        has_phrases(F.col("text")),
        lambda phrases: let(
            lines,
            lambda found: F.struct(
                (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
                F.filter(found, lambda x: ~line_fails(x, phrases)).alias("good"),
            ),
        ),
    )
    counted = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).cast("long").alias("n_repeat_words")))
    step = t.select("doc_id", spaceless.cast("long").alias("word_chars"), _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), counted.alias("w"), judged.alias("j"))
    clean = F.array_join("j.good", "\n")
    out = step.select(
        "doc_id",
        F.col("w.n_words"),
        "word_chars",
        "n_symbols",
        F.col("j.n_dup_lines"),
        F.col("w.n_repeat_words"),
        F.size(_words(clean)).cast("long").alias("n_kept_words"),
        clean.alias("clean_text"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("n_words") - F.col("n_kept_words")
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (lost * 100 <= F.col("n_words") * int(round(max_loss * 100))))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
t AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS tri FROM g),
r AS (SELECT doc_id, p FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nx - p, 3)))::BIGINT AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM r) GROUP BY 1),
l AS (SELECT doc_id, unnest(ls) AS x FROM w),
f AS (SELECT doc_id, x, len(regexp_extract_all(x, '{_W}')) AS n,
  length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS sy, length(x) - length(regexp_replace(x, '[|>»]', '', 'g')) AS se,
  length(x) - length(replace(x, '!', '')) AS ex, length(x) - length(regexp_replace(x, '[A-Za-z\x{{00C0}}-\x{{024F}}]', '', 'g')) AS le,
  length(x) - length(regexp_replace(x, '[A-Z\x{{00C0}}-\x{{00DE}}]', '', 'g')) AS ca, len(list_distinct(regexp_extract_all(x, '{_W}'))) AS dw,
  CASE WHEN regexp_matches(x, '{BOILERPLATE}') THEN len(list_filter(regexp_split_to_array(array_to_string(regexp_extract_all('  ' || regexp_replace(lower(x), '[^\p{{L}}]+', '  ', 'g') || '  ', '{WHOLE}', 1), ' '), ' +'), lambda z: z <> '')) ELSE 0 END AS ph FROM l),
k AS (SELECT doc_id, sum(n)::BIGINT AS n_kept_words FROM f WHERE NOT (sy * 4 > n OR (n > 8 AND NOT regexp_matches(x, '{FINAL.replace("'", "''")}'))
  OR se * 6 > n + 3 OR (regexp_matches(x, '{BOILERPLATE}') AND ph * {PHRASE_SHARE} >= n) OR ex * 3 > n + 3 OR (ca * 2 > le AND n > 2)
  OR (dw * 3 < n AND n > 8)) GROUP BY 1),
o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(k.n_kept_words, 0)::BIGINT AS n_kept_words FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - n_kept_words) * 100 <= n_words * 40 AS kept FROM o
"""
