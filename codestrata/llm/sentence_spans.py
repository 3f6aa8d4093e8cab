"""Substring dedup by sliding sentence spans, with built-in functions only.

A sentence ends after a run of signs (``ends``) and the blanks that follow, but not
within its first ``least`` characters: what is shorter, as a lone sign, a number, a blank
line or an interjection, belongs to the sentence it opens. Every run of ``run``
consecutive sentences is hashed; a run that also occurs earlier in the corpus (smaller
id, then place) takes its sentences away. The first occurrence always stays.

First places are minima taken before the shuffle; the join back to all spans is an
equality join of two written tables, so Spark can split a hash that very many
documents share. Spans travel as hash and place, texts once.

Defined results: null text counts as empty; texts of fewer sentences lose nothing;
rows with equal id and text are one document, so both keep or lose the same; rows
without id come last in order; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.stores import materialize

ENDS = ".!?\n"
BLANKS = " \t\r\n"


def pattern(ends: str, least: int) -> str:
    """One sentence; the rest of the text where no end follows."""
    return rf"[\s\S]{{{least}}}[^{ends}]*[{ends}]+[ \t\r\n]*|[\s\S]+"


def sentences(text: Column, ends: str = ENDS, least: int = 0) -> Column:
    """Parts of the text; joined together they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(ends, least)), F.lit(0))


def _spans(parts: Column, run: int) -> Column:
    """Place and hash of every run of sentences; the list of sentences is made once."""

    def of(clean: Column) -> Column:
        count = F.size(clean) - run + 1
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(clean, i + 1, run), " ").alias("words")))
        return F.transform(runs, lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(x["words"])).alias("hash")))

    return bind(F.transform(parts, lambda x: F.trim(x, F.lit(BLANKS))), of)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", run: int = 3, ends: str = ENDS, least: int = 0
) -> DataFrame:
    """``id, n_sentences, n_removed, kept`` (the remaining text) of every row."""
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    keyed = plain.select("id", F.xxhash64("id", "text").alias("key"), sentences(F.col("text"), ends, least).alias("parts"))
    found = keyed.select("id", "key", F.explode(_spans(F.col("parts"), run)).alias("span"))
    spans = materialize(found.select("id", "key", "span.pos", "span.hash"), "spans")
    place = F.struct(F.col("id").isNull(), "id", "key", "pos")
    firsts = spans.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = materialize(firsts.select("hash", "first"), "first-spans")
    later = spans.join(firsts, "hash").where(place > F.col("first")).groupBy("key").agg(F.collect_set("pos").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (run - 1)))))
    # Parts come out of the join, so the list below is a column and not made again for every sentence.
    every = F.when(F.size("parts") > 0, F.sequence(F.lit(0), F.size("parts") - 1)).otherwise(F.array().cast("array<int>"))
    stays = F.when(F.col("starts").isNull(), every).otherwise(F.array_except(every, covered))
    joined = keyed.join(later, "key", "left").select("id", "parts", stays.alias("stays"))
    return joined.select(
        "id",
        F.size("parts").cast("long").alias("n_sentences"),
        (F.size("parts") - F.size("stays")).cast("long").alias("n_removed"),
        F.array_join(F.transform("stays", lambda i: F.get("parts", i)), "").alias("kept"),
    )


def oracle(run: int = 3, ends: str = ENDS, least: int = 0) -> str:
    """DuckDB text for the digest of ``remove_repeats`` over documents."""
    one = pattern(ends, least).replace("\n", "\\n")
    return f"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{one}') AS p FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string([trim(x, e' \\t\\r\\n') FOR x IN p[i + 1 : i + {run}]], ' ') AS words
  FROM (SELECT doc_id, p, unnest(range(0, len(p) - {run} + 1)) AS i FROM parts)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS k FROM runs)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, range(0, {run}) t(d)),
single AS (SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM parts),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(part, '' ORDER BY i) AS text FROM single ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sentences, CAST(len(p) - coalesce(n, 0) AS BIGINT) AS n_removed,
  md5(coalesce(text, '')) AS kept_md5
FROM parts LEFT JOIN kept USING (doc_id)"""
