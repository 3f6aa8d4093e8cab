"""Quality rules that are judged by host, with built-in functions only.

Every text is measured where it lies, and the rules say which measures fail. A
document that fails a base rule leaves by itself. All rules are then counted by host.
The share of a host that fails is uncertain where the host is small, so it is shrunk
towards the share of the corpus: hosts are taken as draws of one beta distribution,
whose mean is the share of all documents and whose spread is found by the method of
moments (the part of the variation between hosts that chance in their sizes does not
explain). A host of which, after shrinking, more than ``limit`` fails one rule is
rejected, and its verdict is joined back: its documents leave, failing or not.

Measures are narrow work on arrays of one text, and linear but for one sort of the
texts in which a run of words repeats. What is shuffled are counts, summed before,
and measures without text; the join back meets rejected hosts only and is salted, so
a host with a third of all documents is many tasks.

Defined results: null text counts as empty and fails by its number of words; a text of
fewer words than a window repeats none; rows without host are measured and judged
alone; one host only is not shrunk; repeated rows are counted and returned each; an
empty table gives an empty result. Columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources.stores import materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rules: fewest words, largest share of words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED = 10, 20


# --- measures of one text -----------------------------------------------------------------


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more."""

    def covered(places: Column) -> Column:
        new = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b)

    def repeated(pairs: Column) -> Column:
        equal = lambda i, h: F.coalesce(F.get(pairs, i)["h"] == h, F.lit(False))
        found = F.filter(pairs, lambda p, i: equal(i - 1, p["h"]) | equal(i + 1, p["h"]))
        return bind(F.sort_array(F.transform(found, lambda p: p["i"])), covered)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(pairs, repeated)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    kept = [c for c in docs.columns if c != text_column]
    spaces = F.lit(SPACES)
    text = docs.select(*kept, F.coalesce(text_column, F.lit("")).alias("_text"))
    parts = text.select(
        *kept,
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.trim(line, spaces)) > 0).alias("_lines"),
        F.array_remove(F.split(F.translate("_text", SPACES[1:], " " * (len(SPACES) - 1)), " ", -1), "").alias("_words"),
    )
    starts = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = parts.select(
        *kept, "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])).alias("_hashes"),
    )
    return hashed.select(*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _repeat_words(F.col("_hashes")).alias("n_repeat_words"))


#: What fails each rule. The first two are the base rules.
BASE = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
}
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


# --- hosts --------------------------------------------------------------------------------


def host_rates(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``host, n`` and, for every rule, the share of the host that fails, shrunk by the beta prior."""
    counts = measured.where("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in rules.items()]
    )
    counts = materialize(counts, "hosts")
    n = F.col("n").cast("double")
    moments = [F.count("*").alias("hosts"), F.sum(n).alias("rows"), F.sum(n * n).alias("squares")]
    for name in rules:
        f = F.col(f"failed_{name}").cast("double")
        moments += [F.sum(f).alias(f"sum_{name}"), F.sum(f * f / n).alias(f"spread_{name}")]
    prior = counts.agg(*moments)
    free = F.col("hosts") - 1
    room = F.col("rows") - F.col("squares") / F.col("rows") - free
    for name in rules:
        mean = F.col(f"sum_{name}") / F.col("rows")
        excess = (F.col(f"spread_{name}") - mean * F.col(f"sum_{name}")) / F.nullif(mean * (1 - mean), F.lit(0.0)) - free
        # 1 / (alpha + beta + 1): 0 if chance explains all variation, 1 if every host fails as a whole or not at all
        tie = F.when(F.col("hosts") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(excess / F.nullif(room, F.lit(0.0)), F.lit(0.0)))))
        prior = prior.withColumns({f"mean_{name}": mean, f"tie_{name}": tie})
    prior = prior.first()  # one row, whatever the number of hosts

    def shrunk(name: str) -> Column:
        mean, tie = (F.lit(prior[f"{kind}_{name}"]).cast("double") for kind in ("mean", "tie"))
        return (tie * F.col(f"failed_{name}") + (1 - tie) * mean) / (tie * F.col("n") + (1 - tie))

    return counts.select("host", "n", *[shrunk(name).alias(name) for name in rules])


def judge(
    docs: DataFrame, host: Column, id_column: str = "doc_id", text_column: str = "text",
    base: dict[str, str] | None = None, rules: dict[str, str] | None = None, limit: float = 0.5, salts: int = 32,
) -> DataFrame:
    """``id, host``, the measures, ``base_failed``, ``host_failed`` and ``kept`` of every document."""
    base, rules = BASE if base is None else base, RULES if rules is None else rules
    plain = docs.select(F.col(id_column).alias("id"), host.cast("string").alias("host"), F.col(text_column).alias("_body"))
    measured = materialize(measure(plain, "_body"), "measures")
    bad = host_rates(measured, rules).where(" OR ".join(f"{name} > {limit}" for name in rules))
    bad = bad.select("host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("rejected"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("id", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(bad, ["host", "salt"], "left").drop("salt")
    failed = F.expr(" OR ".join(f"({rule})" for rule in base.values()) or "false")
    joined = joined.withColumns({"base_failed": failed, "host_failed": F.coalesce("rejected", F.lit(False))}).drop("rejected")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


# --- DuckDB text --------------------------------------------------------------------------


def oracle(limit: float = 0.5) -> str:
    """DuckDB text of the measures and verdicts over documents, with windows as rows."""
    word = r"[^\x20\x09-\x0D]+"
    failed = ", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in RULES.items())
    one = """(SELECT sum({0}) / sum(n) AS mean, least(1.0, greatest(0.0, coalesce(
    ((sum({0} * 1.0 * {0} / n) - sum({0}) * sum({0}) / sum(n)) / nullif(sum({0}) / sum(n) * (1 - sum({0}) / sum(n)), 0) - (count(*) - 1))
    / nullif(sum(n) - sum(n * n) / sum(n) - (count(*) - 1), 0), 0.0))) AS tie, count(*) AS hosts FROM hosts)"""
    bad = " UNION ".join(
        f"SELECT source FROM hosts, {one.format(name)} WHERE "
        f"CASE WHEN hosts = 1 THEN {name} * 1.0 / n ELSE (tie * {name} + (1 - tie) * mean) / (tie * n + (1 - tie)) END > {limit}"
        for name in RULES
    )
    return f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words,
    list_filter(string_split(coalesce(text, ''), e'\\n'), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
runs AS (SELECT doc_id, i, words[i + 1 : i + {WINDOW}] AS run FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS k FROM runs) WHERE k > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, range(0, {WINDOW}) t(d) GROUP BY doc_id),
measures AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN repeated USING (doc_id)),
hosts AS (SELECT source, count(*) AS n, {failed} FROM measures WHERE source IS NOT NULL GROUP BY source),
bad AS ({bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept
FROM (SELECT *, {" OR ".join(f"({rule})" for rule in BASE.values())} AS base_failed FROM measures)"""
