"""Advice from outside: parse stored answers and lay them over the top opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outputs import ADVICE_ROWS



def parse_advice(raw: Column) -> Column:
    """Advice struct; null for text that is no JSON object, empty lists for wrong types."""
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    opened = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```json\s*", ""), r"^```\s*", "")
    cleaned = F.regexp_replace(F.regexp_replace(opened, r"```$", ""), r"^\s+|\s+$", "")
    value = F.try_parse_json(cleaned)
    text = lambda field: F.try_variant_get(value, f"$.{field}", "string")
    items = lambda field: F.coalesce(
        F.try_variant_get(value, f"$.{field}", "array<string>"), F.array().cast("array<string>")
    )
    parsed = F.struct(
        F.coalesce(text("explanation"), F.lit("")).alias("explanation"),
        items("recommendedRefactor").alias("recommended_refactor"),
        items("riskNotes").alias("risk_notes"),
        items("testsToAdd").alias("tests_to_add"),
        F.nullif(text("agentPrompt"), F.lit("")).alias("agent_prompt"),
    )
    return F.when(value.isNotNull(), parsed)


def overlay(ranked: DataFrame, advice: DataFrame, most: int = ADVICE_ROWS) -> DataFrame:
    """Replace texts of the first ``most`` opportunities where advice is not empty."""
    parsed = advice.filter(F.col("id") <= most).select("repo", "id", parse_advice(F.col("json")).alias("advice"))
    a = F.col("advice")
    filled = lambda items, own: F.when(F.size(items) > 0, items).otherwise(own)
    return ranked.join(parsed, ["repo", "id"], "left").select(
        *[c for c in ranked.columns if c not in ("explanation", "suggested_steps", "tests_to_add")],
        F.when(a["explanation"] != "", a["explanation"]).otherwise(F.col("explanation")).alias("explanation"),
        filled(a["recommended_refactor"], F.col("suggested_steps")).alias("suggested_steps"),
        filled(a["tests_to_add"], F.col("tests_to_add")).alias("tests_to_add"),
        F.when(F.size(a["risk_notes"]) > 0, a["risk_notes"]).alias("risk_notes"),
        a["agent_prompt"].alias("agent_prompt"),
    )
