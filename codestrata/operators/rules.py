"""Opportunity rules and scores.

All file rules are one array per file, so a single pass over the metric rows
emits every draft. Wording is attached after ranking; drafts carry only keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..functions.text import built_once, lookup, lookup_lists, pascal_case
from ..params import Params, Thresholds
from .analysis import SIGNAL_TYPE, is_complex
from .duplicates import duplicate_groups

DRAFT = [
    "repo", "is_duplicate", "primary_path", "rule_ord", "fn_ord", "type", "variant", "subject", "focus",
    "tested", "file_count", "strength", "max_line_count", "max_complexity", "max_dependents",
    "max_signals", "missing_tests", "sensitive", "evidence", "helper_name", "helper_path", "group_ord",
]


@built_once
def primary_symbol() -> Column:
    """Name shown for a file: first component, else longest named function, else the file name."""
    functions = F.col("functions")
    component = F.get(
        F.filter(functions, lambda f: f["returns_jsx"] & f["name"].rlike("^[A-Z]")), F.lit(0)
    )["name"]
    named = F.transform(
        F.filter(functions, lambda f: ~f["name"].startswith(fixed.ANONYMOUS_PREFIX)),
        lambda f: F.struct(
            f["line_count"].alias("lines"), f["complexity"].alias("complexity"),
            (-f["fn_ord"]).alias("first"), f["name"].alias("name"),
        ),
    )
    path = F.col("path")
    stem = paths.without_extension(paths.base_name(path))
    folder = F.when(path.contains("/"), paths.base_name(paths.directory(path))).otherwise(F.lit("."))
    from_file = F.when(stem == "index", F.concat(pascal_case(folder), F.lit("Index"))).otherwise(pascal_case(stem))
    return F.coalesce(component, F.array_max(named)["name"], from_file)


def _has(kind: str) -> Column:
    return F.exists("signals", lambda s: s["type"] == kind)


def _evidence(*kinds: str) -> Column:
    return F.filter("signals", lambda s: s["type"].isin(*kinds))


def _draft(order: int, kind: str, subject: Column, strength: Column | int, evidence: Column, *,
           fn_ord: Column | int = 0, variant: Column | str | None = None, focus: Column | str = "") -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(order).alias("rule_ord"),
        as_column(fn_ord).cast("int").alias("fn_ord"),
        F.lit(kind).alias("type"),
        (F.lit(kind) if variant is None else as_column(variant)).alias("variant"),
        subject.alias("subject"),
        as_column(focus).alias("focus"),
        as_column(strength).cast("int").alias("strength"),
        evidence.cast(f"array<{SIGNAL_TYPE}>").alias("evidence"),
    )


@built_once
def draft_array(limits: Thresholds) -> Column:
    """All drafts of a prepared file row, in rule order."""
    lines, tags = F.col("line_count"), F.col("responsibilities")
    symbol, complex_functions, large = F.col("symbol"), F.col("complex_functions"), F.col("large_components")
    stored = F.slice("api_calls", 1, fixed.MAX_STORED_CALLS)
    services_only = F.forall(stored, lambda c: c["kind"] == "service-call")
    first_complex = F.get(complex_functions, F.lit(0))["name"]
    quoted = lambda name: F.concat(F.lit("`"), name, F.lit("`"))
    needs_tests = (
        ~F.col("has_tests_nearby")
        & ~F.array_contains(tags, "testing")
        & (
            (F.col("complexity_score") >= 15)
            | (lines >= limits.large_file_lines)
            | (F.size(complex_functions) > 0)
            | F.array_contains(tags, "auth")
            | F.array_contains(tags, "database")
        )
    )
    before = F.array(
        F.when(
            (F.size(large) > 0) | ((F.col("component_count") > 0) & (lines >= limits.large_component_lines)),
            _draft(
                1, fixed.SPLIT, F.coalesce(F.get(large, F.lit(0))["name"], symbol),
                F.when(F.size(large) > 0, 3).otherwise(2), _evidence("large-file", "complex-function"),
            ),
        ),
        F.when(_has("too-many-hooks"), _draft(2, fixed.HOOK, symbol, 3, _evidence("too-many-hooks"))),
        F.when(
            _has("api-calls-in-ui"),
            _draft(
                3, fixed.SERVICE, symbol, 3, _evidence("api-calls-in-ui"),
                variant=F.when(services_only, fixed.SERVICE + "/service").otherwise(fixed.SERVICE),
            ),
        ),
    )
    simplify = F.transform(
        F.slice(complex_functions, 1, fixed.COMPLEX_FUNCTIONS_PER_FILE),
        lambda f: _draft(
            4, fixed.SIMPLIFY, f["name"],
            F.when((f["complexity"] >= 18) | (f["line_count"] >= 100), 3).otherwise(2),
            F.filter("signals", lambda s: (s["type"] == "complex-function") & (s["metadata"]["name"] == f["name"])),
            fn_ord=f["fn_ord"], focus=quoted(f["name"]),
        ),
    )
    after = F.array(
        F.when(
            _has("mixed-responsibilities"),
            _draft(
                5, fixed.BOUNDARIES, symbol, F.least(F.lit(4), F.size(tags) - 1),
                _evidence("mixed-responsibilities"),
            ),
        ),
        F.when(
            needs_tests,
            _draft(
                6, fixed.ADD_TESTS, symbol, 3,
                _evidence("complex-function", "large-file", "mixed-responsibilities"),
                variant=F.when(first_complex.isNull(), fixed.ADD_TESTS + "/file").otherwise(fixed.ADD_TESTS),
                focus=quoted(F.coalesce(first_complex, F.col("path"))),
            ),
        ),
        F.when(
            F.col("todo_count") > 0,
            _draft(
                7, fixed.DEAD_CODE, paths.without_extension(paths.base_name(F.col("path"))),
                F.when(F.col("todo_count") >= 3, 2).otherwise(1), _evidence("todo-comments"),
            ),
        ),
    )
    return F.array_compact(F.concat(before, simplify, after))


def file_drafts(files: DataFrame, params: Params = Params()) -> DataFrame:
    """Drafts of the seven file rules."""
    limits = params.thresholds
    lines, tags, functions = F.col("line_count"), F.col("responsibilities"), F.col("functions")
    prepared = files.filter(
        ~(F.array_contains(tags, "testing") & (lines < fixed.SMALL_TEST_FILE_LINES))
    ).select(
        "*",
        primary_symbol().alias("symbol"),
        F.filter(functions, lambda f: is_complex(f, limits)).alias("complex_functions"),
        F.filter(
            functions, lambda f: f["returns_jsx"] & (f["line_count"] >= limits.large_component_lines)
        ).alias("large_components"),
    )
    return prepared.select(
        "repo",
        F.lit(False).alias("is_duplicate"),
        F.col("path").alias("primary_path"),
        F.col("has_tests_nearby").alias("tested"),
        F.lit(1).cast("long").alias("file_count"),
        lines.alias("max_line_count"),
        F.col("complexity_score").alias("max_complexity"),
        F.col("dependent_count").alias("max_dependents"),
        F.size("signals").alias("max_signals"),
        (~F.col("has_tests_nearby")).alias("missing_tests"),
        F.arrays_overlap(tags, F.array(*[F.lit(t) for t in fixed.SENSITIVE_TAGS])).alias("sensitive"),
        F.lit(None).cast("string").alias("helper_name"),
        F.lit(None).cast("string").alias("helper_path"),
        F.lit(None).cast("int").alias("group_ord"),
        F.inline_outer(draft_array(limits)),
    ).filter(F.col("type").isNotNull()).select(*DRAFT)


def duplicate_drafts(groups: DataFrame) -> DataFrame:
    """Drafts of the duplicate rule; members stay in their own rows."""
    strong = (F.col("max_duplicate_lines") >= 25) | (F.col("member_count") >= 3)
    return groups.filter(~F.col("dropped")).select(
        "repo",
        F.lit(True).alias("is_duplicate"),
        F.col("first_spot.path").alias("primary_path"),
        F.lit(8).alias("rule_ord"),
        F.col("first_spot.fn_ord").alias("fn_ord"),
        F.lit(fixed.DEDUPLICATE).alias("type"),
        F.lit(fixed.DEDUPLICATE).alias("variant"),
        F.col("display_name").alias("subject"),
        F.lit("").alias("focus"),
        F.col("all_tested").alias("tested"),
        "file_count",
        F.when(strong, 3).otherwise(1).alias("strength"),
        "max_line_count",
        "max_complexity",
        "max_dependents",
        "max_signals",
        (~F.col("all_tested")).alias("missing_tests"),
        "sensitive",
        F.array().cast(f"array<{SIGNAL_TYPE}>").alias("evidence"),
        "helper_name",
        "helper_path",
        "group_ord",
    ).select(*DRAFT)


def all_drafts(files: DataFrame, params: Params = Params()) -> DataFrame:
    return file_drafts(files, params).unionByName(duplicate_drafts(duplicate_groups(files)))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), value))


def priority_label(priority: Column) -> Column:
    return (
        F.when(priority >= fixed.LABEL_HIGH, "High")
        .when(priority >= fixed.LABEL_MEDIUM, "Medium")
        .otherwise("Low")
    )


def _steps(value: Column, width: int, most: int) -> Column:
    return F.least(F.lit(most), F.floor(value / width).cast("int"))


def score(drafts: DataFrame) -> DataFrame:
    """Add ``impact, risk, confidence, priority, priority_label``."""
    kind, files, strength = F.col("type"), F.col("file_count"), F.col("strength")
    size, complexity = F.col("max_line_count"), F.col("max_complexity")
    users = F.least(F.lit(2), F.col("max_dependents").cast("int"))
    if_ = lambda condition, value: F.when(condition, value).otherwise(0)
    impact = (
        2 + strength + _steps(size, 250, 2) + _steps(complexity, 40, 2) + if_(files > 1, 1) + users
        + if_(kind == fixed.SPLIT, 2)
        + if_(kind.isin(fixed.HOOK, fixed.SERVICE, fixed.SIMPLIFY), 1)
        + if_((kind == fixed.DEDUPLICATE) & (files >= 3), 2)
        + if_((kind == fixed.ADD_TESTS) & ((complexity >= 40) | (size >= 300)), 1)
        - if_(kind == fixed.DEAD_CODE, 1)
    )
    base_risk = (
        2 + _steps(complexity, 35, 3) + users + if_(F.col("missing_tests"), 1) + if_(F.col("sensitive"), 2)
    )
    risk = (
        F.when(kind == fixed.ADD_TESTS, F.greatest(F.lit(1), base_risk - 2))
        .when(kind.isin(fixed.HOOK, fixed.DEAD_CODE), base_risk - 1)
        .when(kind == fixed.BOUNDARIES, base_risk + 1)
        .otherwise(base_risk)
    )
    confidence = (
        4 + strength + _steps(F.col("max_signals"), 3, 2)
        + if_(kind.isin(fixed.SPLIT, fixed.ADD_TESTS) | ((kind == fixed.DEDUPLICATE) & (files >= 3)), 1)
    )
    scored = drafts.select(
        "*", clamp(impact).alias("impact"), clamp(risk).alias("risk"), clamp(confidence).alias("confidence")
    ).withColumn("priority", F.col("impact") * F.col("confidence") - F.col("risk"))
    return scored.withColumn("priority_label", priority_label(F.col("priority")))


def _fill(template: Column) -> Column:
    with_subject = F.replace(template, F.lit("{subject}"), F.col("subject"))
    return F.replace(with_subject, F.lit("{focus}"), F.col("focus"))


def title() -> Column:
    plain = {**fixed.TITLES, fixed.ADD_TESTS + "/file": fixed.TITLES[fixed.ADD_TESTS]}
    special = (F.col("type") == fixed.DEDUPLICATE) & (F.col("helper_name") == fixed.BLOB_READER_HELPER) & (
        F.col("subject") == fixed.BLOB_READER_LABEL
    )
    return F.when(special, F.lit(fixed.BLOB_READER_TITLE)).otherwise(_fill(lookup(plain, F.col("variant"))))


def with_text(opportunities: DataFrame) -> DataFrame:
    """Add ``title, type_label, explanation, suggested_steps, tests_to_add``."""
    variant, kind = F.col("variant"), F.col("type")
    explanations = {**fixed.EXPLANATIONS, fixed.ADD_TESTS + "/file": fixed.EXPLANATIONS[fixed.ADD_TESTS]}
    steps = {**fixed.STEPS, fixed.ADD_TESTS + "/file": fixed.STEPS[fixed.ADD_TESTS]}
    test = F.when(F.col("tested"), lookup(fixed.TESTS_WHEN_COVERED, variant)).otherwise(
        lookup(fixed.TESTS_WHEN_UNCOVERED, variant)
    )
    return opportunities.select(
        "*",
        title().alias("title"),
        lookup(fixed.TYPE_LABELS, kind).alias("type_label"),
        lookup(explanations, variant).alias("explanation"),
        F.transform(lookup_lists(steps, variant), _fill).alias("suggested_steps"),
        F.array(_fill(test)).alias("tests_to_add"),
    )
