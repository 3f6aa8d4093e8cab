"""File metrics and signals. One row per file in, one row per file out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import blocks, paths, script, text
from ..functions.text import bind, built_once, has_cased_word, has_word, listed_words, matches, matches_with
from ..params import Params, Thresholds

METADATA = {
    "lineCount": "int",
    "todoCount": "int",
    "responsibilities": "array<string>",
    "hookCount": "int",
    "apiCallCount": "int",
    "apiCalls": f"array<{script.CALL_TYPE}>",
    "name": "string",
    "parameterCount": "int",
    "cyclomaticComplexity": "int",
    "maxConditionalDepth": "int",
    "tryCatchLineCount": "int",
    "functionName": "string",
    "duplicateLineCount": "int",
    "helperName": "string",
    "suggestedHelperPath": "string",
}
METADATA_TYPE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in METADATA.items()) + ">"
SIGNAL_TYPE = f"struct<type:string,message:string,severity:string,line:int,metadata:{METADATA_TYPE}>"


#: Words of the tag rules of Python and Java.
HEURISTIC_WORDS = [
    *fixed.HTTP_CLIENTS, *fixed.TAG_VALIDATION_WORDS, *fixed.TAG_DATABASE_WORDS, *fixed.TAG_AUTH_WORDS, *fixed.TAG_ROUTING_WORDS,
    *fixed.TAG_LOGIC_WORDS,
]


def signal(kind: str, message: Column, severity: Column | str, line: Column | None = None, **facts) -> Column:
    values = [
        (facts[name] if name in facts else F.lit(None)).cast(type_).alias(name)
        for name, type_ in METADATA.items()
    ]
    return F.struct(
        F.lit(kind).alias("type"),
        message.alias("message"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        F.struct(*values).alias("metadata"),
    )


def _when_high(condition: Column, otherwise: str) -> Column:
    return F.when(condition, F.lit("high")).otherwise(F.lit(otherwise))


def is_complex(fn: Column, limits: Thresholds) -> Column:
    return (
        (fn["line_count"] >= limits.complex_function_lines)
        | (fn["complexity"] >= limits.complex_function_complexity)
        | (fn["parameter_count"] > limits.max_function_params)
        | (fn["max_depth"] >= fixed.DEEP_NESTING)
    )


def _text(value: Column) -> Column:
    return value.cast("string")


def _heuristic_tags(path: Column, language: Column, content: Column) -> Column:
    """Tags of a Python or Java file, from its text without comments."""

    def tags(code: Column, words: Column) -> Column:
        has = lambda *wanted: has_cased_word(code, words, *wanted)
        has_any_case = lambda *wanted: has_word(code, words, *wanted, ignore_case=True)
        return F.array_sort(
            F.array_compact(
                F.array(
                    F.when(paths.is_test_file(path), "testing"),
                    F.when(has(*fixed.HTTP_CLIENTS), "data-fetching"),
                    F.when(has_any_case(*fixed.TAG_VALIDATION_WORDS), "validation"),
                    F.when(
                        has_any_case(*fixed.TAG_DATABASE_WORDS)
                        | matches_with(code, rf"@(?:{'|'.join(fixed.TAG_DATABASE_ANNOTATIONS)})(?!\w)", "@"),
                        "database",
                    ),
                    F.when(has_any_case(*fixed.TAG_AUTH_WORDS), "auth"),
                    F.when(
                        has(*fixed.TAG_ROUTING_WORDS) | matches_with(code, fixed.TAG_ROUTING_DECORATOR, "@"),
                        "routing",
                    ),
                    F.when(
                        has(*fixed.TAG_LOGIC_WORDS)
                        | ((language == "java") & matches_with(code, rf"(?<!\w){fixed.TAG_LOGIC_JAVA_CLASS}", "class")),
                        "business-logic",
                    ),
                )
            )
        )

    def with_words(code: Column) -> Column:
        """The words of the text are taken out once; each list of words would read the whole text."""
        return bind(listed_words(code, HEURISTIC_WORDS), lambda words: tags(code, words))

    stripped = F.when(language == "python", text.strip_hash_comments(content)).otherwise(
        text.strip_slash_comments(content)
    )
    return bind(stripped, with_words)


def _count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: matches(line, pattern)))


def _line_sources(lines: Column, pattern: str, second: bool) -> Column:
    hits = F.filter(lines, lambda line: matches(line, pattern))

    def source(line: Column) -> Column:
        first = F.regexp_extract(line, pattern, 1)
        return F.when(first == "", F.regexp_extract(line, pattern, 2)).otherwise(first) if second else first

    return F.transform(hits, source)


def read_text(files: DataFrame) -> DataFrame:
    """Split each file once: lines for Python and Java, bare and code text for scripts."""
    path, content = F.col("path"), F.col("content")
    is_script = paths.is_script(path)
    return files.select(
        "repo",
        "path",
        "content",
        paths.language(path).alias("language"),
        is_script.alias("is_script"),
        F.when(~is_script, text.lines_of(content)).alias("lines"),
        F.when(is_script, source_column()).alias("source"),
    )


@built_once
def import_sources() -> Column:
    language, lines = F.col("language"), F.col("lines")
    return (
        F.when(language == "python", _line_sources(lines, fixed.PYTHON_IMPORT_SOURCE, True))
        .when(F.col("is_script"), script.import_sources(F.col("source.bare")))
        .otherwise(_line_sources(lines, fixed.JAVA_IMPORT_SOURCE, False))
    )


@built_once
def calls_column() -> Column:
    """Requests of a file; needs the column ``parsed``."""
    return F.when(F.col("is_script"), F.col("parsed.requests")).otherwise(F.array().cast(f"array<{script.CALL_TYPE}>"))


def with_parsed(files: DataFrame) -> DataFrame:
    """Calls and functions of scripts, from one index of their brackets."""
    is_script = F.col("is_script")
    return script.with_parsed(files, F.when(is_script, F.col("source.code")), F.when(is_script, F.col("source.bare")))


@built_once
def tags_column() -> Column:
    path, content, code = F.col("path"), F.col("content"), F.col("source.code")
    return F.when(
        F.col("is_script"), script.responsibilities(path, content, code, F.size("api_calls") > 0)
    ).otherwise(_heuristic_tags(path, F.col("language"), content))


@built_once
def source_column() -> Column:
    return bind(
        script.pieces(F.col("content")),
        lambda parts: F.struct(
            script.without_comments(parts).alias("bare"), script.code_only(parts).alias("code")
        ),
    )


@built_once
def functions_column() -> Column:
    """Functions of a file; needs the column ``parsed``."""
    language, lines = F.col("language"), F.col("lines")
    return (
        F.when(language == "python", blocks.python_functions(lines))
        .when(F.col("is_script"), F.col("parsed.functions"))
        .otherwise(blocks.java_functions(lines))
        .cast(f"array<{blocks.FUNCTION_TYPE}>")
    )


def file_metrics(files: DataFrame, params: Params = Params()) -> DataFrame:
    """``repo, path`` plus every per-file metric, functions and signals."""
    content, language, lines = F.col("content"), F.col("language"), F.col("lines")
    is_script, bare, code = F.col("is_script"), F.col("source.bare"), F.col("source.code")

    measured = with_parsed(read_text(files)).select(
        "repo",
        "path",
        "content",
        "language",
        "is_script",
        "lines",
        "source",
        text.line_count(content).alias("line_count"),
        text.marker_count(content).alias("todo_count"),
        import_sources().alias("import_sources"),
        F.when(is_script, F.size(script.import_sources(bare)))
        .when(language == "python", _count_lines(lines, fixed.PYTHON_IMPORT_LINE))
        .otherwise(_count_lines(lines, fixed.JAVA_IMPORT_SOURCE))
        .alias("import_count"),
        F.when(is_script, script.export_count(code))
        .when(language == "python", _count_lines(lines, fixed.PYTHON_EXPORT_LINE))
        .otherwise(_count_lines(lines, fixed.JAVA_EXPORT_LINE))
        .alias("export_count"),
        F.when(is_script, script.hook_count(F.col("parsed.calls"))).otherwise(0).alias("hook_count"),
        F.when(is_script, script.returns_markup(code)).otherwise(F.lit(False)).alias("has_markup"),
        calls_column().alias("api_calls"),
        functions_column().alias("functions"),
        F.sha2(content, 256).alias("content_hash"),
    )
    tagged = measured.select(
        *[c for c in measured.columns if c not in ("lines", "source", "content")],
        tags_column().alias("responsibilities"),
        (is_script & matches_with(content, r"(?<!\w)style=\{\{", "={{")).alias("inline_styles"),
    )
    total = F.aggregate("functions", F.lit(0), lambda acc, fn: acc + fn["complexity"])
    scored = tagged.select(
        "*",
        F.size("functions").alias("function_count"),
        F.size(
            F.filter("functions", lambda fn: fn["returns_jsx"] & fn["name"].rlike("^[A-Z]"))
        ).alias("component_count"),
        (
            total
            + F.floor(F.col("line_count") / 100).cast("int")
            + 2 * F.greatest(F.lit(0), F.size("responsibilities") - 2)
        ).alias("complexity_score"),
    )
    return scored.select(
        "repo", "path", "language", "line_count", "import_count", "export_count", "function_count",
        "component_count", "hook_count", "todo_count", "complexity_score", "responsibilities",
        "import_sources", "api_calls", "functions", signals(params.thresholds).alias("signals"),
        "content_hash",
    )


@built_once
def signals(limits: Thresholds) -> Column:
    """Signals of a file: file-level rules first, then those of each function."""
    lines, todos, tags = F.col("line_count"), F.col("todo_count"), F.col("responsibilities")
    hooks, calls = F.col("hook_count"), F.col("api_calls")
    plural = F.when(todos == 1, F.lit("")).otherwise(F.lit("s"))
    only_services = F.forall(calls, lambda c: c["kind"] == "service-call")
    of_file = F.array(
        F.when(
            lines >= limits.large_file_lines,
            signal(
                "large-file",
                F.concat(F.lit("File has "), _text(lines), F.lit(" lines.")),
                _when_high(lines >= limits.large_file_lines * 1.5, "medium"),
                lineCount=lines,
            ),
        ),
        F.when(
            todos > 0,
            signal(
                "todo-comments",
                F.concat(
                    F.lit("File contains "), _text(todos), F.lit(" TODO/FIXME/HACK comment"), plural, F.lit(".")
                ),
                F.when(todos >= 3, F.lit("medium")).otherwise(F.lit("low")),
                todoCount=todos,
            ),
        ),
        F.when(
            F.size(tags) >= limits.max_responsibilities,
            signal(
                "mixed-responsibilities",
                F.concat(
                    F.lit("File appears to combine "), F.array_join(tags, ", "), F.lit(" responsibilities.")
                ),
                _when_high(F.size(tags) >= 5, "medium"),
                responsibilities=tags,
            ),
        ),
        F.when(
            (hooks > limits.max_hooks_in_component) & F.col("has_markup"),
            signal(
                "too-many-hooks",
                F.concat(F.lit("React file uses "), _text(hooks), F.lit(" hooks.")),
                _when_high(hooks > limits.max_hooks_in_component * 1.5, "medium"),
                hookCount=hooks,
            ),
        ),
        F.when(
            F.col("has_markup") & (F.size(calls) > 0),
            signal(
                "api-calls-in-ui",
                F.when(only_services, F.lit("UI file calls data/service functions directly.")).otherwise(
                    F.lit("UI file appears to perform network or client calls directly.")
                ),
                "medium",
                apiCallCount=F.size(calls),
                apiCalls=F.slice(calls, 1, fixed.MAX_STORED_CALLS),
            ),
        ),
        F.when(
            F.col("inline_styles"),
            signal("inline-styles", F.lit("File contains inline style objects."), "low"),
        ),
    )

    def of_function(fn: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(
                    is_complex(fn, limits),
                    signal(
                        "complex-function",
                        F.concat(
                            fn["name"], F.lit(" is complex ("), _text(fn["line_count"]),
                            F.lit(" lines, complexity "), _text(fn["complexity"]), F.lit(")."),
                        ),
                        _when_high(fn["complexity"] >= limits.complex_function_complexity * 1.5, "medium"),
                        fn["start_line"],
                        name=fn["name"],
                        lineCount=fn["line_count"],
                        parameterCount=fn["parameter_count"],
                        cyclomaticComplexity=fn["complexity"],
                        maxConditionalDepth=fn["max_depth"],
                    ),
                ),
                F.when(
                    F.col("is_script") & (fn["try_lines"] >= fixed.LARGE_TRY_LINES),
                    signal(
                        "large-try-catch",
                        F.concat(fn["name"], F.lit(" has a large try/catch block.")),
                        "medium",
                        fn["start_line"],
                        name=fn["name"],
                        tryCatchLineCount=fn["try_lines"],
                    ),
                ),
                F.when(
                    F.col("is_script") & fn["is_async"] & (fn["api_call_count"] > 0) & ~fn["has_try"],
                    signal(
                        "async-without-error-handling",
                        F.concat(
                            fn["name"],
                            F.lit(" performs async work without obvious try/catch error handling."),
                        ),
                        "medium",
                        fn["start_line"],
                        name=fn["name"],
                    ),
                ),
            )
        )

    return F.concat(F.array_compact(of_file), F.flatten(F.transform("functions", of_function)))
