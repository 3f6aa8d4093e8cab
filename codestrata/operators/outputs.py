"""Human-facing outputs as tables: limited tasks, report rows, briefs, payloads, explanations.

Texts that list every file of an opportunity are rows, one per line, because a
duplicate group may span any number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..functions.text import brief_file_name, pascal_case
from ..params import OutputSettings

REPORT_ROWS, ADVICE_ROWS = 10, 5
REPORT_EVIDENCE, PAYLOAD_SIGNALS, PAYLOAD_FUNCTIONS = 6, 4, 5


def label_rank(label: Column) -> Column:
    return F.when(label == "High", 3).when(label == "Medium", 2).otherwise(1)


def minimum_rank(priority: Column) -> Column:
    return F.when(priority == "high", 3).when(priority == "medium", 2).otherwise(1)


def prompt_path() -> Column:
    return F.concat(F.lit("prompts/"), brief_file_name(F.col("id"), F.col("title")))


def limited(ranked: DataFrame, settings: OutputSettings = OutputSettings()) -> DataFrame:
    """Opportunities that get a brief.

    Ids follow the priority, so rows above a label are a prefix of the ids and
    the limit is a plain comparison.
    """
    keep = label_rank(F.col("priority_label")) >= minimum_rank(F.lit(settings.min_priority))
    return ranked.filter(keep & (F.col("id") <= settings.limit)).withColumn("prompt_path", prompt_path())


def limited_by_stored(ranked: DataFrame, settings: DataFrame) -> DataFrame:
    """Same, with one settings row per repository."""
    keep = label_rank(F.col("priority_label")) >= minimum_rank(F.col("min_priority"))
    return (
        ranked.join(settings, "repo")
        .filter(keep & (F.col("id") <= F.col("limit")))
        .drop("limit", "min_priority")
        .withColumn("prompt_path", prompt_path())
    )


def find_tasks(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks named by ``wanted(repo, ref)``: the id, which is also the position in the ranking, as text."""
    number = wanted.select("repo", F.trim("ref").try_cast("long").alias("id")).filter("id is not null").distinct()
    return ranked.join(number, ["repo", "id"], "left_semi")


def first_of(items: Column, fallback: str) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(fallback))


def task_rows(limited_rows: DataFrame) -> DataFrame:
    return limited_rows.select(
        "repo", "id", "title", "type_label", "priority_label", "priority", "primary_path", "file_count",
        first_of(F.col("suggested_steps"), fixed.FIRST_STEP_FALLBACK).alias("first_step"),
        first_of(F.col("tests_to_add"), fixed.FIRST_TEST_FALLBACK).alias("test_first"),
        "prompt_path",
    )


# --- files and evidence of opportunities -----------------------------------------------------


def opportunity_files(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """``repo, id, path``: every file of every opportunity."""
    single = ranked.filter(~F.col("is_duplicate")).select("repo", "id", F.col("primary_path").alias("path"))
    groups = ranked.filter(F.col("is_duplicate")).select("repo", "id", "group_ord")
    shared = members.select("repo", "group_ord", "path").distinct().join(groups, ["repo", "group_ord"])
    return single.unionByName(shared.select("repo", "id", "path"))


def opportunity_signals(ranked: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """``repo, id, ord, path, signal``: evidence in order, all of it or the first ``most``."""
    evidence = F.col("evidence") if most is None else F.slice("evidence", 1, most)
    single = ranked.filter(~F.col("is_duplicate")).select(
        "repo", "id", F.posexplode(evidence).alias("pos", "signal"), F.col("primary_path").alias("path")
    ).select("repo", "id", (F.col("pos") + 1).alias("ord"), "path", "signal")
    groups = ranked.filter(F.col("is_duplicate")).select("repo", "id", "group_ord")
    if most is None:
        shared = members.join(groups, ["repo", "group_ord"]).select(
            "repo", "id", F.lit(None).cast("int").alias("ord"), "path", "signal"
        )
    else:
        # A top-k window is cut down in every task before its rows are shuffled.
        order = Window.partitionBy("repo", "group_ord").orderBy("path", "fn_ord")
        first = members.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= most)
        shared = first.join(groups, ["repo", "group_ord"]).select("repo", "id", "ord", "path", "signal")
    return single.unionByName(shared)


def evidence_line() -> Column:
    line = F.col("signal.line")
    place = F.concat(
        F.lit(" ("), F.col("path"), F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")), F.lit(")")
    )
    return F.concat(F.lit("- "), F.col("signal.message"), place)


def evidence_text(ranked: DataFrame, members: DataFrame, most: int, fallback: str) -> DataFrame:
    """``repo, id, evidence_text``: at most ``most`` lines joined by newlines."""
    lines = opportunity_signals(ranked, members, most).groupBy("repo", "id").agg(
        F.array_sort(F.collect_list(F.struct("ord", evidence_line().alias("line")))).alias("rows")
    )
    joined = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return ranked.select("repo", "id").join(lines, ["repo", "id"], "left").select(
        "repo", "id", F.coalesce(joined, F.lit("- " + fallback)).alias("evidence_text")
    )


def report_rows(limited_rows: DataFrame, members: DataFrame) -> DataFrame:
    top = limited_rows.filter(F.col("id") <= REPORT_ROWS)
    evidence = evidence_text(top, members, REPORT_EVIDENCE, fixed.REPORT_EVIDENCE_FALLBACK)
    return top.join(evidence, ["repo", "id"]).select(
        "repo", "id", "title", "type_label", "priority_label", "priority", "impact", "risk", "confidence",
        "primary_path", "file_count", "explanation",
        F.array_join(F.transform("suggested_steps", lambda s: F.concat(F.lit("- "), s)), "\n").alias("steps_text"),
        F.array_join(F.transform("tests_to_add", lambda s: F.concat(F.lit("- "), s)), "\n").alias("tests_text"),
        "evidence_text", "prompt_path",
    )


# --- task briefs ------------------------------------------------------------------------------


def likely_new_files() -> Column:
    path = F.col("primary_path")
    folder = F.regexp_replace(paths.parent_prefix(path), "/$", "")
    stem = paths.file_stem(path)
    place = lambda *parts: F.concat(folder, F.lit("/"), *parts)
    kind = F.col("type")
    return (
        F.when(F.col("helper_path").isNotNull(), F.array(F.col("helper_path")))
        .when(
            kind == fixed.SPLIT,
            F.array(
                place(stem, F.lit("Parts.tsx")), place(F.lit("use"), pascal_case(stem), F.lit("Data.ts"))
            ),
        )
        .when(kind == fixed.HOOK, F.array(place(F.lit("use"), pascal_case(stem), F.lit(".ts"))))
        .when(kind == fixed.SERVICE, F.array(paths.service_path(path)))
        .when(kind == fixed.DEDUPLICATE, F.array(paths.shared_helper_path(path, F.lit("sharedRefactorHelper"))))
        .otherwise(F.array().cast("array<string>"))
    )


def _bullets(items: list[str]) -> list[str]:
    return ["- " + item for item in items]


def brief_lines(chosen: DataFrame, files_of: DataFrame, members: DataFrame, files: DataFrame,
                workspaces: DataFrame, project: DataFrame) -> DataFrame:
    """``repo, id, section, item, line``: the task brief of every chosen opportunity.

    Lines sort by section and item. Sections that list files are joined as rows;
    all other sections come from the opportunity row itself.
    """
    heading = lambda number, title: F.struct(
        F.lit(number).alias("section"), F.lit("").alias("item"), F.lit(f"## {title}").alias("line")
    )
    row = lambda number, line: F.struct(
        F.lit(number).alias("section"), F.lit("").alias("item"), line.alias("line")
    )
    listed = lambda number, items: F.transform(
        items,
        lambda text, i: F.struct(
            F.lit(number).alias("section"), F.lpad(i.cast("string"), 6, "0").alias("item"), text.alias("line")
        ),
    )
    constant = lambda number, items: listed(number, F.array(*[F.lit(t) for t in items]))
    bullet = lambda items: F.transform(items, lambda t: F.concat(F.lit("- "), t))
    quoted = lambda c: F.concat(F.lit("- `"), c, F.lit("`"))
    helper = F.coalesce(
        F.concat(F.col("helper_name"), F.lit(" in "), F.col("helper_path")), F.col("helper_path"), F.col("helper_name")
    )
    own = F.concat(
        F.array(
            row(0, F.concat(F.lit("# Refactor Task: "), F.col("title"))),
            heading(10, "Goal"),
            row(11, F.concat(F.lit("Refactor `"), F.col("primary_path"),
                             F.lit("` to improve maintainability without changing behavior."))),
            heading(20, "Current Problem"),
            row(21, F.col("explanation")),
            row(22, F.lit("Evidence from the scan:")),
            heading(30, "Codebase Context"),
            heading(40, "Required Changes"),
            heading(50, "Constraints"),
            heading(60, "Why This Task Is Bounded"),
            row(61, F.lit(fixed.BRIEF_BOUND)),
            heading(70, "Suggested Implementation Plan"),
            heading(80, "Files Likely Involved"),
            heading(90, "Tests To Add First"),
            heading(100, "Acceptance Criteria"),
        ),
        F.when(helper.isNotNull(), F.array(row(24, F.concat(F.lit("Suggested helper: `"), helper, F.lit("`")))))
        .otherwise(F.array().cast("array<struct<section:int,item:string,line:string>>")),
        listed(41, bullet(F.col("suggested_steps"))),
        constant(51, _bullets(fixed.BRIEF_CONSTRAINTS)),
        constant(71, [f"{n}. {text}" for n, text in enumerate(fixed.BRIEF_PLAN, 1)]),
        listed(83, F.transform(likely_new_files(), quoted)),
        listed(91, bullet(F.col("tests_to_add"))),
        constant(101, _bullets(fixed.BRIEF_ACCEPTANCE)),
    )
    from_row = chosen.select("repo", "id", F.inline_outer(own))

    evidence = opportunity_signals(chosen, members, REPORT_EVIDENCE).select(
        "repo", "id", F.lit(23).alias("section"), F.lpad(F.col("ord").cast("string"), 6, "0").alias("item"),
        evidence_line().alias("line"),
    )
    bare = chosen.filter(~F.col("is_duplicate") & (F.size("evidence") == 0)).select(
        "repo", "id", F.lit(23).alias("section"), F.lit("").alias("item"),
        F.lit("- " + fixed.EVIDENCE_FALLBACK).alias("line"),
    )

    here = files_of.join(chosen.select("repo", "id"), ["repo", "id"])
    spaces = workspaces.select(
        "repo", F.col("root_path").alias("workspace"),
        F.concat(F.coalesce("name", "root_path"), F.lit(" ("), F.col("framework"), F.lit(")")).alias("space_text"),
    )
    known = (
        here.join(files.select("repo", "path", "language", "workspace"), ["repo", "path"])
        .join(spaces, ["repo", "workspace"], "left")
        .join(project.select("repo", F.col("framework").alias("project_framework")), "repo", "left")
    )
    context = F.concat(
        F.lit("- `"), F.col("path"), F.lit("`: "), F.col("language"), F.lit(", workspace/framework: "),
        F.coalesce("space_text", "project_framework", F.lit("unknown")),
    )
    per_file = known.select(
        "repo",
        "id",
        F.inline_outer(
            F.array(
                F.struct(F.lit(31).alias("section"), F.col("path").alias("item"), context.alias("line")),
                F.struct(F.lit(81).alias("section"), F.col("path").alias("item"), quoted(F.col("path")).alias("line")),
                F.struct(
                    F.lit(82).alias("section"), F.col("path").alias("item"),
                    quoted(paths.likely_test_path(F.col("path"))).alias("line"),
                ),
            )
        ),
    )
    return from_row.unionByName(evidence).unionByName(bare).unionByName(per_file)


# --- compact payload ----------------------------------------------------------------------------


def compact_metadata(metadata: Column) -> Column:
    """Metadata with lists cut to two entries and long strings cut to 160 characters."""
    short = lambda c: F.when(F.length(c) > 160, F.concat(F.substring(c, 1, 160), F.lit("..."))).otherwise(c)
    fields = [
        F.slice(metadata[n], 1, 2).alias(n) if n in ("responsibilities", "apiCalls")
        else short(metadata[n]).alias(n) if n in ("name", "functionName", "helperName", "suggestedHelperPath")
        else metadata[n].alias(n)
        for n in (
            "lineCount", "todoCount", "responsibilities", "hookCount", "apiCallCount", "apiCalls", "name",
            "parameterCount", "cyclomaticComplexity", "maxConditionalDepth", "tryCatchLineCount",
            "functionName", "duplicateLineCount", "helperName", "suggestedHelperPath",
        )
    ]
    return F.struct(*fields)


def compact_signal(signal: Column, path: Column) -> Column:
    return F.struct(
        signal["type"].alias("type"),
        signal["message"].alias("message"),
        signal["severity"].alias("severity"),
        F.struct(path.alias("file"), signal["line"].alias("line")).alias("location"),
        compact_metadata(signal["metadata"]).alias("metadata"),
    )


def strongest_functions(functions: Column, most: int) -> Column:
    """Top functions by complexity, then length, then position; arrays sort without a shuffle."""
    keyed = F.transform(
        functions,
        lambda f: F.struct(
            (-f["complexity"]).alias("a"), (-f["line_count"]).alias("b"), f["start_line"].alias("c"),
            f["fn_ord"].alias("d"), f.alias("fn"),
        ),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda k: k["fn"])


def file_summary() -> Column:
    path = F.col("path")
    functions = F.transform(
        strongest_functions(F.col("functions"), PAYLOAD_FUNCTIONS),
        lambda f: F.struct(
            f["name"].alias("name"), f["start_line"].alias("startLine"), f["line_count"].alias("lineCount"),
            f["parameter_count"].alias("parameterCount"), f["complexity"].alias("cyclomaticComplexity"),
            f["max_depth"].alias("maxConditionalDepth"), f["returns_jsx"].alias("returnsJsx"),
        ),
    )
    return F.to_json(
        F.struct(
            path.alias("path"), F.col("line_count").alias("lineCount"), F.col("import_count").alias("importCount"),
            F.col("export_count").alias("exportCount"), F.col("function_count").alias("functionCount"),
            F.col("component_count").alias("componentCount"), F.col("hook_count").alias("hookCount"),
            F.col("has_tests_nearby").alias("hasTestsNearby"), F.col("responsibilities"),
            F.transform(F.slice("signals", 1, PAYLOAD_SIGNALS), lambda s: compact_signal(s, path)).alias("signals"),
            functions.alias("functions"),
        )
    )


def payload_head() -> Column:
    return F.to_json(
        F.struct(
            F.col("id").cast("string").alias("id"), "title", "type", "impact", "risk", "confidence",
            F.col("priority_label").alias("priorityLabel"), "explanation",
            F.slice("suggested_steps", 1, 3).alias("suggestedSteps"),
            F.slice("tests_to_add", 1, 3).alias("testsToAdd"),
            F.struct(
                F.col("helper_name").alias("helperName"), F.col("helper_path").alias("suggestedHelperPath")
            ).alias("metadata"),
        )
    )


def payload_rows(chosen: DataFrame, files_of: DataFrame, members: DataFrame, files: DataFrame,
                 project: DataFrame) -> DataFrame:
    """``repo, id, part, item, json``: compact payload without source text.

    Parts are ``project``, ``opportunity``, ``signal`` (at most four) and one
    ``file`` row for every file of the opportunity.
    """
    part = lambda df, name, item, json: df.select(
        "repo", "id", F.lit(name).alias("part"), item.alias("item"), json.alias("json")
    )
    facts = project.select(
        "repo",
        F.to_json(
            F.struct(
                F.col("package_manager").alias("packageManager"), "framework", "languages",
                F.col("test_framework").alias("testFramework"),
            )
        ).alias("project_json"),
    )
    heads = part(chosen, "opportunity", F.lit(""), payload_head())
    project_part = part(chosen.select("repo", "id").join(facts, "repo"), "project", F.lit(""), F.col("project_json"))
    signals = opportunity_signals(chosen, members, PAYLOAD_SIGNALS)
    signal_part = part(
        signals, "signal", F.lpad(F.col("ord").cast("string"), 6, "0"),
        F.to_json(compact_signal(F.col("signal"), F.col("path"))),
    )
    summaries = files.select("repo", "path", file_summary().alias("file_json"))
    here = files_of.join(chosen.select("repo", "id"), ["repo", "id"]).join(summaries, ["repo", "path"])
    return heads.unionByName(project_part).unionByName(signal_part).unionByName(
        part(here, "file", F.col("path"), F.col("file_json"))
    )


# --- explain -----------------------------------------------------------------------------------------


def explain_files(files: DataFrame) -> DataFrame:
    """Facts and strongest functions of every file; filter on ``repo, path`` for one."""
    lines = F.transform(
        strongest_functions(F.col("functions"), PAYLOAD_FUNCTIONS),
        lambda f: F.concat(
            f["name"], F.lit(":"), f["start_line"].cast("string"), F.lit(":"), f["line_count"].cast("string"),
            F.lit(":"), f["complexity"].cast("string"), F.lit(":"), f["parameter_count"].cast("string"),
        ),
    )
    notes = F.transform(
        "signals",
        lambda s: F.concat(
            s["message"], F.coalesce(F.concat(F.lit(" at line "), s["line"].cast("string")), F.lit(""))
        ),
    )
    return files.select(
        "repo", "path", F.array_join("responsibilities", ", ").alias("responsibilities"), "line_count",
        "import_count", "export_count", "function_count", "component_count", "hook_count", "has_tests_nearby",
        F.array_join(notes, "\n").alias("signal_text"), F.array_join(lines, "\n").alias("strongest_functions"),
    )


def explain_tests(files: DataFrame, files_of: DataFrame, ranked: DataFrame) -> DataFrame:
    """``repo, path, test, first_id``: distinct tests to add per file, with the fallback texts."""
    tests = (
        files_of.join(ranked.select("repo", "id", F.explode("tests_to_add").alias("test")), ["repo", "id"])
        .groupBy("repo", "path", "test")
        .agg(F.min("id").alias("first_id"))
    )
    fallback = F.when(F.col("has_tests_nearby"), F.lit(fixed.EXPLAIN_COVERED_FALLBACK)).otherwise(
        F.lit(fixed.EXPLAIN_UNCOVERED_FALLBACK)
    )
    return files.select("repo", "path", "has_tests_nearby").join(tests, ["repo", "path"], "left").select(
        "repo", "path", F.coalesce("test", fallback).alias("test"), F.coalesce("first_id", F.lit(0)).alias("first_id")
    )


def explain_opportunities(files_of: DataFrame, ranked: DataFrame) -> DataFrame:
    """``repo, path, id, title, priority_label, priority``: opportunities of each file."""
    return files_of.join(
        ranked.select("repo", "id", "title", "priority_label", "priority"), ["repo", "id"]
    ).select("repo", "path", "id", "title", "priority_label", "priority")
