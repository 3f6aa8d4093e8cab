"""Registered queries. Every query reads the given tables and grows with them."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import paths, text
from ..operators import advice, analysis, duplicates, outputs, ranking, relations, rules, runs
from ..params import OutputSettings, Params
from ..sources import files as sources
from ..sources import manifests as project_sources
from ..sources import stores
from . import corpus, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PARAMS = Params()
#: The users of the event log are spread over so many repositories, by their id.
USER_REPOS = 21


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines report the same types."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: _plain(build(spark, sf_dir))
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(spark: SparkSession, sf_dir: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``measure`` of the candidate files, without the rows of ignored ones; only its result is shuffled."""
    listing = corpus.listing(spark, sf_dir)
    ignored = sources.ignored_files(listing, sources.ignore_rules(listing), PARAMS)
    return sources.drop_ignored(measure(sources.candidates(listing, PARAMS)), ignored)


def _analysed_names(prepared: scan.Corpus) -> DataFrame:
    ignored = sources.ignored_files(prepared.names, sources.ignore_rules(prepared.settings), PARAMS)
    return sources.drop_ignored(sources.candidates(prepared.names, PARAMS), ignored)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.selected_metrics(scan.prepare(corpus.listing(spark, sf_dir)), PARAMS)


def _scan(spark: SparkSession, sf_dir: str) -> scan.Scan:
    return scan.scan(corpus.listing(spark, sf_dir), PARAMS)


def _joined(items: Column | str, separator: str = ", ") -> Column:
    return F.array_join(items, separator)


def _repo(number: Column) -> Column:
    return F.concat(F.lit("repo"), number.cast("string"))


# --- files, lines, tags ---------------------------------------------------------------


@register
def corpus_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return sources.select_sources(corpus.listing(spark, sf_dir), PARAMS).select(
        "repo", "path", paths.language(path).alias("language"), paths.is_script(path).alias("is_script"),
        paths.is_test_file(path).alias("is_test"),
    )


@register
def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", text.line_count(body).alias("line_count"),
        text.marker_count(body).alias("marker_count"),
    )


@register
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = text.marker_count(F.col("content")).alias("todo_count")
    return _kept(spark, sf_dir, lambda files: files.select("repo", "path", count))


@register
def import_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(
        "repo", "path", "import_count", "export_count", _joined("import_sources", "|").alias("sources")
    )


@register
def responsibility_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("repo", "path", "language", _joined("responsibilities").alias("tags"))


def _unnest(rows: DataFrame, items: Column, required: str) -> DataFrame:
    """One row per array element; the outer form keeps the array from being computed twice."""
    return rows.select("repo", "path", F.inline_outer(items)).filter(F.col(required).isNotNull())


FUNCTION_COLUMNS = [
    "fn_ord", "name", "start_line", "end_line", "line_count", "parameter_count", "is_async", "has_try", "try_lines",
    "conditional_count", "max_depth", "complexity", "hook_count", "api_call_count", "returns_jsx", "body_hash",
]


def _functions(spark: SparkSession, sf_dir: str, *languages: str) -> DataFrame:
    def found(files: DataFrame) -> DataFrame:
        parsed = analysis.with_parsed(analysis.read_text(files).filter(F.col("language").isin(*languages)))
        return _unnest(parsed, analysis.functions_column(), "name").select("repo", "path", *FUNCTION_COLUMNS)

    return _kept(spark, sf_dir, found)


@register
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(spark, sf_dir, "python")


@register
def java_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(spark, sf_dir, "java")


@register
def js_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _functions(spark, sf_dir, "typescript", "javascript")


@register
def js_api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(files: DataFrame) -> DataFrame:
        calls = _unnest(analysis.with_parsed(analysis.read_text(files).filter("is_script")), analysis.calls_column(), "kind")
        return calls.select("repo", "path", "expression", "kind", "line", "import_source")

    return _kept(spark, sf_dir, found)


@register
def file_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select(
        "repo", "path", "line_count", "function_count", "component_count", "hook_count", "complexity_score"
    )


@register
def js_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).filter(paths.is_script(F.col("path"))).select(
        "repo", "path", "component_count", "hook_count", "export_count", F.size("api_calls").alias("api_call_count"),
        _joined("responsibilities").alias("tags"),
    )


@register
def complex_functions_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.slice(
        F.filter("functions", lambda f: analysis.is_complex(f, PARAMS.thresholds)), 1, fixed.COMPLEX_FUNCTIONS_PER_FILE
    )
    return _unnest(_metrics(spark, sf_dir), chosen, "name").select(
        "repo", "path", "fn_ord", "name", "start_line", "line_count", "complexity"
    )


def _file_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unnest(_metrics(spark, sf_dir), F.col("signals"), "type").select(
        "repo", "path", "type", "message", "severity", F.coalesce("line", F.lit(0)).alias("line")
    )


@register
def file_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_signals(spark, sf_dir)


@register
def js_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_signals(spark, sf_dir).filter(paths.is_script(F.col("path")))


@register
def signals_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = F.array_contains("responsibilities", "testing") & (F.col("line_count") < fixed.SMALL_TEST_FILE_LINES)
    return _metrics(spark, sf_dir).select(
        "repo", "path", F.size("signals").alias("signal_count"), tested.alias("small_test_file")
    )


@register
def path_and_name_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    stem = paths.file_stem(path)
    columns = [
        "repo", "path", text.pascal_case(stem).alias("pascal"), text.snake_case(stem).alias("snake"),
        text.slug(path).alias("slug"), text.brief_file_name(F.length(path), path).alias("brief_name"),
        paths.likely_test_path(path).alias("test_path"), paths.service_path(path).alias("service_path"),
        paths.shared_helper_path(path, F.lit("sharedRefactorHelper")).alias("helper_path"),
        paths.directory(path).alias("folder"), F.sha2("content", 256).alias("content_hash"),
    ]
    return _kept(spark, sf_dir, lambda files: files.select(*columns))


# --- relations ------------------------------------------------------------------------------


@register
def nearby_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = corpus.listing(spark, sf_dir)
    return relations.nearby_tests(sources.select_sources(listing, PARAMS), listing.select("repo", "path"))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import statements, stored like the metrics of a scan, since two relations read them."""
    sources_of = analysis.import_sources().alias("import_sources")
    found = _kept(spark, sf_dir, lambda files: analysis.read_text(files).select("repo", "path", sources_of))
    return stores.materialize(found, "imports")


@register
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = _imports(spark, sf_dir)
    return relations.import_edges(imports, imports.select("repo", "path"))


@register
def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = _imports(spark, sf_dir)
    return relations.dependents(imports, imports.select("repo", "path"))


@register
def workspace_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    kept = _analysed_names(prepared)
    files = kept.select("repo", "path")
    return relations.workspace_of(files, prepared.workspaces)


# --- duplicates --------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    files = stores.materialize(scan.analysed_files(prepared, PARAMS), "files")
    return files, duplicates.duplicate_groups(files)


@register
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups = _groups(spark, sf_dir)
    return groups.select(
        "repo", "body_hash", "group_ord", "file_count", "member_count", "max_duplicate_lines",
        F.col("first_spot.path").alias("first_path"), "display_name", "helper_name", "helper_path", "dropped",
    )


@register
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, groups = _groups(spark, sf_dir)
    members = duplicates.duplicate_members(files, groups)
    return members.select(
        "repo", "group_ord", "path", "fn_ord", F.col("signal.message").alias("message"), F.col("signal.line").alias("line")
    )


@register
def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal normalised texts across sources, straight from the documents table."""
    hashed = _table(spark, sf_dir, "documents").select(
        "source", "doc_id", text.body_hash(F.col("text"), True).alias("body_hash")
    )
    per_source = hashed.groupBy("body_hash", "source").agg(
        F.count("*").alias("members"), F.min("doc_id").alias("first_doc")
    )
    return (
        per_source.groupBy("body_hash")
        .agg(
            F.count("*").alias("source_count"), F.sum("members").alias("member_count"),
            F.min("first_doc").alias("first_doc"),
        )
        .filter(F.col("source_count") > 1)
    )


# --- opportunities ----------------------------------------------------------------------------------


@register
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    files = stores.materialize(scan.analysed_files(prepared, PARAMS), "files")
    return rules.score(rules.all_drafts(files, PARAMS)).select(
        "repo", "type", "primary_path", "rule_ord", "fn_ord", "subject", "strength", "file_count", "impact", "risk",
        "confidence", "priority", "priority_label",
    )


@register
def ranked_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).ranked.select(
        "repo", "id", "type", "title", "primary_path", "file_count", "impact", "risk", "confidence", "priority",
        "priority_label", "explanation", _joined("suggested_steps", "\n").alias("steps"),
        _joined("tests_to_add", "\n").alias("tests"),
    )


@register
def opportunity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).files_of


@register
def priority_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return ranking.summarize(result.ranked, result.files)


@register
def limited_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.limited(_scan(spark, sf_dir).ranked).select(
        "repo", "id", "title", "priority_label", "priority", "prompt_path"
    )


@register
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.task_rows(outputs.limited(_scan(spark, sf_dir).ranked, OutputSettings(min_priority="low")))


def stored_settings(listing: DataFrame) -> DataFrame:
    """Settings derived per repository; some of them are invalid on purpose."""
    number = F.substring("repo", 5, 9).cast("int")
    priority = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("none")), number % 4)
    limit = F.get(F.array(F.lit(-1.0), F.lit(5.0), F.lit(2.5), F.lit(30.0)), (number + F.floor(number / 4)).cast("int") % 4)
    return listing.select("repo").distinct().select("repo", limit.alias("limit"), priority.alias("min_priority"))


@register
def output_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = corpus.listing(spark, sf_dir)
    return stores.effective_settings(listing, stored_settings(listing), PARAMS.output)


@register
def stored_limit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    settings = stores.effective_settings(result.listing, stored_settings(result.listing), PARAMS.output)
    return outputs.task_rows(outputs.limited_by_stored(result.ranked, settings))


@register
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return outputs.report_rows(outputs.limited(result.ranked), result.members)


@register
def opportunity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return outputs.opportunity_signals(result.ranked, result.members).select(
        "repo", "id", "path", F.col("signal.type").alias("type"), F.col("signal.message").alias("message"),
        F.coalesce("signal.line", F.lit(0)).alias("line"),
    )


@register
def task_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return outputs.brief_lines(
        outputs.limited(result.ranked), result.files_of, result.members, result.files, result.workspaces, result.project
    )


@register
def compact_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    chosen = result.ranked.filter(F.col("id") <= outputs.ADVICE_ROWS)
    return outputs.payload_rows(chosen, result.files_of, result.members, result.files, result.project)


@register
def explain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    return outputs.explain_files(scan.analysed_files(prepared, PARAMS))


@register
def explain_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return outputs.explain_tests(result.files, result.files_of, result.ranked)


@register
def explain_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    return outputs.explain_opportunities(result.files_of, result.ranked)


def advice_table(ranked: DataFrame) -> DataFrame:
    """Answers derived from the ranking: fenced, plain, malformed, wrong types, empty."""
    name = F.concat(F.lit('"Why: '), F.col("title"), F.lit('"'))
    answer = (
        F.when(F.col("id") == 1, F.concat(F.lit("```json\n{\"explanation\": "), name, F.lit(', "testsToAdd": ["t1", "t2"]}\n```')))
        .when(F.col("id") == 2, F.concat(F.lit(' {"explanation": "", "recommendedRefactor": ["one", "two"], "agentPrompt": '), name, F.lit("} ")))
        .when(F.col("id") == 3, F.lit("{not json"))
        .when(F.col("id") == 4, F.lit('{"explanation": "short", "recommendedRefactor": "text", "riskNotes": ["r"]}'))
        .otherwise(F.concat(F.lit('{"explanation": '), name, F.lit("}")))
    )
    return ranked.select("repo", "id", answer.alias("json"))


@register
def advice_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _scan(spark, sf_dir).ranked
    return advice.overlay(ranked, advice_table(ranked)).select(
        "repo", "id", "explanation", _joined("suggested_steps", "\n").alias("steps"),
        _joined("tests_to_add", "\n").alias("tests"), F.coalesce(_joined("risk_notes", "\n"), F.lit("")).alias("risk_notes"),
        F.coalesce("agent_prompt", F.lit("")).alias("agent_prompt"),
    )


# --- projects -----------------------------------------------------------------------------------------


@register
def project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    kept = _analysed_names(prepared)
    files = kept.select("repo", "path")
    facts = project_sources.projects(prepared.names, files, prepared.manifests, prepared.workspaces)
    return facts.withColumn("languages", _joined("languages")).withColumn(
        "package_manager", F.coalesce("package_manager", F.lit(""))
    )


@register
def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.prepare(corpus.listing(spark, sf_dir)).workspaces
    return found.select("repo", "root_path", F.coalesce("name", F.lit("")).alias("name"), "framework")


@register
def merged_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = scan.prepare(corpus.listing(spark, sf_dir))
    return project_sources.dependency_table(prepared.manifests, prepared.workspaces)


@register
def check_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    params = Params(check_commands=(" make check ", ""))
    return project_sources.check_commands(
        result.files_of, result.files, result.project, result.manifests, result.workspaces, params
    ).select("repo", "id", "command", "spot.source", "spot.place", "spot.step")


# --- runs ----------------------------------------------------------------------------------------------


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repo, path`` of files that were edited or removed."""
    now = after.select("repo", "path", F.sha2("content", 256).alias("hash_after"))
    return (
        before.select("repo", "path", F.sha2("content", 256).alias("hash"))
        .join(now, ["repo", "path"], "left")
        .filter(F.col("hash_after").isNull() | (F.col("hash_after") != F.col("hash")))
        .select("repo", "path")
    )


def versioned_repos(listing: DataFrame) -> DataFrame:
    return listing.select("repo").distinct().filter(F.substring("repo", 5, 9).cast("int") % 3 != 0)


@register
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines written and read back: plain, quoted and renamed paths."""
    changed = changed_files(corpus.listing(spark, sf_dir), corpus.edited_listing(spark, sf_dir))
    path = F.col("path")
    line = (
        F.when(path.endswith(".py"), F.concat(F.lit(' M "'), path, F.lit('"')))
        .when(path.endswith(".java"), F.concat(F.lit("R  old.java -> "), path))
        .otherwise(F.concat(F.lit("?? "), F.replace(path, F.lit("/"), F.lit("\\"))))
    )
    read = changed.select("repo", line.alias("status_line")).select(
        "repo", runs.changed_path(F.col("status_line")).alias("path")
    )
    own_state = read.select("repo").distinct().withColumn("path", F.lit(f"{PARAMS.state_directory}/runs/x"))
    return runs.without_tool_state(read.unionByName(own_state), PARAMS)


@register
def run_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    changed = changed_files(result.listing, corpus.edited_listing(spark, sf_dir)).join(
        versioned_repos(result.listing), "repo", "left_semi"
    )
    params = Params(allow_dirty=False, max_files_per_task=3)
    path = F.col("primary_path")
    outside = F.when(F.col("id") % 5 == 0, F.concat(F.lit("../"), path)).when(F.col("id") % 5 == 1, F.concat(F.lit("x/../"), path))
    return runs.guard(result.ranked.withColumn("primary_path", F.coalesce(outside, path)), changed, params).select("repo", "id", F.coalesce("error", F.lit("")).alias("error"))


def _runs_of_all(ranked: DataFrame) -> DataFrame:
    run_id = F.concat("repo", F.lit("-"), F.col("id").cast("string"))
    return ranked.filter(F.col("file_count") <= PARAMS.max_files_per_task).select("repo", "id", run_id.alias("run_id"))


@register
def run_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of every opportunity that may be started."""
    result = _scan(spark, sf_dir)
    return runs.snapshot(result.files_of, result.files, _runs_of_all(result.ranked))


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, sf_dir)
    after = corpus.edited_listing(spark, sf_dir)
    targets = runs.snapshot(result.files_of, result.files, _runs_of_all(result.ranked))
    return runs.compare(targets, scan.selected_metrics(scan.prepare(after), PARAMS), after)


@register
def run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    comparisons = _comparisons(spark, sf_dir)
    missing = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    return comparisons.select(
        "repo", "run_id", "path", "exists_now", "changed", "line_count_before", missing("line_count_after"),
        missing("complexity_after"), missing("signal_count_after"), text.signed(F.col("line_delta")).alias("line_delta"),
        text.signed(F.col("complexity_delta")).alias("complexity_delta"), "materially_worse",
    )


def _open_runs(spark: SparkSession, sf_dir: str):
    """The open run of every repository (its best opportunity) with its targets, the changed files and the commands.

    Runs, targets and changed files are stored, because several steps read them.
    """
    result = _scan(spark, sf_dir)
    after = corpus.edited_listing(spark, sf_dir)
    targets = runs.snapshot(result.files_of, result.files, _runs_of_all(result.ranked))
    best = result.ranked.groupBy("repo").agg(F.min("id").alias("id")).select(
        "repo", F.concat("repo", F.lit("-"), F.col("id").cast("string")).alias("run_id")
    )
    targets = stores.materialize(targets.join(best, ["repo", "run_id"], "left_semi"), "targets")
    open_runs = stores.materialize(targets.select("repo", "run_id").distinct(), "open_runs")
    changed = stores.materialize(changed_files(result.listing, after).join(open_runs, "repo"), "changed")
    block = F.floor(F.col("doc_id") / (corpus.KINDS * corpus.BLOCKS_PER_REPO))
    commands = _table(spark, sf_dir, "labels").select(
        _repo(block).alias("repo"), F.concat(F.lit("check "), F.col("doc_id").cast("string")).alias("command"),
        F.col("toxic").alias("exit_code"),
    ).join(open_runs, "repo")
    return result, after, open_runs, targets, changed, commands


def _verdict_inputs(spark: SparkSession, sf_dir: str):
    """The open runs with all facts about them; the later state is measured once."""
    result, after, open_runs, targets, changed, commands = _open_runs(spark, sf_dir)
    current = scan.selected_metrics(scan.prepare(after), PARAMS)
    comparisons = stores.materialize(runs.compare(targets, current, after), "compared")
    return result, open_runs, targets, comparisons, changed, commands


@register
def run_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _, targets, comparisons, changed, _ = _verdict_inputs(spark, sf_dir)
    return runs.scope(changed, targets, comparisons, versioned_repos(result.listing), PARAMS)


@register
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, open_runs, targets, comparisons, changed, commands = _verdict_inputs(spark, sf_dir)
    versioned = versioned_repos(result.listing)
    in_scope = runs.scope(changed, targets, comparisons, versioned, PARAMS)
    failed = runs.failures(comparisons, commands)
    warned = runs.warnings(open_runs, comparisons, in_scope, commands, versioned)
    return runs.verdicts(open_runs, failed, warned)


def _checked_store(spark: SparkSession, sf_dir: str) -> str:
    """A store in which the best task of every repository was begun and checked."""
    store = f"{stores.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    result, after, open_runs, _, changed, commands = _open_runs(spark, sf_dir)
    best = open_runs.withColumn("id", F.substring_index("run_id", "-", -1).cast("long"))
    none = changed.select("repo", "path").filter(F.lit(False))
    started, targets, _ = runs.begin(result.ranked, result.files_of, result.files, best, none, PARAMS)
    started, targets = stores.materialize(started, "started"), stores.materialize(targets, "targets")
    stores.append_runs(started, store)
    current = scan.selected_metrics(scan.prepare(after), PARAMS)
    comparisons, verdict = runs.check(
        started, targets, current, after, changed.select("repo", "path"), commands.drop("run_id"),
        versioned_repos(result.listing), PARAMS,
    )
    verdict = stores.materialize(verdict, "verdicts")
    open_now = stores.current_runs(stores.read_runs(spark, store))
    stores.store_check(comparisons, verdict, runs.checked_version(open_now, verdict), store)
    return store


@register
def check_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored check leaves: the run's newest version and its comparisons."""
    store = _checked_store(spark, sf_dir)
    compared = stores.read_table(spark, store, "comparisons").groupBy("repo", "run_id").agg(F.count("*").alias("comparison_count"))
    checks = stores.read_table(spark, store, "checks").select("repo", "run_id", "failure_count", "warning_count")
    current = stores.current_runs(stores.read_runs(spark, store)).select("repo", "run_id", "status", "last_verdict")
    return current.join(compared, ["repo", "run_id"]).join(checks, ["repo", "run_id"])


@register
def run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked runs, completed: status and summary of the newest version."""
    store = _checked_store(spark, sf_dir)
    stores.append_runs(stores.completion_row(stores.current_runs(stores.read_runs(spark, store))), store)
    return stores.current_runs(stores.read_runs(spark, store)).select("repo", "run_id", "status", "completion_summary")


@register
def target_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the files of tasks that may be started, as hashes."""
    result = _scan(spark, sf_dir)
    targets = runs.snapshot(result.files_of, result.files, _runs_of_all(result.ranked))
    return runs.snapshot_contents(targets, result.listing).select("repo", "path", F.sha2("content", 256).alias("content_hash"))


@register
def task_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task of each repository, named by its id as text; names that are no id find nothing."""
    result = _scan(spark, sf_dir)
    repos = result.ranked.select("repo").distinct()
    ref = F.concat(F.lit(" "), (F.substring("repo", 5, 9).cast("int") % 3 + 1).cast("string"))
    wanted = repos.select("repo", ref.alias("ref")).unionByName(repos.select("repo", F.lit("none").alias("ref")))
    return outputs.find_tasks(result.ranked, wanted).select("repo", "id", "title", "primary_path")


@register
def settings_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written with a scan and read back."""
    store = f"{stores.shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    files = sources.select_sources(corpus.listing(spark, sf_dir), PARAMS)
    stores.write_settings(stores.settings_table(files, OutputSettings(7, "high")), store, "s1")
    stored = stores.read_scan(spark, store, "settings")
    return stores.effective_settings(files, stored, OutputSettings())


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run versions derived from events: one run per user, one version per event."""
    status = {"click": "started", "signup": "started", "view": "checked", "error": "checked", "purchase": "completed"}
    versions = _table(spark, sf_dir, "events").select(
        _repo(F.col("user_id") % USER_REPOS).alias("repo"),
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        text.lookup(status, F.col("event_type")).alias("status"),
        F.col("ts").alias("updated_at"),
    )
    created = versions.groupBy("repo", "run_id").agg(F.min("updated_at").alias("created_at"))
    return versions.join(created, ["repo", "run_id"])


@register
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.current_runs(run_log(spark, sf_dir)).select("repo", "run_id", "status", "updated_at")


@register
def latest_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    return stores.latest_run(log).join(stores.current_runs(log), ["repo", "run_id"]).select("repo", "run_id", "status")


@register
def next_unstarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best task without a run, when every user of the event log has started one task."""
    result = _scan(spark, sf_dir)
    keys = runs.opportunity_keys(result.ranked, result.files_of)
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    tasks = result.ranked.groupBy("repo").agg(F.max("id").alias("tasks"))
    repos = result.ranked.agg(F.max(F.substring("repo", 5, 9).cast("long")) + 1).first()[0] or 1
    started = (
        users.select(_repo(F.col("user_id") % repos).alias("repo"), F.floor(F.col("user_id") / repos).alias("turn"))
        .join(tasks, "repo")
        .select("repo", (F.col("turn") % F.col("tasks") + 1).alias("id"))
        .join(keys, ["repo", "id"])
    )
    return runs.next_unstarted(result.ranked, keys, started)


@register
def scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a scan, its briefs and its settings, and read them back."""
    store = f"{stores.shared_folder(spark)}/store-{spark.sparkContext.applicationId}-{sf_dir.strip('/').replace('/', '-')}"
    result = _scan(spark, sf_dir)
    scan.write_outputs(result, store, "s1")
    files = stores.read_scan(spark, store, "files")
    opportunities = stores.read_scan(spark, store, "opportunities")
    briefs = stores.read_briefs(spark, store)
    counted = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    return (
        counted(files, "file_rows")
        .join(counted(opportunities, "opportunity_rows"), "repo", "left")
        .join(counted(briefs.select("repo", "id").distinct(), "brief_count"), "repo", "left")
        .na.fill(0)
    )


@register
def brief_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All briefs of a scan written, then those of the best tasks once more: nothing is lost, and the newest version is read."""
    store = f"{stores.shared_folder(spark)}/briefs-{uuid.uuid4().hex}"
    result = _scan(spark, sf_dir)
    chosen = outputs.limited(result.ranked)
    lines = outputs.brief_lines(chosen, result.files_of, result.members, result.files, result.workspaces, result.project)
    stores.write_brief_lines(lines, store, "s1")
    best = chosen.groupBy("repo").agg(F.min("id").cast("string").alias("ref"))
    scan.write_task_brief(result, best, store, "s1")
    versions = stores.read_scan(spark, store, "briefs").groupBy("repo").agg(F.countDistinct("id", "batch").alias("version_count"))
    counts = stores.read_briefs(spark, store).groupBy("repo").agg(F.countDistinct("id").alias("brief_count"), F.count("*").alias("line_count"))
    return counts.join(versions, "repo")


@register
def begin_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the start of the best task of every repository stores: targets, brief and check commands."""
    store = f"{stores.shared_folder(spark)}/begun-{uuid.uuid4().hex}"
    result = dataclasses.replace(_scan(spark, sf_dir), params=Params(check_commands=(" make check ", "")))
    best = outputs.limited(result.ranked).groupBy("repo").agg(F.min("id").alias("id"))
    chosen = best.select("repo", "id", F.concat("repo", F.lit("-"), F.col("id").cast("string")).alias("run_id"))
    none = result.listing.select("repo", "path").filter(F.lit(False))
    scan.begin_runs(result, chosen, none, store)
    counted = stores.read_runs(spark, store).select("repo", "run_id", "status")
    for name, count in (("targets", "target_count"), ("run_briefs", "line_count"), ("run_commands", "command_count")):
        counts = stores.read_table(spark, store, name).groupBy("repo", "run_id").agg(F.count("*").alias(count))
        counted = counted.join(counts, ["repo", "run_id"], "left")
    return counted.na.fill(0)
