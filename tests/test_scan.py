from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from codestrata.operators import advice, analysis, duplicates, outputs, ranking, relations, rules, runs
from codestrata.params import OutputSettings, Params, Thresholds
from codestrata.plans import registry, scan
from codestrata.sources import files as sources
from codestrata.sources import stores

SHIPPING = """
def shipping_fee(weight, zone):
    fee = 4
    if zone == "island":
        fee += 6
    if weight > 20:
        fee += 3
    while weight > 100:
        weight -= 50
    return fee
"""
STATES = "".join(f"  const [s{n}, setS{n}] = useState({n});\n" for n in range(8))
VIEW = """
import React, { useEffect, useState } from 'react';

// fetch() in a comment is no call
export function OrderBoard({ shop, token }) {
  const [rows, setRows] = useState([]);
""" + STATES + """
  useEffect(() => {
    async function pull() {
      const reply = await fetch('/orders');
      setRows(await reply.json());
    }
    pull();
  }, [shop]);

  function badge(order, rights, clock, other, prefs, trail) {
    if (!order) return other;
    for (const step of trail) {
      if (step.late) {
        if (prefs.strict) return 'late';
      }
    }
    return 'open';
  }

  // TODO: smaller parts
  return (
    <main style={{ margin: 4 }}>
      {rows.map((row) => (
        <Card key={row.id} label={badge(row)} />
      ))}
    </main>
  );
}
"""
QUIET_VIEW = """
import { Platform, Text } from 'react-native';

// axios.get() is mentioned only
const os = Platform.get('os');

export function Plain() {
  return <Text>{os}</Text>;
}
"""
SERVICE_VIEW = """
import { loadAll } from '../services/items';

export function List() {
  const rows = loadAll();
  return <ul>{rows}</ul>;
}
"""
BLOB = """
import { Text } from 'react-native';

export default function {name}() {
  async function clip(path: string) {
    const request = new XMLHttpRequest();
    request.open('GET', path);
    request.responseType = 'blob';
    const done = new Promise((ready) => {
      request.onload = ready;
    });
    request.send();
    await done;
    return request.response;
  }
  return <Text>x</Text>;
}
"""
ROOT = '{"workspaces": ["apps/*", "packages/*"], "scripts": {"typecheck": "tsc", "test": "vitest"}, "devDependencies": {"vitest": "^3"}}'
APP = '{"name": "@shop/mobile", "dependencies": {"expo": "^54", "react": "^19"}, "scripts": {"typecheck": "tsc", "lint": "eslint ."}}'
MONOREPO = {
    "package.json": ROOT,
    "pnpm-lock.yaml": "x",
    "apps/mobile/package.json": APP,
    "packages/broken/package.json": "{",
    "apps/mobile/src/One.tsx": BLOB.replace("{name}", "One"),
    "apps/mobile/app/(tabs)/Two.tsx": BLOB.replace("{name}", "Two"),
    "apps/mobile/src/components/OrderBoard.tsx": VIEW,
    "apps/mobile/src/components/Plain.tsx": QUIET_VIEW,
    "apps/mobile/src/components/List.tsx": SERVICE_VIEW,
    "apps/mobile/src/services/items.ts": "export function loadAll() { return []; }\n",
}
LOW = Params(output=OutputSettings(min_priority="low"))


@pytest.fixture(scope="module")
def monorepo(listing):
    return scan.scan(listing(MONOREPO), LOW)


def test_selection(listing):
    names = [
        "src/a.py", "src/b.test.ts", ".hidden/a.py", "node_modules/x/a.js", "x/dist/a.js", "types/a.d.ts", "a.min.js",
        "README.md", "gen/a.py", "gen/keep.py", "logs/deep/a.py", "src/logs/b.py",
    ]
    rules_text = "# comment\ngen/*\n!gen/keep.py\n/logs/\n"
    df = listing({**{n: "x" for n in names}, ".gitignore": rules_text})
    kept = {r["path"] for r in sources.select_sources(df).collect()}
    assert kept == {"src/a.py", "src/b.test.ts", "gen/keep.py", "src/logs/b.py"}
    scoped = sources.select_sources(df, Params(base_path="src/")).collect()
    assert {r["path"] for r in scoped} == {"src/a.py", "src/b.test.ts", "src/logs/b.py"}


def test_exclude_entries(spark):
    entries = ["vendor", "src/*.js", "**/*.gen.ts", "lib/**", "{a,b}/x?.py", "docs/"]
    hidden = ["vendor/a.py", "p/vendor/a.py", "src/x.js", "k.gen.ts", "a/b/k.gen.ts", "lib/deep/a.py", "a/x1.py", "b/x2.py", "docs/a.py"]
    seen = ["packages/a/src/x.js", "src/deep/x.js", "vendors/a.py", "p/lib/a.py", "c/x1.py", "a/x12.py", "k.gen.tsx"]
    paths = spark.createDataFrame([(p,) for p in hidden + seen], "path string")
    assert {r[0] for r in paths.filter(F.col("path").rlike(sources.exclude_pattern(entries))).collect()} == set(hidden)
    assert paths.filter(F.col("path").rlike(sources.exclude_pattern([]))).count() == 0


def test_ignored_files_leave_the_metrics(listing):
    df = listing({"src/a.py": SHIPPING, "src/b.py": SHIPPING, ".gitignore": "b.py\n"})
    metrics = scan.selected_metrics(scan.prepare(df), LOW)
    assert [r["path"] for r in metrics.collect()] == ["src/a.py"]


def test_contents_are_not_shuffled(spark):
    """Without broadcasts, no exchange of the listed queries carries contents or texts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("marker_counts", "path_and_name_text", "python_functions", "java_functions", "js_functions", "js_api_calls"):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
            todo = [plan.inputPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
            while todo:
                node = todo.pop()
                kids = node.children()
                todo += [kids.apply(k) for k in range(kids.size())]
                if "Exchange" in node.nodeName():
                    output = node.output()
                    names = {output.apply(k).name() for k in range(output.size())}
                    assert not names & {"content", "text", "lines", "clean"}, (name, names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("place,root", [
    ("hdfs://nn:8020/data/repos", "hdfs://nn:8020/data/repos/"), ("s3a://bucket/data", "s3a://bucket/data"),
    ("file:/data/repos", "file:///data/repos"), ("/data/repos", "/data/repos"),
])
def test_tree_below_a_file_system_root(spark, place, root):
    listed = spark.createDataFrame([(f"{place}/a/src/x.py", bytearray(b"x"))], "path string, content binary")
    assert sources.tree_rows(listed, root).first().asDict() == {"repo": "a", "path": "src/x.py", "content": "x"}
    outside = spark.createDataFrame([("hdfs://nn:8020/other/x.py", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(Exception, match="is not below"):
        sources.tree_rows(outside, root).collect()


def test_intermediate_tables_stay_in_shared_folders(spark):
    assert stores.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert stores.shared_folder(spark, "/given/") == "/given"
    settings = {"spark.sql.warehouse.dir": "hdfs://nn/warehouse/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, *default: settings[name] if name in settings else default[0]))
    assert stores.shared_folder(session) == "hdfs://nn/warehouse/_intermediate"
    assert settings == {"spark.sql.warehouse.dir": "hdfs://nn/warehouse/"}


def test_read_tree(spark, tmp_path):
    for repo in ("one", "two"):
        (tmp_path / repo / "src").mkdir(parents=True)
        (tmp_path / repo / "src" / "a.py").write_text(f"# {repo}\n")
    rows = {(r["repo"], r["path"], r["content"]) for r in sources.read_tree(spark, str(tmp_path)).collect()}
    assert rows == {("one", "src/a.py", "# one\n"), ("two", "src/a.py", "# two\n")}


def test_component_metrics(monorepo):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in monorepo.files.collect()}
    view = rows["OrderBoard.tsx"]
    kinds = {s["type"] for s in view["signals"]}
    assert {"too-many-hooks", "api-calls-in-ui", "inline-styles", "todo-comments", "complex-function"} <= kinds
    assert (view["hook_count"], view["component_count"], view["import_count"]) == (10, 1, 1)
    assert [c["kind"] for c in view["api_calls"]] == ["network-call"]
    status = next(f for f in view["functions"] if f["name"] == "badge")
    assert (status["parameter_count"], status["max_depth"], status["complexity"]) == (6, 3, 5)
    assert next(f for f in view["functions"] if f["name"] == "pull")["is_async"]
    quiet = rows["Plain.tsx"]
    assert "data-fetching" not in quiet["responsibilities"] and not quiet["signals"]
    assert rows["items.ts"]["dependent_count"] == 1
    assert view["workspace"] == "apps/mobile"


def test_monorepo_project_and_titles(monorepo):
    project = monorepo.project.first()
    assert (project["package_manager"], project["framework"], project["test_framework"]) == ("pnpm", "expo", "vitest")
    spaces = {r["root_path"]: r["framework"] for r in monorepo.workspaces.collect()}
    assert spaces == {"apps/mobile": "expo", "packages/broken": "unknown"}
    rows = monorepo.ranked.orderBy("id").collect()
    titles = [r["title"] for r in rows]
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    assert "Extract Shared Local File Blob Reader" in titles
    assert "Move Data Loading Out Of List" in titles and "Move API Calls Out Of OrderBoard" in titles
    assert titles.index("Extract Hook From OrderBoard") < titles.index("Extract Shared Local File Blob Reader")
    assert all(1 <= r[c] <= 10 for r in rows for c in ("impact", "risk", "confidence"))
    high = sum(r["priority_label"] == "High" for r in rows)
    assert high < 0.8 * len(rows)


def test_brief_of_duplicate(monorepo):
    chosen = outputs.limited(monorepo.ranked, LOW.output)
    lines = outputs.brief_lines(
        chosen, monorepo.files_of, monorepo.members, monorepo.files, monorepo.workspaces, monorepo.project
    )
    blob = chosen.filter(F.col("title").contains("Blob Reader")).agg(F.min("id")).first()[0]
    ordered = lines.filter(F.col("id") == blob).orderBy("section", "item").collect()
    body = "\n".join(r["line"] for r in ordered)
    assert "apps/mobile/src/lib/readLocalFileAsBlob.ts" in body
    assert "typescript, workspace/framework: @shop/mobile (expo)" in body
    assert "apps/mobile/src/One.test.tsx" in body and "XMLHttpRequest" not in body
    assert len(" ".join(body.split())) / 4 <= 1500


def test_python_duplicates(listing):
    result = scan.scan(listing({"src/parcels/quotes.py": SHIPPING, "src/parcels/returns.py": SHIPPING}), LOW)
    row = result.ranked.filter("is_duplicate").first()
    assert (row["title"], row["impact"], row["risk"], row["confidence"], row["priority"], row["priority_label"]) == (
        "Deduplicate shipping_fee Logic", 4, 3, 5, 17, "Low",
    )
    assert row["helper_path"] == "src/parcels/extract_shipping_fee_helper.py"
    assert row["file_count"] == 2


def test_groups_are_limited_before_anonymous_ones_are_dropped(listing):
    body = "\n".join(f"    v = {i}" for i in range(8))
    many = {f"a{n}.py": "".join(f"def f{i:02d}():\n    q = {i}\n{body}\n\n" for i in range(12)) for n in range(2)}
    prepared = scan.prepare(listing(many))
    groups = duplicates.duplicate_groups(scan.analysed_files(prepared)).orderBy("group_ord").collect()
    assert [g["display_name"] for g in groups] == [f"f{i:02d}" for i in range(10)]


def test_ids_follow_the_order_over_partitions(monorepo, spark):
    drafts = rules.score(rules.all_drafts(monorepo.files, LOW))
    columns = [*ranking.KEY, "priority", "impact"]
    rows = [r.asDict() for r in drafts.select(*columns).collect()]
    rows.sort(key=lambda r: (-r["priority"], -r["impact"], r["is_duplicate"], r["primary_path"], r["rule_ord"], r["fn_ord"]))
    expected = {(r["primary_path"], r["rule_ord"], r["fn_ord"], k) for k, r in enumerate(rows, 1)}
    ranked = ranking.rank(drafts)
    assert {tuple(r) for r in ranked.select("primary_path", "rule_ord", "fn_ord", "id").collect()} == expected
    assert len(rows) > 5 and ranked.count() == len(rows)


def test_a_task_started_under_a_larger_limit_is_not_offered_again(monorepo):
    keys = runs.opportunity_keys(monorepo.ranked, monorepo.files_of)
    assert keys.count() == monorepo.ranked.count()
    largest = monorepo.ranked.orderBy(F.col("file_count").desc()).first()
    started = keys.filter(F.col("id") == largest["id"])
    open_ = monorepo.ranked.filter(F.col("id") >= largest["id"])
    assert largest["id"] not in {r["id"] for r in runs.next_unstarted(open_, keys, started).collect()}


def test_score_of_a_large_component(spark):
    columns = {
        "type": "split-large-component", "file_count": 1, "strength": 3, "max_line_count": 600, "max_complexity": 90,
        "max_dependents": 3, "max_signals": 7, "missing_tests": True, "sensitive": True,
    }
    row = rules.score(spark.createDataFrame([tuple(columns.values())], list(columns))).first()
    assert (row["impact"], row["risk"], row["confidence"], row["priority"]) == (10, 9, 10, 91)
    labels = spark.createDataFrame([(75,), (74,), (40,), (39,)], "p int").select(rules.priority_label(F.col("p")))
    assert [r[0] for r in labels.collect()] == ["High", "Medium", "Medium", "Low"]


def test_limits_and_settings(monorepo, spark):
    assert outputs.limited(monorepo.ranked, OutputSettings(limit=0, min_priority="low")).count() == 0
    assert outputs.limited(monorepo.ranked, OutputSettings(limit=1, min_priority="low")).first()["prompt_path"].startswith("prompts/01_")
    stored = spark.createDataFrame([("repo", 1.0, "low")], "repo string, limit double, min_priority string")
    settings = stores.effective_settings(monorepo.files, stored, OutputSettings())
    assert outputs.task_rows(outputs.limited_by_stored(monorepo.ranked, settings)).count() == 1
    with pytest.raises(ValueError):
        OutputSettings(limit=-1)


def test_thresholds_change_the_result(listing):
    strict = replace(LOW, thresholds=Thresholds(complex_function_complexity=4))
    df = listing({"src/a.py": SHIPPING})
    count = lambda p: scan.scan(df, p).ranked.filter("type = 'simplify-complex-function'").count()
    assert (count(LOW), count(strict)) == (0, 1)


def test_nearby_tests_and_imports(listing):
    df = listing({
        "a/x.py": "", "a/test_x.py": "", "b/Y.java": "", "b/YTest.java": "", "c/z.ts": "import './w'\nimport './w';\nimport '../a'",
        "c/__tests__/z.spec.tsx": "", "c/w/index.ts": "", "d/q.js": "import '../../x'",
    })
    metrics = analysis.file_metrics(df)
    tested = {r["path"]: r["has_tests_nearby"] for r in relations.nearby_tests(metrics, df).collect()}
    assert [tested[p] for p in ("a/x.py", "b/Y.java", "c/z.ts", "c/w/index.ts", "d/q.js")] == [True, True, True, False, False]
    assert {(r["path"], r["dependent_count"]) for r in relations.dependents(metrics, metrics).collect()} == {("c/w/index.ts", 2)}


def test_run_workflow(monorepo, spark, listing):
    ranked, files_of, files = monorepo.ranked, monorepo.files_of, monorepo.files
    keys = runs.opportunity_keys(ranked, files_of)
    no_changes = spark.createDataFrame([], "repo string, path string")
    empty = spark.createDataFrame([], "repo string, opportunity_key string")
    best = runs.next_unstarted(ranked, keys, empty).first()
    assert best["id"] == 1
    todo = ranked.filter("type = 'remove-dead-code'").select("repo", "id", F.lit("r1").alias("run_id"))
    started, targets, rejected = runs.begin(ranked, files_of, files, todo, no_changes)
    assert rejected.count() == 0 and started.first()["status"] == "started"
    assert todo.first()["id"] not in {r["id"] for r in runs.next_unstarted(ranked, keys, started).collect()}

    edited = {**MONOREPO, "apps/mobile/src/components/OrderBoard.tsx": VIEW.replace("// TODO: smaller parts", "")}
    after = listing(edited)
    comparison = runs.compare(targets, analysis.file_metrics(after), after)
    row = comparison.first()
    assert row["changed"] and row["exists_now"] and row["signal_delta"] == -1 and not row["materially_worse"]
    commands = spark.createDataFrame([], "repo string, run_id string, command string, exit_code int")
    repos = started.select("repo")
    in_scope = runs.scope(no_changes.withColumn("run_id", F.lit("r1")), targets, comparison, repos)
    warned = runs.warnings(started, comparison, in_scope, commands, repos)
    verdict = runs.verdicts(started, runs.failures(comparison, commands), warned).first()
    assert (verdict["recommendation"], verdict["warning_count"]) == ("warn", 1)  # no commands were run
    gone = runs.compare(targets, analysis.file_metrics(after), after.filter("path = ''")).first()
    assert gone["changed"] and not gone["exists_now"] and gone["line_delta"] is None


def test_materially_worse(spark):
    rows = [(100, 20, 0), (100, 21, 0), (300, 30, 0), (300, 31, 0), (100, 0, 2), (100, 0, 3)]
    df = spark.createDataFrame(rows, "b int, l int, c int")
    worse = [r[0] for r in df.select(runs.materially_worse(F.col("b"), F.col("l"), F.col("c"))).collect()]
    assert worse == [False, True, False, True, False, True]


def test_guards(monorepo, spark):
    dirty = spark.createDataFrame([("repo", "x")], "repo string, path string")
    errors = runs.guard(monorepo.ranked, dirty, Params(allow_dirty=False, max_files_per_task=1)).collect()
    assert all(r["error"] for r in errors) and any("exceeds the limit of 1" in r["error"] for r in errors)
    state = spark.createDataFrame([("repo", ".codestrata/x"), ("repo", "a")], "repo string, path string")
    assert [r["path"] for r in runs.without_tool_state(state).collect()] == ["a"]


def test_advice(spark):
    rows = [("```json\n{\"explanation\": \"e\", \"testsToAdd\": [\"t\"]}\n```",), ("{bad",), ('{"riskNotes": "no list"}',)]
    parsed = [r[0] for r in spark.createDataFrame(rows, "j string").select(advice.parse_advice(F.col("j"))).collect()]
    assert (parsed[0]["explanation"], parsed[0]["tests_to_add"], parsed[0]["risk_notes"]) == ("e", ["t"], [])
    assert parsed[1] is None and parsed[2]["risk_notes"] == []


def test_payload_has_no_source_text(monorepo):
    top = monorepo.ranked.filter("id <= 5")
    rows = outputs.payload_rows(top, monorepo.files_of, monorepo.members, monorepo.files, monorepo.project).collect()
    assert {r["part"] for r in rows} == {"project", "opportunity", "signal", "file"}
    assert not any("setRows" in r["json"] for r in rows)


def test_store_roundtrip_and_run_log(monorepo, spark, tmp_path):
    store = str(tmp_path)
    scan.write_outputs(monorepo, store, "s1")
    scan.write_outputs(monorepo, store, "s2")
    assert stores.read_scan(spark, store, "opportunities").count() == monorepo.ranked.count()
    briefs = stores.read_briefs(spark, store).select("repo", "id").distinct().count()
    assert briefs == outputs.limited(monorepo.ranked, LOW.output).count()
    log = [("repo", "r1", "k", "started", 1), ("repo", "r1", "k", "checked", 2), ("repo", "r2", "k", "started", 1)]
    versions = spark.createDataFrame(log, "repo string, run_id string, opportunity_key string, status string, t int").select(
        "repo", "run_id", "opportunity_key", "status", F.lit(0).cast("timestamp").alias("created_at"),
        F.timestamp_seconds("t").alias("updated_at"), F.lit(None).cast("string").alias("last_verdict"),
        F.lit(None).cast("string").alias("completion_summary"),
    )
    stores.append_runs(versions, store)
    log_rows = stores.read_runs(spark, store)
    assert stores.latest_run(log_rows).first()["run_id"] == "r1"
    done = stores.completion_row(stores.current_runs(log_rows).filter("run_id = 'r1'"))
    stores.append_runs(done, store)
    final = stores.current_runs(stores.read_runs(spark, store)).filter("run_id = 'r1'").first()
    assert (final["status"], final["completion_summary"]) == ("completed", "Completed without a recorded check result.")


def test_writing_one_brief_keeps_the_others(monorepo, spark, tmp_path):
    store = str(tmp_path)
    scan.write_outputs(monorepo, store, "s1")
    before = sorted(map(tuple, stores.read_briefs(spark, store).collect()))
    wanted = spark.createDataFrame([("repo", "1"), ("repo", "none")], "repo string, ref string")
    changed = replace(monorepo, ranked=monorepo.ranked.withColumn("title", F.concat("title", F.lit(" (new)"))))
    assert scan.write_task_brief(changed, wanted, store, "s1").count() == 1
    after = sorted(map(tuple, stores.read_briefs(spark, store).collect()))
    other = lambda rows: [r for r in rows if r[1] != 1]
    assert other(after) == other(before) and len(other(after)) > 0
    assert after != before and any("(new)" in str(r) for r in after)
    scan.write_outputs(monorepo, store, "s1")
    assert sorted(map(tuple, stores.read_briefs(spark, store).collect())) == before


@pytest.mark.parametrize("broken", ["checks", "runs", "commits"])
def test_a_check_that_breaks_off_does_not_count(spark, tmp_path, monkeypatch, broken):
    store = str(tmp_path)
    names = "repo string, run_id string, opportunity_key string, status string"
    run = lambda status, at: spark.createDataFrame([("r", "1", "k", status)], names).select(
        "*", F.lit(0).cast("timestamp").alias("created_at"), F.timestamp_seconds(F.lit(at)).alias("updated_at"),
        F.lit("ok").alias("last_verdict"), F.lit(None).cast("string").alias("completion_summary"),
    )
    stores.append_runs(run("started", 1), store)
    comparisons = spark.createDataFrame([("r", "1", f"f{k}") for k in range(3)], "repo string, run_id string, path string")
    verdict = spark.createDataFrame([("r", "1", 0, 1)], "repo string, run_id string, failure_count int, warning_count int")
    written = DataFrameWriter.parquet

    def failing(self, path, *arguments, **named):
        if path.endswith(f"/{broken}"):
            raise OSError("lost")
        return written(self, path, *arguments, **named)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(OSError, match="lost"):
            stores.store_check(comparisons, verdict, run("checked", 2), store)
    assert stores.read_table(spark, store, "comparisons").count() == 0
    assert [r["status"] for r in stores.current_runs(stores.read_runs(spark, store)).collect()] == ["started"]
    stores.store_check(comparisons, verdict, run("checked", 2), store)
    assert stores.read_table(spark, store, "comparisons").count() == 3
    assert stores.read_table(spark, store, "checks").count() == 1
    assert [r["status"] for r in stores.current_runs(stores.read_runs(spark, store)).collect()] == ["checked"]


def test_only_contents_of_targets_are_shuffled(spark):
    listing = spark.range(3000).select(F.concat(F.lit("r"), F.col("id") % 7).alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("content"))
    targets = listing.filter("path like '%5'").select("repo", "path", F.lit("run").alias("run_id"))
    assert sorted(map(tuple, runs.possible_targets(targets, listing, bits=24).collect())) == sorted(map(tuple, listing.filter("path like '%5'").collect()))
    assert runs.possible_targets(targets, listing, bits=4).count() > 300  # a small bitmap lets others pass, and loses none
    assert runs.snapshot_contents(targets, listing).count() == 300
    assert runs.snapshot_contents(targets.limit(0), listing).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = runs.snapshot_contents(targets, listing)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before_exchange = plan[plan.index("Exchange hashpartitioning(repo") :]
    assert "bitmap" in before_exchange and "BroadcastHashJoin" in before_exchange


def test_every_path_of_a_task_is_guarded(spark):
    ranked = spark.createDataFrame([("r", 1, 2, "a.py"), ("r", 2, 1, "a.py"), ("r", 3, 1, "../a.py")], "repo string, id long, file_count int, primary_path string")
    files_of = spark.createDataFrame([("r", 1, "a.py"), ("r", 1, "x/../../b.py"), ("r", 2, "y/../a.py"), ("r", 3, "../a.py")], "repo string, id long, path string")
    none = spark.createDataFrame([], "repo string, path string")
    found = {r["id"]: r["error"] is None for r in runs.guard(ranked, none, Params(), files_of).collect()}
    assert found == {1: False, 2: True, 3: False}
    assert {r["id"]: r["error"] is None for r in runs.guard(ranked, none).collect()} == {1: True, 2: True, 3: False}
