"""Oracle texts of the registered queries: relations, rules, outputs, runs."""

from __future__ import annotations

from .. import fixed
from . import corpus
from .oracle import BLOCKS, MARKERS, complex_condition, count, q, sql, swap, text_of

FOLDER = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
PREFIX = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') || '/' ELSE '' END"
BASE = "split_part({0}, '/', -1)"
STEM = "regexp_replace(split_part({0}, '/', -1), '^(.+)\\.[^.]*$', '\\1')"
PASCAL = (
    "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9]+'), lambda x: x <> ''), "
    "lambda x: upper(x[1]) || x[2:]), '')"
)


def snake(column: str) -> str:
    runs = swap(swap(column, "([a-z0-9])([A-Z])", r"\1_\2"), "[^a-zA-Z0-9]+", "_")
    return f"lower({swap(runs, '^_+|_+$', '')})"


def slug(column: str) -> str:
    return f"substr({swap(swap(f'lower({column})', '[^a-z0-9]+', '_'), '^_+|_+$', '')}, 1, 80)"


def brief_name(number: str, title: str) -> str:
    return (
        f"CASE WHEN length(CAST({number} AS VARCHAR)) < 2 THEN '0' || {number} ELSE CAST({number} AS VARCHAR) END "
        f"|| '_' || {slug(title)} || '.md'"
    )


# --- relations ----------------------------------------------------------------------------

_folder, _stem = PREFIX.format("path"), STEM.format("path")
_candidates = ", ".join(
    f"{_folder} || {shape}"
    for e in fixed.SOURCE_EXTENSIONS
    for shape in (
        f"{_stem} || '.test.{e}'", f"{_stem} || '.spec.{e}'", f"'__tests__/' || {_stem} || '.test.{e}'",
        f"'__tests__/' || {_stem} || '.spec.{e}'", f"'test_' || {_stem} || '.{e}'", f"{_stem} || 'Test.{e}'",
    )
)
BLOCKS["covered"] = f"""
  SELECT repo, path, is_test OR any_hit AS has_tests_nearby FROM (
    SELECT s.repo, s.path, any_value(s.is_test) AS is_test, bool_or(c.path IS NOT NULL) AS any_hit
    FROM (SELECT repo, path, is_test, unnest([{_candidates}]) AS candidate FROM sources) s
    LEFT JOIN corpus c ON c.repo = s.repo AND c.path = s.candidate GROUP BY s.repo, s.path)"""
_segments = f"string_split({_folder} || source, '/')"
BLOCKS["relative_imports"] = f"""
  SELECT repo, path, place, ltrim(base, '/') AS base FROM (
    SELECT repo, path, place, list_reduce(list_concat([''], {_segments}), lambda acc, x:
      CASE WHEN acc = '!' OR (x = '..' AND acc = '') THEN '!' WHEN x IN ('', '.') THEN acc
           WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END) AS base
    FROM imports WHERE starts_with(source, '.')) WHERE base <> '!'"""
BLOCKS["edges"] = """
  SELECT repo, path, place, base, min_by(target, rank) AS target FROM (
    SELECT i.*, s.path AS target, c.rank FROM (
      SELECT *, unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS suffix,
             unnest(range(0, 9)) AS rank FROM relative_imports) i, LATERAL (SELECT i.rank AS rank) c
    JOIN sources s ON s.repo = i.repo AND s.path = ltrim(i.base || i.suffix, '/'))
  GROUP BY repo, path, place, base"""
BLOCKS["dependent_counts"] = "SELECT repo, target AS path, count(*) AS dependent_count FROM edges GROUP BY ALL"

_keys = "list_concat(coalesce(json_keys(content, '$.dependencies'), []), coalesce(json_keys(content, '$.devDependencies'), []))"
BLOCKS["manifests"] = f"""
  SELECT repo, path, {FOLDER.format('path')} AS root_path, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS content
  FROM corpus WHERE path = 'package.json' OR path LIKE '%/package.json'"""
BLOCKS["globs"] = """
  SELECT repo, starts_with(g, '!') AS barred, '^' || replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(g, '^!', ''), '^[.]/', ''), '/$', '') || '/package.json', '**/', '~'), '*', '[^/]*'), '~', '(?:.+/)?') || '$' AS pattern
  FROM (SELECT repo, CASE WHEN item IS NULL THEN g ELSE regexp_replace(g, '\\{[^{}]*\\}', item) END AS g
    FROM (SELECT repo, g, unnest(CASE WHEN regexp_matches(g, '\\{[^{}]*,[^{}]*\\}') THEN string_split(regexp_extract(g, '\\{([^{}]*)\\}', 1), ',') ELSE [NULL] END) AS item
      FROM (SELECT repo, unnest(CAST(coalesce(json_extract(content, '$.workspaces.packages'), json_extract(content, '$.workspaces')) AS VARCHAR[])) AS g
        FROM manifests WHERE path = 'package.json')))"""


def framework(names: str, app_file: str) -> str:
    has = lambda items: f"list_has_any({names}, [{', '.join(q(i) for i in items)}])"
    (first, label), *rest = fixed.FRAMEWORK_DEPENDENCIES
    return (
        f"CASE WHEN {has(first)} OR {app_file} THEN {q(label)} "
        + " ".join(f"WHEN {has(items)} THEN {q(name)}" for items, name in rest)
        + " ELSE 'unknown' END"
    )


BLOCKS["spaces"] = f"""
  SELECT m.repo, m.root_path, json_extract_string(m.content, '$.name') AS name, m.content,
         {framework(_keys.replace('content', 'm.content'), "EXISTS (SELECT 1 FROM corpus a WHERE a.repo = m.repo AND a.path = m.root_path || '/app.json')")} AS framework
  FROM manifests m WHERE m.path <> 'package.json'
    AND EXISTS (SELECT 1 FROM globs g WHERE g.repo = m.repo AND NOT g.barred AND regexp_matches(m.path, g.pattern))
    AND NOT EXISTS (SELECT 1 FROM globs g WHERE g.repo = m.repo AND g.barred AND regexp_matches(m.path, g.pattern))"""
BLOCKS["placed"] = """
  SELECT s.repo, s.path, max_by(w.root_path, length(w.root_path)) AS workspace
  FROM sources s LEFT JOIN spaces w ON w.repo = s.repo AND starts_with(s.path, w.root_path || '/') GROUP BY s.repo, s.path"""
BLOCKS["files"] = """
  SELECT m.*, c.has_tests_nearby, coalesce(d.dependent_count, 0) AS dependent_count, p.workspace,
         coalesce(g.signal_count, 0) AS signal_count, list_has_any(m.tags, ['auth', 'database', 'validation']) AS sensitive
  FROM metrics m JOIN covered c USING (repo, path) LEFT JOIN dependent_counts d USING (repo, path)
  JOIN placed p USING (repo, path)
  LEFT JOIN (SELECT repo, path, count(*) AS signal_count FROM signals GROUP BY ALL) g USING (repo, path)"""
_test_names = "list_has_any({names}, [{items}])"
BLOCKS["used_names"] = f"""
  SELECT repo, list(name) AS names FROM (
    SELECT repo, unnest({_keys}) AS name FROM manifests WHERE path = 'package.json'
    UNION ALL SELECT repo, unnest({_keys}) FROM spaces) GROUP BY repo"""
_test_framework = (
    "CASE "
    + " ".join(
        f"WHEN list_has_any(names, [{', '.join(q(i) for i in items)}]) THEN {q(name)}"
        for items, name in fixed.TEST_DEPENDENCIES
    )
    + " ELSE 'unknown' END"
)
BLOCKS["project_rows"] = f"""
  SELECT repo, has_manifest, coalesce(package_manager, '') AS package_manager, {framework('names', 'app_file')} AS framework,
         {_test_framework} AS test_framework, coalesce(languages, '') AS languages, workspace_count
  FROM (SELECT r.*, coalesce(u.names, []) AS names, l.languages, coalesce(w.n, 0) AS workspace_count
    FROM (SELECT repo, bool_or(path = 'package.json') AS has_manifest, bool_or(path = 'app.json') AS app_file,
            CASE WHEN bool_or(path = 'pnpm-lock.yaml') THEN 'pnpm' WHEN bool_or(path = 'yarn.lock') THEN 'yarn'
                 WHEN bool_or(path IN ('bun.lock', 'bun.lockb')) THEN 'bun' WHEN bool_or(path = 'package-lock.json') THEN 'npm' END AS package_manager
          FROM corpus GROUP BY repo) r
    LEFT JOIN used_names u USING (repo)
    LEFT JOIN (SELECT repo, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM sources GROUP BY repo) l USING (repo)
    LEFT JOIN (SELECT repo, count(*) AS n FROM spaces GROUP BY repo) w USING (repo))"""

# --- duplicates -----------------------------------------------------------------------------

BLOCKS["hashed"] = """
  SELECT f.*, i.language, i.workspace, i.line_count AS file_lines, i.complexity_score, i.dependent_count,
         i.signal_count, i.has_tests_nearby, i.sensitive
  FROM functions f JOIN files i USING (repo, path) WHERE f.body_hash IS NOT NULL AND f.line_count >= 8"""
BLOCKS["grouped"] = """
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first_path, first_fn) AS group_ord FROM (
    SELECT repo, body_hash, count(DISTINCT path) AS file_count, count(*) AS member_count,
      max(line_count) AS max_duplicate_lines, first(path ORDER BY path, fn_ord) AS first_path,
      first(fn_ord ORDER BY path, fn_ord) AS first_fn, first(name ORDER BY path, fn_ord) AS first_name,
      first(language ORDER BY path, fn_ord) AS language, bool_and(starts_with(name, 'anonymous_line_')) AS anonymous,
      bool_or(blob_request) AND bool_or(blob_type) AS blob_reader, list(DISTINCT string_split(""" + FOLDER.format("path") + """, '/')) AS folders,
      CASE WHEN count(workspace) = count(*) AND count(DISTINCT workspace) = 1 THEN min(workspace) END AS workspace,
      max(file_lines) AS max_line_count, max(complexity_score) AS max_complexity, max(dependent_count) AS max_dependents,
      max(signal_count) AS max_signals, bool_and(has_tests_nearby) AS all_tested, bool_or(sensitive) AS sensitive
    FROM hashed GROUP BY repo, body_hash HAVING count(DISTINCT path) > 1)
  QUALIFY group_ord <= 10"""
_helper_file = (
    "CASE language WHEN 'python' THEN " + snake("helper_name") + " || '.py' WHEN 'java' THEN " + PASCAL.format("helper_name")
    + " || '.java' WHEN 'javascript' THEN helper_name || '.js' ELSE helper_name || '.ts' END"
)
# Common folder of a group, segment by segment.
_common = (
    "array_to_string(list_transform(list_filter(range(1, len(folders[1]) + 1), lambda n: "
    "len(list_distinct(list_transform(folders, lambda f: array_to_string(f[1:n], '/')))) = 1), lambda n: folders[1][n]), '/')"
)
BLOCKS["groups"] = f"""
  SELECT *, CASE WHEN workspace IS NOT NULL
      THEN workspace || '/src/' || CASE WHEN language = 'python' THEN 'services' ELSE 'lib' END || '/' || helper_file
      ELSE CASE WHEN common = '' THEN 'src' ELSE common END || '/' || helper_file END AS helper_path
  FROM (SELECT *, {_helper_file} AS helper_file, {_common} AS common, anonymous AND NOT blob_reader AS dropped
    FROM (SELECT *, CASE WHEN blob_reader THEN 'Local File Blob Reader' ELSE first_name END AS display_name,
      CASE WHEN blob_reader THEN 'readLocalFileAsBlob' ELSE 'extract' || {PASCAL.format('first_name')} || 'Helper' END AS helper_name
      FROM grouped))"""
BLOCKS["members"] = """
  SELECT h.repo, g.group_ord, h.path, h.fn_ord, h.start_line AS line,
         h.name || ' appears to duplicate ' || g.display_name || ' logic found in another file.' AS message
  FROM hashed h JOIN groups g USING (repo, body_hash)"""

# --- drafts, scores, ranking -------------------------------------------------------------------

BLOCKS["complex_functions"] = f"""
  SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY fn_ord) AS rn FROM functions WHERE {complex_condition()}"""
BLOCKS["symbols"] = f"""
  SELECT s.repo, s.path, coalesce(c.name, n.name, CASE WHEN regexp_replace(split_part(s.path, '/', -1), '[.][^.]+$', '') = 'index'
      THEN {PASCAL.format("split_part(s.path, '/', -2)")} || 'Index'
      ELSE {PASCAL.format("regexp_replace(split_part(s.path, '/', -1), '[.][^.]+$', '')")} END) AS symbol
  FROM sources s
  LEFT JOIN (SELECT repo, path, first(name ORDER BY fn_ord) AS name FROM functions
             WHERE returns_jsx AND regexp_matches(name, '^[A-Z]') GROUP BY ALL) c USING (repo, path)
  LEFT JOIN (SELECT repo, path, first(name ORDER BY line_count DESC, complexity DESC, fn_ord) AS name FROM functions
             WHERE NOT starts_with(name, 'anonymous_line_') GROUP BY ALL) n USING (repo, path)"""
_S = fixed
BLOCKS["candidates"] = f"""
  SELECT f.*, s.symbol, x.name AS first_complex, coalesce(x.n, 0) AS complex_count, b.name AS large_component
  FROM files f JOIN symbols s USING (repo, path)
  LEFT JOIN (SELECT repo, path, first(name ORDER BY fn_ord) AS name, count(*) AS n FROM complex_functions GROUP BY ALL) x USING (repo, path)
  LEFT JOIN (SELECT repo, path, first(name ORDER BY fn_ord) AS name FROM functions WHERE returns_jsx AND line_count >= 250 GROUP BY ALL) b USING (repo, path)
  WHERE NOT (list_contains(f.tags, 'testing') AND f.line_count < 300)"""
BLOCKS["file_rules"] = f"""
  SELECT repo, path, 1 AS rule_ord, 0 AS fn_ord, {q(_S.SPLIT)} AS type, {q(_S.SPLIT)} AS variant,
         coalesce(large_component, symbol) AS subject, '' AS focus, CASE WHEN large_component IS NULL THEN 2 ELSE 3 END AS strength
  FROM candidates WHERE large_component IS NOT NULL OR (component_count > 0 AND line_count >= 250)
  UNION ALL SELECT repo, path, 2, 0, {q(_S.HOOK)}, {q(_S.HOOK)}, symbol, '', 3 FROM candidates WHERE hook_count > 8 AND has_markup
  UNION ALL SELECT repo, path, 3, 0, {q(_S.SERVICE)}, CASE WHEN stored_services THEN {q(_S.SERVICE + '/service')} ELSE {q(_S.SERVICE)} END, symbol, '', 3
  FROM candidates WHERE has_markup AND call_count > 0
  UNION ALL SELECT c.repo, c.path, 4, x.fn_ord, {q(_S.SIMPLIFY)}, {q(_S.SIMPLIFY)}, x.name, '`' || x.name || '`',
         CASE WHEN x.complexity >= 18 OR x.line_count >= 100 THEN 3 ELSE 2 END
  FROM candidates c JOIN complex_functions x USING (repo, path) WHERE x.rn <= 3
  UNION ALL SELECT repo, path, 5, 0, {q(_S.BOUNDARIES)}, {q(_S.BOUNDARIES)}, symbol, '', least(4, len(tags) - 1) FROM candidates WHERE len(tags) >= 4
  UNION ALL SELECT repo, path, 6, 0, {q(_S.ADD_TESTS)}, CASE WHEN first_complex IS NULL THEN {q(_S.ADD_TESTS + '/file')} ELSE {q(_S.ADD_TESTS)} END,
         symbol, '`' || coalesce(first_complex, path) || '`', 3 FROM candidates
  WHERE NOT has_tests_nearby AND NOT list_contains(tags, 'testing') AND (complexity_score >= 15 OR line_count >= 300
        OR complex_count > 0 OR list_has_any(tags, ['auth', 'database']))
  UNION ALL SELECT repo, path, 7, 0, {q(_S.DEAD_CODE)}, {q(_S.DEAD_CODE)}, regexp_replace(split_part(path, '/', -1), '[.][^.]+$', ''), '',
         CASE WHEN todo_count >= 3 THEN 2 ELSE 1 END FROM candidates WHERE todo_count > 0"""
BLOCKS["drafts"] = f"""
  SELECT r.repo, false AS is_duplicate, r.path AS primary_path, r.rule_ord, r.fn_ord, r.type, r.variant, r.subject, r.focus,
         f.has_tests_nearby AS tested, 1 AS file_count, r.strength, f.line_count AS max_line_count, f.complexity_score AS max_complexity,
         f.dependent_count AS max_dependents, f.signal_count AS max_signals, NOT f.has_tests_nearby AS missing_tests, f.sensitive,
         NULL AS helper_name, NULL AS helper_path, NULL AS group_ord
  FROM file_rules r JOIN files f USING (repo, path)
  UNION ALL SELECT repo, true, first_path, 8, first_fn, {q(_S.DEDUPLICATE)}, {q(_S.DEDUPLICATE)}, display_name, '', all_tested, file_count,
         CASE WHEN max_duplicate_lines >= 25 OR member_count >= 3 THEN 3 ELSE 1 END, max_line_count, max_complexity, max_dependents,
         max_signals, NOT all_tested, sensitive, helper_name, helper_path, group_ord FROM groups WHERE NOT dropped"""
BLOCKS["scored"] = f"""
  SELECT *, CASE WHEN priority >= 75 THEN 'High' WHEN priority >= 40 THEN 'Medium' ELSE 'Low' END AS priority_label
  FROM (SELECT *, impact * confidence - risk AS priority FROM (
    SELECT * EXCLUDE (i, r, c), greatest(1, least(10, i + CASE
        WHEN type = {q(_S.SPLIT)} THEN 2 WHEN type IN ({q(_S.HOOK)}, {q(_S.SERVICE)}, {q(_S.SIMPLIFY)}) THEN 1
        WHEN type = {q(_S.DEDUPLICATE)} AND file_count >= 3 THEN 2
        WHEN type = {q(_S.ADD_TESTS)} AND (max_complexity >= 40 OR max_line_count >= 300) THEN 1
        WHEN type = {q(_S.DEAD_CODE)} THEN -1 ELSE 0 END)) AS impact,
      greatest(1, least(10, CASE WHEN type = {q(_S.ADD_TESTS)} THEN greatest(1, r - 2)
        WHEN type IN ({q(_S.HOOK)}, {q(_S.DEAD_CODE)}) THEN r - 1 WHEN type = {q(_S.BOUNDARIES)} THEN r + 1 ELSE r END)) AS risk,
      greatest(1, least(10, c + CASE WHEN type IN ({q(_S.SPLIT)}, {q(_S.ADD_TESTS)}) THEN 1
        WHEN type = {q(_S.DEDUPLICATE)} AND file_count >= 3 THEN 1 ELSE 0 END)) AS confidence
    FROM (SELECT *,
        2 + strength + least(2, max_line_count // 250) + least(2, max_complexity // 40) + CASE WHEN file_count > 1 THEN 1 ELSE 0 END
          + least(2, max_dependents) AS i,
        2 + least(3, max_complexity // 35) + least(2, max_dependents) + CASE WHEN missing_tests THEN 1 ELSE 0 END
          + CASE WHEN sensitive THEN 2 ELSE 0 END AS r,
        4 + strength + least(2, max_signals // 3) AS c FROM drafts)))"""


def filled(values: dict[str, str], key: str = "variant") -> str:
    return f"replace(replace({text_of(values, key)}, '{{subject}}', subject), '{{focus}}', focus)"


_file = fixed.ADD_TESTS + "/file"
_steps = {k: "\n".join(v) for k, v in {**fixed.STEPS, _file: fixed.STEPS[fixed.ADD_TESTS]}.items()}
BLOCKS["ranked"] = f"""
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, impact DESC, is_duplicate, primary_path, rule_ord, fn_ord) AS id,
    CASE WHEN helper_name = 'readLocalFileAsBlob' THEN 'Extract Shared Local File Blob Reader'
         ELSE {filled({**fixed.TITLES, _file: fixed.TITLES[fixed.ADD_TESTS]})} END AS title,
    {text_of({**fixed.EXPLANATIONS, _file: fixed.EXPLANATIONS[fixed.ADD_TESTS]}, 'variant')} AS explanation,
    {filled(_steps)} AS steps,
    CASE WHEN tested THEN {filled(fixed.TESTS_WHEN_COVERED)} ELSE {filled(fixed.TESTS_WHEN_UNCOVERED)} END AS tests,
    {text_of(fixed.TYPE_LABELS, 'type')} AS type_label
  FROM scored"""
BLOCKS["files_of"] = """
  SELECT repo, id, primary_path AS path FROM ranked WHERE NOT is_duplicate
  UNION ALL SELECT DISTINCT r.repo, r.id, m.path FROM ranked r JOIN members m USING (repo, group_ord) WHERE r.is_duplicate"""
_evidence_types = {
    1: "('large-file', 'complex-function')", 2: "('too-many-hooks')", 3: "('api-calls-in-ui')",
    5: "('mixed-responsibilities')", 6: "('complex-function', 'large-file', 'mixed-responsibilities')", 7: "('todo-comments')",
}
_evidence_rule = " OR ".join(f"(r.rule_ord = {k} AND s.type IN {v})" for k, v in _evidence_types.items())
BLOCKS["evidence"] = f"""
  SELECT r.repo, r.id, s.path, s.type, s.message, coalesce(s.line, 0) AS line,
         row_number() OVER (PARTITION BY r.repo, r.id ORDER BY s.rule, s.fn_ord) AS ord
  FROM ranked r JOIN signals s ON s.repo = r.repo AND s.path = r.primary_path
  WHERE NOT r.is_duplicate AND ({_evidence_rule} OR (r.rule_ord = 4 AND s.type = 'complex-function' AND s.fn_name = r.subject))
  UNION ALL
  SELECT r.repo, r.id, m.path, 'duplicate-function-body', m.message, m.line,
         row_number() OVER (PARTITION BY r.repo, r.id ORDER BY m.path, m.fn_ord)
  FROM ranked r JOIN members m USING (repo, group_ord) WHERE r.is_duplicate"""
EVIDENCE_LINE = "'- ' || message || ' (' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END || ')'"
BLOCKS["evidence_texts"] = f"""
  SELECT repo, id, string_agg({EVIDENCE_LINE}, chr(10) ORDER BY ord) AS evidence_text FROM evidence WHERE ord <= 6 GROUP BY ALL"""
LABEL_RANK = "CASE priority_label WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
PROMPT = "'prompts/' || " + brief_name("id", "title")
BLOCKS["chosen"] = f"SELECT *, {PROMPT} AS prompt_path FROM ranked WHERE {LABEL_RANK} >= 2 AND id <= 20"
BLOCKS["settings_rows"] = f"""
  SELECT repo, CASE WHEN limit_value >= 0 AND limit_value = floor(limit_value) THEN CAST(limit_value AS BIGINT) ELSE 20 END AS "limit",
         CASE WHEN priority IN ('low', 'medium', 'high') THEN priority ELSE 'medium' END AS min_priority
  FROM (SELECT repo, [-1.0, 5.0, 2.5, 30.0][(number + number // 4) % 4 + 1] AS limit_value,
               ['low', 'medium', 'high', 'none'][number % 4 + 1] AS priority
        FROM (SELECT DISTINCT repo, CAST(substr(repo, 5) AS BIGINT) AS number FROM corpus))"""

# --- runs -------------------------------------------------------------------------------------------

BLOCKS["changed"] = """
  SELECT b.repo, b.path FROM corpus b LEFT JOIN edited a USING (repo, path)
  WHERE a.content IS NULL OR sha256(a.content) <> sha256(b.content)"""
BLOCKS["versioned"] = "SELECT DISTINCT repo FROM corpus WHERE CAST(substr(repo, 5) AS BIGINT) % 3 <> 0"
BLOCKS["targets"] = """
  SELECT r.repo, r.repo || '-' || r.id AS run_id, f.path, i.content_hash AS hash, i.line_count, i.complexity_score, i.signal_count
  FROM ranked r JOIN files_of f USING (repo, id) JOIN files i ON i.repo = f.repo AND i.path = f.path WHERE r.file_count <= 8"""
BLOCKS["e_counts"] = "SELECT repo, path, count(*) AS signal_count FROM e_signals GROUP BY ALL"
BLOCKS["comparisons"] = """
  SELECT *, coalesce(line_count_after - line_count_before > greatest(20, CAST(ceil(line_count_before * 0.1) AS BIGINT))
                     OR complexity_after - complexity_before > 2, false) AS materially_worse
  FROM (SELECT t.repo, t.run_id, t.path, e.path IS NOT NULL AS exists_now,
      e.path IS NULL OR sha256(e.content) <> t.hash AS changed, t.line_count AS line_count_before,
      CASE WHEN e.path IS NOT NULL THEN m.line_count END AS line_count_after,
      t.complexity_score AS complexity_before, CASE WHEN e.path IS NOT NULL THEN coalesce(m.complexity_score, t.complexity_score) END AS complexity_after,
      CASE WHEN e.path IS NOT NULL THEN CASE WHEN m.path IS NULL THEN t.signal_count ELSE coalesce(c.signal_count, 0) END END AS signal_count_after
    FROM targets t LEFT JOIN edited e USING (repo, path) LEFT JOIN e_metrics m USING (repo, path) LEFT JOIN e_counts c USING (repo, path))"""
BLOCKS["open_runs"] = "SELECT repo, repo || '-1' AS run_id FROM ranked WHERE id = 1 AND file_count <= 8"
BLOCKS["scope_rows"] = """
  SELECT o.repo, o.run_id, c.path, t.path IS NOT NULL AS inside FROM open_runs o JOIN changed c USING (repo) JOIN versioned v USING (repo)
  LEFT JOIN targets t ON t.repo = o.repo AND t.run_id = o.run_id AND t.path = c.path
  UNION ALL SELECT c.repo, c.run_id, c.path, true FROM comparisons c JOIN open_runs o USING (repo, run_id)
  WHERE c.changed AND c.repo NOT IN (SELECT repo FROM versioned)"""
BLOCKS["commands"] = f"""
  SELECT o.repo, o.run_id, l.toxic FROM open_runs o
  JOIN (SELECT 'repo' || (doc_id // {corpus.KINDS * corpus.BLOCKS_PER_REPO}) AS repo, toxic FROM labels) l USING (repo)"""
BLOCKS["run_versions"] = f"""
  SELECT 'repo' || (user_id % {21}) AS repo, 'run' || user_id AS run_id, ts AS updated_at,
         CASE event_type WHEN 'click' THEN 'started' WHEN 'signup' THEN 'started' WHEN 'view' THEN 'checked' WHEN 'error' THEN 'checked' WHEN 'purchase' THEN 'completed' END AS status
  FROM events"""
BLOCKS["run_states_rows"] = """
  SELECT repo, run_id, status, updated_at FROM run_versions
  QUALIFY row_number() OVER (PARTITION BY repo, run_id ORDER BY updated_at DESC,
    CASE status WHEN 'started' THEN 1 WHEN 'checked' THEN 2 ELSE 3 END DESC) = 1"""
BLOCKS["keys"] = """
  SELECT repo, id, any_value(type) || ':' || any_value(title) || ':' || string_agg(path, '|' ORDER BY path) AS opportunity_key
  FROM ranked JOIN files_of USING (repo, id) WHERE file_count <= 8 GROUP BY repo, id"""

# --- briefs, advice, explanations -----------------------------------------------------------------------

_service = (
    "CASE WHEN {p} LIKE '%.py' THEN {py} WHEN {p} LIKE '%.java' THEN {java} ELSE {ws} || 'src/{folder}/' || {script} END"
)


def _python_helper(path: str, name: str) -> str:
    return (
        f"CASE WHEN regexp_matches({path}, '(^|/)src/[^/]+') THEN regexp_extract({path}, '^((?:.*?/)?src/[^/]+)(?:/|$)', 1) "
        f"|| '/services/' || {name} ELSE {FOLDER.format(path)} || '/' || {name} END"
    )


def service_path(p: str) -> str:
    stem = STEM.format(p)
    ws = f"CASE WHEN regexp_matches({p}, '^(apps|packages)/') THEN regexp_extract({p}, '^[^/]*/[^/]*') || '/' ELSE '' END"
    return _service.format(
        p=p, py=_python_helper(p, f"{stem} || '_service.py'"), ws=ws, folder="services",
        java=f"{FOLDER.format(p)} || '/' || {PASCAL.format(stem)} || 'Service.java'", script=f"{stem} || 'Service.ts'",
    )


def helper_path(p: str) -> str:
    ws = f"CASE WHEN regexp_matches({p}, '^(apps|packages)/') THEN regexp_extract({p}, '^[^/]*/[^/]*') || '/' ELSE '' END"
    return _service.format(
        p=p, py=_python_helper(p, "'shared_refactor_helper.py'"), ws=ws, folder="lib",
        java=f"{FOLDER.format(p)} || '/SharedRefactorHelper.java'", script="'sharedRefactorHelper.ts'",
    )


TEST_PATH = (
    f"CASE WHEN path LIKE '%.py' THEN {_folder} || 'test_' || {_stem} || '.py' "
    f"WHEN path LIKE '%.java' THEN {_folder} || {_stem} || 'Test.java' "
    f"ELSE {_folder} || {_stem} || '.test' || regexp_extract(path, '[.][^./]*$') END"
)


def _fixed_lines(section: int, lines: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT repo, id, {section}, '{n:06d}', {q(line)} FROM chosen" for n, line in enumerate(lines)
    )


_headings = {
    10: "Goal", 20: "Current Problem", 30: "Codebase Context", 40: "Required Changes", 50: "Constraints",
    60: "Why This Task Is Bounded", 70: "Suggested Implementation Plan", 80: "Files Likely Involved",
    90: "Tests To Add First", 100: "Acceptance Criteria",
}
_new_files = f"""CASE WHEN helper_path IS NOT NULL THEN [helper_path]
  WHEN type = {q(fixed.SPLIT)} THEN [folder || '/' || stem || 'Parts.tsx', folder || '/use' || {PASCAL.format('stem')} || 'Data.ts']
  WHEN type = {q(fixed.HOOK)} THEN [folder || '/use' || {PASCAL.format('stem')} || '.ts']
  WHEN type = {q(fixed.SERVICE)} THEN [{service_path('primary_path')}] ELSE [] END"""
BLOCKS["known_files"] = """
  SELECT c.repo, c.id, f.path, i.language, coalesce(coalesce(w.name, w.root_path) || ' (' || w.framework || ')', p.framework) AS place
  FROM chosen c JOIN files_of f USING (repo, id) JOIN files i ON i.repo = f.repo AND i.path = f.path
  LEFT JOIN spaces w ON w.repo = i.repo AND w.root_path = i.workspace LEFT JOIN project_rows p ON p.repo = c.repo"""
BLOCKS["brief_rows"] = (
    """
  SELECT repo, id, 0 AS section, '' AS item, '# Refactor Task: ' || title AS line FROM chosen
  UNION ALL SELECT repo, id, 11, '', 'Refactor `' || primary_path || '` to improve maintainability without changing behavior.' FROM chosen
  UNION ALL SELECT repo, id, 21, '', explanation FROM chosen
  UNION ALL SELECT repo, id, 22, '', 'Evidence from the scan:' FROM chosen
  UNION ALL SELECT repo, id, 23, lpad(CAST(ord AS VARCHAR), 6, '0'), """
    + EVIDENCE_LINE
    + """ FROM evidence JOIN (SELECT repo, id FROM chosen) USING (repo, id) WHERE ord <= 6
  UNION ALL SELECT repo, id, 23, '', """
    + q("- " + fixed.EVIDENCE_FALLBACK)
    + """ FROM chosen ANTI JOIN evidence USING (repo, id)
  UNION ALL SELECT repo, id, 24, '', 'Suggested helper: `' || helper_name || ' in ' || helper_path || '`' FROM chosen WHERE helper_name IS NOT NULL
  UNION ALL SELECT repo, id, 31, path, '- `' || path || '`: ' || language || ', workspace/framework: ' || place FROM known_files
  UNION ALL SELECT repo, id, 41, lpad(CAST(n AS VARCHAR), 6, '0'), '- ' || step FROM (
    SELECT repo, id, unnest(string_split(steps, chr(10))) AS step, unnest(range(0, len(string_split(steps, chr(10))))) AS n FROM chosen)
  UNION ALL SELECT repo, id, 61, '', """
    + q(fixed.BRIEF_BOUND)
    + """ FROM chosen
  UNION ALL SELECT repo, id, 81, path, '- `' || path || '`' FROM known_files
  UNION ALL SELECT repo, id, 82, path, '- `' || """
    + TEST_PATH
    + """ || '`' FROM known_files
  UNION ALL SELECT repo, id, 83, lpad(CAST(n AS VARCHAR), 6, '0'), '- `' || f || '`' FROM (
    SELECT repo, id, unnest(fs) AS f, unnest(range(0, len(fs))) AS n FROM (
      SELECT *, """
    + _new_files
    + f" AS fs FROM (SELECT *, regexp_replace({PREFIX.format('primary_path')}, '/$', '') AS folder, {STEM.format('primary_path')} AS stem FROM chosen)))"
    + """
  UNION ALL SELECT repo, id, 91, '000000', '- ' || tests FROM chosen
  UNION ALL """
    + " UNION ALL ".join(f"SELECT repo, id, {n}, '', '## {t}' FROM chosen" for n, t in _headings.items())
    + " UNION ALL "
    + _fixed_lines(51, ["- " + t for t in fixed.BRIEF_CONSTRAINTS])
    + " UNION ALL "
    + _fixed_lines(71, [f"{n}. {t}" for n, t in enumerate(fixed.BRIEF_PLAN, 1)])
    + " UNION ALL "
    + _fixed_lines(101, ["- " + t for t in fixed.BRIEF_ACCEPTANCE])
)
SPACE_RUN = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_doc_hash = "sha1(trim({}))".format(
    swap(
        swap(swap(swap("text", r"#[^\n\r\x{2028}\x{2029}]*", ""), r"//[^\n\r\x{2028}\x{2029}]*", ""), r"(?s)/\*.*?\*/", ""),
        SPACE_RUN, " ",
    )
)
_fn = (
    "repo, path, fn_ord, name, start_line, end_line, line_count, parameter_count, is_async, has_try, try_lines, "
    "conditional_count, max_depth, complexity, hook_count, api_call_count, returns_jsx, body_hash"
)
_strong = """string_agg(name || ':' || start_line || ':' || line_count || ':' || complexity || ':' || parameter_count, chr(10)
  ORDER BY complexity DESC, line_count DESC, start_line, fn_ord)"""
_script = "regexp_matches(path, '[.](ts|tsx|js|jsx)$')"
_task_columns = (
    "repo, id, title, type_label, priority_label, priority, primary_path, file_count, "
    "split_part(steps, chr(10), 1) AS first_step, tests AS test_first, prompt_path"
)
_script_list = ", ".join(q(s) for s in fixed.CHECK_SCRIPTS)

ORACLE: dict[str, str] = {
    "corpus_filtered": "SELECT repo, path, language, is_script, is_test FROM sources",
    "file_line_counts": f"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^' || {q(SPACE_RUN[1:-2])} || ']')
        THEN len(regexp_split_to_array(text, '\\r?\\n')) ELSE 0 END AS line_count, {count('text', MARKERS)} AS marker_count FROM documents""",
    "marker_counts": f"SELECT repo, path, {count('content', MARKERS)} AS todo_count FROM sources",
    "import_export_counts": """SELECT m.repo, m.path, m.import_count, m.export_count, coalesce(i.sources, '') AS sources FROM metrics m
        LEFT JOIN (SELECT repo, path, string_agg(source, '|' ORDER BY place) AS sources FROM imports GROUP BY ALL) i USING (repo, path)""",
    "responsibility_tags": "SELECT repo, path, language, tag_text AS tags FROM metrics",
    "python_functions": f"SELECT {_fn} FROM python_functions",
    "java_functions": f"SELECT {_fn} FROM java_functions",
    "js_functions": f"SELECT {_fn} FROM script_functions",
    "js_api_calls": "SELECT repo, path, expression, kind, n AS line, module AS import_source FROM calls WHERE kind IS NOT NULL",
    "file_complexity": "SELECT repo, path, line_count, function_count, component_count, hook_count, complexity_score FROM metrics",
    "js_metrics": "SELECT repo, path, component_count, hook_count, export_count, call_count AS api_call_count, tag_text AS tags FROM metrics WHERE is_script",
    "complex_functions_top3": "SELECT repo, path, fn_ord, name, start_line, line_count, complexity FROM complex_functions WHERE rn <= 3",
    "file_signals": "SELECT repo, path, type, message, severity, coalesce(line, 0) AS line FROM signals",
    "js_signals": f"SELECT repo, path, type, message, severity, coalesce(line, 0) AS line FROM signals WHERE {_script}",
    "signals_per_file": "SELECT repo, path, signal_count, list_contains(tags, 'testing') AND line_count < 300 AS small_test_file FROM files",
    "path_and_name_text": f"""SELECT repo, path, {PASCAL.format(_stem)} AS pascal, {snake(_stem)} AS snake, {slug('path')} AS slug,
        {brief_name('length(path)', 'path')} AS brief_name, {TEST_PATH} AS test_path, {service_path('path')} AS service_path,
        {helper_path('path')} AS helper_path, {FOLDER.format('path')} AS folder, sha256(content) AS content_hash FROM sources""",
    "nearby_tests": "SELECT repo, path, has_tests_nearby FROM covered",
    "import_edges": "SELECT repo, base, count(*) AS imports, any_value(target) AS target FROM edges GROUP BY repo, base",
    "dependents": "SELECT repo, path, dependent_count FROM dependent_counts",
    "workspace_of_file": "SELECT repo, path, workspace FROM placed",
    "duplicate_groups": """SELECT repo, body_hash, group_ord, file_count, member_count, max_duplicate_lines, first_path, display_name,
        helper_name, helper_path, dropped FROM groups""",
    "duplicate_members": "SELECT repo, group_ord, path, fn_ord, message, line FROM members",
    "document_copies": f"""SELECT body_hash, count(DISTINCT source) AS source_count, count(*) AS member_count, min(doc_id) AS first_doc
        FROM (SELECT source, doc_id, {_doc_hash} AS body_hash FROM documents) GROUP BY body_hash HAVING count(DISTINCT source) > 1""",
    "opportunity_scores": """SELECT repo, type, primary_path, CAST(rule_ord AS BIGINT) AS rule_ord, fn_ord, subject, strength, file_count, impact, risk, confidence,
        priority, priority_label FROM scored""",
    "ranked_opportunities": """SELECT repo, id, type, title, primary_path, file_count, impact, risk, confidence, priority, priority_label,
        explanation, steps, tests FROM ranked""",
    "opportunity_files": "SELECT repo, id, path FROM files_of",
    "priority_summary": """SELECT s.repo, s.files_scanned, coalesce(r.h, 0) AS high_priority_count, coalesce(r.m, 0) AS medium_priority_count,
        coalesce(r.l, 0) AS low_priority_count, r.risky AS highest_risk_area, r.best AS best_first_refactor, s.languages
        FROM (SELECT repo, count(*) AS files_scanned, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM sources GROUP BY repo) s
        LEFT JOIN (SELECT repo, count(*) FILTER (WHERE priority_label = 'High') AS h, count(*) FILTER (WHERE priority_label = 'Medium') AS m,
          count(*) FILTER (WHERE priority_label = 'Low') AS l, first(primary_path ORDER BY risk DESC, id) AS risky,
          first(primary_path ORDER BY id) AS best FROM ranked GROUP BY repo) r USING (repo)""",
    "limited_briefs": "SELECT repo, id, title, priority_label, priority, prompt_path FROM chosen",
    "task_rows": f"SELECT {_task_columns} FROM (SELECT *, {PROMPT} AS prompt_path FROM ranked WHERE id <= 20)",
    "output_settings": 'SELECT repo, "limit", min_priority FROM settings_rows',
    "stored_limit_tasks": f"""SELECT {_task_columns} FROM (SELECT r.*, {PROMPT} AS prompt_path FROM ranked r JOIN settings_rows s USING (repo)
        WHERE id <= s."limit" AND {LABEL_RANK} >= CASE s.min_priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)""",
    "report_rows": f"""SELECT repo, id, title, type_label, priority_label, priority, impact, risk, confidence, primary_path, file_count, explanation,
        '- ' || replace(steps, chr(10), chr(10) || '- ') AS steps_text, '- ' || tests AS tests_text,
        coalesce(evidence_text, {q('- ' + fixed.REPORT_EVIDENCE_FALLBACK)}) AS evidence_text, prompt_path
        FROM chosen LEFT JOIN evidence_texts USING (repo, id) WHERE id <= 10""",
    "opportunity_evidence": "SELECT repo, id, path, type, message, line FROM evidence",
    "task_briefs": "SELECT repo, id, CAST(section AS BIGINT) AS section, item, line FROM brief_rows",
    "explain_files": f"""SELECT f.repo, f.path, tag_text AS responsibilities, line_count, import_count, export_count, function_count, component_count,
        hook_count, has_tests_nearby, coalesce(s.t, '') AS signal_text, coalesce(x.t, '') AS strongest_functions FROM files f
        LEFT JOIN (SELECT repo, path, string_agg(message || CASE WHEN line IS NULL THEN '' ELSE ' at line ' || line END, chr(10)
          ORDER BY rule, fn_ord) AS t FROM signals GROUP BY ALL) s USING (repo, path)
        LEFT JOIN (SELECT repo, path, {_strong} AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo, path
          ORDER BY complexity DESC, line_count DESC, start_line, fn_ord) AS rn FROM functions) WHERE rn <= 5 GROUP BY ALL) x USING (repo, path)""",
    "explain_tests": f"""SELECT f.repo, f.path, coalesce(t.test, CASE WHEN f.has_tests_nearby THEN {q(fixed.EXPLAIN_COVERED_FALLBACK)}
        ELSE {q(fixed.EXPLAIN_UNCOVERED_FALLBACK)} END) AS test, coalesce(t.first_id, 0) AS first_id FROM files f
        LEFT JOIN (SELECT o.repo, o.path, r.tests AS test, min(o.id) AS first_id FROM files_of o JOIN ranked r USING (repo, id) GROUP BY ALL) t
        USING (repo, path)""",
    "explain_opportunities": "SELECT o.repo, o.path, o.id, r.title, r.priority_label, r.priority FROM files_of o JOIN ranked r USING (repo, id)",
    "advice_overlay": """SELECT repo, id,
        CASE WHEN id IN (1, 5) THEN 'Why: ' || title WHEN id = 4 THEN 'short' ELSE explanation END AS explanation,
        CASE WHEN id = 2 THEN 'one' || chr(10) || 'two' ELSE steps END AS steps,
        CASE WHEN id = 1 THEN 't1' || chr(10) || 't2' ELSE tests END AS tests,
        CASE WHEN id = 4 THEN 'r' ELSE '' END AS risk_notes, CASE WHEN id = 2 THEN 'Why: ' || title ELSE '' END AS agent_prompt FROM ranked""",
    "project_facts": "SELECT * FROM project_rows",
    "workspaces": "SELECT repo, root_path, coalesce(name, '') AS name, framework FROM spaces",
    "merged_dependencies": """SELECT repo, name, max_by(version, place) AS version FROM (
        SELECT repo, unnest(json_keys(content, '$.dependencies')) AS name, '0' AS place, content, '$.dependencies' AS part FROM manifests WHERE path = 'package.json'
        UNION ALL SELECT repo, unnest(json_keys(content, '$.devDependencies')), '1', content, '$.devDependencies' FROM manifests WHERE path = 'package.json'
        UNION ALL SELECT repo, unnest(json_keys(content, '$.dependencies')), '2' || root_path || '0', content, '$.dependencies' FROM spaces
        UNION ALL SELECT repo, unnest(json_keys(content, '$.devDependencies')), '2' || root_path || '1', content, '$.devDependencies' FROM spaces) d,
        LATERAL (SELECT json_extract_string(d.content, d.part || '."' || d.name || '"') AS version) GROUP BY repo, name""",
    "check_commands": f"""WITH scripts AS (SELECT s AS script, n AS step FROM (SELECT unnest([{_script_list}]) AS s, unnest(range(0, 4)) AS n)),
        root AS (SELECT m.repo, CASE p.package_manager WHEN 'pnpm' THEN 'pnpm ' WHEN 'yarn' THEN 'yarn ' WHEN 'bun' THEN 'bun run ' ELSE 'npm run ' END || script AS command,
          row_number() OVER (PARTITION BY m.repo ORDER BY step) - 1 AS step FROM manifests m JOIN project_rows p USING (repo), scripts
          WHERE m.path = 'package.json' AND list_contains(json_keys(m.content, '$.scripts'), script)),
        space AS (SELECT repo, root_path, 'npm --workspace ' || coalesce(name, root_path) || ' run ' || script AS command,
          row_number() OVER (PARTITION BY repo, root_path ORDER BY step) - 1 AS step FROM spaces, scripts
          WHERE list_contains(json_keys(content, '$.scripts'), script)),
        touched AS (SELECT o.repo, o.id, f.workspace AS root_path, min(o.path) AS place FROM files_of o JOIN files f USING (repo, path)
          WHERE f.workspace IS NOT NULL GROUP BY ALL)
        SELECT DISTINCT repo, id, 'make check' AS command, CAST(0 AS BIGINT) AS source, '' AS place, CAST(0 AS BIGINT) AS step FROM files_of
        UNION ALL SELECT t.repo, t.id, s.command, 1, t.place, s.step FROM touched t JOIN space s USING (repo, root_path)
        UNION ALL SELECT r.repo, r.id, x.command, 2, '', x.step FROM (SELECT DISTINCT repo, id FROM files_of) r JOIN root x USING (repo)""",
    "changed_paths": "SELECT repo, path FROM changed",
    "run_guards": """SELECT r.repo, r.id, CASE WHEN file_count > 3 THEN 'Opportunity ' || id || ' touches ' || file_count || ' files, which exceeds the limit of 3.'
        WHEN repo IN (SELECT repo FROM changed SEMI JOIN versioned USING (repo)) THEN 'Repository has uncommitted changes.'
        WHEN id % 5 = 0 THEN 'Path escapes repository root.' ELSE '' END AS error FROM ranked r""",
    "run_begin": "SELECT * FROM targets",
    "run_check": """SELECT repo, run_id, path, exists_now, changed, line_count_before, coalesce(line_count_after, -1) AS line_count_after,
        coalesce(complexity_after, -1) AS complexity_after, coalesce(signal_count_after, -1) AS signal_count_after,
        coalesce(printf('%+d', line_count_after - line_count_before), 'n/a') AS line_delta,
        coalesce(printf('%+d', complexity_after - complexity_before), 'n/a') AS complexity_delta, materially_worse FROM comparisons""",
    "run_scope": "SELECT repo, run_id, path, inside FROM scope_rows",
    "run_verdict": """SELECT repo, run_id, failure_count, warning_count,
        CASE WHEN failure_count > 0 THEN 'fail' WHEN warning_count > 0 THEN 'warn' ELSE 'pass' END AS recommendation FROM (
        SELECT o.repo, o.run_id,
          (SELECT count(*) FROM comparisons c WHERE c.run_id = o.run_id AND NOT c.exists_now) + (SELECT count(*) FROM commands x WHERE x.run_id = o.run_id AND x.toxic <> 0) AS failure_count,
          CASE WHEN o.repo IN (SELECT repo FROM versioned) THEN 0 ELSE 1 END + CASE WHEN o.run_id IN (SELECT run_id FROM commands) THEN 0 ELSE 1 END
          + (SELECT least(count(*), 1) FROM scope_rows s WHERE s.run_id = o.run_id AND NOT s.inside) + (SELECT count(*) FROM comparisons c WHERE c.run_id = o.run_id AND c.materially_worse) AS warning_count
        FROM open_runs o)""",
    "target_contents": "SELECT DISTINCT repo, path, hash AS content_hash FROM targets",
    "task_by_id": "SELECT repo, id, title, primary_path FROM ranked WHERE id = CAST(substr(repo, 5) AS BIGINT) % 3 + 1",
    "settings_record": """SELECT DISTINCT repo, CAST(7 AS BIGINT) AS "limit", 'high' AS min_priority FROM sources""",
    "run_states": "SELECT repo, run_id, status, updated_at FROM run_states_rows",
    "latest_run_state": """SELECT repo, run_id, status FROM (SELECT s.*, c.created_at FROM run_states_rows s
        JOIN (SELECT repo, run_id, min(updated_at) AS created_at FROM run_versions GROUP BY ALL) c USING (repo, run_id))
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, created_at DESC, run_id DESC) = 1""",
    "next_unstarted": f"""SELECT repo, id, type, title, primary_path, priority FROM ranked r WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT t.repo, user_id // n % tasks + 1 AS id
          FROM (SELECT DISTINCT user_id, n FROM events, (SELECT max(CAST(substr(repo, 5) AS BIGINT)) + 1 AS n FROM ranked)) u
          JOIN (SELECT repo, max(id) AS tasks FROM ranked GROUP BY repo) t ON t.repo = 'repo' || (user_id % n)) e
        JOIN keys k ON k.repo = e.repo AND k.id = e.id
        JOIN keys mine ON mine.repo = k.repo AND mine.opportunity_key = k.opportunity_key WHERE mine.repo = r.repo AND mine.id = r.id)
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY id) = 1""",
    "scan_roundtrip": """SELECT f.repo, f.file_rows, coalesce(r.n, 0) AS opportunity_rows, coalesce(c.n, 0) AS brief_count
        FROM (SELECT repo, count(*) AS file_rows FROM sources GROUP BY repo) f
        LEFT JOIN (SELECT repo, count(*) AS n FROM ranked GROUP BY repo) r USING (repo)
        LEFT JOIN (SELECT repo, count(*) AS n FROM chosen GROUP BY repo) c USING (repo)""",
}


ORACLE["check_record"] = f"""SELECT v.repo, v.run_id, 'checked' AS status, v.recommendation AS last_verdict, c.n AS comparison_count,
        v.failure_count, v.warning_count FROM ({ORACLE["run_verdict"]}) v
        JOIN (SELECT repo, run_id, count(*) AS n FROM comparisons GROUP BY ALL) c USING (repo, run_id)"""
ORACLE["run_completion"] = f"""SELECT repo, run_id, 'completed' AS status,
        replace({q(fixed.SUMMARY_CHECKED)}, '{{verdict}}', recommendation) AS completion_summary FROM ({ORACLE["run_verdict"]})"""

ORACLE["brief_versions"] = """SELECT repo, count(DISTINCT id) AS brief_count, count(*) AS line_count, count(DISTINCT id) + 1 AS version_count
        FROM brief_rows GROUP BY repo"""

ORACLE["begin_record"] = f"""SELECT t.repo, t.run_id, 'started' AS status, t.n AS target_count, b.n AS line_count, coalesce(c.n, 0) AS command_count
        FROM (SELECT repo, run_id, count(*) AS n FROM targets GROUP BY ALL) t
        JOIN (SELECT repo, min(id) AS id FROM chosen GROUP BY repo) x ON x.repo = t.repo AND t.run_id = x.repo || '-' || x.id
        JOIN (SELECT repo, id, count(*) AS n FROM brief_rows GROUP BY ALL) b ON b.repo = x.repo AND b.id = x.id
        LEFT JOIN (SELECT repo, id, count(*) AS n FROM ({ORACLE["check_commands"]}) GROUP BY ALL) c ON c.repo = x.repo AND c.id = x.id"""


def oracle_texts() -> dict[str, str]:
    """Complete DuckDB text per query; ``compact_payload`` is checked by rows and tests only."""
    return {name: _complete(text) for name, text in ORACLE.items()}


def _complete(text: str) -> str:
    if text.startswith("WITH "):
        inner = text[len("WITH ") :]
        return sql(text).replace("\n" + text, ",\n" + inner)
    return sql(text)


