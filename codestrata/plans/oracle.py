"""DuckDB text for every registered query.

The texts restate the results relationally (unnested lines, windows, range
joins), not as the array folds of the Spark side, so that both can disagree.
Each named block is a CTE; ``sql`` collects the blocks a query needs.
"""

from __future__ import annotations

import re

from .. import fixed
from ..params import Params
from . import corpus

PARAMS = Params()
LIMITS = PARAMS.thresholds


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alt(words: list[str]) -> str:
    return "|".join(words)


def found(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {q(pattern)}))"


def group(column: str, pattern: str, number: int) -> str:
    return f"regexp_extract({column}, {q(pattern)}, {number})"


def swap(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(by)}, 'g')"


def word(words: list[str], flag: str = "") -> str:
    return rf"{flag}\b(?:{alt(words)})\b"


def text_of(values: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"


BLOCKS: dict[str, str] = {}

BLOCKS["corpus"] = corpus.corpus_sql()
BLOCKS["edited"] = corpus.corpus_sql(edited=True)


def _sources(table: str) -> str:
    names = [e for e in PARAMS.exclude if "*" not in e]
    return f"""
  SELECT repo, path, content,
    CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java'
         WHEN regexp_matches(path, '\\.tsx?$') THEN 'typescript' ELSE 'javascript' END AS language,
    regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AS is_script,
    regexp_matches(path, '(^|/)(__tests__|tests?)/') OR regexp_matches(path, '\\.(test|spec)\\.[jt]sx?$')
      OR regexp_matches(path, '(^|/)test_[^/]+\\.py$') OR path LIKE '%Test.java' AS is_test
  FROM {table}
  WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|py|java)$')
    AND len(list_filter(string_split(path, '/'), lambda s: starts_with(s, '.'))) = 0
    AND NOT list_has_any(string_split(path, '/'), [{", ".join(q(n) for n in names)}, '__pycache__'])
    AND path NOT LIKE '%.d.ts' AND path NOT LIKE '%.min.js'
    AND NOT list_contains(string_split(path, '/'), 'generated')
    AND NOT (path LIKE '%.gen.py' AND NOT regexp_matches(path, '(^|/)keep[^/]*\\.gen\\.py$'))
    AND NOT starts_with(path, 'docs/') AND NOT regexp_matches(path, '^packages/p[^/]*/build/')"""


def _lines(table: str) -> str:
    return f"""
  SELECT repo, path, language, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS n, len(parts) AS total
  FROM (SELECT repo, path, language, regexp_split_to_array(content, '\\r?\\n') AS parts
        FROM {table} WHERE NOT is_script)"""


PARAM_LIST = (
    "len(list_filter(string_split(params, ','), lambda p: NOT regexp_matches(p, '^\\s*(self)?\\s*$')))"
)
NORMAL = "sha1(trim({}))".format(
    swap(swap(swap(swap("body", r"#[^\n\r]*", ""), r"//[^\n\r]*", ""), r"(?s)/\*.*?\*/", ""), r"\s+", " ")
)
CONDITIONS = r"\b(?:" + alt(fixed.CONDITION_WORDS) + r")\b"
HTTP = word(fixed.HTTP_CLIENTS)
TRIES = word(fixed.TRY_WORDS)


def _python_spans(lines: str) -> str:
    return f"""
  WITH l AS (
    SELECT *, length(regexp_extract(line, '^\\s*')) AS indent, NOT regexp_matches(line, '\\S') AS blank
    FROM {lines} WHERE language = 'python'),
  s AS (
    SELECT repo, path, n, indent, total, {group('line', fixed.PYTHON_DEF, 2)} AS name,
           {group('line', fixed.PYTHON_DEF, 3)} AS params, line AS head,
           lead(n) OVER (PARTITION BY repo, path ORDER BY n) AS next_n
    FROM l WHERE {found('line', fixed.PYTHON_DEF)}),
  dedent AS (
    SELECT s.repo, s.path, s.n, min(l.n) AS low
    FROM s JOIN l ON l.repo = s.repo AND l.path = s.path AND l.n > s.n AND NOT l.blank AND l.indent <= s.indent
    GROUP BY ALL)
  SELECT s.repo, s.path, s.n AS start_line, s.name, {PARAM_LIST} AS parameter_count,
         regexp_matches(head, '\\basync\\b') AS is_async,
         least(coalesce(low - 1, total), coalesce(next_n - 1, total)) AS end_line
  FROM s LEFT JOIN dedent d ON d.repo = s.repo AND d.path = s.path AND d.n = s.n"""


JAVA_METHOD = (
    r"^\s*(?:(?:" + alt(fixed.JAVA_METHOD_MODIFIERS) + r")\s+)*(?:<[^>]+>\s*)?(?:[\w$.\[\]<>?,]+\s+)+"
    r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)\s*(?:throws\s+[^{}]+)?\{"
)
JAVA_CONSTRUCTOR = (
    r"^\s*(?:(?:" + alt(fixed.JAVA_CONSTRUCTOR_MODIFIERS) + r")\s+)?"
    r"([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)\s*(?:throws\s+[^{}]+)?\{"
)
JAVA_TYPE = r"\b(?:" + alt(fixed.JAVA_TYPE_WORDS) + r")\s+"


def _java_lines(lines: str) -> str:
    return f"""
  SELECT *, sum(delta) OVER (PARTITION BY repo, path ORDER BY n) - delta AS before,
         last_value(type_name IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY n) AS current_type
  FROM (SELECT *, length(replace(line, '}}', '')) - length(replace(line, '{{', '')) AS delta,
               nullif({group('line', JAVA_TYPE + '([A-Za-z_][A-Za-z0-9_]*)', 1)}, '') AS type_name,
               regexp_replace(line, {q(fixed.JAVA_ANNOTATIONS)}, '') AS text
        FROM {lines} WHERE language = 'java')"""


def _java_spans(java_lines: str) -> str:
    return f"""
  WITH heads AS (
    SELECT *, CASE WHEN {found('text', JAVA_TYPE)} THEN NULL
        WHEN {group('text', JAVA_CONSTRUCTOR, 1)} <> '' AND {group('text', JAVA_CONSTRUCTOR, 1)} = current_type
          THEN {{'name': current_type, 'params': {group('text', JAVA_CONSTRUCTOR, 2)}}}
        WHEN {found('text', JAVA_METHOD)}
             AND {group('text', JAVA_METHOD, 1)} NOT IN ({", ".join(q(w) for w in fixed.JAVA_NOT_METHODS)})
          THEN {{'name': {group('text', JAVA_METHOD, 1)}, 'params': {group('text', JAVA_METHOD, 2)}}} END AS head
    FROM {java_lines}),
  s AS (SELECT repo, path, n, before, total, line, head.name AS name, head.params AS params FROM heads
        WHERE head IS NOT NULL),
  ends AS (
    SELECT s.repo, s.path, s.n, min(l.n) AS end_line FROM s
    JOIN {java_lines} l ON l.repo = s.repo AND l.path = s.path AND l.n > s.n AND l.before + l.delta <= s.before
    GROUP BY ALL)
  SELECT s.repo, s.path, s.n AS start_line, s.name, {PARAM_LIST} AS parameter_count,
         regexp_matches(s.line, '\\basync\\b') AS is_async, coalesce(e.end_line, s.total) AS end_line
  FROM s LEFT JOIN ends e ON e.repo = s.repo AND e.path = s.path AND e.n = s.n"""


def _heuristic_functions(spans: str, lines: str, depth: str) -> str:
    return f"""
  SELECT f.repo, f.path, f.start_line, f.end_line, f.name, f.parameter_count, f.is_async,
         string_agg(l.line, chr(10) ORDER BY l.n) AS body,
         min(l.n) FILTER (WHERE {found('l.line', TRIES)}) AS first_try,
         {depth} AS max_depth
  FROM {spans} f JOIN {lines} l
    ON l.repo = f.repo AND l.path = f.path AND l.n BETWEEN f.start_line AND f.end_line
  GROUP BY ALL"""


def _finish_heuristic(bodies: str) -> str:
    return f"""
  SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY start_line) - 1 AS fn_ord,
         name, start_line, end_line, end_line - start_line + 1 AS line_count, parameter_count, is_async,
         first_try IS NOT NULL AS has_try, coalesce(end_line - first_try + 1, 0) AS try_lines,
         {count('body', CONDITIONS)} AS conditional_count, CAST(coalesce(max_depth, 0) AS BIGINT) AS max_depth,
         1 + {count('body', CONDITIONS)} + {count('body', r'&&|\|\||\band\b|\bor\b')} AS complexity,
         CAST(0 AS BIGINT) AS hook_count, {count('body', HTTP)} AS api_call_count, false AS returns_jsx,
         CASE WHEN end_line - start_line + 1 >= 8 THEN {NORMAL} END AS body_hash,
         contains(body, 'XMLHttpRequest') AS blob_request, {found('body', fixed.BLOB_READER_TYPE)} AS blob_type
  FROM {bodies}"""


# --- scripts --------------------------------------------------------------------------

NAME = r"[A-Za-z_$][\w$]*"
PIECES = (
    r"//[^\n]*|/\*(?s:.*?)\*/" r'|"(?:[^"\\\n]|\\.)*"' r"|'(?:[^'\\\n]|\\.)*'" r"|`(?:[^`\\]|\\(?s:.))*`"
    r"|[^\"'`/]+|(?s:.)"
)
IMPORT = r"""(?m)^[ \t]*import([\s*{][^"';()]*)?["']([^"'\n]+)["']"""
WORD = r"[A-Za-z_$\x{0080}-\x{FFFF}][\w$\x{0080}-\x{FFFF}]*"
TOKEN = rf'{WORD}|\d[\w.]*|=>|\?\.|\.\.\.|&&|\|\||\?\?|""|``|\S'
# What stands before a parenthesis and after its partner, tokens with blanks between.
CHAIN = rf"(?:^| )((?:{WORD} (?:\.|\?\.) )*{WORD})((?: <[^()=;{{}}]*>)?(?: \?\.)?)$"
FUNCTION = rf"(?:^| )(?:async )?function(?: \*)?(?: ({WORD}))?(?: <[^()]*>)?$"
METHOD = (
    r"(?:^| )((?:(?:public|private|protected|static|override|async|readonly|abstract|\*) )*)"
    rf"({WORD})(?: <[^()]*>)?$"
)
ASYNC_ARROW = r"(?:^| )(?:async(?: <[^()=;{}]*>)?|<[^()=;{}]*>)$"
RETURNS = r"(?:: (?:[\w$.]+ < )?\{[^{}]*\}(?: >)?(?: \[ \])* |: [^=(){};]+ )?"
TO_ARROW, TO_BLOCK = rf"^{RETURNS}=>", rf"^{RETURNS}\{{"
VARIABLE = rf"(?:^| )(?:const|let|var) ({WORD})(?: : (?:[^=;]|=>)*?)? =$"
PROPERTY = rf"(?:^|(?:^| )[{{,] )({WORD}) :$"
EXPRESSION = (
    r"(?:^| )(?:[(,=:?\[&|!+~]|=>|&&|\|\||\?\?|\.\.\.|return|await|yield|new|typeof|void|delete|in|of|case)$"
)
PLAIN_TYPE = r"=> (?:void|string|number|boolean|unknown|any|never|Promise < [^()]*>)(?: \[ \])*(?: [;,)|}=]|$)"
ENDED_TYPE = r"=> [\w$.]+(?: <[^()]*>)?(?: \[ \])* [;=]"
ALIAS = rf"(?:^| )type {WORD}(?: <[^()]*>)? =$"
NOT_METHODS = "'if','for','while','switch','catch','function','constructor','return','else','do','try','with','await'"
NOT_CALLED = (
    "'if','for','while','switch','catch','return','function','typeof','await','yield','delete','void','in','of','new','case',"
    "'do','else','throw','instanceof','with','async','constructor'"
)
def _flat(text: str, rounds: int = 6) -> str:
    for _ in range(rounds):
        text = swap(text, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    return swap(text, r"[(\[{].*", "")


# Per line: a list counts its items, a variable statement its commas that start another one, the rest 1.
EXPORTS = f"""greatest({count('code', r'(?m)^export' + chr(92) + 'b')}, CAST(list_sum(list_transform(
  regexp_extract_all(code, '(?m)^export\\b(?:\\s+(?:type\\s+)?\\{{[^{{}}]*\\}}|[^\\n]*)'), lambda e: CASE
    WHEN regexp_matches(e, '^export\\s*\\*\\s*from') THEN 0
    WHEN regexp_matches(e, '^export\\s+(?:type\\s+)?\\{{') THEN
      len(list_filter(string_split(regexp_extract(e, '\\{{([^{{}}]*)\\}}', 1), ','), lambda x: regexp_matches(x, '\\S')))
    WHEN regexp_matches(e, '^export\\s+(?:declare\\s+)?(?:const|let|var)\\s') THEN
      1 + len(regexp_extract_all(replace({_flat("regexp_extract(e, '^[^;]*')")}, '=>', '~'), {q(rf",\s*{NAME}\s*(?::[^=,;]+)?=[^=]")}))
    ELSE 1 END)) AS BIGINT))"""
DECISION = r"(?:^|[^\w$.])(?:if|for|while|case|switch)\b"
BRANCH = r"(?:^|[^\w$.])(?:if|switch)\b"
CATCH = r"(?:^|[^\w$.])catch\b"
TRY = r"(?:^|[^\w$.])try\s*\{"
TERNARY = r"\s\?\s"
LOGICAL = r"&&|\|\||\?\?"
MARKUP_OPEN = r"(?m)(?:^|[(\[{,;:?&|>=]|\breturn)\s*<(?:>|[A-Za-z][\w.]*(?:\s|/?>))"


def markup(column: str) -> str:
    return f"({found(column, MARKUP_OPEN)} AND {found(column, '</|/>')})"


def _script_text(table: str) -> str:
    pieces = f"regexp_extract_all(content, {q(PIECES)})"
    newline = "regexp_replace(p, '[^\\n]', '', 'g')"
    return f"""
  SELECT *, {swap('raw_code', r'>[^<>{}()=;\n]*</', '></')} AS code
  FROM (SELECT repo, path, content, language, is_test,
    array_to_string(list_transform(pieces, lambda p: CASE WHEN starts_with(p, '//') THEN ''
      WHEN starts_with(p, '/*') THEN {newline} ELSE p END), '') AS bare,
    array_to_string(list_transform(pieces, lambda p: CASE WHEN starts_with(p, '//') THEN ''
      WHEN starts_with(p, '/*') THEN {newline}
      WHEN starts_with(p, '`') AND length(p) > 1 THEN '``' || {newline}
      WHEN length(p) > 1 AND (starts_with(p, '"') OR starts_with(p, '''')) THEN '""' ELSE p END), '') AS raw_code
  FROM (SELECT *, {pieces} AS pieces FROM {table} WHERE is_script))"""


def _script_lines(texts: str) -> str:
    closers = swap(r"regexp_extract(code_line, '^[\s)\]};,]*')", r"[^)\]}]", "")
    return f"""
  SELECT *, sum(delta) OVER (PARTITION BY repo, path ORDER BY n) AS after,
         sum(delta) OVER (PARTITION BY repo, path ORDER BY n) - delta - closers AS low
  FROM (SELECT *, {count('code_line', r'[(\[{]')} - {count('code_line', r'[)\]}]')} AS delta,
               length({closers}) AS closers,
               {count('code_line', DECISION)} + {count('code_line', TERNARY)} AS decisions,
               regexp_matches(code_line, '^\\s*\\}}\\s*else\\s+if\\b') AS chained,
               regexp_matches(code_line, '^\\s*\\}}\\s*(?:catch|finally)\\b') AS continues,
               {found('code_line', TRY)} AS tries
        FROM (SELECT repo, path, language, unnest(c) AS code_line, unnest(b) AS bare_line,
                     unnest(range(1, len(c) + 1)) AS n, len(c) AS total
              FROM (SELECT repo, path, language, regexp_split_to_array(code, '\\r?\\n') AS c,
                           regexp_split_to_array(bare, '\\r?\\n') AS b FROM {texts})))"""


def _bindings(texts: str) -> str:
    plain = swap("clause", r"(^|[\s,{])type\s+", r"\1")
    return f"""
  SELECT repo, path, local, max_by(module, place) AS module FROM (
    SELECT repo, path, module, place, unnest(list_concat(
      [{group('c', rf'^\s*({NAME})\s*(?:,|from\b)', 1)}, {group('c', rf'\*\s*as\s+({NAME})', 1)}],
      list_transform(string_split({group('c', r'\{([^{}]*)\}', 1)}, ','),
                     lambda i: {group('i', rf'({NAME})\s*$', 1)}))) AS local
    FROM (SELECT repo, path, module, place, {plain} AS c FROM (
      SELECT repo, path, unnest(regexp_extract_all(bare, {q(IMPORT)}, 1)) AS clause,
             unnest(regexp_extract_all(bare, {q(IMPORT)}, 2)) AS module,
             unnest(range(0, {count('bare', IMPORT)})) AS place FROM {texts})))
  WHERE local <> '' GROUP BY ALL"""


def _words(text: str) -> str:
    return f"CASE WHEN trim({text}) = '' THEN 0 ELSE len(string_split(trim({text}), ' ')) END"


def _tokens(lines: str) -> str:
    return f"""
  SELECT repo, path, n, t, row_number() OVER (PARTITION BY repo, path ORDER BY n, k) - 1 AS p
  FROM (SELECT repo, path, n, unnest(x) AS t, unnest(range(0, len(x))) AS k
        FROM (SELECT repo, path, n, regexp_extract_all(code_line, {q(TOKEN)}) AS x FROM {lines}))"""


def _brackets(tokens: str) -> str:
    """Partners are neighbours of one level, the opener around a bracket is the last one of the level above."""
    return f"""
  WITH levels AS (
    SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w + CASE WHEN opens THEN 0 ELSE 1 END AS level
    FROM (SELECT *, t IN ('(', '[', '{{') AS opens FROM {tokens} WHERE t IN ('(', ')', '[', ']', '{{', '}}'))
    WINDOW w AS (PARTITION BY repo, path ORDER BY p)),
  paired AS (
    SELECT *, CASE WHEN opens AND NOT lead(opens) OVER v THEN lead(p) OVER v WHEN NOT opens AND lag(opens) OVER v THEN lag(p) OVER v END AS partner
    FROM levels WINDOW v AS (PARTITION BY repo, path, level ORDER BY p))
  SELECT b.*, o.p AS up, o.t AS up_sign, o.partner AS up_partner FROM paired b
  ASOF LEFT JOIN (SELECT * FROM paired WHERE opens) o ON o.repo = b.repo AND o.path = b.path AND o.level = b.level - 1 AND o.p < b.p"""


def _parens(streams: str, brackets: str) -> str:
    return f"""
  SELECT b.repo, b.path, b.p, b.partner AS q, b.level, b.up, b.up_sign, b.up_partner, texts, numbers,
    array_to_string(texts[greatest(b.p - 39, 1) : b.p], ' ') AS before, array_to_string(texts[b.partner + 2 : b.partner + 25], ' ') AS after
  FROM {brackets} b JOIN {streams} s ON s.repo = b.repo AND s.path = b.path WHERE b.t = '(' AND b.partner IS NOT NULL"""


def _steps(streams: str, brackets: str) -> str:
    """Closing brackets after which the expression goes on, and the end of its next pair."""
    return f"""
  SELECT c.repo, c.path, c.p, f.partner AS further FROM {brackets} c
  ASOF JOIN {brackets} f ON f.repo = c.repo AND f.path = c.path AND f.p > c.p
  JOIN {streams} s ON s.repo = c.repo AND s.path = c.path
  WHERE NOT c.opens AND f.opens AND f.partner IS NOT NULL AND NOT list_has_any(texts[c.p + 2 : f.p], [',', ';', '=>'])
    AND (numbers[c.p + 2] = c.n OR texts[c.p + 2] IN ('.', '?.', '&&', '||', '??', '?', ':', '+'))"""


def _reach(steps: str, brackets: str) -> str:
    """For every closing bracket the end of the expression it stands in."""
    return f"""
  WITH RECURSIVE walk(repo, path, p, last) AS (
    SELECT repo, path, p, p FROM {brackets} WHERE NOT opens
    UNION ALL SELECT w.repo, w.path, w.p, s.further FROM walk w JOIN {steps} s ON s.repo = w.repo AND s.path = w.path AND s.p = w.last)
  SELECT repo, path, p, max(last) AS last FROM walk GROUP BY ALL"""


def _heads(parens: str, brackets: str, reach: str, tokens: str, streams: str) -> str:
    """Functions and function types with the places of their first and last token."""
    strip = lambda text, pattern: f"rtrim(regexp_replace({text}, {q(pattern)}, ''))"
    first = lambda column, pattern: f"regexp_extract({column}, {q(pattern)})"
    follows = "array_to_string(texts[up_partner + 2 : up_partner + 25], ' ')"
    around = "array_to_string(texts[greatest(up - 39, 1) : up], ' ')"
    return f"""
  WITH read AS (
    SELECT *, {first('before', FUNCTION)} AS fn, {first('after', TO_ARROW)} AS ta, {first('after', TO_BLOCK)} AS tb,
      {first('before', METHOD)} AS me, {group('before', METHOD, 2)} AS me_name, {first('before', ASYNC_ARROW)} AS tail FROM {parens}),
  shaped AS (
    SELECT *, q + {_words('ta')} AS arrow, CASE
        WHEN fn <> '' THEN 'function' WHEN ta <> '' THEN 'arrow'
        WHEN tb <> '' AND me <> '' AND me_name NOT IN ({NOT_METHODS}) AND up_sign = '{{'
          AND NOT {found('before', rf"(?:^| )[gs]et {WORD}$")} THEN 'method' END AS shape FROM read),
  typed AS (
    SELECT *, shape = 'arrow' AND coalesce({found("substr(after, length(ta) - 1)", "^" + PLAIN_TYPE)}
        OR (texts[arrow + 2] IN ('void', 'string', 'number', 'boolean', 'unknown', 'any', 'never') AND numbers[arrow + 3] > numbers[arrow + 2])
        OR {found('before', ALIAS)}
        OR (texts[p] = ':' AND ({found("substr(after, length(ta) - 1)", "^" + ENDED_TYPE)}
          OR (up_sign = '(' AND ({found(follows, TO_ARROW)} OR {found(follows, TO_BLOCK)} OR {found(around, FUNCTION)})))), false) AS is_type
    FROM shaped WHERE shape IS NOT NULL),
  places AS (
    SELECT repo, path, p, arrow, shape, is_type, texts, numbers,
      p - CASE shape WHEN 'function' THEN {_words('fn')} WHEN 'arrow' THEN {_words('tail')} ELSE {_words('me')} END AS start_p,
      CASE shape WHEN 'function' THEN CASE WHEN tb <> '' THEN q + {_words('tb')} END WHEN 'method' THEN q + {_words('tb')} END AS block,
      CASE WHEN shape = 'function' AND tb = '' THEN q END AS plain_end,
      CASE shape WHEN 'function' THEN {strip('before', FUNCTION)} WHEN 'arrow' THEN {strip('before', ASYNC_ARROW)} ELSE '' END AS stem,
      CASE shape WHEN 'function' THEN {group('before', FUNCTION, 1)} WHEN 'method' THEN me_name ELSE '' END AS own,
      CASE shape WHEN 'function' THEN starts_with(trim(fn), 'async') WHEN 'arrow' THEN starts_with(trim(tail), 'async')
        ELSE list_contains(string_split({group('before', METHOD, 1)}, ' '), 'async') END AS is_async
    FROM typed),
  singles AS (
    SELECT t.repo, t.path, NULL AS p, t.p AS arrow, 'arrow' AS shape, false AS is_type, texts, numbers,
      t.p - 1 - CASE WHEN texts[t.p - 1] = 'async' THEN 1 ELSE 0 END AS start_p, NULL AS block, NULL AS plain_end,
      {strip("array_to_string(texts[greatest(t.p - 40, 1) : t.p - 1], ' ')", "(?:^| )async$")} AS stem, '' AS own,
      coalesce(texts[t.p - 1] = 'async', false) AS is_async
    FROM {tokens} t JOIN {streams} s ON s.repo = t.repo AND s.path = t.path
    ANTI JOIN (SELECT repo, path, arrow FROM places WHERE shape = 'arrow') a ON a.repo = t.repo AND a.path = t.path AND a.arrow = t.p
    WHERE t.t = '=>' AND {found('texts[t.p]', f"^{WORD}$")} AND coalesce(texts[t.p - 1], '') NOT IN ('.', '|', '&', 'is', 'extends')),
  every AS (SELECT * FROM places UNION ALL SELECT * FROM singles),
  ended AS (
    SELECT e.*, b.p AS next_p, b.opens AS next_opens, b.partner AS next_partner, b.t AS next_sign, r.last AS next_last, k.partner AS block_end
    FROM every e
    ASOF LEFT JOIN {brackets} b ON b.repo = e.repo AND b.path = e.path AND b.p > e.arrow
    LEFT JOIN {reach} r ON r.repo = e.repo AND r.path = e.path AND r.p = b.partner
    LEFT JOIN {brackets} k ON k.repo = e.repo AND k.path = e.path AND k.p = e.block),
  closed AS (
    SELECT *, CASE WHEN shape <> 'arrow' THEN CASE WHEN block IS NOT NULL THEN block_end ELSE plain_end END
      WHEN next_opens AND next_p = arrow + 1 AND next_partner IS NULL THEN NULL
      WHEN next_sign = '{{' AND next_p = arrow + 1 THEN next_partner
      WHEN next_opens AND next_partner IS NOT NULL AND NOT list_has_any(texts[arrow + 2 : next_p], [',', ';']) THEN next_last
      ELSE least(arrow + 1, len(texts) - 1) END AS last_p FROM ended)
  SELECT repo, path, p, start_p, coalesce(last_p, len(texts)) AS end_p, is_type, is_async, numbers[start_p + 1] AS start_line, numbers[last_p + 1] AS last_line,
    CASE WHEN {group('stem', VARIABLE, 1)} <> '' THEN 'variable' WHEN {group('stem', PROPERTY, 1)} <> '' THEN 'property' ELSE 'own' END AS kind,
    CASE WHEN {group('stem', VARIABLE, 1)} <> '' THEN {group('stem', VARIABLE, 1)} WHEN {group('stem', PROPERTY, 1)} <> '' THEN {group('stem', PROPERTY, 1)}
      WHEN {found('stem', EXPRESSION)} THEN '' ELSE own END AS plain_name
  FROM closed"""


def _calls(parens: str, brackets: str, heads: str, bindings: str) -> str:
    names = ", ".join(q(n) for n in fixed.NETWORK_NAMES)
    client = rf"(?i)^(?:{alt(fixed.CLIENT_NAMES)})$"
    compact = swap("array_to_string(texts[root_p + 1 : p - words_after], ' ')", r" ?([^\w $]+) ?", r"\1")
    return f"""
  WITH RECURSIVE read AS (
    SELECT repo, path, p, texts, numbers, {group('before', CHAIN, 1)} AS chain, {_words(group('before', CHAIN, 2))} AS words_after,
      p - {_words(f"regexp_extract(before, {q(CHAIN)})")} AS first_p FROM {parens}),
  chained AS (
    SELECT r.*, texts[first_p] AS previous, coalesce(texts[first_p] IN ('.', '?.'), false) AS on_result, split_part(chain, ' ', 1) AS head, b.partner AS link
    FROM read r LEFT JOIN {brackets} b ON b.repo = r.repo AND b.path = r.path AND b.p = r.first_p - 2 AND b.t = ')' AND texts[first_p] IN ('.', '?.')
    WHERE chain <> ''),
  linked AS (
    SELECT c.* REPLACE (o.p AS link) FROM chained c LEFT JOIN chained o ON o.repo = c.repo AND o.path = c.path AND o.p = c.link),
  walk(repo, path, p, receiver, root_p) AS (
    SELECT repo, path, p, CASE WHEN on_result OR head IN ('this', 'super') OR coalesce(previous = 'new', false) THEN '' ELSE head END, first_p
    FROM linked WHERE link IS NULL
    UNION ALL SELECT l.repo, l.path, l.p, w.receiver, w.root_p FROM walk w JOIN linked l ON l.repo = w.repo AND l.path = w.path AND l.link = w.p),
  listed AS (
    SELECT l.*, w.receiver, w.root_p, split_part(chain, ' ', -1) AS method, on_result OR contains(chain, ' ') AS dotted
    FROM linked l JOIN walk w ON w.repo = l.repo AND w.path = l.path AND w.p = l.p
    ANTI JOIN (SELECT repo, path, p FROM {heads} WHERE p IS NOT NULL) h ON h.repo = l.repo AND h.path = l.path AND h.p = l.p
    WHERE chain NOT IN ({NOT_CALLED}) AND coalesce(previous, '') NOT IN ('new', 'get', 'set')),
  named AS (
    SELECT repo, path, p, p AS place, numbers[root_p + 1] AS n, nullif(receiver, '') AS receiver, method, dotted,
      CASE WHEN NOT on_result THEN replace(chain, ' ', '') WHEN receiver <> '' THEN {compact} ELSE '.' || replace(chain, ' ', '') END AS expression
    FROM listed)
  SELECT c.*, b.module, CASE
      WHEN c.receiver IS NULL THEN NULL
      WHEN NOT dotted THEN CASE WHEN receiver IN ({names}) THEN 'network-call'
        WHEN {found('module', fixed.SERVICE_MODULE)} THEN 'service-call'
        WHEN receiver IN ({", ".join(q(n) for n in fixed.DATA_HOOK_NAMES)}) THEN 'data-hook' END
      WHEN method IN ('then', 'catch', 'finally') THEN NULL
      WHEN receiver = 'supabase' THEN CASE WHEN method <> 'from' THEN 'client-call' END
      WHEN receiver IN ('axios', 'ky') THEN 'network-call'
      WHEN {found('module', fixed.SERVICE_MODULE)} THEN 'service-call'
      WHEN method IN ({", ".join(q(n) for n in fixed.HTTP_VERBS)})
        AND ({found('receiver', client)} OR coalesce({found('module', fixed.CLIENT_MODULE)}, false)) THEN 'client-call' END AS kind
  FROM named c LEFT JOIN {bindings} b ON b.repo = c.repo AND b.path = c.path AND b.local = c.receiver"""


def _script_spans(heads: str, lines: str, brackets: str, tokens: str) -> str:
    """Functions with their lines, and parameters counted from the tokens right inside the parentheses."""
    angled = "replace(inside, '=>', '~')"
    for _ in range(3):
        angled = swap(angled, "<[^<>]*>", "x")
    return f"""
  WITH sizes AS (SELECT repo, path, max(n) AS total FROM {lines} GROUP BY ALL),
  own_tokens AS (
    SELECT t.repo, t.path, t.p, t.t, CASE WHEN k.p IS NOT NULL THEN k.up WHEN b.opens THEN b.p ELSE b.up END AS inside_of
    FROM {tokens} t LEFT JOIN {brackets} k ON k.repo = t.repo AND k.path = t.path AND k.p = t.p
    ASOF LEFT JOIN {brackets} b ON b.repo = t.repo AND b.path = t.path AND b.p < t.p),
  listed AS (
    SELECT h.repo, h.path, h.p, string_agg(t.t, ' ' ORDER BY t.p) AS inside FROM {heads} h
    JOIN own_tokens t ON t.repo = h.repo AND t.path = h.path AND t.inside_of = h.p GROUP BY ALL)
  SELECT h.repo, h.path, h.start_p, h.end_p, h.start_line, coalesce(h.last_line, s.total) AS end_line, h.is_async, h.kind, h.plain_name,
    CASE WHEN h.plain_name = '' THEN 'anonymous_line_' || h.start_line ELSE h.plain_name END AS name,
    CASE WHEN h.p IS NULL THEN 1 ELSE len(list_filter(string_split(coalesce({angled}, ''), ','), lambda x: regexp_matches(x, '\\S'))) END AS parameter_count,
    row_number() OVER (PARTITION BY h.repo, h.path ORDER BY h.start_p, h.end_p) - 1 AS fn_ord
  FROM {heads} h JOIN sizes s ON s.repo = h.repo AND s.path = h.path
  LEFT JOIN listed l ON l.repo = h.repo AND l.path = h.path AND l.p = h.p WHERE NOT h.is_type"""


def _script_functions(spans: str, lines: str, calls: str) -> str:
    inside = "l.repo = f.repo AND l.path = f.path AND l.n BETWEEN f.start_line AND f.end_line"
    quoted = r"replace(plain_name, '$', '\$')"
    variable = rf"'^.*?(?:const|let|var)\s+' || {quoted} || '(?:\s*:(?:[^=;]|=>)*)?\s*=\s*'"
    prop = rf"'^(?:.*?[\s{{,])?' || {quoted} || '\s*:\s*'"
    strip = swap(swap(swap("hashed", r"//[^\n\r]*", ""), r"(?s)/\*.*?\*/", ""), r"\s+", " ")
    return f"""
  WITH deaths AS (
    SELECT p.repo, p.path, p.n, p.low, min(x.n) AS death FROM {lines} p
    LEFT JOIN {lines} x ON x.repo = p.repo AND x.path = p.path AND x.n > p.n AND NOT x.chained AND x.low <= p.low
    WHERE p.decisions > 0 AND p.after > p.low GROUP BY ALL),
  levels AS (
    SELECT f.repo, f.path, f.fn_ord, l.n, any_value(l.decisions) + count(d.n) AS level
    FROM {spans} f JOIN {lines} l ON {inside} AND l.decisions > 0
    LEFT JOIN deaths d ON d.repo = f.repo AND d.path = f.path AND d.n >= f.start_line AND d.n < l.n
      AND (d.death IS NULL OR d.death > l.n OR (d.death = l.n AND l.chained))
    GROUP BY ALL),
  deepest AS (SELECT repo, path, fn_ord, max(level) AS max_depth FROM levels GROUP BY ALL),
  try_ends AS (
    SELECT p.repo, p.path, p.n, CASE WHEN p.after <= p.low THEN p.n ELSE min(x.n) END AS last FROM {lines} p
    LEFT JOIN {lines} x ON x.repo = p.repo AND x.path = p.path AND x.n > p.n AND NOT x.continues AND x.low <= p.low
    WHERE p.tries GROUP BY p.repo, p.path, p.n, p.after, p.low),
  try_sums AS (
    SELECT f.repo, f.path, f.fn_ord, sum(least(coalesce(t.last, f.end_line), f.end_line) - t.n + 1) AS try_lines
    FROM {spans} f JOIN try_ends t ON t.repo = f.repo AND t.path = f.path AND t.n BETWEEN f.start_line AND f.end_line
    GROUP BY ALL),
  call_sums AS (
    SELECT f.repo, f.path, f.fn_ord, count(*) FILTER (WHERE l.kind IS NOT NULL) AS api_call_count,
           count(*) FILTER (WHERE {found('l.expression', '^use[A-Z0-9]')} OR contains(l.expression, '.use')) AS hook_count
    FROM {spans} f JOIN {calls} l ON l.repo = f.repo AND l.path = f.path AND l.p BETWEEN f.start_p AND f.end_p GROUP BY ALL),
  bodies AS (
    SELECT f.repo, f.path, f.fn_ord, f.start_line, f.end_line, f.name, f.plain_name, f.kind, f.is_async, f.parameter_count,
           string_agg(l.code_line, chr(10) ORDER BY l.n) AS body,
           list(l.bare_line ORDER BY l.n) AS bare
    FROM {spans} f JOIN {lines} l ON {inside} GROUP BY ALL),
  hashing AS (
    SELECT *, array_to_string(list_concat(list_concat(
        [CASE kind WHEN 'variable' THEN regexp_replace(bare[1], {variable}, '') WHEN 'property' THEN regexp_replace(bare[1], {prop}, '') ELSE bare[1] END],
        bare[2:len(bare) - 1]),
        [CASE WHEN regexp_extract(bare[-1], '^\\s*\\}}') <> '' THEN regexp_extract(bare[-1], '^\\s*\\}}') ELSE bare[-1] END]),
        chr(10)) AS hashed
    FROM bodies)
  SELECT h.repo, h.path, h.fn_ord, h.name, h.start_line, h.end_line, h.end_line - h.start_line + 1 AS line_count, h.parameter_count,
    h.is_async, {found('body', TRY)} AS has_try, CAST(coalesce(t.try_lines, 0) AS BIGINT) AS try_lines,
    {count('body', BRANCH)} + {count('body', TERNARY)} AS conditional_count, coalesce(d.max_depth, 0) AS max_depth,
    1 + {count('body', DECISION)} + {count('body', TERNARY)} + {count('body', CATCH)} + {count('body', LOGICAL)} AS complexity,
    coalesce(c.hook_count, 0) AS hook_count, coalesce(c.api_call_count, 0) AS api_call_count,
    {markup('body')} AS returns_jsx,
    CASE WHEN h.end_line - h.start_line + 1 >= 8 THEN sha1(trim({strip})) END AS body_hash,
    contains(hashed, 'XMLHttpRequest') AS blob_request, {found('hashed', fixed.BLOB_READER_TYPE)} AS blob_type
  FROM hashing h
  LEFT JOIN deepest d ON d.repo = h.repo AND d.path = h.path AND d.fn_ord = h.fn_ord
  LEFT JOIN try_sums t ON t.repo = h.repo AND t.path = h.path AND t.fn_ord = h.fn_ord
  LEFT JOIN call_sums c ON c.repo = h.repo AND c.path = h.path AND c.fn_ord = h.fn_ord"""


# --- tags, metrics, signals ------------------------------------------------------------


def _heuristic_tags(table: str) -> str:
    any_case = "(?i)"
    rules = {
        "auth": found("t", word(fixed.TAG_AUTH_WORDS, any_case)),
        "business-logic": f"({found('t', word(fixed.TAG_LOGIC_WORDS))} OR (language = 'java' AND {found('t', chr(92) + 'b' + fixed.TAG_LOGIC_JAVA_CLASS)}))",
        "data-fetching": found("t", HTTP),
        "database": f"({found('t', word(fixed.TAG_DATABASE_WORDS, any_case))} OR {found('t', '@(' + alt(fixed.TAG_DATABASE_ANNOTATIONS) + ')' + chr(92) + 'b')})",
        "routing": f"({found('t', word(fixed.TAG_ROUTING_WORDS))} OR {found('t', fixed.TAG_ROUTING_DECORATOR)})",
        "testing": "is_test",
        "validation": found("t", word(fixed.TAG_VALIDATION_WORDS, any_case)),
    }
    cases = ", ".join(f"CASE WHEN {rule} THEN {q(tag)} END" for tag, rule in rules.items())
    stripped = (
        f"CASE WHEN language = 'python' THEN {swap('content', '#[^' + chr(92) + 'n' + chr(92) + 'r]*', '')} ELSE "
        + swap(swap("content", r"//[^\n\r]*", ""), r"(?s)/\*.*?\*/", "") + " END"
    )
    return f"""
  SELECT repo, path, list_filter([{cases}], lambda x: x IS NOT NULL) AS tags
  FROM (SELECT *, {stripped} AS t FROM {table} WHERE NOT is_script)"""


def _script_tags(texts: str, calls: str) -> str:
    b = chr(92) + "b"
    any_case = "(?i)"
    pair = lambda words, starts, flag="": f"({found('content', word(words, flag))} OR {found('content', flag + b + '(?:' + alt(starts) + ')' + b)})"  # noqa: E731,E501
    rules = {
        "auth": found("content", word(fixed.SCRIPT_AUTH_WORDS, any_case)),
        "business-logic": f"({found('code', r'(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?function' + b)} OR {found('lower(content)', word(fixed.SCRIPT_LOGIC_WORDS))})",
        "data-fetching": "call_count > 0",
        "database": pair(fixed.SCRIPT_DATABASE_WORDS, fixed.SCRIPT_DATABASE_PREFIXES, any_case),
        "routing": pair(fixed.SCRIPT_ROUTING_WORDS, fixed.SCRIPT_ROUTING_PREFIXES),
        "state": found("content", word(fixed.SCRIPT_STATE_WORDS)),
        "styling": pair(fixed.SCRIPT_STYLING_WORDS, fixed.SCRIPT_STYLING_PREFIXES),
        "testing": "is_test",
        "ui": f"(regexp_matches(path, '\\.(tsx|jsx)$') OR {markup('code')})",
        "validation": found("content", word(fixed.SCRIPT_VALIDATION_WORDS, any_case)),
    }
    cases = ", ".join(f"CASE WHEN {rule} THEN {q(tag)} END" for tag, rule in rules.items())
    return f"""
  SELECT t.repo, t.path, list_filter([{cases}], lambda x: x IS NOT NULL) AS tags
  FROM (SELECT s.*, coalesce(c.call_count, 0) AS call_count FROM {texts} s
        LEFT JOIN (SELECT repo, path, count(*) AS call_count FROM {calls} WHERE kind IS NOT NULL GROUP BY ALL) c
        USING (repo, path)) t"""


LINE_COUNT = "CASE WHEN regexp_matches({0}, '\\S') THEN len(regexp_split_to_array({0}, '\\r?\\n')) ELSE 0 END"
MARKERS = r"(?i)\b(?:TODO|FIXME|HACK)\b"


def _imports(sources: str, lines: str, texts: str) -> str:
    python = fixed.PYTHON_IMPORT_SOURCE
    return f"""
  SELECT repo, path, n AS place, coalesce(nullif({group('line', python, 1)}, ''), {group('line', python, 2)}) AS source
  FROM {lines} WHERE language = 'python' AND {found('line', python)}
  UNION ALL
  SELECT repo, path, n, {group('line', fixed.JAVA_IMPORT_SOURCE, 1)} FROM {lines}
  WHERE language = 'java' AND {found('line', fixed.JAVA_IMPORT_SOURCE)}
  UNION ALL
  SELECT repo, path, unnest(range(0, {count('bare', IMPORT)})), unnest(regexp_extract_all(bare, {q(IMPORT)}, 2)) FROM {texts}"""


def _metrics(p: str) -> str:
    """Metric rows; ``p`` is the prefix of the corpus version."""
    return f"""
  WITH of_functions AS (
    SELECT repo, path, count(*) AS function_count, sum(complexity) AS complexity,
           count(*) FILTER (WHERE returns_jsx AND regexp_matches(name, '^[A-Z]')) AS component_count
    FROM {p}functions GROUP BY ALL),
  of_lines AS (
    SELECT repo, path,
      count(*) FILTER (WHERE CASE language WHEN 'python' THEN {found('line', fixed.PYTHON_IMPORT_LINE)}
                             ELSE {found('line', fixed.JAVA_IMPORT_SOURCE)} END) AS imports,
      count(*) FILTER (WHERE CASE language WHEN 'python' THEN {found('line', fixed.PYTHON_EXPORT_LINE)}
                             ELSE {found('line', fixed.JAVA_EXPORT_LINE)} END) AS exports
    FROM {p}lines GROUP BY ALL),
  of_scripts AS (
    SELECT repo, path, {count('bare', IMPORT)} AS imports, {EXPORTS} AS exports,
           {markup('code')} AS has_markup, {found('content', r'\bstyle=\{\{')} AS inline_styles FROM {p}texts),
  of_calls AS (
    SELECT repo, path, count(*) FILTER (WHERE kind IS NOT NULL) AS call_count,
           bool_and(kind = 'service-call') FILTER (WHERE kind IS NOT NULL) AS only_services,
           count(*) FILTER (WHERE {found('expression', '^use[A-Z0-9]')} OR contains(expression, '.use')) AS hook_count
    FROM {p}calls GROUP BY ALL),
  stored AS (
    SELECT repo, path, bool_and(kind = 'service-call') AS stored_services FROM (
      SELECT repo, path, kind, row_number() OVER (PARTITION BY repo, path ORDER BY n, place) AS rn
      FROM {p}calls WHERE kind IS NOT NULL) WHERE rn <= 8 GROUP BY ALL),
  joined AS (
    SELECT s.repo, s.path, s.language, s.is_script, s.is_test, s.content,
      {LINE_COUNT.format('s.content')} AS line_count, {count('s.content', MARKERS)} AS todo_count,
      coalesce(l.imports, x.imports, 0) AS import_count, coalesce(l.exports, x.exports, 0) AS export_count,
      coalesce(f.function_count, 0) AS function_count, coalesce(f.component_count, 0) AS component_count,
      coalesce(f.complexity, 0) AS function_complexity, coalesce(c.hook_count, 0) AS hook_count,
      coalesce(c.call_count, 0) AS call_count, coalesce(c.only_services, true) AS only_services,
      coalesce(st.stored_services, true) AS stored_services,
      coalesce(x.has_markup, false) AS has_markup, coalesce(x.inline_styles, false) AS inline_styles, t.tags
    FROM {p}sources s JOIN {p}tags t USING (repo, path) LEFT JOIN of_functions f USING (repo, path)
    LEFT JOIN of_lines l USING (repo, path) LEFT JOIN of_scripts x USING (repo, path)
    LEFT JOIN of_calls c USING (repo, path) LEFT JOIN stored st USING (repo, path))
  SELECT * EXCLUDE (content), sha256(content) AS content_hash, array_to_string(tags, ', ') AS tag_text,
         CAST(function_complexity + line_count // 100 + 2 * greatest(0, len(tags) - 2) AS BIGINT) AS complexity_score
  FROM joined"""


def complex_condition(prefix: str = "") -> str:
    return (
        f"({prefix}line_count >= {LIMITS.complex_function_lines} OR {prefix}complexity >= "
        f"{LIMITS.complex_function_complexity} OR {prefix}parameter_count > {LIMITS.max_function_params} "
        f"OR {prefix}max_depth >= {fixed.DEEP_NESTING})"
    )


def _signals(p: str) -> str:
    return f"""
  SELECT repo, path, 1 AS rule, 0 AS fn_ord, 'large-file' AS type, 'File has ' || line_count || ' lines.' AS message,
         CASE WHEN line_count >= 450 THEN 'high' ELSE 'medium' END AS severity, NULL::BIGINT AS line, NULL AS fn_name
  FROM {p}metrics WHERE line_count >= 300
  UNION ALL SELECT repo, path, 2, 0, 'todo-comments', 'File contains ' || todo_count || ' TODO/FIXME/HACK comment'
         || CASE WHEN todo_count = 1 THEN '' ELSE 's' END || '.', CASE WHEN todo_count >= 3 THEN 'medium' ELSE 'low' END, NULL, NULL
  FROM {p}metrics WHERE todo_count > 0
  UNION ALL SELECT repo, path, 3, 0, 'mixed-responsibilities', 'File appears to combine ' || tag_text || ' responsibilities.',
         CASE WHEN len(tags) >= 5 THEN 'high' ELSE 'medium' END, NULL, NULL FROM {p}metrics WHERE len(tags) >= 4
  UNION ALL SELECT repo, path, 4, 0, 'too-many-hooks', 'React file uses ' || hook_count || ' hooks.',
         CASE WHEN hook_count > 12 THEN 'high' ELSE 'medium' END, NULL, NULL FROM {p}metrics WHERE hook_count > 8 AND has_markup
  UNION ALL SELECT repo, path, 5, 0, 'api-calls-in-ui', CASE WHEN only_services
         THEN 'UI file calls data/service functions directly.'
         ELSE 'UI file appears to perform network or client calls directly.' END, 'medium', NULL, NULL
  FROM {p}metrics WHERE has_markup AND call_count > 0
  UNION ALL SELECT repo, path, 6, 0, 'inline-styles', 'File contains inline style objects.', 'low', NULL, NULL
  FROM {p}metrics WHERE inline_styles
  UNION ALL SELECT repo, path, 7, 3 * fn_ord, 'complex-function',
         name || ' is complex (' || line_count || ' lines, complexity ' || complexity || ').',
         CASE WHEN complexity >= 18 THEN 'high' ELSE 'medium' END, start_line, name
  FROM {p}functions WHERE {complex_condition()}
  UNION ALL SELECT f.repo, f.path, 7, 3 * fn_ord + 1, 'large-try-catch', name || ' has a large try/catch block.', 'medium',
         start_line, name FROM {p}functions f JOIN {p}sources s USING (repo, path) WHERE s.is_script AND try_lines >= 40
  UNION ALL SELECT f.repo, f.path, 7, 3 * fn_ord + 2, 'async-without-error-handling',
         name || ' performs async work without obvious try/catch error handling.', 'medium', start_line, name
  FROM {p}functions f JOIN {p}sources s USING (repo, path)
  WHERE s.is_script AND is_async AND api_call_count > 0 AND NOT has_try"""


for _prefix, _table in (("", "corpus"), ("e_", "edited")):
    _p = _prefix
    BLOCKS[_p + "sources"] = _sources(_table)
    BLOCKS[_p + "lines"] = _lines(_p + "sources")
    BLOCKS[_p + "python_spans"] = _python_spans(_p + "lines")
    BLOCKS[_p + "python_bodies"] = _heuristic_functions(
        _p + "python_spans", _p + "lines",
        f"max(length(regexp_extract(l.line, '^\\s*')) // 2) FILTER (WHERE {found('l.line', word(fixed.PYTHON_BRANCH_WORDS))})",
    )
    BLOCKS[_p + "python_functions"] = _finish_heuristic(_p + "python_bodies")
    BLOCKS[_p + "java_lines"] = _java_lines(_p + "lines")
    BLOCKS[_p + "java_spans"] = _java_spans(_p + "java_lines")
    BLOCKS[_p + "java_starts"] = f"SELECT f.*, l.before AS base FROM {_p}java_spans f JOIN {_p}java_lines l ON l.repo = f.repo AND l.path = f.path AND l.n = f.start_line"
    BLOCKS[_p + "java_bodies"] = _heuristic_functions(
        _p + "java_starts", _p + "java_lines",
        f"greatest(0, max(l.before - f.base + 1) FILTER (WHERE {found('l.line', word(fixed.JAVA_BRANCH_WORDS))}))",
    )
    BLOCKS[_p + "java_functions"] = _finish_heuristic(_p + "java_bodies")
    BLOCKS[_p + "texts"] = _script_text(_p + "sources")
    BLOCKS[_p + "script_lines"] = _script_lines(_p + "texts")
    BLOCKS[_p + "bindings"] = _bindings(_p + "texts")
    BLOCKS[_p + "script_tokens"] = _tokens(_p + "script_lines")
    BLOCKS[_p + "script_streams"] = f"SELECT repo, path, list(t ORDER BY p) AS texts, list(n ORDER BY p) AS numbers FROM {_p}script_tokens GROUP BY ALL"
    BLOCKS[_p + "script_brackets"] = _brackets(_p + "script_tokens")
    BLOCKS[_p + "script_parens"] = _parens(_p + "script_streams", _p + "script_brackets")
    BLOCKS[_p + "script_steps"] = _steps(_p + "script_streams", _p + "script_brackets")
    BLOCKS[_p + "script_reach"] = _reach(_p + "script_steps", _p + "script_brackets")
    BLOCKS[_p + "script_heads"] = _heads(*(_p + f"script_{x}" for x in ("parens", "brackets", "reach", "tokens", "streams")))
    BLOCKS[_p + "calls"] = _calls(_p + "script_parens", _p + "script_brackets", _p + "script_heads", _p + "bindings")
    BLOCKS[_p + "script_spans"] = _script_spans(*(_p + f"script_{x}" for x in ("heads", "lines", "brackets", "tokens")))
    BLOCKS[_p + "script_functions"] = _script_functions(_p + "script_spans", _p + "script_lines", _p + "calls")
    BLOCKS[_p + "functions"] = (
        f"SELECT * FROM {_p}python_functions UNION ALL BY NAME SELECT * FROM {_p}java_functions "
        f"UNION ALL BY NAME SELECT * FROM {_p}script_functions"
    )
    BLOCKS[_p + "heuristic_tags"] = _heuristic_tags(_p + "sources")
    BLOCKS[_p + "script_tags"] = _script_tags(_p + "texts", _p + "calls")
    BLOCKS[_p + "tags"] = f"SELECT * FROM {_p}heuristic_tags UNION ALL SELECT * FROM {_p}script_tags"
    BLOCKS[_p + "imports"] = _imports(_p + "sources", _p + "lines", _p + "texts")
    BLOCKS[_p + "metrics"] = _metrics(_p)
    BLOCKS[_p + "signals"] = _signals(_p)


def needed(text: str) -> list[str]:
    """Blocks a text refers to, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", body)):
            if name in BLOCKS and name not in order and BLOCKS[name] is not body:
                visit(BLOCKS[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def sql(text: str) -> str:
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name]})" for name in needed(text))
    return f"WITH {ctes}\n{text}" if ctes else text
