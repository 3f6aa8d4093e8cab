"""A code corpus derived from the ``documents`` table.

The test tables hold prose, no source code. Every document becomes one file of
some repository: its id picks a template, its length the number of repeated
blocks, and its whole text goes into the file as comments, statements or markup.
Twelve neighbouring ids are a block with one folder for its apps, four blocks are
a repository, so the number of repositories grows with the table.
Root files (manifest, lock file, ignore file) follow from the set of
repositories. The same templates also give the DuckDB text of the corpus, so
that both engines see the same files.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS, GROUPS, BLOCKS_PER_REPO = 12, 5, 4

PYTHON_SERVICE = '''import csv
from fastapi import APIRouter
from .colony import weigh_{g}
from pydantic import BaseModel
import requests

hives = APIRouter()


class Reading{id}(BaseModel):
    grams: int


@hives.put("/hives/{id}/weight")
async def record_weight_{id}(reading, scale, weather, keeper, season, journal) -> dict:
    if season == "winter" and weather:
        journal.skip(keeper)
{blocks}
    def settle_{g}(grams, self):
        while grams > 40 and grams < 90:
            grams -= 1
        return grams

    try:
        forecast = requests.get("https://hives.example/forecast")
    except TimeoutError:
        forecast = None
    finally:
        journal.seal()
{statements}
    return forecast


# TODO: recalibrate scale {id}
{comments}
'''
PYTHON_TEST = '''import unittest


class TestService{prev}(unittest.TestCase):
    def test_create(self):
        """Covers service{prev}."""
        for value in range(3):
            self.assertTrue(value or True)
{statements}


{comments}
'''
PYTHON_UTIL = '''from datetime import date


def ripeness_{v}(basket, month):
    # orchard sheet {id}
    score = 0
    for fruit in basket:
        if fruit.firm or month > 8:
            score += 1  # firm fruit keeps
        score -= fruit.spots
    while score > 10:
        score = score // 2
    return score


def label_{id}(self, text):
{statements}
    return text


{comments}
'''
JAVA_SERVICE = '''package com.ex;

import org.springframework.web.client.RestTemplate;
import static java.util.Map.entry;
import java.util.List;
import org.springframework.jdbc.core.JdbcTemplate;

@RestController
public class Svc{id} {
  private final JdbcTemplate tides;

  public Svc{id}(JdbcTemplate tides) {
    this.tides = tides;
  }

  int beams() { return 3; }

  @GetMapping("/harbour/{id}")
  public static <T extends Vessel & Pilot> List<T> berths{g}(@Valid Cargo cargo, Pilot pilot, Lantern lantern) throws IOException {
{blocks}
    try {
      pilot.signal();
    } catch (Exception fog) {
      lantern.dim();
    }
{statements}
    return null;
  }

  private enum Beam { RED, WHITE }

  protected void dusk{id}() {
    if (tides != null && lantern == null || pilot == null) {
      switch (beam) {
        case RED: break;
        default: pilot.rest();
      }
    }
  }
}
// FIXME chart depth
{comments}
'''
JAVA_TEST = '''package com.ex;

import org.junit.jupiter.api.Test;

class Svc{prev}Test {
  @Test
  void works() {
    assertTrue(new Svc{prev}(null).beams() == 3);
  }
}
{comments}
'''
JAVA_DUPLICATE = '''package com.ex;

/* Quarry helpers.
   Shared by documents. */
public class Dup{id} {
  // TODO: merge
  public int haul{v}(int stones, String road) {
    int carts = stones;
    while (carts > 12) {
      carts = carts - 12; // one load
    }
    for (int mile = 0; mile < 3; mile++) {
      if (road.startsWith("steep")) {
        carts = carts + mile;
      }
    }
    return carts;
  }

  public String text{id}() {
{statements}
    return "";
  }
}
{comments}
'''
SCRIPT_VIEW = '''import React, { useMemo as memo, useEffect, useState } from 'react';
import { load{next} } from '../lib/api{next}';
import type { Item } from '../lib/api{next}';
import * as client from '@/services/client';

// fetch() in a comment is not a call
function announce(train, speaker, volume, language, repeats, chime) {
  while (repeats > 3) repeats = repeats - 1;
  if (train.night) {
    if (volume > 7) {
      if (chime) return 'soft';
      return 'dim';
    }
  }
  return speaker ? language : chime ?? volume;
}

export function View{id}({ station, clock }: { station: string; clock: string }) {
  const [platform, setPlatform] = useState(4);
  const open = client.list().filter((x) => x.open === clock);
{blocks}
  const [trains, setTrains] = useState<Item[]>([]);
  const late = memo(() => {
    return trains
      .filter((train) => train.delay > 5 || train.cancelled === clock)
      .map((train) => train.line);
  }, [trains, clock]);
  async function poll() {
    const board = await fetch(`/rail/${station}/departures`);
    setTrains(await board.json());
  }

  useEffect(() => {
    setPlatform(2);
    void poll();
    return undefined;
  }, [station]);

  return (
    <main style={{ margin: 4 }} className="board">
{markup}
      <ul>
        {late.map((line) => (
          <li key={line} onClick={() => client.save(line, announce)}>
            {line}
          </li>
        ))}
      </ul>
    </main>
  );
}
'''
SCRIPT_API = '''import axios from 'axios';
import { z } from "zod";
import './setup';

export const limit = 10;

export type Item = { name: string; onPick: (id: string) => void };

/* Loads one page.
 * Uses axios.get() below. */
export const load{id} = async (page: number, size: number) => {
  const answer = await axios.get('https://example.com/items//' + page);
{blocks}
  return answer.data && answer.data.items ? answer.data.items : [];
};

export function damp{v}(signal, gain) {
  // shared
  let level = gain;
  for (const echo of signal) {
    level = level - echo;
    if (level < 0) {
      level = 0;
    }
  }
  return level;
}

export class Reader {
  constructor(private readonly db: Db) {}

  async read(uri: string) {
    const request = new XMLHttpRequest();
    request.open('GET', uri);
    request.responseType = 'blob';
    const done = new Promise((ready) => {
      request.onload = ready;
    });
    request.send();
    await done;
    return request.response;
  }

  run(
    first: string,
    pick: (x: string) => Item,
    rest = [1, [2, 3]],
  ): Promise<{ items: Item[] }> {
    return ky.get(first, { rest })
      .json();
  }

  each(use: (x: string) => void) {
    use("one");
  }

  get size() { return 1; }

  static async *pages<T>(a: T, b?: Map<string, T>): AsyncGenerator<T> { yield a; }
}

const mix{v} = (a = g(h(1)), { b, c } = {}) => {
  return a(b).then((d) => c(d));
};

const sorted: (x: Item[]) => string[] = (items) =>
  items.map((item) => item.name)
    .sort(function byName(x, y) { return x < y ? 1 : 0; });

export const handlers = { open: (x) => mix{v}(x), async close(y) { await y; }, keep: async z => z };

export { Reader as Feed, damp{v} as soften };
export const first = 1, second = damp{v}([], 2);

function getFeed() {
  return new Reader(null);
}

export async function late(path) {
  return getFeed().fetch("/late");
}
{comments}
'''
SCRIPT_INDEX = '''import { load{prev} } from './api{prev}';
import api from '../api';
export * from './api{prev}';
export default run{id};

// FIXME: split
export async function run{id}(api, page) {
  const rows = await api.get('/rows');
  return load{prev}(page ?? rows);
}

async function guarded(client) {
  try {
    await client.post('/log');
{statements}
  } catch (error) {
    console.error(error);
  }
  while (client.busy) client.wait();
}

class Relay {
  async request(path) {
    return path;
  }

  useTrack(name) {
    return name;
  }
}

export function useBoard{id}() {
  return guarded(null);
}

const helpers = {
  first: (row) => row.first,
  second: function (row) {
    return row.second || null;
  },
};
{comments}
'''
PLAIN_SCRIPT = '''module.exports = {};
{comments}
'''
PLAIN_PYTHON = '''def generated(self, value):
    return value


{comments}
'''
APP_MANIFEST = '{"name": "@r{r}/app{block}", "version": "{id}.0.0", "description": "{flat}", "dependencies": {"react": "^19.0.0"{extra}}, "devDependencies": {"zod": "^3.{g}.0"}, "scripts": {"typecheck": "tsc", "lint": "eslint .", "start": "node ."}}\n'
BROKEN_MANIFEST = '{"name": "@r{r}/app{block}", "description": "{flat}", "dependencies": \n'
ROOT_MANIFEST_LIST = '{"private": true, "workspaces": ["./{apps,libs}/*", "packages/**/", "!apps/app*7", "!**/none"], "scripts": {"build": "tsc -b", "test": "vitest run"}, "devDependencies": {"vitest": "^3.0.0"}}\n'
ROOT_MANIFEST_OBJECT = '{"private": true, "workspaces": {"packages": ["apps/*"]}, "dependencies": {"express": "^5.0.0"}, "devDependencies": {"jest": "^29.0.0", "zod": "^2.0.0"}, "scripts": {"lint": "eslint ."}}\n'
IGNORE_FILE = '''# generated code
generated/

*.gen.py
!keep*.gen.py
/docs
packages/p*/build
'''

# (kind, first and last group) -> path, content. The template placeholders are
# filled by plain string replacement.
FILES = [
    (0, 0, 4, "src/mod{g}/service{id}.py", PYTHON_SERVICE),
    (1, 0, 4, "src/mod{gp}/test_service{prev}.py", PYTHON_TEST),
    (2, 0, 4, "src/mod{g}/util{id}.py", PYTHON_UTIL),
    (3, 0, 4, "src/main/java/com/ex/Svc{id}.java", JAVA_SERVICE),
    (4, 0, 4, "src/main/java/com/ex/Svc{prev}Test.java", JAVA_TEST),
    (5, 0, 4, "src/main/java/com/ex/Dup{id}.java", JAVA_DUPLICATE),
    (6, 0, 4, "apps/app{block}/src/components/View{id}.tsx", SCRIPT_VIEW),
    (7, 0, 4, "apps/app{block}/src/lib/api{id}.ts", SCRIPT_API),
    (8, 0, 4, "apps/app{block}/src/lib/index{id}.js", SCRIPT_INDEX),
    (9, 0, 0, "node_modules/p{id}/a.js", PLAIN_SCRIPT),
    (9, 1, 1, ".cache/x{id}.js", PLAIN_SCRIPT),
    (9, 2, 2, "docs/guide{id}.js", PLAIN_SCRIPT),
    (9, 3, 3, "packages/p{id}/build/out.js", PLAIN_SCRIPT),
    (9, 4, 4, "notes/readme{id}.md", PLAIN_SCRIPT),
    (10, 0, 0, "generated/x{id}.ts", PLAIN_SCRIPT),
    (10, 1, 1, "src/made{id}.gen.py", PLAIN_PYTHON),
    (10, 2, 2, "src/keep{id}.gen.py", PLAIN_PYTHON),
    (10, 3, 3, "lib/x{id}.min.js", PLAIN_SCRIPT),
    (10, 4, 4, "types/x{id}.d.ts", PLAIN_SCRIPT),
]
MANIFEST_KIND = 11
MANIFEST_PATH = "apps/app{block}/package.json"
EXTRA_DEPENDENCIES = {0: ', "expo": "^54.0.0"', 1: ', "next": "^15.0.0"', 2: ', "react-native": "1"'}
BLOCKS = {
    0: '    if season.open("hive"):\n        for frame in reading:\n            if frame or weather:\n                journal.note(frame)\n',
    3: "    if (cargo != null) {\n      while (lantern.turns()) {\n        if (pilot.ready() && cargo.dry()) { pilot.moor(); }\n      }\n    }\n",
    6: "  const [more, setMore] = useState('x');\n  const ref = React.useRef(null);\n",
    7: "  if (page > limit && size) {\n    return [];\n  }\n",
}
COMMENT = {0: "# ", 1: "# ", 2: "# ", 10: "# "}
STATEMENT = {
    0: ('    note("', '")'),
    1: ('        self.note("', '")'),
    2: ('    note("', '")'),
    3: ('    note("', '");'),
    5: ('    note("', '");'),
    8: ("    note('", "');"),
}
MARKUP = ("      <p>", "</p>")
CLEAN = r"[^A-Za-z0-9 .,\n]"
# The same characters one by one: the JVM looks those up in one table, while it tests joined
# ranges one after the other, which took 20 times as long when all cores did it.
CLEAN_LISTED = rf"[^{string.ascii_letters}{string.digits} .,\n]"

LOCKS = ["pnpm-lock.yaml", "yarn.lock", "bun.lock", "package-lock.json"]


def _case_spark(key: Column, values: dict) -> Column:
    chain = F.lit("")
    for value, text in values.items():
        chain = F.when(key == value, text if isinstance(text, Column) else F.lit(text)).otherwise(chain)
    return chain


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "text")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the derived corpus: ``repo, path, content``."""
    return _render(_documents(spark, sf_dir), edited=False)


def edited_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after edits: one file in seven removed, one grown, one cleaned."""
    return _render(_documents(spark, sf_dir), edited=True)


def _numbers(documents: DataFrame) -> DataFrame:
    block = F.floor(F.col("doc_id") / KINDS)
    return documents.select(
        "doc_id",
        (F.col("doc_id") % KINDS).alias("k"),
        (F.col("doc_id") % GROUPS).alias("g"),
        F.floor(block / BLOCKS_PER_REPO).alias("r"),
        (block % BLOCKS_PER_REPO).alias("b"),
        block.alias("block"),
        (F.col("n_chars") % 6).alias("n"),
        "text",
    )


def _fill(template: Column, d: dict[str, Column]) -> Column:
    for name, value in d.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _render(documents: DataFrame, edited: bool) -> DataFrame:
    rows = _numbers(documents)
    k, g, doc_id = F.col("k"), F.col("g"), F.col("doc_id")
    newline = F.lit("\n")
    slot = lambda c: c.cast("string")
    numbers = {
        "id": slot(doc_id),
        "prev": slot(doc_id - 1),
        "next": slot(doc_id + 1),
        "g": slot(g),
        "gp": slot((doc_id - 1) % GROUPS),
        "r": slot(F.col("r")),
        "block": slot(F.col("block")),
        "v": slot(F.col("block") % 2),
    }
    clean, mark, before, after = F.col("clean"), F.col("mark"), F.col("before"), F.col("after")
    texts = {
        "extra": _case_spark(g, EXTRA_DEPENDENCIES),
        "blocks": F.repeat(_case_spark(k, BLOCKS), F.col("n").cast("int")),
        "comments": F.concat(mark, F.replace(clean, newline, F.concat(newline, mark))),
        "statements": F.concat(before, F.replace(clean, newline, F.concat(after, newline, before)), after),
        "markup": F.concat(
            F.lit(MARKUP[0]), F.replace(clean, newline, F.lit(MARKUP[1] + "\n" + MARKUP[0])), F.lit(MARKUP[1])
        ),
        "flat": F.replace(clean, newline, F.lit(" ")),
    }
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, low, high, path_template, template in FILES:
        here = (k == kind) & g.between(low, high)
        path = F.when(here, F.lit(path_template)).otherwise(path)
        content = F.when(here, F.lit(template)).otherwise(content)
    manifest = k == MANIFEST_KIND
    path = F.when(manifest, F.lit(MANIFEST_PATH)).otherwise(path)
    content = (
        F.when(manifest & (F.col("b") == 0), F.lit(BROKEN_MANIFEST))
        .when(manifest, F.lit(APP_MANIFEST))
        .otherwise(content)
    )

    chosen = rows.filter(manifest | (doc_id % 7 != 0)) if edited else rows
    python_like = k.isin(0, 1, 2) | ((k == 10) & g.isin(1, 2))
    # Paths come out of a one-element generator, so that the long expression
    # behind them is not copied into every filter and join of a query.
    keys = F.struct(
        F.concat(F.lit("repo"), F.col("r").cast("string")).alias("repo"), _fill(path, numbers).alias("path")
    )
    files = chosen.select("*", F.inline_outer(F.array(keys))).select(
        "doc_id", "k", "g", "r", "b", "n", "block", "repo", "path",
        _fill(content, numbers).alias("content"),
        F.regexp_replace("text", CLEAN_LISTED, "~").alias("clean"),
        F.when(python_like, F.lit("# ")).otherwise(F.lit("// ")).alias("mark"),
        _case_spark(k, {kind: pair[0] for kind, pair in STATEMENT.items()}).alias("before"),
        _case_spark(k, {kind: pair[1] for kind, pair in STATEMENT.items()}).alias("after"),
    )
    for name, value in texts.items():
        mark_text = F.lit("{" + name + "}")
        files = files.withColumn(
            "content",
            F.when(F.contains("content", mark_text), F.replace("content", mark_text, value)).otherwise(
                F.col("content")
            ),
        )
    body = F.col("content")
    if edited:
        grown = F.concat(F.repeat(F.lit("// more\n"), 25), body)
        cleaned = F.replace(body, F.lit("TODO"), F.lit("DONE"))
        body = F.when(doc_id % 7 == 1, grown).when(doc_id % 7 == 2, cleaned).otherwise(body)
    return files.select("repo", "path", body.alias("content")).unionByName(_root_files(rows))


def _root_files(rows: DataFrame) -> DataFrame:
    r = F.col("r")
    entry = lambda path, content: F.struct(path.alias("path"), F.lit(content).alias("content"))
    lock = F.when(r % 5 < 4, F.get(F.array(*[F.lit(x) for x in LOCKS]), (r % 5).cast("int")))
    manifest = F.when(r % 2 == 0, F.lit(ROOT_MANIFEST_LIST)).otherwise(F.lit(ROOT_MANIFEST_OBJECT))
    files = F.array(
        F.struct(F.lit("package.json").alias("path"), manifest.alias("content")),
        entry(F.lit(".gitignore"), IGNORE_FILE),
        entry(lock, "lock\n"),
        entry(F.when(r % 7 == 3, F.lit("app.json")), "{}\n"),
    )
    return (
        rows.select("r")
        .distinct()
        .select(F.concat(F.lit("repo"), r.cast("string")).alias("repo"), F.inline(files))
        .filter(F.col("path").isNotNull())
    )


# --- the same corpus as DuckDB text --------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_sql(key: str, values: dict) -> str:
    whens = " ".join(f"WHEN {key} = {value} THEN {_q(text)}" for value, text in values.items())
    return f"CASE {whens} ELSE '' END"


def corpus_sql(edited: bool = False) -> str:
    """Body of a CTE with ``repo, path, content``."""
    fill_numbers = [
        ("id", "doc_id"), ("prev", "doc_id - 1"), ("next", "doc_id + 1"), ("g", "g"),
        ("gp", f"(doc_id - 1) % {GROUPS}"), ("r", "r"), ("block", "block"), ("v", "block % 2"),
    ]
    fill_texts = [
        ("extra", _case_sql("g", EXTRA_DEPENDENCIES)),
        ("blocks", f"repeat({_case_sql('k', BLOCKS)}, CAST(n AS BIGINT))"),
        ("comments", "mark || replace(body, chr(10), chr(10) || mark)"),
        ("statements", "before || replace(body, chr(10), after || chr(10) || before) || after"),
        ("markup", f"{_q(MARKUP[0])} || replace(body, chr(10), {_q(MARKUP[1])} || chr(10) || {_q(MARKUP[0])}) || {_q(MARKUP[1])}"),
        ("flat", "replace(body, chr(10), ' ')"),
    ]

    def fill(expression: str, slots: list) -> str:
        for name, value in slots:
            expression = f"replace({expression}, '{{{name}}}', CAST({value} AS VARCHAR))"
        return expression

    paths = " ".join(f"WHEN k = {kind} AND g BETWEEN {lo} AND {hi} THEN {_q(p)}" for kind, lo, hi, p, _ in FILES)
    contents = " ".join(f"WHEN k = {kind} AND g BETWEEN {lo} AND {hi} THEN {_q(c)}" for kind, lo, hi, _, c in FILES)
    body = fill(fill("content_template", fill_numbers), fill_texts)
    if edited:
        body = (
            f"CASE WHEN doc_id % 7 = 1 THEN repeat('// more' || chr(10), 25) || {body} "
            f"WHEN doc_id % 7 = 2 THEN replace({body}, 'TODO', 'DONE') ELSE {body} END"
        )
    gone = f" AND (doc_id % 7 <> 0 OR k = {MANIFEST_KIND})" if edited else ""
    root = (
        "SELECT r, 'package.json' AS path, "
        f"CASE WHEN r % 2 = 0 THEN {_q(ROOT_MANIFEST_LIST)} ELSE {_q(ROOT_MANIFEST_OBJECT)} END AS content FROM repos "
        f"UNION ALL SELECT r, '.gitignore', {_q(IGNORE_FILE)} FROM repos "
        + " ".join(
            f"UNION ALL SELECT r, {_q(lock)}, 'lock' || chr(10) FROM repos WHERE r % 5 = {i}"
            for i, lock in enumerate(LOCKS)
        )
        + " UNION ALL SELECT r, 'app.json', '{}' || chr(10) FROM repos WHERE r % 7 = 3"
    )
    return f"""
  WITH numbers AS (
    SELECT doc_id, doc_id % {KINDS} AS k, doc_id % {GROUPS} AS g,
           doc_id // {KINDS} AS block, doc_id // {KINDS * BLOCKS_PER_REPO} AS r,
           (doc_id // {KINDS}) % {BLOCKS_PER_REPO} AS b, n_chars % 6 AS n,
           regexp_replace(text, '{CLEAN}', '~', 'g') AS body
    FROM documents),
  repos AS (SELECT DISTINCT r FROM numbers),
  shaped AS (
    SELECT *,
      CASE {paths} WHEN k = {MANIFEST_KIND} THEN {_q(MANIFEST_PATH)} END AS path_template,
      CASE {contents} WHEN b = 0 THEN {_q(BROKEN_MANIFEST)} ELSE {_q(APP_MANIFEST)} END AS content_template,
      CASE WHEN k IN (0, 1, 2) OR (k = 10 AND g IN (1, 2)) THEN '# ' ELSE '// ' END AS mark,
      {_case_sql('k', {kind: pair[0] for kind, pair in STATEMENT.items()})} AS before,
      {_case_sql('k', {kind: pair[1] for kind, pair in STATEMENT.items()})} AS after
    FROM numbers)
  SELECT 'repo' || r AS repo, {fill('path_template', fill_numbers)} AS path, {body} AS content
  FROM shaped WHERE true{gone}
  UNION ALL
  SELECT 'repo' || r, path, content FROM ({root})
"""
