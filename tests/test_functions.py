import time

from pyspark.sql import functions as F

from codestrata.functions import blocks, paths, script, text
from codestrata.sources import manifests

PARCELS = '''import httpx
from pydantic import BaseModel


class Parcel(BaseModel):
    city: str
    grams: int


def quote(parcel, carrier, rates, day, express, insured):
    if parcel.grams > 900 and express:
        for rate in rates:
            if rate.fits(parcel):
                return rate.price
    if insured:
        return 12
    reply = httpx.get("https://example.com/rates")
    while day > 6:
        day -= 7
    return reply
'''
OUTER = """def outer(a):
    x = 1
    def inner(self, b, c):
        return b
    return x
y = 1
"""
JAVA = """class A {
  int a() { return 1; }

  A(int x) {
    this.x = x;
  }
  @Override @Named("v")
  public <T extends B & C> Map<String, T> go(Runnable r, int k) throws E, F {
    run(new R() {
      public void call() {
        if (a && b) {
        }
      }
    });
  }
  enum Kind { X }
  void open() {
    if (x) {
"""


def functions_of(spark, build, source):
    df = spark.createDataFrame([(source,)], "content string")
    return df.select(F.inline(build(text.lines_of(F.col("content"))))).collect()


def test_python_function_metrics(spark):
    (fn,) = functions_of(spark, blocks.python_functions, PARCELS)
    assert (fn["name"], fn["start_line"], fn["end_line"], fn["parameter_count"]) == ("quote", 10, 21, 6)
    assert fn["conditional_count"] == 5
    assert fn["complexity"] == 1 + 5 + 1
    assert fn["max_depth"] == 6  # four-space code counts double
    assert fn["api_call_count"] == 1
    assert fn["body_hash"] is not None and not fn["is_async"] and not fn["has_try"]


def test_nested_python_function_ends_the_outer_one(spark):
    outer, inner = functions_of(spark, blocks.python_functions, OUTER)
    assert (outer["start_line"], outer["end_line"]) == (1, 2)
    assert (inner["start_line"], inner["end_line"], inner["parameter_count"]) == (3, 4, 2)


def test_java_functions(spark):
    found = {f["name"]: f for f in functions_of(spark, blocks.java_functions, JAVA)}
    spans = {n: (f["start_line"], f["end_line"]) for n, f in found.items()}
    # a one-line method ends on the next line; an unclosed one at the end of the file
    assert spans == {"a": (2, 3), "A": (4, 6), "go": (8, 15), "call": (10, 13), "open": (17, 19)}
    assert found["go"]["parameter_count"] == 2
    assert found["go"]["max_depth"] == 4
    assert found["A"]["parameter_count"] == 1


def test_very_long_lines_do_not_exhaust_the_regex_stack(spark):
    words = "word " * 60_000
    source = f"class A {{\n  {words}(x) {{\n  }}\n}}\n"
    (fn,) = functions_of(spark, blocks.java_functions, source)
    assert fn["name"] == "word"
    escapes = '"' + '\\"' * 60_000 + '"'
    df = spark.createDataFrame([(f"const a = {escapes};\n",)], "content string")
    code = df.select(script.code_only(script.pieces(F.col("content"))).alias("c")).first()["c"]
    assert code == 'const a = "";\n'


def test_body_hash_ignores_comments_and_spacing(spark):
    rows = [("a = 1  # x\n  b = 2\n",), ("a = 1\nb  = 2 // y",), ("a = 2\nb = 2",)]
    df = spark.createDataFrame(rows, "c string").select(text.body_hash(F.col("c"), True).alias("h"))
    first, second, third = [r["h"] for r in df.collect()]
    assert first == second != third


def test_line_counts(spark):
    rows = [("",), (" \n",), ("a",), ("a\n",), ("a\r\nb",)]
    df = spark.createDataFrame(rows, "c string").select(text.line_count(F.col("c")).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 0, 1, 2, 2]


def test_names_and_deltas(spark):
    row = spark.range(1).select(
        text.brief_file_name(F.lit(7), F.lit("Extract Hook From Sidebar")).alias("short"),
        text.brief_file_name(F.lit(123), F.lit("Extract Hook From Sidebar")).alias("long"),
        text.snake_case(F.lit("extractShippingFeeHelper")).alias("snake"),
        text.pascal_case(F.lit("sign-in_form v2")).alias("pascal"),
        text.signed(F.lit(3)).alias("up"),
        text.signed(F.lit(-3)).alias("down"),
        text.signed(F.lit(None).cast("int")).alias("none"),
    ).first()
    assert row["short"] == "07_extract_hook_from_sidebar.md"
    assert row["long"] == "123_extract_hook_from_sidebar.md"
    assert (row["snake"], row["pascal"]) == ("extract_shipping_fee_helper", "SignInFormV2")
    assert (row["up"], row["down"], row["none"]) == ("+3", "-3", "n/a")


def test_paths(spark):
    p = lambda s: F.lit(s)
    row = spark.range(1).select(
        paths.resolve(p("apps/a/src"), p("../lib/./x")).alias("inside"),
        paths.resolve(p("apps"), p("../../x")).alias("outside"),
        paths.stays_inside(p("a/../../b")).alias("climbs"),
        paths.stays_inside(p("a/../b")).alias("stays"),
        paths.service_path(p("packages/x/src/a/b.py")).alias("service"),
        paths.likely_test_path(p("src/UserService.java")).alias("test"),
        paths.folder_prefix_of(p("src/a/b/"), p("src/ab/")).alias("prefix"),
        paths.relative_to(p("/r/x"), p("/r/x/src/a.py")).alias("relative"),
    ).first()
    assert (row["inside"], row["outside"]) == ("apps/a/lib/x", None)
    assert (row["climbs"], row["stays"]) == (False, True)
    assert row["service"] == "packages/x/src/a/services/b_service.py"
    assert (row["test"], row["prefix"], row["relative"]) == ("src/UserServiceTest.java", "src", "src/a.py")


def parsed(spark, *contents):
    """Calls, functions and requests of script texts."""
    df = spark.createDataFrame(list(enumerate(contents)), "k int, content string")
    parts = script.pieces(F.col("content"))
    df = df.select("k", script.without_comments(parts).alias("bare"), script.code_only(parts).alias("code"))
    df = script.with_parsed(df, F.col("code"), F.col("bare"))
    requests = script.request_calls(F.col("parsed.calls"), script.import_bindings(F.col("bare")))
    return [r.asDict() for r in df.select("k", "parsed.*", requests.alias("requests")).orderBy("k").collect()]


def test_script_calls(spark):
    """Declarations are no calls; a call on a call result has the root of that call."""
    rows = {
        "export function useTodos() {": [],
        "class A { async request(path) { } }": [],
        "class A {  static *items<T>(a, b): T[] {} get size() { return 1; } }": [],
        'getClient().fetch("")': ["getClient", "getClient().fetch"],
        "const a = [...fetch(1), x?.y(2)];": ["fetch", "x?.y"],
        "if (load(x)) {}": ["load"],
        "list[0].get(1)": [".get"],
        "(await x).json()": [".json"],
        "new Thing(1).go(2)": [".go"],
        "this.a.b(1).c()": ["this.a.b", ".c"],
        "useThing(); api.useOther<T>(1)": ["useThing", "api.useOther"],
        "function (x) { return go(x); }": ["go"],
        "a(1)\n  .b(c(2))\n  ?.d`x`.e(3);": ["a", "a(1).b", "c", ".e"],
    }
    found = dict(zip(rows, parsed(spark, *rows), strict=True))
    assert {k: sorted(c["expression"] for c in v["calls"]) for k, v in found.items()} == {k: sorted(v) for k, v in rows.items()}
    df = spark.createDataFrame([(k, [c.asDict() for c in v["calls"]]) for k, v in found.items() if v["calls"]],
                               "code string, calls array<struct<p:int,expression:string,receiver:string,method:string,dotted:boolean,line:int>>")
    hooks = {r[0]: r[1] for r in df.select("code", script.hook_count(F.col("calls"))).collect()}
    assert {k: n for k, n in hooks.items() if n} == {"useThing(); api.useOther<T>(1)": 2}


def test_requests_of_call_results(spark):
    """By hand: a request counts when the name at the root of its chain is a client, a service or a network function."""
    contents = [
        'getClient().fetch("")',
        "class A {\n  async request(path) { }\n}\nfetch(a)\naxios.get(b)",
        "ky.get(u).json();",
        "import { getUsers } from './services/users';\ngetUsers()\n  .filter((u) => u.ok)\n  .map(f);",
        'supabase.from("t").select("*").eq("a", 1);',
        "fetch(u).then((r) => r.json()).catch(e);",
        "api.make(1).post(2); other.make(1).post(2);",
        "new request(1); request(2)",
        "a.b(ky.get(x).text())",
        "ky" + ".get(x)" * 150,
    ]
    found = [[(c["expression"], c["kind"], c["line"]) for c in r["requests"]] for r in parsed(spark, *contents)]
    assert found[:9] == [
        [],
        [("fetch", "network-call", 4), ("axios.get", "network-call", 5)],
        [("ky.get", "network-call", 1), ("ky.get(u).json", "network-call", 1)],
        [("getUsers", "service-call", 2), ("getUsers().filter", "service-call", 2), ("getUsers().filter((u)=>u.ok).map", "service-call", 2)],
        [('supabase.from("").select', "client-call", 1), ('supabase.from("").select("").eq', "client-call", 1)],
        [("fetch", "network-call", 1)],
        [("api.make(1).post", "client-call", 1)],
        [("request", "network-call", 1)],
        [("ky.get", "network-call", 1), ("ky.get(x).text", "network-call", 1)],
    ]
    assert len(found[9]) == 150 and {k for _, k, _ in found[9]} == {"network-call"}


SHAPES = """export async function main(a, b: Map<string, number>, { c, d }: X = {}) {
  const mk = (a = g(h(1)), b) => {
    return a;
  };
  list.map(u => u.id);
}
class K {
  run(
    first: string,
    cb: (x: string) => Foo,
    third = [1, [2, 3]],
  ): Promise<{ a: string }> {
    return 1;
  }
  each(cb: (x: string) => void) { return 2; }
  static async *items<T>(a: T): AsyncGenerator<T> { yield a; }
  get size() { return 1; }
  constructor(private a: A) { super(a); }
  handler = async (e) => { go(e); };
}
const o = { p: (x) => x + 1, async q(y) { return y; }, r: function (z) { return z }, s: async x => x };
const t = cond ? (b) : c;
foo(function named(a) { return 1 }, async () => 2);
export default function () { return 1 }
type F = (a: string) => Bar;
interface I { f: (x: A) => B; g(y: C): void }
const late: (x: number) => string = (x) =>
  x.toString()
    .padStart(2);
let w = list.map((v) => (
  v + 1
)).filter(Boolean);
function deep(a = { b: [(c) => ({ d: [1, 2], e: (f, g) => 3 }), 4], h: 5 }, ...i) { }
"""


def test_script_function_shapes(spark):
    """Names, lines, parameters and async by hand."""
    (found,) = parsed(spark, SHAPES)
    got = [(f["name"], f["start_line"], f["end_line"], f["parameter_count"], f["is_async"]) for f in found["functions"]]
    assert got == [
        ("main", 1, 6, 3, True), ("mk", 2, 4, 2, False), ("anonymous_line_5", 5, 5, 1, False),
        ("run", 8, 14, 3, False), ("each", 15, 15, 1, False), ("items", 16, 16, 1, True), ("anonymous_line_19", 19, 19, 1, True),
        ("p", 21, 21, 1, False), ("q", 21, 21, 1, True), ("r", 21, 21, 1, False), ("s", 21, 21, 1, True),
        ("anonymous_line_23", 23, 23, 1, False), ("anonymous_line_23", 23, 23, 0, True), ("anonymous_line_24", 24, 24, 0, False),
        ("late", 27, 29, 1, False), ("anonymous_line_30", 30, 32, 1, False),
        ("deep", 33, 33, 2, False), ("anonymous_line_33", 33, 33, 1, False), ("e", 33, 33, 2, False),
    ]
    assert [f["fn_ord"] for f in found["functions"]] == list(range(len(got)))


def test_odd_scripts_do_not_fail(spark):
    contents = ["", "\n", ")]}", "((([{", "=> x", "f(", "a => {", "function", "const x = (a, b) => {\n  y(", "`${", "class { m( { }"]
    found = parsed(spark, *contents)
    assert [len(r["functions"]) for r in found][:6] == [0, 0, 0, 0, 0, 0]
    assert [(f["name"], f["start_line"], f["end_line"]) for f in found[8]["functions"]] == [("x", 1, 2)]


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_time_grows_with_the_file(spark):
    """Twice the functions (or inner types) take little more than twice the time."""
    one = {
        "script": lambda k: f"  m{k}(a, b) {{\n    return api.get(a).then((x) => x);\n  }}\n",
        "java": lambda k: f"  class T{k} {{\n    T{k}(int a) {{\n    }}\n    public int m{k}(int a) {{\n      return a;\n    }}\n  }}\n",
    }

    def taken(kind: str, n: int) -> float:
        content = "class A {\n" + "".join(map(one[kind], range(n))) + "}\n"
        if kind == "script":
            return seconds(lambda: parsed(spark, content))
        df = spark.createDataFrame([(content,)], "content string").select(text.lines_of(F.col("content")).alias("lines"))
        return seconds(lambda: df.select(F.size(blocks.java_functions(F.col("lines")))).collect())

    for kind, n in {"script": 2000, "java": 4000}.items():  # 4,000 functions, 4,000 inner types; and twice as many
        taken(kind, 200)
        small, large = taken(kind, n), taken(kind, 2 * n)
        assert large < 2.5 * small, (kind, small, large)


def test_export_count(spark):
    rows = {
        "export { a, b };\n": 2,
        "export const c = 1, d = 2;\n": 2,
        "export const f = (a = 1, b = [2, 3]) => ({ a, b });\n": 1,
        "export * from \"\";\nexport default x;\n": 2,
        "export { a,\n  b as c,\n};\nexport type { T } from \"\";\nexport class K {}\n": 4,
        "export {};\n": 1,
        "const x = 1;\n": 0,
        "export const m = new Map<string, number>(), n = g(h(1, 2), 3),\n  o = 4;\n": 2,
    }
    df = spark.createDataFrame([(k,) for k in rows], "code string")
    assert {r[0]: r[1] for r in df.select("code", script.export_count(F.col("code"))).collect()} == rows


def test_workspace_globs(spark):
    rows = {
        ("apps/*", "apps/a"): True, ("apps/*", "apps/a/b"): False, ("apps/*/", "apps/a"): True, ("./apps/*", "apps/a"): True,
        ("packages/**", "packages"): True, ("packages/**", "packages/a/b"): True, ("packages/**", "packagesx/a"): False,
        ("{a,b}/*", "a/x"): True, ("{a,b}/*", "b/x"): True, ("{a,b}/*", "c/x"): False, ("{a}/*", "{a}/x"): True,
        ("**/ui", "ui"): True, ("**/ui", "x/y/ui"): True, ("a?c/(x)+", "abc/(x)+"): True, ("!apps/old", "apps/old"): True, ("a.b", "axb"): False,
    }
    df = spark.createDataFrame([(*k, f"{k[1]}/package.json") for k in rows], "glob string, folder string, path string")
    matched = df.select("glob", "folder", F.regexp_like("path", manifests.glob_pattern(F.col("glob"))).alias("m"))
    assert {(r[0], r[1]): r[2] for r in matched.collect()} == rows
