"""Steps of the file metrics do less work and give what the plain forms give."""

import random

from pyspark.sql import functions as F

from codestrata import fixed
from codestrata.functions import blocks, script, text, tokens
from codestrata.operators import analysis


def test_bound_values_are_not_copied_into_an_array(spark):
    plan = spark.range(3).select(text.bind(F.col("id") + 1, lambda x: x * x).alias("v"))
    assert "transform(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [r.v for r in plan.collect()] == [1, 4, 9]


def test_patterns_behind_quick_tests(spark):
    texts = ["", "try {", "retry{", "a ? b : c", "x?y", "x.catch(1)", "} catch (e)", "a && b || c ?? d", "httpx.get urllib.request", "android or and", "if (for", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    cases = [
        (text.matches_with(t, script.TRY, "try"), text.matches(t, script.TRY)),
        (text.occurrences_with(t, script.TERNARY, "?"), text.occurrences(t, script.TERNARY)),
        (text.occurrences_with(t, script.CATCH, "catch"), text.occurrences(t, script.CATCH)),
        (text.occurrences_with(t, script.LOGICAL, "&&", "||", "??"), text.occurrences(t, script.LOGICAL)),
        (text.occurrences_with(t, script.DECISION, *script.DECISION_WORDS), text.occurrences(t, script.DECISION)),
        (text.occurrences_with(t, blocks.HTTP, *blocks.HTTP_PARTS), text.occurrences(t, blocks.HTTP)),
        (text.occurrences(t, blocks.BOOLEAN_OPERATORS), text.occurrences(t, rf"&&|\|\||{text.whole_words('and', 'or')}")),
    ]
    for got, want in cases:
        wrong = rows.select("t", got.alias("got"), want.alias("want")).filter(~F.col("got").eqNullSafe(F.col("want")))
        assert wrong.collect() == []


def test_script_tags_from_words(spark):
    texts = ["sort(x)", "sortİ", "Key sorK", "map", "İmap", "router.push", "router. x", "next/navigation", "react-router", "SafeParse", "db.x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tags = script.responsibilities(F.lit("a/b.ts"), F.col("t"), F.lit(""), F.lit(False))
    t = F.col("t")
    plain = {
        "business-logic": text.matches(F.lower(t), text.whole_words(*fixed.SCRIPT_LOGIC_WORDS)),
        "routing": text.matches(t, text.whole_words(*fixed.SCRIPT_ROUTING_WORDS)) | text.matches(t, text.word_starts(*fixed.SCRIPT_ROUTING_PREFIXES)),
        "validation": text.matches(t, text.whole_words(*fixed.SCRIPT_VALIDATION_WORDS, ignore_case=True)),
    }
    for name, want in plain.items():
        found = F.coalesce(F.array_contains(tags, name), F.lit(False))
        wrong = rows.select("t", found.alias("got"), F.coalesce(want, F.lit(False)).alias("want")).filter("got != want")
        assert wrong.collect() == [], name


def test_constructors_belong_to_the_type_declared_last(spark):
    lines = ["class A {", "  A(int x) {", "  }", "  enum B { X }", "  A(int y) {", "  }", "  B(int z) {", "  }", "}"]
    rows = spark.createDataFrame([(lines,)], "lines array<string>")
    found = rows.select(blocks.java_functions(F.col("lines")).alias("f")).first()["f"]
    assert [(f.name, f.start_line) for f in found] == [("A", 2), ("B", 7)]


def test_bracket_around_an_opener(spark):
    """The search in the order of level and place gives what a stack gives, also for brackets without a partner."""
    rng = random.Random(3)
    files = ["", "(", ")", "))((", "(()())(", ")(())", *("".join(rng.choice("()[]{}") for _ in range(rng.randint(1, 40))) for _ in range(40))]
    rows = spark.createDataFrame([(list(f),) for f in files], "signs array<string>")
    rows = rows.select("signs", tokens.signs(F.transform("signs", lambda t, i: F.struct(t.alias("t"), (i + 1).alias("n")))).alias("found"))
    rows = rows.withColumn("ordered", tokens.by_level(F.col("found"), tokens.depths(F.col("found"))))
    rows = rows.withColumn("known", tokens.partners(F.col("ordered")))
    around = F.transform("known", lambda k: F.when(F.get("found", k["i"])["opens"], tokens.around(F.col("ordered"), k["level"], k["i"])))
    for row in rows.select("signs", around.alias("around")).collect():
        stack, want = [], []
        for i, sign in enumerate(row.signs):
            want.append((stack[-1] if stack else -1) if sign in "([{" else None)
            if sign in "([{":
                stack.append(i)
            elif stack:
                stack.pop()
        assert row.around == want, row.signs


def test_lines_that_tell_nothing_are_left_out(spark):
    """Nesting and sums over the telling lines are those over all lines, and runs of plain lines are gone."""
    rng = random.Random(4)
    some = ["", "  x();", "note(1);", "a {", "}", ")", "x) {", "if (a) {", "} else if (b) {", "try {", "} catch (e) {", "} finally {", "for (;;) f(", "a ? b : c", "p && q", "});", "try { y() } catch {}"]
    files = [[rng.choice(some) for _ in range(rng.randint(1, 25))] for _ in range(150)]
    rows = spark.createDataFrame([(f,) for f in files], "lines array<string>").withColumn("facts", script.line_facts(F.col("lines")))
    rows = rows.withColumn("telling", script.telling(F.col("facts")))
    last = F.size("lines")
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["points"])
    same = script.nesting(F.col("facts"), last).eqNullSafe(script.nesting(F.col("telling"), last)) & (total("facts") == total("telling"))
    assert rows.filter(~same).select("lines").collect() == []
    body = F.array_join("lines", "\n")
    counted = text.occurrences(body, script.DECISION) + text.occurrences(body, script.CATCH) + text.occurrences(body, script.LOGICAL)
    assert rows.filter(counted != total("telling")).select("lines").collect() == []
    plain = spark.createDataFrame([(["a {", *["  x();"] * 50, "}"],)], "lines array<string>")
    assert plain.select(F.size(script.telling(script.line_facts(F.col("lines"))))).first()[0] == 3


def test_listed_words_in_any_case(spark):
    texts = ["", "Auth", "unauth AUTH1", "toKen x", "toKen", "loginİ", "javax.validation.Valid", "javax validation", "sort(x)", "If for", "httpx", "HTTPX", "é route", "urllib.request", "db.x", "Db", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    words = text.listed_words(t, [*analysis.HEURISTIC_WORDS, *script.TAG_WORDS])
    for listed in (fixed.HTTP_CLIENTS, fixed.TAG_AUTH_WORDS, fixed.TAG_VALIDATION_WORDS, fixed.TAG_LOGIC_WORDS, fixed.SCRIPT_ROUTING_WORDS):
        cases = [
            (text.has_word(t, words, *listed, ignore_case=True), text.matches(t, text.whole_words(*listed, ignore_case=True))),
            (text.has_cased_word(t, words, *listed), text.matches(t, text.whole_words(*listed))),
        ]
        for got, want in cases:
            wrong = rows.select("t", got.alias("got"), want.alias("want")).filter(~F.col("got").eqNullSafe(F.col("want")))
            assert wrong.collect() == [], listed


def test_only_parentheses_of_functions_keep_what_is_around(spark):
    line = "f(a); x = (b) => c; async function * g<T>(d) { h(e)(i) }"
    rows = spark.createDataFrame([([line],)], "code array<string>").withColumn("s", tokens.tokens(F.col("code")))
    rows = rows.withColumn("found", tokens.signs(F.col("s"))).withColumn("o", tokens.by_level(F.col("found"), tokens.depths(F.col("found"))))
    rows = rows.withColumn("b", tokens.brackets(F.col("found"), tokens.partners(F.col("o"))))
    found = rows.select(script.parens(F.col("s")["t"], F.col("b")).alias("p")).first().p
    assert [bool(p.after) for p in found] == [False, True, True, False, False]
    assert found[1].before.endswith("x =") and found[2].before.endswith("async function * g < T >")


def test_cases_in_lambdas_are_nested_ifs(spark):
    rows = spark.createDataFrame([([1, 2, 3, None],)], "v array<int>")
    cases = text.when(F.lit(None).cast("boolean"), 0, F.col("v")[0] == 2, 1, F.col("v")[0] == 1, 2)
    assert rows.select(cases).first()[0] == 2
    spoken = rows.select(F.transform("v", lambda v: text.when(v == 1, "one", v > 2, F.lit("many"), None)))
    assert spoken.first()[0] == ["one", None, "many", None]
    assert "CASE" not in spoken._jdf.queryExecution().optimizedPlan().toString()
    steps = "".join(c._jc.toString() for _, c in script._steps())
    assert "CASE" not in steps


def test_statements_are_no_heads(spark):
    """What stands around the parentheses of statements is not joined; a function named like one is found as before."""
    line = "if (a) { while (b) { } } function if (c) { } class K { constructor (d) { } m (e) { } } x = (f) => { }; if (g) => h"
    rows = spark.createDataFrame([([line],)], "code array<string>").withColumn("s", tokens.tokens(F.col("code")))
    rows = rows.withColumn("found", tokens.signs(F.col("s"))).withColumn("o", tokens.by_level(F.col("found"), tokens.depths(F.col("found"))))
    rows = rows.withColumn("b", tokens.brackets(F.col("found"), tokens.partners(F.col("o"))))
    found = rows.select(script.parens(F.col("s")["t"], F.col("b")).alias("p")).first().p
    assert [bool(p.after) for p in found] == [False, False, True, False, True, True, True]


def test_methods_with_any_number_of_modifiers(spark):
    long = "public static override async readonly abstract private protected "
    for content, name, is_async in (
        (f"class K {{\n  {long}m(a) {{\n  }}\n}}\n", "m", True),
        ("class K {\n  static m<A, B>(a) {\n  }\n}\n", "m", False),
        ("class K {\n  x = 1;\n  async n(a) {\n  }\n}\n", "n", True),
    ):
        df = spark.createDataFrame([("r", "a.ts", content)], "repo string, path string, content string")
        found = analysis.with_parsed(analysis.read_text(df)).select("parsed.functions").first()[0]
        assert [(f.name, f.is_async) for f in found] == [(name, is_async)]


def test_every_client_has_its_quick_test():
    assert all(any(part in client for part in blocks.HTTP_PARTS) for client in fixed.HTTP_CLIENTS)
