"""Functions of Python and Java files as array expressions.

A file stays one row: lines are an array, function starts are a filtered array,
ends come from one fold over the lines. No text is exploded or shuffled, so the
whole extraction is a narrow step behind the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import tokens
from .text import (
    bind, body_hash, has_any, matches, matches_with, occurrences, occurrences_with, when, whole_words, without_indent,
)

CONDITIONS = whole_words(*fixed.CONDITION_WORDS)
BOOLEAN_OPERATORS = rf"(?=[&|ao])(?:&&|\|\||{whole_words('and', 'or')})"
TRIES = whole_words(*fixed.TRY_WORDS)
HTTP = whole_words(*fixed.HTTP_CLIENTS)
#: Every client holds one of these; each is looked for in every body, so they are few.
HTTP_PARTS = ["requests", "http", "urllib", "fetch", "RestTemplate", "Client"]
PYTHON_BRANCH = whole_words(*fixed.PYTHON_BRANCH_WORDS)
JAVA_BRANCH = whole_words(*fixed.JAVA_BRANCH_WORDS)
JAVA_TYPE_LINE = rf"(?<!\w)(?:{'|'.join(fixed.JAVA_TYPE_WORDS)})\s+"
JAVA_TYPE_NAME = JAVA_TYPE_LINE + r"([A-Za-z_][A-Za-z0-9_]*)"
_THROWS_BRACE = r"\s*\(([^)]*)\)\s*(?:throws\s+[^{}]+)?\{"
JAVA_CONSTRUCTOR = (
    rf"^\s*(?:(?:{'|'.join(fixed.JAVA_CONSTRUCTOR_MODIFIERS)})\s+)?"
    rf"([A-Za-z_][A-Za-z0-9_]*){_THROWS_BRACE}"
)
# One run of type characters and spaces instead of a repeated group: the same
# lines match, and a very long line cannot exhaust the JVM regex stack.
JAVA_METHOD = (
    rf"^\s*(?:(?:(?:{'|'.join(fixed.JAVA_METHOD_MODIFIERS)})\s+)*<[^>]+>\s*)?"
    rf"[\w$.\[\]<>?,][\w$.\[\]<>?,\s]*\s([A-Za-z_$][A-Za-z0-9_$]*){_THROWS_BRACE}"
)

FUNCTION_TYPE = (
    "struct<fn_ord:int,name:string,start_line:int,end_line:int,line_count:int,"
    "parameter_count:int,is_async:boolean,has_try:boolean,try_lines:int,"
    "conditional_count:int,max_depth:int,complexity:int,hook_count:int,"
    "api_call_count:int,returns_jsx:boolean,body_hash:string,"
    "blob_request:boolean,blob_type:boolean>"
)


def indent_of(line: Column) -> Column:
    return F.length(line) - F.length(without_indent(line))


def parameter_count(params: Column) -> Column:
    return F.size(
        F.filter(
            F.transform(F.split(params, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")),
            lambda p: (p != "") & (p != "self"),
        )
    )


def char_count(line: Column, char: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))


def brace_delta(line: Column) -> Column:
    return when(has_any(line, "{", "}"), char_count(line, "{") - char_count(line, "}"), 0)


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first, F.greatest(F.lit(0), last - first + 1))


def strip_annotations(line: Column) -> Column:
    return F.regexp_replace(line, fixed.JAVA_ANNOTATIONS, "")


def first_position(lines: Column, test) -> Column:
    """1-based position of the first line that passes, 0 if none does."""
    return F.array_position(F.transform(lines, test), F.lit(True)).cast("int")


def _python_depth(body_lines: Column) -> Column:
    """Only a line that is indented deeper than the branches before it is searched for a branch."""

    def step(deepest, line):
        return bind(
            F.shiftright(indent_of(line), 1),
            lambda depth: when((depth > deepest) & matches(line, PYTHON_BRANCH), depth, deepest),
        )

    return F.aggregate(body_lines, F.lit(0), step)


def _java_depth(body_lines: Column) -> Column:
    def step(acc, line):
        deeper = acc["depth"] + 1
        seen = when((deeper > acc["deepest"]) & matches(line, JAVA_BRANCH), deeper, acc["deepest"])
        return F.struct((acc["depth"] + brace_delta(line)).alias("depth"), seen.alias("deepest"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    return F.aggregate(body_lines, start, step, lambda acc: acc["deepest"])


def _function(head: Column, order: Column, start: Column, end: Column, body_lines: Column, depth) -> Column:
    """Function row from its header fields and its lines."""

    def build(body: Column) -> Column:
        conditionals = occurrences(body, CONDITIONS)
        first_try = when(matches_with(body, TRIES, *fixed.TRY_WORDS), first_position(body_lines, lambda line: matches(line, TRIES)), 0)
        size = F.size(body_lines)
        return F.struct(
            order.cast("int").alias("fn_ord"),
            head["name"].alias("name"),
            start.cast("int").alias("start_line"),
            end.cast("int").alias("end_line"),
            F.greatest(F.lit(1), end - start + 1).cast("int").alias("line_count"),
            head["parameters"].cast("int").alias("parameter_count"),
            matches(F.get(body_lines, F.lit(0)), whole_words("async")).alias("is_async"),
            (first_try > 0).alias("has_try"),
            when(first_try > 0, size - first_try + 1, 0).cast("int").alias("try_lines"),
            conditionals.alias("conditional_count"),
            depth(body_lines).cast("int").alias("max_depth"),
            (1 + conditionals + occurrences(body, BOOLEAN_OPERATORS)).cast("int").alias("complexity"),
            F.lit(0).alias("hook_count"),
            occurrences_with(body, HTTP, *HTTP_PARTS).alias("api_call_count"),
            F.lit(False).alias("returns_jsx"),
            when(size >= fixed.MIN_HASHED_LINES, body_hash(body, True)).alias("body_hash"),
            body.contains(fixed.BLOB_READER_REQUEST).alias("blob_request"),
            matches_with(body, fixed.BLOB_READER_TYPE, "responseType").alias("blob_type"),
        )

    return bind(F.array_join(body_lines, "\n"), build)


def python_functions(lines: Column) -> Column:
    """Functions of one Python file, in source order.

    A function ends before the first later non-blank line that is not indented
    deeper, and in any case before the next function start. Function bodies are
    therefore disjoint and the work is linear in the number of lines.
    """
    numbered = F.transform(
        lines,
        lambda line, i: when(
            line.contains("def") & matches(line, fixed.PYTHON_DEF), F.struct(line.alias("line"), (i + 1).alias("n"))
        ),
    )
    starts = F.filter(numbered, lambda x: x.isNotNull())

    def all_functions(found: Column) -> Column:
        return F.transform(found, lambda s, i: one(found, s, i))

    def one(found: Column, s: Column, i: Column) -> Column:
        following = F.get(found, i + 1)["n"]
        last = F.coalesce(following - 1, F.size(lines))
        own = indent_of(s["line"])
        dedent = first_position(
            line_slice(lines, s["n"] + 1, last),
            lambda line: bind(
                without_indent(line), lambda rest: (rest != "") & (F.length(line) - F.length(rest) <= own)
            ),
        )
        head = F.struct(
            F.regexp_extract(s["line"], fixed.PYTHON_DEF, 2).alias("name"),
            parameter_count(F.regexp_extract(s["line"], fixed.PYTHON_DEF, 3)).alias("parameters"),
        )
        end_line = when(dedent > 0, s["n"] + dedent - 1, last)
        return bind(
            end_line,
            lambda end: bind(
                line_slice(lines, s["n"], end),
                lambda body: _function(head, i, s["n"], end, body, _python_depth),
            ),
        )

    return bind(starts, all_functions)


def brace_ends(deltas: Column, starts: Column, total: Column) -> Column:
    """Start and end lines of the brace blocks of a file, in order.

    ``deltas`` holds the change of depth of every line, ``starts`` the numbers of the lines that
    start a block. A block ends on the first
    line after its start where the running depth is back at or below the depth
    before the start; blocks still open at the end of the file end there. Each start
    finds its end in a table of range minima over the depths.
    """

    def with_depths(depths: Column) -> Column:
        return bind(F.struct(depths.alias("after"), tokens.range_minima(depths).alias("minima")), with_minima)

    def with_minima(x: Column) -> Column:
        def block(start: Column) -> Column:
            before = F.coalesce(F.get(x["after"], start - 2), F.lit(0))
            end = tokens.first_at_most(x["minima"], start, before) + 1
            return F.struct(start.alias("start"), F.least(end, total).alias("end"))

        return F.transform(starts, block)

    return bind(tokens.running_sum(deltas), with_depths)


def java_functions(lines: Column) -> Column:
    """Methods and constructors of one Java file, in source order."""
    # The type a line stands in is the one declared last; only lines that may be headers look for it.
    named = F.transform(
        lines,
        lambda line, i: when(
            matches_with(line, JAVA_TYPE_NAME, *fixed.JAVA_TYPE_WORDS), F.struct(i.alias("i"), F.regexp_extract(line, JAVA_TYPE_NAME, 1).alias("name")),
        ),
    )
    declared = bind(
        F.filter(named, lambda x: x.isNotNull()),
        lambda found: F.struct(F.transform(found, lambda x: x["i"]).alias("places"), found.alias("types")),
    )

    def with_types(known: Column) -> Column:
        def header(line: Column, i: Column) -> Column:
            def parse(text: Column) -> Column:
                latest = tokens.first_at_least(known["places"], i + 1) - 1
                current = F.coalesce(F.get(known["types"], latest)["name"], F.lit(""))
                own = F.regexp_extract(text, JAVA_CONSTRUCTOR, 1)
                method = F.regexp_extract(text, JAVA_METHOD, 1)
                constructor = F.struct(
                    own.alias("name"),
                    parameter_count(F.regexp_extract(text, JAVA_CONSTRUCTOR, 2)).alias("parameters"),
                )
                ordinary = F.struct(
                    method.alias("name"),
                    parameter_count(F.regexp_extract(text, JAVA_METHOD, 2)).alias("parameters"),
                )
                return (
                    when(
                        matches(text, JAVA_TYPE_LINE), F.lit(None),
                        (own != "") & (own == current), constructor,
                        (method != "") & ~method.isin(fixed.JAVA_NOT_METHODS), ordinary,
                    )
                )

            return when(line.contains("(") & line.contains("{"), bind(strip_annotations(line), parse))

        heads = F.transform(
            lines,
            lambda line, i: bind(header(line, i), lambda head: when(head.isNotNull(), F.struct((i + 1).cast("int").alias("n"), head.alias("head")))),
        )
        return bind(F.filter(heads, lambda x: x.isNotNull()), with_heads)

    def with_heads(heads: Column) -> Column:
        blocks = brace_ends(F.transform(lines, brace_delta), F.transform(heads, lambda x: x["n"]), F.size(lines))
        return F.transform(
            blocks,
            lambda block, i: bind(
                line_slice(lines, block["start"], block["end"]),
                lambda body: _function(F.get(heads, i)["head"], i, block["start"], block["end"], body, _java_depth),
            ),
        )

    return bind(declared, with_types)
