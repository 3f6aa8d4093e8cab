"""TypeScript and JavaScript files, read lexically.

Strings, templates and comments are blanked first (newlines stay). Functions and
calls are then found on the token stream of the whole file with its index of matching
brackets: what stands before a parenthesis, and what follows its partner, tells a
function from a call, however many lines or brackets lie between. Imports, exports
and measures of a body are patterns and folds over lines. Nothing here needs a syntax
tree or a Python worker; README lists where a lexical reading differs from a parsed one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from . import paths, tokens
from .blocks import line_slice
from .text import (
    bind, body_hash, built_once, has_any, has_cased_word, has_word, keywords, lines_of, listed_words, matches, matches_with,
    occurrences, occurrences_with, when, whole_words, word_starts,
)

NAME = r"[A-Za-z_$][\w$]*"
# Every character of a file belongs to exactly one piece. The possessive loops
# keep long literals off the regex stack.
PIECES = (
    r"//[^\n]*"
    r"|/\*(?s:.*?)\*/"
    r'|"(?:[^"\\\n]|\\.)*+"'
    r"|'(?:[^'\\\n]|\\.)*+'"
    r"|`(?:[^`\\]|\\(?s:.))*+`"
    r"|[^\"'`/]+"
    r"|(?s:.)"
)
IMPORT = r"""(?m)^[ \t]*import([\s*{][^"';()]*)?["']([^"'\n]+)["']"""
MARKUP_TEXT = r">[^<>{}()=;\n]*</"
MARKUP_OPEN = rf"(?m)(?:^|[(\[{{,;:?&|>=]|(?<!\w)return)\s*<(?:>|[A-Za-z][\w.]*(?:\s|/?>))"
# Patterns on tokens with blanks between: what stands before a parenthesis, and what follows its partner.
CHAIN = rf"(?<![^ ])((?:{tokens.NAME} (?:\.|\?\.) )*{tokens.NAME})((?: <[^()=;{{}}]*>)?(?: \?\.)?)$"
FUNCTION = rf"(?<![^ ])(?:async )?function(?: \*)?(?: ({tokens.NAME}))?(?: <[^()]*>)?$"
METHOD = (
    r"(?<![^ ])((?:(?:public|private|protected|static|override|async|readonly|abstract|\*) )*)"
    rf"({tokens.NAME})(?: <[^()]*>)?$"
)
ACCESSOR = rf"(?<![^ ])[gs]et {tokens.NAME}$"
ASYNC_ARROW = r"(?<![^ ])(?:async(?: <[^()=;{}]*>)?|<[^()=;{}]*>)$"
RETURN_TYPE = r"(?:: (?:[\w$.]+ < )?\{[^{}]*\}(?: >)?(?: \[ \])* |: [^=(){};]+ )?"
TO_ARROW = rf"^{RETURN_TYPE}=>"
TO_BLOCK = rf"^{RETURN_TYPE}\{{"
VARIABLE = rf"(?<![^ ])(?:const|let|var) ({tokens.NAME})(?: : (?:[^=;]|=>)*?)? =$"
PROPERTY = rf"(?:^|(?<![^ ])[{{,] )({tokens.NAME}) :$"
EXPRESSION = (
    r"(?<![^ ])(?:[(,=:?\[&|!+~]|=>|&&|\|\||\?\?|\.\.\.|return|await|yield|new|typeof|void|delete|in|of|case)$"
)
# A function type: after its arrow stands a type, and then what ends a type.
PLAIN_TYPE = r"^=> (?:void|string|number|boolean|unknown|any|never|Promise < [^()]*>)(?: \[ \])*(?: [;,)|}=]|$)"
ENDED_TYPE = r"^=> [\w$.]+(?: <[^()]*>)?(?: \[ \])* [;=]"
TYPE_WORDS = ["void", "string", "number", "boolean", "unknown", "any", "never"]
ALIAS = rf"(?<![^ ])type {tokens.NAME}(?: <[^()]*>)? =$"
NOT_METHODS = [
    "if", "for", "while", "switch", "catch", "function", "constructor", "return", "else", "do",
    "try", "with", "await",
]
NOT_CALLED = [
    "if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "yield", "delete", "void", "in", "of",
    "new", "case", "do", "else", "throw", "instanceof", "with", "async", "constructor",
]
CONTINUES = [".", "?.", "&&", "||", "??", "?", ":", "+"]
EXPORT = r"(?m)^export(?!\w)"
EXPORT_LIST = r"(?m)^export\s+(?:type\s+)?\{([^{}]*)\}"
EXPORT_ALL = r"(?m)^export\s*\*\s*from"
EXPORT_VARIABLES = r"(?m)^export\s+(?:declare\s+)?(?:const|let|var)\s([^;\n]*,[^;\n]*)"
INNER_BRACKETS = r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}"
MORE_VARIABLES = rf",\s*{NAME}\s*(?::[^=,;]+)?=(?![=>])"
TERNARY = r"\s\?\s"
DECISION_WORDS = ["if", "for", "while", "case", "switch"]
DECISION = keywords(*DECISION_WORDS)
BRANCH = keywords("if", "switch")
CATCH = keywords("catch")
LOGICAL = r"&&|\|\||\?\?"
TRY = r"(?<![\w$.])try\s*\{"
ELSE_IF = r"^\s*\}\s*else\s+if(?!\w)"
TRY_CONTINUES = r"^\s*\}\s*(?:catch|finally)(?!\w)"
#: Before their sign these stand as whole words.
ROUTING_PARTS, STYLING_PARTS, DATABASE_PARTS = (
    [re.match(r"\w+", part)[0] for part in parts]
    for parts in (fixed.SCRIPT_ROUTING_PREFIXES, fixed.SCRIPT_STYLING_PREFIXES, fixed.SCRIPT_DATABASE_PREFIXES)
)
TAG_WORDS = [
    *fixed.SCRIPT_STATE_WORDS, *fixed.SCRIPT_VALIDATION_WORDS, *fixed.SCRIPT_DATABASE_WORDS, *DATABASE_PARTS, *fixed.SCRIPT_AUTH_WORDS,
    *fixed.SCRIPT_ROUTING_WORDS, *ROUTING_PARTS, *fixed.SCRIPT_STYLING_WORDS, *STYLING_PARTS, *fixed.SCRIPT_LOGIC_WORDS,
]
TOP_LEVEL_FUNCTION = r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?function(?!\w)"

CALL_TYPE = "struct<expression:string,kind:string,line:int,receiver:string,import_source:string>"


def pieces(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(PIECES), F.lit(0))


def _newlines(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", "")


def without_comments(parts: Column) -> Column:
    """Source text with comments removed; line numbers stay."""
    return F.array_join(
        F.transform(
            parts,
            lambda p: when(p.startswith("//"), F.lit(""), p.startswith("/*"), _newlines(p), p),
        ),
        "",
    )


def code_only(parts: Column) -> Column:
    """Source text without comments, string contents and plain markup text."""
    joined = F.array_join(
        F.transform(
            parts,
            lambda p: when(
                p.startswith("//"), F.lit(""),
                p.startswith("/*"), _newlines(p),
                p.startswith("`") & (F.length(p) > 1), F.concat(F.lit("``"), _newlines(p)),
                p.rlike("^[\"']") & (F.length(p) > 1), F.lit('""'),
                p,
            ),
        ),
        "",
    )
    return F.regexp_replace(joined, MARKUP_TEXT, "></")


def import_sources(bare: Column) -> Column:
    return F.regexp_extract_all(bare, F.lit(IMPORT), F.lit(2))


def import_bindings(bare: Column) -> Column:
    """``array<struct<local, module>>`` in source order; the last one wins."""

    def bindings(clause: Column, module: Column) -> Column:
        plain = F.regexp_replace(clause, r"(^|[\s,{])type\s+(?!,|from(?!\w))", "$1")
        default = F.regexp_extract(plain, rf"^\s*({NAME})\s*(?:,|from(?!\w))", 1)
        namespace = F.regexp_extract(plain, rf"\*\s*as\s+({NAME})", 1)
        named = F.transform(
            F.split(F.regexp_extract(plain, r"\{([^{}]*)\}", 1), ","),
            lambda item: F.regexp_extract(item, rf"({NAME})\s*$", 1),
        )
        names = F.filter(F.concat(F.array(default, namespace), named), lambda n: n != "")
        return F.transform(names, lambda n: F.struct(n.alias("local"), module.alias("module")))

    clauses = F.regexp_extract_all(bare, F.lit(IMPORT), F.lit(1))
    return F.flatten(F.transform(F.arrays_zip(clauses.alias("clause"), import_sources(bare).alias("module")),
                                 lambda d: bindings(F.coalesce(d["clause"], F.lit("")), d["module"])))


def returns_markup(code: Column) -> Column:
    return has_any(code, "</", "/>") & matches(code, MARKUP_OPEN)


def export_count(code: Column) -> Column:
    """Export statements or exported names, whichever are more; other modules are not followed."""
    statements = occurrences(code, EXPORT)
    lists = F.regexp_extract_all(code, F.lit(EXPORT_LIST), F.lit(1))
    items = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))

    def more(text: Column) -> Column:
        openers = F.length(F.regexp_replace(text, r"[^(\[{]", ""))
        flat = F.aggregate(
            when(openers > 0, F.sequence(F.lit(1), openers), F.array().cast("array<int>")), text,
            lambda acc, _: F.regexp_replace(acc, INNER_BRACKETS, ""),
        )
        return occurrences(F.regexp_replace(flat, r"[(\[{].*", ""), MORE_VARIABLES)

    variables = F.regexp_extract_all(code, F.lit(EXPORT_VARIABLES), F.lit(1))
    further = F.aggregate(F.transform(variables, more), F.lit(0), lambda a, n: a + n)
    named = F.size(F.filter(items, lambda x: x.rlike(r"\S")))
    names = statements - F.size(lists) - occurrences(code, EXPORT_ALL) + named + further
    return F.greatest(statements, names)


# --- index of a file ----------------------------------------------------------------------


def parens(texts: Column, found: Column) -> Column:
    """Parentheses ``struct<i, p, q, before, after>``: place among the brackets, places of both signs among the tokens, what stands around those that may be of a function."""

    def around(b: Column, i: Column) -> Column:
        close = F.get(found, b["partner"])["p"]

        def surrounded(head: Column) -> Column:
            return F.struct(
                i.alias("i"), b["p"].alias("p"), close.alias("q"),
                when(head, tokens.words_before(texts, b["p"], 40), "").alias("before"),
                when(head, tokens.words_from(texts, close + 1, 24), "").alias("after"),
            )

        # Of a function, if a type, an arrow or a block follows, or a function word with no more than a star, a name and
        # type arguments stands before. A block after a word that names no method is that of a statement. What is around
        # other parentheses is not asked for.
        head = (
            F.get(texts, close + 1).isin(":", "=>")
            | ((F.get(texts, close + 1) == "{") & ~F.coalesce(F.get(texts, b["p"] - 1).isin(NOT_METHODS), F.lit(False)))
            | F.get(texts, b["p"] - 1).endswith(">")
            | (F.get(texts, b["p"] - 1) == "function") | (F.get(texts, b["p"] - 2) == "function") | (F.get(texts, b["p"] - 3) == "function")
        )
        return bind(F.coalesce(head, F.lit(False)), surrounded)

    known = F.transform(found, lambda b, i: when((b["sign"] == "(") & b["partner"].isNotNull(), around(b, i)))
    return F.filter(known, lambda x: x.isNotNull())


def _type_arrow(x: Column, paren: Column, arrow: Column, up: Column) -> Column:
    """Whether ``(...) =>`` is a function type."""
    texts, numbers = x["texts"], x["numbers"]
    result = F.substring(paren["after"], F.length(F.regexp_extract(paren["after"], TO_ARROW, 0)) - 1, 1000)
    annotated = F.get(texts, paren["p"] - 1) == ":"
    last_on_line = F.get(texts, arrow + 1).isin(TYPE_WORDS) & (F.get(numbers, arrow + 2) > F.get(numbers, arrow + 1))

    def listing(parent: Column) -> Column:
        """The parent's parenthesis lists parameters if a body or an arrow follows it, or a function word stands before it."""
        follows = tokens.words_from(texts, F.get(x["brackets"], parent["partner"])["p"] + 1, 24)
        return (parent["sign"] == "(") & (
            follows.rlike(TO_ARROW) | follows.rlike(TO_BLOCK) | tokens.words_before(texts, parent["p"], 40).rlike(FUNCTION)
        )

    parameters = bind(F.get(x["brackets"], up), listing)
    return (
        matches(result, PLAIN_TYPE) | last_on_line | paren["before"].rlike(ALIAS)
        | (annotated & (matches(result, ENDED_TYPE) | F.coalesce(parameters, F.lit(False))))
    )


def _chains(found: Column) -> Column:
    """States for ``tokens.inherited``: for every closing bracket the last one of the expression it stands in."""

    def state(x: Column) -> Column:
        def joined(b: Column, following: Column) -> Column:
            between = F.slice(x["texts"], b["p"] + 2, F.greatest(following["p"] - b["p"] - 1, F.lit(0)))
            here = F.get(x["numbers"], b["p"] + 1) == b["n"]
            goes_on = (
                following["opens"] & following["partner"].isNotNull()
                & (here | F.get(x["texts"], b["p"] + 1).isin(CONTINUES))
                & ((following["p"] == b["p"] + 1) | ~F.exists(between, lambda t: t.isin(",", ";", "=>")))
            )
            return when(goes_on, following["partner"])

        def one(b: Column, i: Column) -> Column:
            # Openers are never asked for.
            link = when(~b["opens"], bind(F.get(x["brackets"], i + 1), lambda following: joined(b, following)))
            return bind(link, lambda to: F.struct(when(to.isNull(), i).alias("value"), to.alias("link")))

        return F.transform(x["brackets"], one)

    return state(found)


def heads(x: Column, last: Column, known: Column | None = None) -> Column:
    """Functions of an indexed file whose parameters stand in parentheses; with these (``known``) all in source order.

    ``struct<start_p, end_p, start, end, kind, name, is_async, i, arrow>``; kind says how
    the name was found, i is the place of the parameters among the brackets (null: a single name), arrow
    that of its arrow among the tokens (null: none).
    """
    texts, numbers, found = x["texts"], x["numbers"], x["brackets"]
    total = F.size(texts)

    def named(stem: Column, own: Column) -> Column:
        """kind and name from what stands before; own: the name of a declaration, else empty."""
        variable = when(stem.endswith("="), F.regexp_extract(stem, VARIABLE, 1), "")
        prop = when(stem.endswith(":"), F.regexp_extract(stem, PROPERTY, 1), "")
        last_word = F.substring_index(stem, " ", -1)
        return when(
            variable != "", F.struct(F.lit("variable").alias("kind"), variable.alias("name")),
            prop != "", F.struct(F.lit("property").alias("kind"), prop.alias("name")),
            F.struct(F.lit("own").alias("kind"), when(last_word.rlike(EXPRESSION), "", own).alias("name")),
        )

    def spanned(start: Column, end: Column, stem: Column, own: Column, is_async: Column, i: Column, arrow: Column) -> Column:
        def build(name: Column) -> Column:
            return F.struct(
                start.alias("start_p"), F.coalesce(end, total).alias("end_p"), F.get(numbers, start).alias("start"),
                F.get(numbers, end).alias("end"), name["kind"].alias("kind"), name["name"].alias("name"), is_async.alias("is_async"),
                i.alias("i"), arrow.alias("arrow"),
            )

        return bind(named(stem, own), build)

    def expression_end(arrow: Column, following: Column, last: Column) -> Column:
        """Place of the last token of an arrow's body; following: place of the next bracket among the brackets."""
        return bind(
            F.struct(F.get(found, following).alias("b"), arrow.alias("arrow")), lambda y: body_end(y["arrow"], y["b"], last)
        )

    def body_end(arrow: Column, b: Column, last: Column) -> Column:
        between = F.slice(texts, arrow + 2, F.greatest(b["p"] - arrow - 1, F.lit(0)))
        reaches = b["opens"] & b["partner"].isNotNull() & ~F.arrays_overlap(between, F.array(F.lit(","), F.lit(";")))
        block = (b["sign"] == "{") & (b["p"] == arrow + 1)
        end = when(block, b["partner"], reaches, F.get(last, b["partner"]))
        open_end = b["opens"] & (b["p"] == arrow + 1) & b["partner"].isNull()
        return when(open_end, F.lit(None).cast("int"), F.coalesce(F.get(found, end)["p"], F.least(arrow + 1, total - 1)))

    def method_words(paren: Column) -> Column:
        """What ``METHOD`` finds before a parenthesis: in the last eight words, unless it may reach beyond these."""

        def near(words: Column) -> Column:
            long = F.regexp_extract(paren["before"], METHOD, 0)
            found = bind(
                F.regexp_extract(words, METHOD, 0),
                lambda name: when((paren["p"] > 8) & (tokens.word_count(name) >= 7), long, name),
            )
            return when(words.endswith(">"), long, found)

        return bind(tokens.words_before(texts, paren["p"], 8), near)

    def of_paren(paren: Column, last: Column) -> Column:
        """A head, if a body, an arrow or a type follows or a function word stands before; most parentheses have neither."""
        before, after = paren["before"], paren["after"]
        function = when(before.contains("function"), F.regexp_extract(before, FUNCTION, 0), "")

        def of_parts(parts: Column) -> Column:
            """Of arrow, method and function only the one that is meant is read on."""
            to_arrow, to_block, named = parts["to_arrow"], parts["to_block"], parts["function"] != ""
            method = ~named & (to_arrow == "") & (to_block != "")
            tail = ~named & (to_arrow != "") & (before.endswith("async") | before.endswith(">"))
            read = F.struct(
                to_arrow.alias("to_arrow"), to_block.alias("to_block"), parts["function"].alias("function"),
                when(method, method_words(paren), "").alias("method"),
                when(tail, F.regexp_extract(before, ASYNC_ARROW, 0), "").alias("tail"),
            )
            return when(named | (to_arrow != "") | method, bind(read, lambda words: of_words(paren, words, last)))

        def of_function(name: Column) -> Column:
            typed = after.startswith(":")
            parts = F.struct(
                when(typed | after.startswith("=>"), F.regexp_extract(after, TO_ARROW, 0), "").alias("to_arrow"),
                when(typed | after.startswith("{"), F.regexp_extract(after, TO_BLOCK, 0), "").alias("to_block"),
                name.alias("function"),
            )
            possible = after.startswith("=>") | after.startswith("{") | typed | (name != "")
            return when(possible, bind(parts, of_parts))

        return bind(function, of_function)

    def of_words(paren: Column, words: Column, last: Column) -> Column:
        before = paren["before"]
        to_arrow, to_block, function, method = (words[c] for c in ("to_arrow", "to_block", "function", "method"))
        close = F.get(found, paren["i"])["partner"]
        without_end = lambda text, end: F.rtrim(text.substr(F.lit(1), F.length(text) - F.length(end)))
        no_arrow = F.lit(None).cast("int")
        signs = lambda text: F.length(F.regexp_replace(text, r"[^(){}\[\]]", ""))
        block_end = F.get(found, F.get(found, close + signs(to_block))["partner"])["p"]
        up = tokens.around(x["ordered"], F.get(found, paren["i"])["level"], paren["i"])
        arrow = paren["q"] + tokens.word_count(to_arrow)

        of_function = spanned(
            paren["p"] - tokens.word_count(function),
            when(to_block != "", block_end, paren["q"]),
            without_end(before, function), F.regexp_extract(function, FUNCTION, 1),
            function.startswith("async"), paren["i"], no_arrow,
        )
        tail = words["tail"]
        of_arrow = spanned(
            paren["p"] - tokens.word_count(F.trim(tail)), expression_end(arrow, close + signs(to_arrow) + 1, last),
            without_end(before, tail), F.lit(""), tail.startswith("async"), paren["i"], arrow,
        )
        name = F.regexp_extract(method, METHOD, 2)
        of_method = spanned(
            paren["p"] - tokens.word_count(method), block_end, F.lit(""), name,
            matches_with(F.regexp_extract(method, METHOD, 1), r"(?<!\w)async(?!\w)", "async"), paren["i"], no_arrow,
        )
        is_method = (
            (to_block != "") & (method != "") & ~name.isin(NOT_METHODS)
            & ~matches_with(before, ACCESSOR, "get ", "set ") & (F.get(found, up)["sign"] == "{")
        )
        # Function types are found, too, and keep their arrows from being read as those of a single name.
        return when(
            function != "", of_function,
            to_arrow != "", bind(of_arrow, lambda h: h.withField("kind", when(_type_arrow(x, paren, arrow, up), "type", h["kind"]))),
            is_method, of_method,
        )

    def single(arrow: Column, last: Column) -> Column:
        before = tokens.words_before(texts, arrow - 1, 40)
        following = tokens.first_at_least(x["places"], arrow)
        is_async = F.get(texts, arrow - 2) == "async"
        return spanned(
            arrow - 1 - is_async.cast("int"), expression_end(arrow, following, last),
            F.rtrim(when(is_async, before.substr(F.lit(1), F.length(before) - 5), before)), F.lit(""), is_async, F.lit(None).cast("int"), arrow,
        )

    if known is None:
        return F.filter(F.transform(x["parens"], lambda paren: of_paren(paren, last)), lambda h: h.isNotNull())
    claimed = F.transform(F.filter(known, lambda h: h["arrow"].isNotNull()), lambda h: h["arrow"])
    every = F.filter(F.transform(texts, lambda t, i: when(t == "=>", i)), lambda i: i.isNotNull())
    free = F.filter(
        F.array_except(every, claimed),
        lambda i: F.get(texts, i - 1).rlike(f"^{tokens.NAME}$") & ~F.coalesce(F.get(texts, i - 2).isin(".", "|", "&", "is", "extends"), F.lit(False)),
    )
    return F.sort_array(F.concat(known, F.transform(free, lambda i: single(i, last))))


def parameter_count(x: Column, i: Column) -> Column:
    """Parameters between a parenthesis (its place among the brackets) and its partner; null means a single name."""
    b = F.get(x["brackets"], i)
    close = F.get(x["brackets"], b["partner"])["p"]
    inside = F.array_join(F.slice(x["texts"], b["p"] + 2, F.greatest(close - b["p"] - 1, F.lit(0))), " ")
    deepest = F.array_max(F.transform(F.slice(x["brackets"], i + 2, F.greatest(b["partner"] - i - 1, F.lit(0))), lambda c: c["level"]))
    bare = F.replace(tokens.without_inner_brackets(inside, F.coalesce(deepest - b["level"], F.lit(0))), F.lit("=>"), F.lit("~"))

    def counted(text: Column) -> Column:
        plain = text
        for _ in range(3):
            plain = F.regexp_replace(plain, "<[^<>]*>", "x")
        return F.size(F.filter(F.split(when(text.contains("<"), plain, text), ","), lambda p: p.rlike(r"\S")))

    count = bind(bare, counted)
    return when(i.isNull(), F.lit(1), count)


def _on_result(c: Column) -> Column:
    return F.coalesce(c["previous"].isin(".", "?."), F.lit(False))


def call_names(listed: Column, texts: Column) -> Column:
    """Names right before parentheses: ``struct<i, p, start, previous, chain, tail>``."""

    def whole(paren: Column) -> Column:
        """Text of the name. Most names are short: the last eight words tell them, unless the name
        may reach beyond these or type arguments or ``?.`` stand behind it."""

        def near(words: Column) -> Column:
            long = F.regexp_extract(tokens.words_before(texts, paren["p"], 40), CHAIN, 0)
            short = bind(
                F.regexp_extract(words, CHAIN, 0),
                lambda name: when((paren["p"] > 8) & (tokens.word_count(name) >= 7), long, name),
            )
            return when(words.endswith(">") | words.endswith("?."), long, short)

        return bind(tokens.words_before(texts, paren["p"], 8), near)

    def own(paren: Column, name: Column) -> Column:
        start = paren["p"] - tokens.word_count(name)
        return F.struct(
            paren["i"].alias("i"), paren["p"].alias("p"), start.alias("start"), F.get(texts, start - 1).alias("previous"),
            F.regexp_extract(name, CHAIN, 1).alias("chain"), F.trim(F.regexp_extract(name, CHAIN, 2)).alias("tail"),
        )

    named = F.transform(listed, lambda paren: bind(whole(paren), lambda name: when(name != "", own(paren, name))))
    return F.filter(named, lambda c: c.isNotNull())


def call_roots(found: Column, named: Column, places: Column) -> Column:
    """States for ``tokens.inherited``: root name and start of each call, or the call on whose result it is made."""

    def state(c: Column) -> Column:
        before = F.get(found, c["i"] - 1)
        linked = _on_result(c) & (before["sign"] == ")") & (before["p"] == c["start"] - 2) & before["partner"].isNotNull()
        place = when(F.coalesce(linked, F.lit(False)), tokens.first_at_least(places, before["partner"]))
        first = F.substring_index(c["chain"], " ", 1)
        no_root = _on_result(c) | first.isin("this", "super") | F.coalesce(c["previous"] == "new", F.lit(False))
        root = F.struct(when(no_root, "", first).alias("name"), c["start"].alias("start"))

        def placed(at: Column) -> Column:
            link = when(F.get(places, at) == before["partner"], at)
            return F.struct(when(link.isNull(), root).alias("value"), link.alias("link"))

        return bind(place, placed)

    return F.transform(named, state)


def calls(x: Column, named: Column, places: Column, roots: Column, found_heads: Column) -> Column:
    """Calls of an indexed file in the order of their parentheses: ``struct<p, expression, receiver, method, dotted, line>``.

    A call on a call result has the receiver of that call; names of declared functions
    and methods, and of classes after ``new``, are no calls. Without a name at its root
    an expression keeps a leading dot and has no receiver.
    """

    def one(c: Column, root: Column) -> Column:
        plain = F.replace(c["chain"], F.lit(" "), F.lit(""))
        length = c["p"] - root["start"] - tokens.word_count(c["tail"])
        whole = tokens.compact(F.array_join(F.slice(x["texts"], root["start"] + 1, F.greatest(length, F.lit(0))), " "))
        return F.struct(
            c["p"].alias("p"),
            when(~_on_result(c), plain, root["name"] != "", whole, F.concat(F.lit("."), plain)).alias("expression"),
            F.nullif(root["name"], F.lit("")).alias("receiver"),
            F.substring_index(c["chain"], " ", -1).alias("method"),
            (_on_result(c) | c["chain"].contains(" ")).alias("dotted"),
            F.get(x["numbers"], root["start"]).alias("line"),
        )

    heads_at = F.transform(F.filter(found_heads, lambda h: h["i"].isNotNull()), lambda h: h["i"])
    free = F.transform(F.array_except(places, heads_at), lambda i: tokens.first_at_least(places, i))
    called = F.filter(
        free,
        lambda k: ~F.get(named, k)["chain"].isin(NOT_CALLED) & ~F.coalesce(F.get(named, k)["previous"].isin("new", "get", "set"), F.lit(False)),
    )
    return F.transform(called, lambda k: one(F.get(named, k), F.get(roots, k)))


def hook_count(found: Column) -> Column:
    return F.size(F.filter(found, lambda c: c["expression"].rlike("^use[A-Z0-9]") | c["expression"].contains(".use")))


def request_call(call: Column, bindings: Column) -> Column:
    """Evidence row for a call, null kind if it is no request."""
    receiver, method, dotted = call["receiver"], call["method"], call["dotted"]

    def classify(module: Column) -> Column:
        service = F.coalesce(matches(module, fixed.SERVICE_MODULE), F.lit(False))
        client = receiver.rlike(f"(?i)^(?:{'|'.join(fixed.CLIENT_NAMES)})$") | F.coalesce(
            matches(module, fixed.CLIENT_MODULE), F.lit(False)
        )
        kind = (
            when(
                receiver.isNull(), F.lit(None).cast("string"),
                ~dotted, when(
                    receiver.isin(fixed.NETWORK_NAMES), F.lit("network-call"),
                    service, F.lit("service-call"),
                    receiver.isin(fixed.DATA_HOOK_NAMES), F.lit("data-hook"),
                ),
                method.isin(fixed.PROMISE_METHODS), F.lit(None).cast("string"),
                receiver == fixed.QUERY_BUILDER_RECEIVER, when(method != fixed.QUERY_BUILDER_START, F.lit("client-call")),
                receiver.isin(fixed.NETWORK_RECEIVERS), F.lit("network-call"),
                service, F.lit("service-call"),
                method.isin(fixed.HTTP_VERBS) & client, F.lit("client-call"),
            )
        )
        return F.struct(
            call["expression"].alias("expression"),
            kind.alias("kind"),
            call["line"].cast("int").alias("line"),
            when(dotted, receiver).alias("receiver"),
            when(dotted | (kind != "network-call"), module).alias("import_source"),
        )

    own = F.filter(bindings, lambda b: b["local"] == receiver)
    module = F.try_element_at(own, F.lit(-1))["module"]
    return bind(module, classify)


def request_calls(found: Column, bindings: Column) -> Column:
    """Bindings are read from the text once, not for every call."""
    return bind(bindings, lambda known: requests(F.transform(found, lambda c: request_call(c, known))))


def requests(evidence: Column) -> Column:
    return F.filter(evidence, lambda e: e["kind"].isNotNull())


def bracket_delta(line: Column) -> Column:
    openers = occurrences_with(line, r"[(\[{]", "(", "[", "{")
    return openers - occurrences_with(line, r"[)\]}]", ")", "]", "}")


def leading_closers(line: Column) -> Column:
    closers = F.length(F.regexp_replace(F.regexp_extract(line, r"^[\s)\]};,]*", 0), r"[^)\]}]", ""))
    return when(has_any(line, ")", "]", "}"), closers, 0)


def line_facts(code_lines: Column) -> Column:
    """Bracket, decision and try facts of every line of a file.

    branches are its words among the conditions; points are its words, catches and logical
    operators: none of these reaches over a line end, so those of a body are the sums of its lines.
    """

    def facts(line: Column, i: Column) -> Column:
        closing = line.contains("}")
        words = occurrences_with(line, DECISION, *DECISION_WORDS)

        def counted(words: Column) -> Column:
            return F.struct(
                (i + 1).cast("int").alias("n"),
                bracket_delta(line).alias("delta"),
                leading_closers(line).alias("closers"),
                (words + occurrences_with(line, TERNARY, "?")).alias("decisions"),
                (closing & matches(line, ELSE_IF)).alias("chained"),
                (closing & matches(line, TRY_CONTINUES)).alias("continues"),
                (line.contains("try") & matches(line, TRY)).alias("tries"),
                when(words > 0, occurrences(line, BRANCH), 0).alias("branches"),
                (
                    words + occurrences_with(line, CATCH, "catch") + occurrences_with(line, LOGICAL, "&&", "||", "??")
                ).alias("points"),
            )

        no, none = F.lit(False), F.lit(0)
        blank = [none, none, none, no, no, no, none, none]
        names = ["delta", "closers", "decisions", "chained", "continues", "tries", "branches", "points"]
        nothing = F.struct((i + 1).cast("int").alias("n"), *[v.alias(c) for v, c in zip(blank, names, strict=True)])
        return when(F.trim(line) == "", nothing, bind(words, counted))

    return F.transform(code_lines, facts)


def telling(facts: Column) -> Column:
    """Facts without the lines that change nothing in ``nesting`` and in the sums of a body.

    A line without any of the facts only drops what stands as deep as it; a second one after it drops nothing more.
    """
    quiet = lambda x: F.coalesce(
        (x["delta"] == 0) & (x["closers"] == 0) & (x["decisions"] == 0) & (x["points"] == 0)
        & ~x["chained"] & ~x["continues"] & ~x["tries"],
        F.lit(False),
    )
    return F.filter(facts, lambda x, i: ~(quiet(x) & quiet(F.get(facts, i - 1))))


def nesting(facts: Column, last: Column) -> Column:
    """Deepest nesting of decisions and total lines of try statements in a body that ends with the line ``last``."""
    pair = "array<struct<start:int,depth:int>>"

    def step(acc, x):
        low = acc["depth"] - x["closers"]
        after = acc["depth"] + x["delta"]
        kept = when(x["chained"], acc["open"], F.filter(acc["open"], lambda d: d < low))
        ending = when(x["continues"], F.array().cast(pair), F.filter(acc["tries"], lambda t: t["depth"] >= low))
        ended_lines = F.aggregate(ending, F.lit(0), lambda sum_, t: sum_ + x["n"] - t["start"] + 1)
        running = when(x["continues"], acc["tries"], F.filter(acc["tries"], lambda t: t["depth"] < low))
        own_try = F.struct(x["n"].alias("start"), low.alias("depth"))
        decided = x["decisions"] > 0
        return F.struct(
            after.alias("depth"),
            when(decided & (after > low), F.array_append(kept, low), kept).alias("open"),
            when(decided, F.greatest(acc["deepest"], F.size(kept) + x["decisions"]), acc["deepest"])
            .alias("deepest"),
            when(x["tries"] & (after > low), F.array_append(running, own_try), running).alias("tries"),
            (acc["try_lines"] + ended_lines + when(x["tries"] & (after <= low), 1, 0)).alias("try_lines"),
        )

    zero = F.struct(
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("open"),
        F.lit(0).alias("deepest"),
        F.array().cast(pair).alias("tries"),
        F.lit(0).alias("try_lines"),
    )
    return F.aggregate(
        facts,
        zero,
        step,
        lambda acc: F.struct(
            acc["deepest"].alias("deepest"),
            (
                acc["try_lines"]
                + F.aggregate(acc["tries"], F.lit(0), lambda sum_, t: sum_ + last - t["start"] + 1)
            ).alias("try_lines"),
        ),
    )


def hashed_text(kind: Column, name: Column, bare_lines: Column) -> Column:
    """Function text without what stands before its start and after its end."""
    quoted = F.replace(name, F.lit("$"), F.lit("\\$"))
    variable = F.concat(F.lit(r"^.*?(?:const|let|var)\s+"), quoted, F.lit(r"(?:\s*:(?:[^=;]|=>)*)?\s*=(?!>)\s*"))
    prop = F.concat(F.lit(r"^(?:.*?[\s{,])?"), quoted, F.lit(r"\s*:\s*"))
    head = F.get(bare_lines, F.lit(0))
    cut_head = when(
        kind == "variable", F.regexp_replace(head, variable, F.lit("")),
        kind == "property", F.regexp_replace(head, prop, F.lit("")),
        head,
    )
    last = F.get(bare_lines, F.size(bare_lines) - 1)
    brace = F.regexp_extract(last, r"^\s*\}", 0)
    cut_last = when(brace != "", brace, last)
    middle = F.slice(bare_lines, F.lit(2), F.greatest(F.lit(0), F.size(bare_lines) - 2))
    return F.array_join(F.concat(F.array(cut_head), middle, F.array(cut_last)), "\n")


def functions(
    x: Column, found: Column, called: Column, places: Column, evidence: Column, facts: Column, told: Column, code_lines: Column, bare_lines: Column
) -> Column:
    """Functions of one TypeScript or JavaScript file, in source order.

    places: those of the calls among the tokens; evidence: what ``request_call`` says of them; facts: those of the telling lines; told: the numbers of these.
    """

    def body_of(h: Column, i: Column) -> Column:
        end = F.coalesce(h["end"], F.size(code_lines))
        place = lambda p: tokens.first_at_least(places, p)
        line = lambda n: tokens.first_at_least(told, n)
        cut = lambda values, y: F.slice(values, y["a"] + 1, F.greatest(y["b"] - y["a"], F.lit(0)))
        own = bind(
            F.struct(place(h["start_p"]).alias("a"), place(h["end_p"] + 1).alias("b")),
            lambda y: F.struct(hook_count(cut(called, y)).alias("hooks"), F.size(requests(cut(evidence, y))).alias("requests")),
        )
        own_facts = bind(F.struct(line(h["start"]).alias("a"), line(end + 1).alias("b")), lambda y: cut(facts, y))
        return bind(
            F.struct(
                line_slice(code_lines, h["start"], end).alias("lines"), own_facts.alias("facts"),
                own.alias("calls"), end.alias("end"), parameter_count(x, h["i"]).alias("parameters"),
            ),
            lambda part: one(h, i, part),
        )

    def one(h: Column, i: Column, part: Column) -> Column:
        size = F.size(part["lines"])
        anonymous = F.concat(F.lit(fixed.ANONYMOUS_PREFIX), h["start"].cast("string"))

        def build(x: Column) -> Column:
            body, nested, text = x["body"], x["nested"], x["text"]
            ternaries = occurrences_with(body, TERNARY, "?")
            total = lambda fact: F.aggregate(part["facts"], F.lit(0), lambda sum_, line: sum_ + line[fact])
            return F.struct(
                i.cast("int").alias("fn_ord"),
                when(h["name"] == "", anonymous, h["name"]).alias("name"),
                h["start"].cast("int").alias("start_line"),
                part["end"].cast("int").alias("end_line"),
                size.alias("line_count"),
                part["parameters"].alias("parameter_count"),
                h["is_async"].alias("is_async"),
                matches_with(body, TRY, "try").alias("has_try"),
                nested["try_lines"].alias("try_lines"),
                (total("branches") + ternaries).alias("conditional_count"),
                nested["deepest"].alias("max_depth"),
                (1 + total("points") + ternaries).alias("complexity"),
                part["calls"]["hooks"].alias("hook_count"),
                part["calls"]["requests"].alias("api_call_count"),
                returns_markup(body).alias("returns_jsx"),
                when(size >= fixed.MIN_HASHED_LINES, body_hash(text, False)).alias("body_hash"),
                F.coalesce(text.contains(fixed.BLOB_READER_REQUEST), F.lit(False)).alias("blob_request"),
                F.coalesce(matches_with(text, fixed.BLOB_READER_TYPE, "responseType"), F.lit(False)).alias("blob_type"),
            )

        return bind(
            F.struct(
                F.array_join(part["lines"], "\n").alias("body"),
                nesting(part["facts"], part["end"]).alias("nested"),
                hashed_text(h["kind"], h["name"], line_slice(bare_lines, h["start"], part["end"])).alias("text"),
            ),
            build,
        )

    return F.transform(F.filter(found, lambda h: h["kind"] != "type"), body_of)


@built_once
def _steps() -> list[tuple[str, Column]]:
    """Columns from the lines of a file to its calls and functions, each made of earlier ones.

    What a step reads is handed on as a whole, so every step is evaluated once.
    """
    out: list[tuple[str, Column]] = []

    def step(name: str, inputs: list[str], make: Callable[..., Column]) -> None:
        given = F.struct(*[F.col(f"_{c}").alias(c) for c in inputs])
        out.append((f"_{name}", bind(given, lambda y: make(*[y[c] for c in inputs]))))

    step("stream", ["code"], tokens.tokens)
    step("signs", ["stream"], tokens.signs)
    step("depths", ["signs"], tokens.depths)
    step("ordered", ["signs", "depths"], tokens.by_level)
    step("partners", ["ordered"], tokens.partners)
    step("brackets", ["signs", "partners"], tokens.brackets)
    step("places", ["brackets"], lambda b: b["p"])
    step("texts", ["stream"], lambda s: s["t"])
    step("numbers", ["stream"], lambda s: s["n"])
    step("parens", ["texts", "brackets"], parens)
    index = ("texts", "numbers", "brackets", "ordered", "parens", "places")
    out.append(("_x", F.struct(*[F.col(f"_{c}").alias(c) for c in index])))
    step("ends", ["x"], _chains)
    step("last", ["ends"], tokens.inherited)
    step("known", ["x", "last"], heads)
    step("heads", ["x", "last", "known"], heads)
    step("named", ["parens", "texts"], call_names)
    step("named_places", ["named"], lambda n: n["i"])
    step("links", ["brackets", "named", "named_places"], call_roots)
    step("roots", ["links"], tokens.inherited)
    step("calls", ["x", "named", "named_places", "roots", "heads"], calls)
    step("call_places", ["calls"], lambda k: k["p"])
    step("evidence", ["calls", "bindings"], lambda k, b: F.transform(k, lambda c: request_call(c, b)))
    step("facts", ["code"], line_facts)
    step("telling", ["facts"], telling)
    step("told", ["telling"], lambda t: t["n"])
    step("functions", ["x", "heads", "calls", "call_places", "evidence", "telling", "told", "code", "bare"], functions)
    return out


def with_parsed(files: DataFrame, code: Column, bare: Column) -> DataFrame:
    """``files`` with ``parsed``: calls, requests and functions of a script, ``struct<calls, requests, functions>``."""
    kept = files.columns
    files = files.withColumns({"_code": lines_of(code), "_bare": lines_of(bare), "_bindings": import_bindings(bare)})
    for name, column in _steps():
        files = files.withColumn(name, column)
    return files.select(*kept, F.struct(F.col("_calls").alias("calls"), requests(F.col("_evidence")).alias("requests"), F.col("_functions").alias("functions")).alias("parsed"))


def responsibilities(path: Column, content: Column, code: Column, has_calls: Column) -> Column:
    """Tags of a TypeScript or JavaScript file, sorted; the words of its text are taken out once."""

    def tags(words: Column) -> Column:
        has = lambda *wanted: has_cased_word(content, words, *wanted)
        has_any_case = lambda *wanted: has_word(content, words, *wanted, ignore_case=True)

        def starts(parts: list[str], prefixes: list[str], ignore_case: bool = False) -> Column:
            found = F.arrays_overlap(words, F.array(*[F.lit(w) for w in parts]))
            return found & matches(content, word_starts(*prefixes, ignore_case=ignore_case))

        # Signs outside ASCII whose lower case is within it change the words of the text in lower case.
        logic = when(
            has_any(content, "\u212a", "\u0130"), matches(F.lower(content), whole_words(*fixed.SCRIPT_LOGIC_WORDS)),
            has_any_case(*fixed.SCRIPT_LOGIC_WORDS),
        )
        return F.array(
            when(paths.is_test_file(path), "testing"),
            when(path.rlike(r"\.(tsx|jsx)$") | returns_markup(code), "ui"),
            when(has(*fixed.SCRIPT_STATE_WORDS), "state"),
            when(has_calls, "data-fetching"),
            when(has_any_case(*fixed.SCRIPT_VALIDATION_WORDS), "validation"),
            when(
                has_any_case(*fixed.SCRIPT_DATABASE_WORDS) | starts(DATABASE_PARTS, fixed.SCRIPT_DATABASE_PREFIXES, ignore_case=True),
                "database",
            ),
            when(has_any_case(*fixed.SCRIPT_AUTH_WORDS), "auth"),
            when(has(*fixed.SCRIPT_ROUTING_WORDS) | starts(ROUTING_PARTS, fixed.SCRIPT_ROUTING_PREFIXES), "routing"),
            when(has(*fixed.SCRIPT_STYLING_WORDS) | starts(STYLING_PARTS, fixed.SCRIPT_STYLING_PREFIXES), "styling"),
            when(matches_with(code, TOP_LEVEL_FUNCTION, "function") | logic, "business-logic"),
        )

    return F.array_sort(F.array_compact(bind(listed_words(content, TAG_WORDS), tags)))
