"""Token stream of a script with an index of its matching brackets, as array columns.

Nothing here grows a list inside a fold. Depths are running sums made by doubling,
partners are neighbours in the order of (depth, position), the bracket around one is
searched in that order, and what a bracket takes over from an earlier one (the root of a
call chain) is found by pointer doubling. So a file of n tokens costs n log n, whatever stands in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, when

NAME = r"[A-Za-z_$\u0080-\uFFFF][\w$\u0080-\uFFFF]*"
TOKEN = rf'{NAME}|\d[\w.]*|=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|""|``|\S'
TOKEN_TYPE = "struct<t:string,n:int>"


def tokens(code_lines: Column) -> Column:
    """``array<struct<t, n>>``: text and line of every token."""
    per_line = F.transform(
        code_lines,
        lambda line, i: F.transform(
            F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)),
            lambda t: F.struct(t.alias("t"), (i + 1).cast("int").alias("n")),
        ),
    )
    return F.flatten(per_line)


def _rounds(values: Column) -> Column:
    """0, 1, ... until 2**k covers the array."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))


def _doublings(values: Column) -> Column:
    """0, 1, ... so that steps of 2**k add up to the array."""
    return F.sequence(F.lit(0), (F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))) - 1).cast("int"))


def running_sum(values: Column) -> Column:
    """Sums of an integer array up to every place."""

    def doubled(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0)))

    return F.aggregate(_doublings(values), values, doubled)


def first_at_least(values: Column, least: Column) -> Column:
    """Place of the first of ascending integers that is ``least`` or more; the size if there is none."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        below = F.get(values, middle) < least
        return when(
            acc["low"] < acc["high"], F.struct(when(below, middle + 1, acc["low"]).alias("low"), when(below, acc["high"], middle).alias("high")),
            acc,
        )

    whole = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(_rounds(values), whole, halve, lambda acc: acc["low"])


def range_minima(values: Column) -> Column:
    """Minima of 1, 2, 4, ... values from every place on; for ``first_at_most``."""

    def longer(acc: Column, k: Column) -> Column:
        ahead = F.call_function("shiftleft", F.lit(1), k)
        last = F.element_at(acc, -1)
        return F.array_append(acc, F.transform(last, lambda x, i: F.least(x, F.get(last, i + ahead))))

    return F.aggregate(_doublings(values), F.array(values), longer)


def first_at_most(minima: Column, start: Column, most: Column) -> Column:
    """Place of the first value from ``start`` on that is ``most`` or less; the size or more if there is none."""

    def jump(at: Column, table: Column) -> Column:
        k = F.size(minima) - 1 - table
        far = F.get(F.get(minima, k), at) > most
        return when(far, at + F.call_function("shiftleft", F.lit(1), k), at)

    return F.aggregate(F.sequence(F.lit(0), F.size(minima) - 1), start, jump)


def inherited(states: Column) -> Column:
    """Values of ``array<struct<value, link>>``: a null value is that of the element the link names, and so on."""

    def jump(acc: Column, _: Column) -> Column:
        def own(state: Column) -> Column:
            other = F.get(acc, state["link"])
            return when(
                state["value"].isNotNull() | state["link"].isNull(), state,
                F.struct(other["value"].alias("value"), other["link"].alias("link")),
            )

        # Most chains are short: a round is skipped when every state is settled.
        open_ = F.exists(acc, lambda state: state["value"].isNull() & state["link"].isNotNull())
        return when(open_, F.transform(acc, own), acc)

    return F.transform(F.aggregate(_rounds(states), states, jump), lambda s: s["value"])


# The index is made in steps, each a function of the column of the step before; a caller keeps them as
# columns (one expression would nest deeper than the analyzer goes).


def signs(stream: Column) -> Column:
    """``array<struct<p, sign, n, opens>>``: the brackets of a stream."""
    # No token has two of the signs, so a token within the list of them is one.
    one_of = lambda listed, t: F.lit(listed).contains(t)
    found = F.transform(
        stream,
        lambda x, i: when(
            one_of("()[]{}", x["t"]), F.struct(i.alias("p"), x["t"].alias("sign"), x["n"].alias("n"), one_of("([{", x["t"]).alias("opens")),
        ),
    )
    return F.filter(found, lambda b: b.isNotNull())


def depths(found: Column) -> Column:
    """Number of open brackets after each one."""
    return running_sum(F.transform(found, lambda b: when(b["opens"], 1, -1)))


def by_level(found: Column, depth: Column) -> Column:
    """``array<struct<level, i, opens>>`` in the order of level and place; a bracket and its partner are on one level."""
    return F.sort_array(
        F.transform(
            found,
            lambda b, i: F.struct(
                (F.get(depth, i) + when(b["opens"], 0, 1)).alias("level"), i.alias("i"), b["opens"].alias("opens")
            ),
        )
    )


def partners(ordered: Column) -> Column:
    """``array<struct<i, level, partner>>`` in order; partner: place among the brackets, null if there is none."""

    def partner(s: Column, k: Column) -> Column:
        other = F.get(ordered, k + when(s["opens"], 1, -1))
        return when((other["level"] == s["level"]) & (other["opens"] != s["opens"]), other["i"])

    return F.sort_array(
        F.transform(ordered, lambda s, k: F.struct(s["i"].alias("i"), s["level"].alias("level"), partner(s, k).alias("partner")))
    )


def brackets(found: Column, known: Column) -> Column:
    """``array<struct<p, sign, n, opens, level, partner>>`` in order."""
    return F.transform(
        found,
        lambda b, i: F.struct(
            b["p"].alias("p"), b["sign"].alias("sign"), b["n"].alias("n"), b["opens"].alias("opens"),
            F.get(known, i)["level"].alias("level"), F.get(known, i)["partner"].alias("partner"),
        ),
    )


def around(ordered: Column, level: Column, i: Column) -> Column:
    """Place of the opener around an opener on a level; -1 if there is none.

    On every level openers and closers take turns, so it is the last bracket before on the level below.
    """
    own = F.struct((level - 1).alias("level"), i.alias("i"), F.lit(False).alias("opens"))
    found = bind(own, lambda s: F.struct(s["level"].alias("level"), F.get(ordered, first_at_least(ordered, s) - 1).alias("last")))
    return bind(
        found, lambda x: when((x["last"]["level"] == x["level"]) & x["last"]["opens"], x["last"]["i"], F.lit(-1))
    )


def words_before(texts: Column, place: Column, most: int) -> Column:
    """The tokens right before a place, with blanks between."""
    start = F.greatest(place - most, F.lit(0))
    return F.array_join(F.slice(texts, start + 1, F.greatest(place - start, F.lit(0))), " ")


def words_from(texts: Column, place: Column, most: int) -> Column:
    """The tokens from a place on, with blanks between."""
    return F.array_join(F.slice(texts, place + 1, F.lit(most)), " ")


def word_count(words: Column) -> Column:
    return when(words == "", 0, F.size(F.split(words, " ")))


def compact(words: Column) -> Column:
    """Tokens as source text, without the blanks that are not needed."""
    return F.regexp_replace(words, r" ?((?!\$)[^\w $]+) ?", "$1")


def without_inner_brackets(words: Column, rounds: Column) -> Column:
    """Text in which every outer bracket pair is an x."""
    return F.aggregate(
        when(rounds > 0, F.sequence(F.lit(1), rounds), F.array().cast("array<int>")), words,
        lambda acc, _: F.regexp_replace(acc, r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}", "x"),
    )
