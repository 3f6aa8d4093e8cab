"""Texts are read once for many words, and plain classes of signs give what the wider ones gave."""

import hashlib
import re

from pyspark.sql import functions as F

from codestrata import fixed
from codestrata.functions import script, text, tokens

TEXTS = [
    "", "Auth", "unauth auth_ AUTH1", "loginİ", "toKen x", "toKen", "javax.validation.Valid", "javax validation", "my_javax.validation",
    "JAVAX.Validation", "x.django.db;", "django.dbx", "éroute", "route9", "urllib.request", "urllibxrequest", "if(", "else if",
]


def test_words_taken_out_once_match_like_their_pattern(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    words = text.distinct_words(F.col("t"))
    lowered = F.transform(words, F.lower)
    for listed in (fixed.TAG_VALIDATION_WORDS, fixed.TAG_DATABASE_WORDS, fixed.TAG_AUTH_WORDS, fixed.HTTP_CLIENTS, fixed.TAG_ROUTING_WORDS, fixed.TAG_LOGIC_WORDS):
        for any_case in (False, True):
            got = text.has_word(F.col("t"), lowered if any_case else words, *listed, ignore_case=any_case)
            want = text.matches(F.col("t"), text.whole_words(*listed, ignore_case=any_case))
            wrong = rows.select("t", got.alias("got"), want.alias("want")).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
            assert wrong == [], listed


def test_comments_and_wide_space(spark):
    texts = ["a # b c # d\re", "a // b c /* x\n// y */ z\n", "a\u0085b // c\u0085d", "x /* open", "p q　　r é", "é  f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    line = lambda t, sign: re.sub(sign + "[^\n\r  ]*", "", t)
    slashes = lambda t: re.sub(r"(?s)/\*.*?\*/", "", line(t, "//"))

    def digest(t: str) -> str:
        flat = re.sub(text.WIDE_SPACE, " ", slashes(t))
        return hashlib.sha1(re.sub(r"[\t\n\x0b\f\r][\t\n\x0b\f\r ]*| [\t\n\x0b\f\r ]+", " ", flat).strip(" ").encode()).hexdigest()

    t = F.col("t")
    for row in rows.select("t", text.strip_hash_comments(t), text.strip_slash_comments(t), text.body_hash(t, False)).collect():
        assert list(row)[1:] == [line(row.t, "#"), slashes(row.t), digest(row.t)]


def test_wider_classes_are_not_searched_in_plain_texts(spark):
    """A class that joins others is several tests a character; ASCII texts never need it."""
    plan = spark.range(1).select(text.strip_hash_comments(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "Contains" in plan or "contains" in plan


def test_names_of_any_length_before_a_parenthesis(spark):
    heads = [
        "x = a", "a . b . c", " . ".join("abcdefgh"), "z = " + " . ".join("abcdefgh"), "q ( " + " . ".join("abcd"), "q . a . b . c . d",
        "f < a . b < c >", "g < a , b , c , d , e , f , g >", "a . b ?.", "a ?. b", "1 + (", "=>", "x , y", "return b . c . d . e", ". b . c . d . e",
        "( . b . c . d",
    ]

    for i, head in enumerate(heads):
        words = head.split(" ")
        df = spark.createDataFrame([(words,)], "texts array<string>")
        paren = F.struct(F.lit(i).alias("i"), F.lit(len(words)).alias("p"), tokens.words_before(F.col("texts"), F.lit(len(words)), 40).alias("before"))
        got = df.select(script.call_names(F.array(paren), F.col("texts"))).first()[0]
        want = df.select(*[F.regexp_extract(F.lit(head), script.CHAIN, k) for k in (0, 1, 2)]).first()
        start = len(words) - (len(want[0].split(" ")) if want[0] else 0)
        assert [(g.chain, g.tail, g.start) for g in got] == ([(want[1], want[2].strip(), start)] if want[1] else []), head
