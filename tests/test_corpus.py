import re
import string

from pyspark.sql import functions as F

from codestrata.plans import corpus


def test_clean_characters_are_listed_one_by_one(spark):
    """The JVM tests joined ranges one after the other; the listed class must keep the same characters."""
    kept = set(string.ascii_letters + string.digits + " .,\n")
    assert not re.search("[a-z]-[a-z]|[0-9]-[0-9]", corpus.CLEAN_LISTED)
    every = [chr(c) for c in [*range(1, 0xD800, 7), *range(1, 0x250), 0xFFFD, 0x1F600]]
    df = spark.createDataFrame([(c,) for c in every], "c string")
    rows = df.select("c", F.regexp_replace("c", corpus.CLEAN_LISTED, "~"), F.regexp_replace("c", corpus.CLEAN, "~")).collect()
    assert len(rows) == len(every) and all(new == old == (c if c in kept else "~") for c, new, old in rows)
    source = corpus.listing.__globals__["_render"].__code__.co_names
    assert "CLEAN_LISTED" in source and "CLEAN" not in source
