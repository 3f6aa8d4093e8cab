import hashlib
import random

import numpy as np
import pytest

from codestrata.llm import multiset
from codestrata.llm.words import word_hashes


def test_word_hashes():
    data = b"Ab  cd\tab\x0bCD \xc3\x84 x" + b" long" * 3000
    starts, ends, h = word_hashes(data, block=64)
    words = [data[a:b].lower() for a, b in zip(starts, ends, strict=True)]
    assert words == data.lower().split()
    assert len(set(h.tolist())) == len(set(words))
    assert all(h[words.index(w)] == x for w, x in zip(words, h, strict=True))
    assert np.array_equal(h, word_hashes(data)[2])
    assert len(word_hashes(b"")[2]) == len(word_hashes(b" \n")[2]) == 0


def test_sums_do_not_depend_on_order_or_grouping():
    lines = ["one two three four", "", "five", "one two three four", "six seven \u00e4"]
    whole = multiset.fingerprint("\n".join(lines))
    assert whole == multiset.fingerprint("\n".join(lines[::-1]))
    first, rest = multiset.fingerprint("\n".join(lines[:2])), multiset.fingerprint("\n".join(lines[2:]))
    assert multiset.combined(first, rest) == whole
    assert multiset.combined(whole, rest, -1) == first
    assert whole != multiset.fingerprint("\n".join(lines[:-1]))
    assert len(whole) == 2 * multiset.SIZE


def test_likeness():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    sketch = [multiset.vectors([" ".join(w).encode()])[1][0] for w in (words, words[:200] + [f"x{k}" for k in range(200)], [f"v{w}" for w in words])]
    assert multiset.likeness(sketch[0], sketch[0]) == 1.0
    assert 0.1 < multiset.likeness(sketch[0], sketch[1]) < 0.9
    assert multiset.likeness(sketch[0], sketch[2]) < 0.3


def test_lanes_hold_a_line_of_50000_repeats():
    line = "one two three"
    text, half = "\n".join([line] * 50_000), "\n".join([line] * 25_000)
    edited = half + "\n" + "\n".join(f"w{k} x{k} y{k}" for k in range(25_000))
    whole, changed = (multiset.vectors([t.encode()])[1][0] for t in (text, edited))
    assert np.abs(whole.astype(np.int32)).max() == 50_000
    assert multiset.likeness(whole, changed) > 0.9
    assert multiset.combined(multiset.fingerprint(half), multiset.fingerprint(half)) == multiset.fingerprint(text)
    assert multiset.combined(multiset.fingerprint(text), multiset.fingerprint(half), -1) == multiset.fingerprint(half)


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    out = []
    for (name, _), text, other in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), multiset.fingerprint(text), multiset.fingerprint(edited)))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 2000])
def test_next_documents(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(rng.randrange(10**6) * 7 - 10**6, "".join(rng.choice("ab \n\u00e4\U0001f600") for _ in range(rng.randrange(60)))) for _ in range(40)]
    rows += [(-(2**62), None), (2**62, ""), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int").repartition(3)
    found = {r["id"]: r for r in multiset.with_next(docs, block_rows=block_rows).collect()}
    assert len(found) == len(rows)
    for name, n, sha, own, edited in plain(rows):
        r = found[name]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, own, edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


@pytest.mark.parametrize("rows", [[], [(5, "alone here")], [(None, None)], [(1, "same"), (1, "same"), (1, "same")], [(None, "x y"), (None, "x y")]])
def test_small_tables(spark, rows):
    found = multiset.with_next(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=1).collect()
    assert sorted(r["edited_sha256"] for r in found) == sorted(x[2] for x in plain(rows))
