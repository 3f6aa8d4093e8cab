import hashlib
import random

import numpy as np
import pytest

from codestrata.llm import suffix_dedup as sd

L = 128


def brute_spans(docs, length, keep):
    """Byte flags per text; docs in order."""
    seen = {}
    for d, text in enumerate(docs):
        for p in range(len(text) - length + 1):
            seen.setdefault(text[p : p + length], []).append((d, p))
    flags = [np.zeros(len(t), bool) for t in docs]
    for places in seen.values():
        for d, p in places[1 if keep == "first" else 0 :] if len(places) > 1 else []:
            flags[d][p : p + length] = True
    return flags


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh \u00e4\u20ac"

    def fresh(n):
        return "".join(rng.choice(letters) for _ in range(n))

    shared = [fresh(n) for n in (90, 110, 130, 200, 400, 700)]
    docs = [None, "", "short", "a" * 500, "ab" * 300, fresh(3000)]
    for _ in range(25):
        docs.append("".join(rng.choice([fresh(rng.randint(1, 200)), rng.choice(shared)]) for _ in range(rng.randint(1, 6))))
    docs += [docs[7], docs[9][3:], docs[5][:1500] + "X" + docs[5][1500:]]
    return docs


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limit", [2000, 1])
def test_equals_brute_force(spark, keep, limit):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    found = {r["id"]: r for r in sd.removal_digest(docs, length=L, keep=keep, limit=limit).collect()}
    data = [(t or "").encode() for t in texts]
    for i, (text, flags) in enumerate(zip(data, brute_spans(data, L, keep), strict=True)):
        kept = bytes(np.frombuffer(text, np.uint8)[~flags])
        runs = int(flags[:1].sum() + (flags[1:] & ~flags[:-1]).sum())
        row = found[i]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(text), int(flags.sum()), runs), (i, texts[i])
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    text = corpus(5)[5][:300]
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    none = sorted((r["id"] or 0, r["n_removed"]) for r in sd.removal_digest(docs, length=L, keep="none").collect())
    size = len(text.encode())
    assert none == [(0, 0), (0, size), (1, size), (1, size)]
    first = sorted((r["id"] or 0, r["n_removed"]) for r in sd.removal_digest(docs, length=L, keep="first").collect())
    assert first == [(0, 0), (0, size), (1, 0), (1, 0)]


def test_shortened_texts_are_whole_characters(spark):
    text = "\u20ac" * 100
    docs = spark.createDataFrame([(1, "x" + text, 5), (2, "yz" + text, 6), (3, text, 7), (4, None, 8)], "doc_id long, text string, __n int")
    kept = {r["doc_id"]: r["text"] for r in sd.drop_repeats(docs, length=L, keep="first").collect()}
    assert kept[1].startswith("x\u20ac") and kept[2].startswith("yz") and kept[4] is None
    assert all("\ufffd" not in (t or "") for t in kept.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.removal_digest(docs, length=L).count() == 0
    assert sd.drop_repeats(docs, length=L).count() == 0


def test_longest_previous_factor_and_lcp():
    rng = random.Random(2)
    data = "".join(rng.choice("ab") for _ in range(400)).encode()
    places = np.arange(0, 380)
    found = sd.Suffixes(np.frombuffer(data, np.uint8), places, 16)
    padded = data + b"\0" * 40

    def common(a, b):
        n = 0
        while n < 16 and padded[a + n] == padded[b + n]:
            n += 1
        return n

    ordered = [padded[p : p + 16] for p in found.sorted]
    assert ordered == sorted(ordered)
    assert found.lcp[1:].tolist() == [common(a, b) for a, b in zip(found.sorted, found.sorted[1:])]
    lpf = sd.longest_previous(found.sorted, found.lcp)
    for place, value in zip(found.sorted.tolist(), lpf.tolist(), strict=True):
        assert value == max([common(place, q) for q in range(place)], default=0)


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abc") for _ in range(5000)).encode()
    whole = [c for block in sd._blocks([text], L) for c in listing(block)]
    monkeypatch.setattr(sd, "BLOCK", 700)
    parts = [c for block in sd._blocks([text], L) for c in listing(block)]
    covered = sorted(p for start, n, _ in parts for p in range(start, start + n))
    assert covered == list(range(len(text) - L + 1))
    anchor = {p: a for start, n, a in whole for p in range(start, start + n)}
    assert all(anchor[p] == a for start, n, a in parts for p in range(start, start + n))


def listing(block):
    data, starts, ends, numbers, offsets = block
    text, first, count, anchor = sd.contexts(data, starts, ends, L)
    return list(zip((first - starts[text] + offsets[text]).tolist(), count.tolist(), anchor.tolist(), strict=True))
