import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from codestrata.llm import langid

SMALL = langid.Settings(window=16, widths=(2, 3, 4), filters=3, embedding=4, per_label=40, epochs=6, batch=16)


def model_and_batch():
    model = langid.ByteCnn(["a", "b", "c"], SMALL)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(1)
    return model, rng.integers(0, 256, (5, 16)).astype(np.uint8), rng.integers(0, 3, 5)


def test_gradients_equal_differences():
    model, x, y = model_and_batch()
    _, grads = model.gradients(x, y)
    rng = np.random.default_rng(2)
    for name, weight in model.weights.items():
        places = [tuple(rng.integers(0, n) for n in weight.shape) for _ in range(6)]
        if name == "embedding":
            places = [(int(x[0, k]), k % 4) for k in range(6)]
        for place in places:
            old = weight[place]
            loss = []
            for step in (1e-6, -1e-6):
                weight[place] = old + step
                loss.append(model.gradients(x, y)[0])
            weight[place] = old
            assert grads[name][place] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)


def test_tables_equal_direct_form():
    model, x, _ = model_and_batch()
    p = model.weights
    best = []
    for w in SMALL.widths:
        e = p["embedding"][x]
        z = np.concatenate([e[:, k : k + 16 - w + 1] for k in range(w)], axis=2) @ p[f"filter{w}"] + p[f"bias{w}"]
        best.append(z.max(axis=1))
    logits = np.maximum(np.concatenate(best, axis=1), 0) @ p["out"] + p["shift"]
    expected = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(model.log_probabilities(x, model.tables()), expected)


def test_windows_cover_all_bytes():
    texts = [b"x" * 16, b"y" * 17, b"z", b"w" * 50]
    x, owner, sizes = langid.windows_of(texts, 16)
    for k, text in enumerate(texts):
        assert b"".join(bytes(r)[:n] for r, n in zip(x[owner == k], sizes[owner == k], strict=True)) == text


def test_variety_counts_different_pairs():
    texts = [b"ababababababab", b"a", b"abcdefgh", b"x" * 16, b"abcabdab"]
    x, _, _ = langid.windows_of(texts, 16)
    expected = [max(1, len({t[k : k + 2] for k in range(len(t) - 1)})) for t in texts]
    assert langid.variety(x).tolist() == expected


def rows(seed, n=150):
    rng = random.Random(seed)
    sounds = {"aa": ["lo", "mi", "ta", "ru "], "bb": ["gesch", "über", "icht", "en "], "cc": ["eaux", "çon", "ment", "é "]}
    labels = list(sounds)
    return [(k, "".join(rng.choice(sounds[labels[k % 3]]) for _ in range(rng.randint(10, 300))), labels[k % 3]) for k in range(n)]


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1) for r in rows(1)], "doc_id long, text string, lang string, score int").repartition(4)
    settings = langid.Settings(window=32, per_label=40, epochs=8)
    model = langid.train(docs, settings=settings)
    found = langid.identify(docs, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", "aa"), (3, "123 !?\n", None), (None, "lotami ruta", None), (4, "lo" * 10**6, None)] * 2,
        "doc_id long, text string, lang string",
    )
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == got[4][0] == "aa"


def test_a_repeated_phrase_does_not_outvote_the_rest(spark):
    docs = spark.createDataFrame(rows(2), "doc_id long, text string, lang string")
    model = langid.train(docs, settings=langid.Settings(window=32, per_label=40, epochs=8))
    text = rows(3)[0][1][:400] + "gesch. " * 100
    found = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert found["lang_pred"] == "aa"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "some text", None), (1, None, "aa")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.labels == []
    assert [r["lang_pred"] for r in langid.identify(docs, model).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_one_label_and_deterministic():
    model = langid.ByteCnn(["aa"], SMALL).train(np.zeros((4, 16), np.uint8), np.zeros(4, int))
    found = langid.predict(pa.array(["text"]), model, model.tables()).to_pylist()
    assert found == [{"lang": "aa", "score": 1.0}]


def test_rows_without_letters_take_no_places(spark):
    docs = [(k, text, label) for k, text, label in rows(4, 90)] + [(1000 + k, [None, "", "12 !?"][k % 3], "aa") for k in range(4000)]
    found = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    settings = langid.Settings(window=32, per_label=8, epochs=1)
    model = langid.train(found, settings=settings)
    assert model.labels == ["aa", "bb", "cc"]


def test_signs_that_are_no_letters(spark):
    model = langid.ByteCnn(["aa"], SMALL).train(np.zeros((4, 16), np.uint8), np.zeros(4, int))
    texts = ["\u00bd", "\u00b2", "\u2460", "\u2167", "\u00bd \u00b2 \u2460 \u2167 12", "\u00aa", "\u4f60", "\u0301"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert [found[k] for k in range(len(texts))] == ["und"] * 5 + ["aa", "aa", "und"]
    learned = docs.withColumn("lang", F.lit("bb"))
    assert sorted(r["doc_id"] for r in langid.drop_unknown(learned, langid.ByteCnn([], SMALL)).collect()) == [5, 6]


def test_repeated_ids_and_rows_are_bounded(spark):
    plain = rows(5, 90)
    for name in (0, 3, 5, 9):  # whatever their hash
        copies = [(name, plain[0][1], "aa")] * 3000 + [(name, f"{plain[0][1]} {k}", "aa") for k in range(3000)]
        docs = spark.createDataFrame(plain + copies, "doc_id long, text string, lang string").repartition(4)
        seen = []
        model = langid.ByteCnn.train

        def count(self, x, y, model=model, seen=seen):
            seen.append(np.bincount(y))
            return self

        langid.ByteCnn.train = count
        try:
            found = langid.train(docs, settings=langid.Settings(window=32, per_label=8, windows=2, epochs=1))
        finally:
            langid.ByteCnn.train = model
        assert found.labels == ["aa", "bb", "cc"]
        assert max(seen[0]) <= 8 * 2


def test_equal_scores_and_a_long_text():
    model = langid.ByteCnn(["aa", "bb"], SMALL)
    for k in model.weights:
        model.weights[k][:] = 0
    texts = ["text", "x" * (1 << 19), "\u00e4 " * (1 << 18), "one"]
    assert langid.predict(pa.array(texts), model, model.tables()).to_pylist() == [{"lang": "aa", "score": 0.5}] * 4
