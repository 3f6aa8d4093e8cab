import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from codestrata.llm import pitman_yor as py


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return lowered.encode().split() + [b""]


def brute(rows):
    """Contract columns but score."""
    learned = Counter(w for name, text in rows if name is not None and zlib.crc32(str(name).encode()) % 5 != 1 for w in words(text))
    n, v = sum(learned.values()), len(learned)
    out = []
    for name, text in rows:
        own = words(text)
        base = sum(math.log10((learned[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        held = name is not None and zlib.crc32(str(name).encode()) % 5 == 1
        out.append((name, held, len(own), sum(learned[w] > 0 for w in own), n, base))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    chain = {w: [f"w{rng.randrange(60)}" for _ in range(3)] for w in [f"w{k}" for k in range(60)] + ["the"]}
    rows = []
    for k in range(n):
        text, w = [], "the"
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(chain[w]) if rng.random() < 0.8 else "the"
            text.append(rng.choice([w, w.upper(), w + str(rng.randrange(9))]) if rng.random() < 0.2 else w)
        rows.append((k, rng.choice([" ", "\t", " \x0b"]).join(text)))
    return rows + [(1000, None), (1001, ""), (None, "the w1 unknown"), (1002, "Ä   x y"), (7, rows[7][1]), (1003, "the " * 3000)]


@pytest.mark.parametrize("settings", [
    py.Settings(), py.Settings(group_tokens=700, batch_tokens=200, context_keys=20),
])
def test_counts_and_base_equal_brute_force(spark, settings):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3).sortWithinPartitions("doc_id")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/py-{settings.group_tokens}"
    docs.write.mode("overwrite").parquet(path)
    found = py.score(spark.read.parquet(path), settings=settings).collect()
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found), key=repr)
    expected = brute(rows)
    assert got == sorted((e[:5] for e in expected), key=repr)
    base = {e[0]: e[5] for e in expected}
    assert all(r["base_score"] == pytest.approx(base[r["id"]], abs=1e-5) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in found)


def test_without_training_rows(spark):
    name = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = spark.createDataFrame([(name, "a b c"), (None, None)], "doc_id long, text string")
    found = py.score(docs).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found) == [(1, 0, 0, 0.0, 0.0), (4, 0, 0, 0.0, 0.0)]
    assert py.score(docs.limit(0)).count() == 0


def exact_rows(c: int, d: float) -> np.ndarray:
    """Logarithms of S(c, 1..c)."""
    row = np.array([0.0])
    with np.errstate(divide="ignore"):
        for k in range(1, c):
            t = np.arange(1, k + 1)
            row = np.logaddexp(np.r_[np.log(k - d * t) + row, -np.inf], np.r_[-np.inf, row])
    return row


def moments(c: int, weight: float, d: float) -> tuple[float, float]:
    t = np.arange(1, c + 1)
    p = exact_rows(c, d) + math.log(weight) * t
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = p @ t
    return mean, p @ (t - mean) ** 2


def test_stirling_numbers():
    counts, rows = py.stirling(0.3)
    for c in (2, 3, 6, 50):
        row = rows[list(counts).index(c)][:c]
        true = exact_rows(c, 0.3)
        assert np.allclose(row - row[0], true - true[0])


def test_drawn_tables_follow_their_distribution():
    d, weight, c = 0.5, 0.7, 4
    p = np.exp(exact_rows(c, d) + math.log(weight) * np.arange(1, c + 1))
    drawn = py.draw_tables(np.full(40_000, c), np.full(40_000, weight), d, np.random.default_rng(0))
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / 40_000, p / p.sum(), atol=0.01)
    assert py.draw_tables(np.array([0, 1]), np.ones(2), d, np.random.default_rng(0)).tolist() == [0, 1]


@pytest.mark.parametrize(("c", "weight", "d"), [
    (4000, 700.0, 0.74), (4000, 40.0, 0.74), (4000, 25.0, 0.6), (3000, 5000.0, 0.74), (1500, 60.0, 0.9), (500, 2000.0, 0.5), (2500, 60.0, 0.3), (60, 1e5, 0.8), (3000, 3.0, 0.7),
])
def test_many_tables_have_no_ceiling(c, weight, d):
    mean, variance = moments(c, weight, d)
    drawn = py.draw_tables(np.full(20_000, c), np.full(20_000, weight), d, np.random.default_rng(1))
    assert drawn.mean() == pytest.approx(mean, rel=0.01)
    assert drawn.std() == pytest.approx(variance**0.5, rel=0.06, abs=0.3)
    assert py.expected_tables(np.array([c]), np.array([weight]), d)[0] == pytest.approx(mean, rel=0.01)


def test_tables_of_counts_beyond_any_row():
    drawn = py.draw_tables(np.full(1000, 11_830), np.full(1000, 700.0), 0.74, np.random.default_rng(1))
    assert 935 < drawn.mean() < 960
    drawn = py.draw_tables(np.full(1000, 10**7), np.full(1000, 1e5), 0.7, np.random.default_rng(1))
    assert drawn.mean() == pytest.approx(1e5 / 0.7, rel=0.02)


def grouped(tables, key, *columns):
    whole = pa.concat_tables(tables)
    return {k: whole.filter(pc.equal(whole[key], k)) for k in sorted(set(whole[key].to_pylist()))}


def run_groups(rows, settings, groups, least):
    """The stages without Spark; words learned at least so often are split over all groups. Yields group, split words, what it hears."""
    texts = [t.encode() for t, _ in rows]
    word, _, owner = py.tokens(texts)
    train = np.array([x for _, x in rows])
    learned = Counter(word[train[owner]].tolist())
    hot = sorted(w for w, c in learned.items() if c >= least)
    corpus = py.Corpus(
        sum(learned.values()), len(learned), groups, 3, np.array(hot, np.uint64), np.full(len(hot), groups, np.int64), np.array([learned[w] for w in hot], np.int64)
    )
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(rows))), "text": [t for t, _ in rows], "train": train.tolist(), "out": (~train).tolist()})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(py.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
        blocks = grouped([pa.Table.from_batches([b]) for b in py._dealt(iter([batch.slice(k, 40) for k in range(0, len(rows), 40)]), corpus, settings.batch_tokens)], "g")

    def exchanged(asked, kept, first=False):
        return grouped([py._answered(t, corpus, settings, kept, first) for t in grouped(asked, "q").values()], "g")

    heard = exchanged([py._count(t, corpus) for t in blocks.values()], 1, True)
    heard = exchanged([py._sample(t, heard[g], corpus, settings, True) for g, t in blocks.items()], 1)
    heard = exchanged([py._sample(t, heard[g], corpus, settings, False) for g, t in blocks.items()], settings.sweeps)
    for g, t in blocks.items():
        group = py.Group(t)
        places, split = py._splits(group, g, corpus)
        yield group, places, py._heard(heard[g], group, split, corpus), corpus


@pytest.mark.parametrize(("groups", "least"), [(1, 10**9), (5, 10**9), (5, 60)])
def test_probabilities_sum_to_one_over_groups(groups, least):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    learned = [" ".join(rng.choices(vocabulary + ["w0"] * 30 + ["w1"] * 10, k=50)) for _ in range(60)]
    present = sorted({w for t in learned for w in t.split()})
    # Rows not learned from: after each of some words, every word, an unknown one and the end.
    asked = [f"{u} {w}" for u in present[:6] for w in [*present, "unknown"]] + present[:6]
    settings = py.Settings(batch_tokens=200)
    sums = Counter()
    splits = 0
    for group, places, shared, corpus in run_groups([(t, True) for t in learned] + [(t, False) for t in asked], settings, groups, least):
        p = 10 ** py.log_probabilities(group, places, shared, corpus, settings)
        splits += len(places)
        for context, value in zip(group.contexts[group.context].tolist(), p.tolist(), strict=True):
            sums[context] += value
    first = py.tokens([w.encode() for w in present[:6]])[0]
    for context in (first[first != py.END] >> np.uint64(24)).tolist():
        assert sums[context] == pytest.approx(1, abs=1e-5)
    assert (splits > groups) == (least < 100)


def sequential(train, held, rounds=60, burn=20, strength=1.0):
    """Mean log10 probability of held-out tokens, by moving one customer at a time; discounts as the operator takes them."""
    rng = random.Random(8)
    pairs = [(u, w) for t in train for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
    types = Counter(pairs)
    followers = Counter(w for _, w in types)
    share = lambda c: min(0.95, max(0.05, (one := sum(x == 1 for x in c)) / max(one + 2 * sum(x == 2 for x in c), 1)))
    d, dp, v = share(types.values()), share(followers.values()), len(followers)
    tables, parent = {k: [] for k in types}, {w: [] for w in followers}
    total, tables_of = Counter(), Counter()
    customers, parent_tables = 0, 0

    def above(w):
        own = parent.get(w, [])
        return (sum(own) - dp * len(own) + (strength + dp * parent_tables) / (v + 1)) / (strength + customers)

    def chance(u, w):
        own = tables.get((u, w), [])
        return (sum(own) - d * len(own) + (strength + d * tables_of[u]) * above(w)) / (strength + total[u])

    def sit(own, discount, fresh):
        at = rng.random() * (sum(own) - discount * len(own) + fresh)
        for k, n in enumerate(own):
            at -= n - discount
            if at < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def leave(own):
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    scores = np.zeros(sum(len(t) + 1 for t in held))
    for r in range(rounds):
        for u, w in pairs:
            if r:
                total[u] -= 1
                if leave(tables[u, w]):
                    tables_of[u] -= 1
                    customers -= 1
                    parent_tables -= leave(parent[w])
            if sit(tables[u, w], d, (strength + d * tables_of[u]) * above(w)):
                tables_of[u] += 1
                parent_tables += sit(parent[w], dp, (strength + dp * parent_tables) / (v + 1))
                customers += 1
            total[u] += 1
        if r >= burn:
            scores += [chance(u, w) / (rounds - burn) for t in held for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
    return np.log10(scores)


def test_scores_near_those_of_sequential_seating():
    rng = random.Random(9)
    chain = {f"w{k}": [f"w{rng.randrange(50)}" for _ in range(3)] for k in range(50)}

    def text():
        out = ["w0"]
        for _ in range(rng.randint(5, 30)):
            out.append(rng.choice(chain.get(out[-1], ["w0"])) if rng.random() < 0.7 else rng.choice(["w0", "w1", f"w{rng.randrange(50)}", f"x{rng.randrange(400)}"]))
        return out

    train, held = [text() for _ in range(150)], [text() for _ in range(40)]
    settings, rows = py.Settings(batch_tokens=10**6), [(" ".join(t), k < 150) for k, t in enumerate(train + held)]
    expected = sequential(train, held).sum()
    for groups, least in ((1, 10**9), (4, 100)):
        score = 0.0
        for group, places, shared, corpus in run_groups(rows, settings, groups, least):
            model = py.log_probabilities(group, places, shared, corpus, settings)[group.type]
            score += model[group.document >= 150].sum()  # all documents are one batch
        assert score == pytest.approx(expected, rel=0.015)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x"), (None, "y")], "doc_id string, text string")
    docs = docs.withColumn("day", F.lit(1.5).cast("decimal(5,1)"))
    assert {r["id"] for r in py.score(docs).collect()} == {"a", "b", None}
    assert {str(r["id"]) for r in py.score(docs, id_column="day").collect()} == {"1.5"}


def test_packed_arrays():
    arrays = [np.array([3, 5, 2**50], np.uint64), np.array([], np.int64), np.array([7], np.uint16)]
    for a, b in zip(arrays, py.unpacked(py.packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
