"""Language identification with a byte convolutional network in numpy.

Bytes (A-Z lowered) are embedded, filters of several widths slide over fixed
windows, each filter keeps its maximum, and a softmax layer gives the label. The
network is trained with Adam on the driver from a bounded sample: at most
``windows`` windows of ``window`` bytes from at most ``per_label`` documents per
label, those whose hash of id and text is smallest (equal rows are one); only their
hashes and windows travel. Prediction covers every byte of every text: windows in
batches, their log-probabilities averaged. A window weighs as the square of
the number of its different byte pairs, so a phrase repeated over and over does not outvote the rest.
For speed the embedding is folded into tables of byte pairs, so that a filter is a
few table rows added up.

Defined results: a null text or one without a letter (a sign of a Unicode class L)
is ``und`` with score 0; of labels with equal scores the first in order is taken; if
there is nothing to learn from, all are; rows without id are predicted but not
learned from and not held out; equal rows get equal results; an empty table gives an
empty result. Other columns are kept, except those named like a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ship import shipped

UNKNOWN = "und"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    window: int = 128
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    per_label: int = 400
    windows: int = 8
    epochs: int = 4
    batch: int = 64
    rate: float = 4e-3
    seed: int = 11


class ByteCnn:
    """Embedding, filters with maximum over time, softmax."""

    def __init__(self, labels: list[str], settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.labels, self.settings = labels, settings
        e, f = settings.embedding, settings.filters
        self.weights = {"embedding": rng.normal(0, 0.5, (256, e))}
        for w in settings.widths:
            self.weights[f"filter{w}"] = rng.normal(0, (w * e) ** -0.5, (w * e, f))
            self.weights[f"bias{w}"] = np.zeros(f)
        self.weights["out"] = rng.normal(0, 0.1, (f * len(settings.widths), len(labels)))
        self.weights["shift"] = np.zeros(len(labels))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients for windows x (batch, window) with label numbers y."""
        p, e = self.weights, self.settings.embedding
        n = len(x)
        embedded = p["embedding"][x]
        best, tops, views = [], [], []
        for w in self.settings.widths:
            steps = x.shape[1] - w + 1
            unfolded = np.concatenate([embedded[:, k : k + steps] for k in range(w)], axis=2)
            z = unfolded @ p[f"filter{w}"] + p[f"bias{w}"]
            top = z.argmax(axis=1)
            tops.append(top)
            views.append(unfolded[np.arange(n)[:, None], top])
            best.append(np.take_along_axis(z, top[:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(best, axis=1), 0)
        logits = h @ p["out"] + p["shift"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-np.log(prob[np.arange(n), y] + 1e-9).mean())
        delta = prob
        delta[np.arange(n), y] -= 1
        delta /= n
        grads = {"out": h.T @ delta, "shift": delta.sum(axis=0), "embedding": np.zeros_like(p["embedding"])}
        back = (delta @ p["out"].T) * (h > 0)
        for k, w in enumerate(self.settings.widths):
            own = back[:, k * self.settings.filters : (k + 1) * self.settings.filters]
            grads[f"filter{w}"] = np.einsum("bfi,bf->if", views[k], own)
            grads[f"bias{w}"] = own.sum(axis=0)
            for j in range(w):
                part = own[:, :, None] * p[f"filter{w}"][j * e : (j + 1) * e].T
                np.add.at(grads["embedding"], x[np.arange(n)[:, None], tops[k] + j], part)
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray) -> ByteCnn:
        """Adam over shuffled batches; some windows are shortened, as last windows of texts are."""
        s = self.settings
        rng = np.random.default_rng(s.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, total = 0, s.epochs * -(-len(x) // s.batch)
        for _ in range(s.epochs):
            for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // s.batch)):
                part = x[rows].copy()
                size = np.where(rng.random(len(rows)) < 0.3, rng.integers(8, s.window + 1, len(rows)), s.window)
                part[np.arange(s.window) >= size[:, None]] = 0
                _, grads = self.gradients(part, y[rows])
                step += 1
                rate = s.rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For every width, what each pair of bytes (and a last single one) adds to the filters."""
        p, e = self.weights, self.settings.embedding
        out = {}
        for w in self.settings.widths:
            single = [p["embedding"] @ p[f"filter{w}"][j * e : (j + 1) * e] for j in range(w)]
            single[0] = single[0] + p[f"bias{w}"]
            parts = [(single[j][:, None] + single[j + 1][None]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            out[w] = [np.ascontiguousarray(t) for t in (parts + [single[-1]] if w % 2 else parts)]
        return out

    def log_probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Of each label for each window."""
        x = x.astype(np.int64)
        pairs = x[:, :-1] * 256 + x[:, 1:]
        best = []
        for w, parts in tables.items():
            steps = x.shape[1] - w + 1
            z = np.take(parts[0], pairs[:, :steps], axis=0)
            for k, table in enumerate(parts[1:], 1):
                source = pairs if len(table) > 256 else x
                z += np.take(table, source[:, 2 * k : 2 * k + steps], axis=0)
            best.append(z.max(axis=1))
        logits = np.maximum(np.concatenate(best, axis=1), 0) @ self.weights["out"] + self.weights["shift"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


# --- windows ------------------------------------------------------------------------------


def windows_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each filled up with zeros; text numbers and lengths."""
    counts = np.array([-(-len(t) // window) for t in texts])
    data = b"".join(t.ljust(n * window, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(np.array([len(t) for t in texts])[owner] - place * window, window)
    return np.frombuffer(data, np.uint8).reshape(-1, window), owner, sizes


def variety(x: np.ndarray) -> np.ndarray:
    """Different byte pairs of each window, without those of the filling; 1 at least."""
    pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
    pairs[x[:, 1:] == 0] = 0
    pairs.sort(axis=1, kind="stable")
    new = (pairs[:, 1:] != pairs[:, :-1]).sum(axis=1) + (pairs[:, 0] != 0)
    return np.maximum(new, 1)


def predict(texts: pa.Array, model: ByteCnn, tables: dict[int, list[np.ndarray]]) -> pa.Array:
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    held, size = [], 0

    def solve() -> None:
        x, owner, _ = windows_of([t for _, t in held], model.settings.window)
        sums, weight = np.zeros((len(held), len(model.labels))), variety(x) ** 2
        for at in range(0, len(x), 128):
            logs = model.log_probabilities(x[at : at + 128], tables)
            np.add.at(sums, owner[at : at + 128], logs * weight[at : at + 128, None])
        sums /= np.bincount(owner, weights=weight)[:, None]
        prob = np.exp(sums - sums.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for (row, _), p in zip(held, prob, strict=True):
            labels[row], scores[row] = model.labels[int(p.argmax())], p.max()

    for row, item in enumerate(texts):
        text = item.as_py()
        if model.labels and text is not None and any(map(str.isalpha, text)):
            held.append((row, text.encode().translate(LOWER)))
            size += len(text)
            if size >= 1 << 18:
                solve()
                held, size = [], 0
    if held:
        solve()
    return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores)], names=["lang", "score"])


def _spread(batches: Iterator[pa.RecordBatch], window: int, count: int) -> Iterator[pa.RecordBatch]:
    """Up to ``count`` windows, evenly spread over each text."""
    for batch in batches:
        rows = []
        for name, label, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            data = text.encode().translate(LOWER)
            steps = max(1, min(count, len(data) // window))
            for k in range(steps):
                at = k * (len(data) - window) // max(steps - 1, 1) if len(data) > window else 0
                rows.append((name, label, data[at : at + window].ljust(window, b"\0")))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        types = (pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "lang", "data"])


# --- distributed --------------------------------------------------------------------------


def remainder(id_column: str, divisor: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor


@shipped
def train(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
    held_out: tuple[int, int] = (3, 1), settings: Settings | None = None,
) -> ByteCnn:
    """Network learned from labelled rows whose crc32(id) modulo held_out[0] is not held_out[1]."""
    s = settings or Settings()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang"))
    pool = plain.where(remainder("id", held_out[0]) != held_out[1]).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("id", "text").alias("place")
    # Equal rows are one place, and partial results of the distinct and of the ranks come before their shuffles.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    ranked = pool.select("lang", place).distinct().withColumn("rank", rank)
    chosen = ranked.where(F.col("rank") <= s.per_label).select("lang", "place")
    spread = (
        pool.withColumn("place", place)
        .join(F.broadcast(chosen), ["lang", "place"], "left_semi")  # per_label rows per label
        .select("place", "lang", "text")
        .dropDuplicates(["lang", "place"])
        .mapInArrow(lambda batches: _spread(batches, s.window, s.windows), "id long, lang string, data binary")
    )
    rows = sorted((r["lang"], r["id"], bytes(r["data"])) for r in spread.collect())
    labels = sorted({r[0] for r in rows})
    model = ByteCnn(labels, s)
    if rows:
        x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, s.window)
        model.train(x, np.array([labels.index(r[0]) for r in rows]))
    return model


def _found(model: ByteCnn, text_column: str) -> Column:
    """Struct of lang and score."""
    made: dict[int, dict[int, list[np.ndarray]]] = {}

    def run(texts: pa.Array) -> pa.Array:
        if 0 not in made:
            made[0] = model.tables()
        return predict(texts, model, made[0])

    return F.arrow_udf(run, "struct<lang string, score double>")(text_column).alias("__found")


@shipped
def identify(docs: DataFrame, model: ByteCnn, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, _found(model, text_column))
    return found.select(*kept, F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))


@shipped
def drop_unknown(docs: DataFrame, model: ByteCnn, text_column: str = "text", excess: float = 0.2) -> DataFrame:
    """``docs`` without texts that have no letter, or whose best label scores less than ``1 + excess`` times an even share.

    If nothing could be learned, every text with a letter stays.
    """
    found = docs.select("*", _found(model, text_column))
    if model.labels:
        known = (F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") >= min(1.0, (1 + excess) / len(model.labels)))
    else:
        known = F.col(text_column).rlike(r"\p{L}")
    return found.where(known).drop("__found")
