"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Each previous word is a restaurant; all of them share one parent, the restaurant of
words without context, whose base is uniform. A (context, word) type with c customers
has t tables, and its tables are customers of the parent. Discounts come from the
counts of counts. Seating is sampled as table counts: the number of tables of a type
is drawn from its full conditional, generalised Stirling numbers times powers of the
weight of a new table. Small numbers are drawn from rows of these numbers; where some
forty tables or more are to be expected, however many, from the normal distribution at
the saddle point of their generating function. Tables of types change at once within a
sweep (parallel Gibbs).

Where the work happens. Tokens are dealt by a hash of the word, so a type, its word
and the parent's word sit in one group of about ``group_tokens`` tokens; a word that
would fill a group (found by exact counts) is split by its context. A batch of
documents sends one packed block of tokens to each group, counted and unsorted texts
are never needed again. Sweeps come in two rounds. Before, between and after them the
groups exchange sums in packed form: customers and tables of the contexts, the parent's
customers of split words, the parent's totals; a group asks for the contexts it holds
and gets the sums over all groups. Within a round a group counts its own changes and
takes the others as they were. The predictive probability uses the mean of the sweeps of
the last round and, everywhere, the sums after it, so all groups hold one hierarchy:
the probabilities after a context sum to one over words of all groups. Groups answer with
sums per document. The plan uses the same shuffle of tokens four times (counting, two
rounds, scoring). The driver sees the number of tokens, of words, and the split words.

Words are told apart by 48 bits of their hash, contexts by 40.

Defined results: null text counts as empty, that is one end token; rows without id
are scored, not learned from and not held out; repeated rows count as often as they
occur; without training rows every score is 0; an empty table gives an empty result.
Input partitions have to be reproducible (files or written tables). Other columns
are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ship import shipped
from .words import mixed, word_hashes

END, START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A257A257A257A2)
GRID = 64  # counts up to here have their own row of Stirling numbers
ROW = 128  # length of a row
MANY = 40  # tables to be expected from here on are drawn at the saddle point
SPLIT = np.uint64(1 << 40)  # keys of split words in the exchange, above those of contexts
FIXED = 1 << 20  # fractions of tables in the exchange


@dataclass(frozen=True)
class Settings:
    group_tokens: int = 2_000_000
    batch_tokens: int = 600_000
    context_keys: int = 200_000
    strength: float = 1.0
    first_sweeps: int = 2
    sweeps: int = 3


# --- packed integers ----------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays by byte planes, compressed."""
    planes = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes, protocol=5), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.decompress(data)):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(planes, np.uint8).reshape(width, len(planes) // width).T.copy().view(kind).ravel())
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; cumsum takes them back."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


# --- tokens -------------------------------------------------------------------------------


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and previous word (hashes) and document number of every token, ends included."""
    starts, _, h = word_hashes(b"\n".join(texts))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    counts = np.bincount(owner, minlength=len(texts)) + 1
    word = np.full(len(h) + len(texts), END)
    word[np.arange(len(h)) + owner] = h
    previous = np.empty_like(word)
    previous[1:] = word[:-1]
    previous[np.cumsum(counts) - counts] = START
    return word, previous, np.repeat(np.arange(len(texts)), counts)


def _document_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[bytes], np.ndarray, np.ndarray]]:
    """Number, ids, texts, learned-from and held-out flags of documents of about ``size`` tokens."""
    number = TaskContext.get().partitionId() << 24
    rows, held = [], 0
    for batch in batches:
        for name, text, train, out in zip(*batch.columns, strict=True):
            data = (text.as_py() or "").encode()
            rows.append((name.as_py(), data, train.as_py(), out.as_py()))
            held += len(data)
            if held >= 6 * size:
                yield number, *_columns(rows)
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, *_columns(rows)


def _columns(rows: list[tuple]) -> tuple[list, list[bytes], np.ndarray, np.ndarray]:
    ids, texts, train, out = zip(*rows, strict=True)
    return list(ids), list(texts), np.array(train, bool), np.array(out, bool)


def _counted(batches: Iterator[pa.RecordBatch], groups: int, size: int) -> Iterator[pa.RecordBatch]:
    """Words of each batch with their counts (all, learned from), dealt by word."""
    for _, _, texts, train, _ in _document_batches(batches, size):
        word, _, owner = tokens(texts)
        keys, place = np.unique(word, return_inverse=True)
        every, learned = np.bincount(place), np.bincount(place, weights=train[owner]).astype(np.int64)
        group = (keys % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        parts = np.split(order, cuts[1:])
        blocks = [packed(steps(keys[p]), every[p], learned[p]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(group[order][cuts], pa.int64()), pa.array(blocks, pa.binary())], names=["g", "block"])


def _summed(table: pa.Table, top: int) -> pa.Table:
    """Totals of one group of words, and its most frequent words."""
    parts = [unpacked(b) for b in table["block"].to_pylist()]
    keys, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    every, learned = (np.bincount(place, weights=np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))
    most = np.argsort(-every, kind="stable")[:top]
    values = [int(every.sum()), int(learned.sum()), int((learned > 0).sum())]
    lists = [keys[most].view(np.int64).tolist(), every[most].tolist(), learned[most].tolist()]
    return pa.table([pa.array([v]) for v in values] + [pa.array([x], pa.list_(pa.int64())) for x in lists], names=_TOTALS)


_TOTALS = ["n_all", "n_train", "n_words", "words", "counts", "learned"]
_TOTALS_TYPE = "n_all long, n_train long, n_words long, words array<long>, counts array<long>, learned array<long>"


@dataclass(frozen=True)
class Corpus:
    """Totals, number of groups, and the split words (ascending) with splits and learned counts."""

    n: int
    v: int
    groups: int
    context_groups: int
    split: np.ndarray
    splits: np.ndarray
    learned: np.ndarray


def _dealt(batches: Iterator[pa.RecordBatch], corpus: Corpus, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of tokens for each group; one row per batch with what is known of its documents."""
    for number, ids, texts, train, out in _document_batches(batches, size):
        word, previous, owner = tokens(texts)
        group = (word % np.uint64(corpus.groups)).astype(np.int64)
        if len(corpus.split):
            at = np.minimum(np.searchsorted(corpus.split, word), len(corpus.split) - 1)
            hot = np.flatnonzero(corpus.split[at] == word)
            part = mixed(previous[hot]) % corpus.splits[at[hot]].astype(np.uint64)
            group[hot] = (group[hot] + part.astype(np.int64)) % corpus.groups
        order = np.lexsort((word, group))
        group, word, previous = group[order], word[order] >> np.uint64(16), previous[order] >> np.uint64(24)
        flagged = (2 * owner + train[owner])[order].astype(np.uint32)
        rows: list[tuple[int, int, bytes]] = []
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(group) != 0]), len(group)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            words, runs = np.unique(word[a:b], return_counts=True)
            contexts, place = np.unique(previous[a:b], return_inverse=True)
            place = place.astype(np.uint16 if len(contexts) <= 65536 else np.uint32)
            rows.append((int(group[a]), 0, packed(steps(words), runs.astype(np.uint32), steps(contexts), place, flagged[a:b])))
        known = (ids, np.bincount(owner, minlength=len(texts)).tolist(), out.tolist())
        rows.append((number % corpus.groups, 1, zstandard.compress(pickle.dumps(known), 1)))
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array(columns[2], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["g", "kind", "batch", "block"])


# --- seating ------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def stirling(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts and logarithms of generalised Stirling numbers S(c, t), t = 1..ROW, up to a factor per row.

    All counts to GRID, then every fiftieth part more, to 200 * ROW. Beyond, the ratio
    of neighbours in a row no longer depends on the count.
    """
    row = np.full(ROW + 1, -np.inf)  # row[t - 1] is t tables; one place more for the shift
    row[0] = 0.0
    counts, rows = [1], [row[:-1].copy()]
    t = np.arange(1, ROW + 1)
    last = 200 * ROW
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, last):
            stay = np.log(np.maximum(c - discount * t, 0)) + row[:-1]
            new = np.r_[-np.inf, row[: ROW - 1]]
            row[:-1] = np.logaddexp(stay, new)
            row[:-1] -= row[:-1].max()
            if c + 1 <= GRID or c + 1 >= counts[-1] * 1.02 or c + 1 == last:
                counts.append(c + 1)
                rows.append(row[:-1].copy())
    return np.array(counts), np.array(rows)


def saddle(counts: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables with probabilities S(c, t) * weight**t, for many tables.

    S(c, t) is c!/t! d**-t times the coefficient of z**c in (1 - (1 - z)**d)**t. At the
    saddle point u = 1 - z of coefficient and sum over t, (1 - u) * u**(d - 1) = c / weight.
    """
    target = np.log(counts) - np.log(weight)
    low, high = np.full(len(counts), -700.0 / (1 - discount)), np.full(len(counts), -1e-12)
    for _ in range(60):  # log u by halving: the left side falls
        middle = (low + high) / 2
        above = np.log(-np.expm1(middle)) + (discount - 1) * middle > target
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    u, ud = np.exp(high), np.exp(discount * high)
    mode = weight / discount * (1 - ud)
    slope = discount * ud / (1 - ud)
    variance = mode / (1 + slope / (1 - discount + u / (1 - u) - slope))
    return mode + (1 + variance / mode) / 2, variance


def _rows(counts: np.ndarray, weight: np.ndarray, discount: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of counts and their probabilities of 1, 2, ... tables, for few tables."""
    grid, rows = stirling(round(discount, 3))
    row = np.searchsorted(grid, counts, "right") - 1
    order = np.argsort(row, kind="stable")
    row = row[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(row) != 0][: len(row)]), len(row)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        width = int(min(ROW, grid[row[a]]))
        base, t = rows[row[a], :width], np.arange(1, width + 1)
        for low in range(a, b, 1 << 16):
            part = order[low : min(b, low + (1 << 16))]
            p = base + np.log(np.maximum(weight[part], 1e-300))[:, None] * t
            yield part, np.exp(p - p.max(axis=1, keepdims=True))


def _few_and_many(counts: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of counts above 1 with few tables, and of those with many, their mean and variance."""
    several = counts > 1
    many = np.flatnonzero(several & (np.minimum(counts, weight / discount) >= MANY))
    mean, variance = saddle(counts[many].astype(np.float64), weight[many], discount)
    large = mean >= MANY
    several[many[large]] = False
    return np.flatnonzero(several), many[large], mean[large], variance[large]


def draw_tables(counts: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with the given customers; weight: of a new table, against customers minus discounts."""
    tables = (counts > 0).astype(np.int64)
    few, many, mean, variance = _few_and_many(counts, weight, discount)
    for part, p in _rows(counts[few], weight[few], discount):
        p = np.cumsum(p, axis=1)
        drawn = (rng.random(len(p))[:, None] * p[:, -1:] > p).sum(axis=1) + 1
        tables[few[part]] = np.minimum(drawn, p.shape[1])
    drawn = np.rint(rng.normal(mean, np.sqrt(variance))).astype(np.int64)
    tables[many] = np.clip(drawn, 1, counts[many])
    return tables


def expected_tables(counts: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Mean of what is drawn."""
    tables = (counts > 0).astype(np.float64)
    few, many, mean, _ = _few_and_many(counts, weight, discount)
    for part, p in _rows(counts[few], weight[few], discount):
        tables[few[part]] = p @ np.arange(1, p.shape[1] + 1) / p.sum(axis=1)
    tables[many] = np.minimum(mean, counts[many])
    return tables


class Group:
    """Tokens of one group as types: (word, context) with the number learned from."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table["batch"].to_pylist(), table["kind"].to_pylist(), table["block"].to_pylist(), strict=True))
        self.known = [(batch, block) for batch, kind, block in rows if kind == 1]
        parts = [(batch, unpacked(block)) for batch, kind, block in rows if kind == 0]
        self.batches = np.array([batch for batch, _ in parts], dtype=np.int64)
        sizes = np.array([len(p[4]) for _, p in parts], dtype=np.int64)
        self.block = np.repeat(np.arange(len(parts)), sizes)
        none = [np.zeros(0, np.uint64)]
        self.words, word = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for _, p in parts] or none), return_inverse=True)
        word = np.repeat(word, np.concatenate([p[1] for _, p in parts] or none).astype(np.int64))
        self.contexts, context = np.unique(np.concatenate([np.cumsum(p[2], dtype=np.uint64) for _, p in parts] or none), return_inverse=True)
        bases = np.cumsum([0, *(len(p[2]) for _, p in parts)])
        place = np.concatenate([p[3].astype(np.int64) + b for (_, p), b in zip(parts, bases, strict=False)] or [np.zeros(0, np.int64)])
        flagged = np.concatenate([p[4] for _, p in parts] or [np.zeros(0, np.uint32)])
        self.document, train = flagged >> 1, flagged & 1
        types, self.type = np.unique(word * len(self.contexts) + context[place], return_inverse=True)
        self.word, self.context = np.divmod(types, max(len(self.contexts), 1))
        self.count = np.bincount(self.type, weights=train, minlength=len(types)).astype(np.int64)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts))

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=values, minlength=len(self.words))

    def totals(self) -> list[int]:
        """Types, types seen once and twice, words with one and two types."""
        followers = self.per_word(self.count > 0)
        return [int(x.sum()) for x in (self.count > 0, self.count == 1, self.count == 2, followers == 1, followers == 2)]


class Shared(NamedTuple):
    """What a group hears of all groups, in the order of its contexts and of its split words."""

    customers: np.ndarray
    tables: np.ndarray  # of its contexts, summed over the kept sweeps
    words: np.ndarray  # customers of the parent, for its split words
    totals: np.ndarray  # as in Group.totals(); then customers and (times FIXED) tables of the parent
    state: np.ndarray | None  # its own tables, summed over the kept sweeps


class Parent:
    """The restaurant without context, as far as a group sees it."""

    def __init__(self, totals: np.ndarray, corpus: Corpus, settings: Settings):
        types, once, twice, words_once, words_twice = totals[:5].tolist()
        self.types_discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
        self.discount = min(0.95, max(0.05, words_once / max(words_once + 2 * words_twice, 1)))
        self.strength, self.v = settings.strength, corpus.v
        self.rate = (self.strength + self.discount * self.v) / (self.v + 1)

    def expected(self, customers: np.ndarray) -> np.ndarray:
        customers = np.rint(customers).astype(np.int64)
        return expected_tables(customers, np.full(len(customers), self.rate), self.discount)

    def drawn(self, customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        customers = np.rint(customers).astype(np.int64)
        return draw_tables(customers, np.full(len(customers), self.rate), self.discount, rng)

    def probabilities(self, customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float) -> np.ndarray:
        base = (self.strength + self.discount * all_tables) / (self.v + 1)
        return (customers - self.discount * tables + base) / (self.strength + all_customers)


def sweeps(group: Group, split: np.ndarray, shared: Shared, first: bool, corpus: Corpus, s: Settings, seed: int) -> tuple[np.ndarray, int]:
    """Tables of the types after a round, summed over its kept sweeps; their number (of the first round the last is kept)."""
    rng, parent = np.random.default_rng(seed), Parent(shared.totals, corpus, s)
    tables = (group.count > 0).astype(np.int64) if shared.state is None else shared.state
    cold = np.setdiff1d(np.arange(len(group.words)), split, assume_unique=True)
    in_words, in_contexts = group.per_word(tables), group.per_context(tables)
    others = np.zeros(len(group.words))
    others[split] = shared.words - in_words[split]
    above = shared.tables - in_contexts
    at_first = max(tables.sum(), 1)
    kept = np.zeros(len(tables), np.int64)
    drawn_first = (in_words[cold] > 0).sum() if first else parent.expected(in_words[cold]).sum()
    for _ in range(s.first_sweeps if first else s.sweeps):
        customers = group.per_word(tables) + others
        drawn = parent.drawn(customers, rng)
        # The parent's totals change as this group's part of them does.
        all_customers = shared.totals[5] * tables.sum() / at_first
        all_tables = shared.totals[6] / FIXED * (drawn[cold].sum() / drawn_first if drawn_first else 1.0)
        word = parent.probabilities(customers, drawn, all_customers, all_tables)
        weight = (s.strength + parent.types_discount * (above + group.per_context(tables))[group.context]) * word[group.word]
        tables = draw_tables(group.count, weight, parent.types_discount, rng)
        kept += tables
    return (tables, 1) if first else (kept, s.sweeps)


def log_probabilities(group: Group, split: np.ndarray, shared: Shared, corpus: Corpus, s: Settings) -> np.ndarray:
    """log10 of the predictive probability of each type, after the last round."""
    parent, n = Parent(shared.totals, corpus, s), s.sweeps
    customers = group.per_word(shared.state) / n
    customers[split] = shared.words / n
    word = parent.probabilities(customers, parent.expected(customers), shared.totals[5] / n, shared.totals[6] / FIXED)
    own = np.maximum(group.count - parent.types_discount * shared.state / n, 0)
    above = (s.strength + parent.types_discount * shared.tables[group.context] / n) * word[group.word]
    return np.log10((own + above) / (s.strength + shared.customers[group.context]))


# --- exchange of sums ---------------------------------------------------------------------


def _splits(group: Group, number: int, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Places of the group's split words, and their places in the list of all."""
    if not len(corpus.split):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = corpus.split >> np.uint64(16)
    order = np.argsort(short)
    k = order[np.minimum(np.searchsorted(short[order], group.words), len(order) - 1)]
    home = (corpus.split[k] % np.uint64(corpus.groups)).astype(np.int64)
    hot = np.flatnonzero((short[k] == group.words) & ((number - home) % corpus.groups < corpus.splits[k]))
    return hot, k[hot]


def _keys(group: Group, split: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and split words of a group, ascending, and the context groups that sum them."""
    keys = np.r_[group.contexts, SPLIT + np.sort(split).astype(np.uint64)]
    return keys, np.where(keys < SPLIT, keys % np.uint64(corpus.context_groups), 0).astype(np.int64)


def _asked(number: int, group: Group, corpus: Corpus, tables: np.ndarray, parent_tables: int, state: bytes | None) -> pa.Table:
    """A row for each context group: the keys held here with customers and tables; and the state, which only passes through."""
    hot, split = _splits(group, number, corpus)
    keys, to = _keys(group, split, corpus)
    in_words = group.per_word(tables).astype(np.int64)
    by_split = np.argsort(split)
    customers = np.r_[group.per_context(group.count), group.per_word(group.count)[hot][by_split]].astype(np.int64)
    held = np.r_[group.per_context(tables).astype(np.int64), in_words[hot][by_split]]
    totals = [*group.totals(), int(in_words.sum() - in_words[hot].sum()), parent_tables]
    rows: list[tuple] = []
    for q in np.unique(np.r_[0, to]).tolist():
        at = np.flatnonzero(to == q)
        rows.append((q, number, 0, packed(steps(keys[at]), customers[at], held[at]), totals if q == 0 else []))
    if state is not None:
        rows.append((number % corpus.context_groups, number, 1, state, []))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["q", "g", "kind", "block", "totals"])


_ASKED_TYPE = "q long, g long, kind long, block binary, totals array<long>"


def _answered(table: pa.Table, corpus: Corpus, settings: Settings, kept: int, first: bool) -> pa.Table:
    """Sums over all groups, for each group in the order of its question; sums of totals from the first context group."""
    rows = list(zip(*(table[c].to_pylist() for c in ("g", "kind", "block", "totals")), strict=True))
    q = table["q"][0].as_py()
    out = [(g, q, 1, block, []) for g, kind, block, _ in rows if kind == 1]
    asked = [(g, unpacked(block), totals) for g, kind, block, totals in rows if kind == 0]
    if asked:
        keys, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for _, p, _ in asked]), return_inverse=True)
        sums = [np.bincount(place, weights=np.concatenate([p[k] for _, p, _ in asked]), minlength=len(keys)) for k in (1, 2)]
        totals = []
        if q == 0:
            totals = np.sum(np.array([t for _, _, t in asked], dtype=np.int64), axis=0)
            split = sums[1][keys >= SPLIT]
            parent = Parent(totals, corpus, settings)
            totals[5] += int(split.sum())
            totals[6] += len(split) * FIXED if first else round(float(parent.expected(split / kept).sum()) * FIXED)
            totals = totals.tolist()
        end = 0
        for g, p, _ in asked:
            own = place[end : end + len(p[0])]
            end += len(own)
            out.append((g, q, 0, packed(*(np.rint(x[own]).astype(np.int64) for x in sums)), totals))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["g", "q", "kind", "block", "totals"])


_ANSWERED_TYPE = "g long, q long, kind long, block binary, totals array<long>"


def _heard(answers: pa.Table, group: Group, split: np.ndarray, corpus: Corpus) -> Shared:
    keys, to = _keys(group, split, corpus)
    customers, tables = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    totals, state = np.zeros(7, np.int64), None
    for q, kind, block, given in zip(*(answers[c].to_pylist() for c in ("q", "kind", "block", "totals")), strict=True):
        if kind == 1:
            (state,) = unpacked(block)
            continue
        at = np.flatnonzero(to == q)
        customers[at], tables[at] = unpacked(block)
        if q == 0:
            totals = np.array(given, dtype=np.int64)
    n = len(group.contexts)
    words = np.empty(len(split))
    words[np.argsort(split)] = tables[n:]
    return Shared(customers[:n], tables[:n], words, totals, None if state is None else state.astype(np.int64))


def _count(table: pa.Table, corpus: Corpus) -> pa.Table:
    group, number = Group(table), table["g"][0].as_py()
    hot, _ = _splits(group, number, corpus)
    known = group.per_word(group.count > 0) > 0
    return _asked(number, group, corpus, group.count > 0, int(known.sum() - known[hot].sum()) * FIXED, None)


def _sample(table: pa.Table, answers: pa.Table, corpus: Corpus, settings: Settings, first: bool) -> pa.Table:
    group, number = Group(table), table["g"][0].as_py()
    hot, split = _splits(group, number, corpus)
    shared = _heard(answers, group, split, corpus)
    tables, kept = sweeps(group, hot, shared, first, corpus, settings, 2 * number + first)
    in_words = group.per_word(tables) / kept
    in_words[hot] = 0
    parent_tables = round(float(Parent(shared.totals, corpus, settings).expected(in_words).sum()) * FIXED)
    return _asked(number, group, corpus, tables, parent_tables, packed(tables.astype(np.uint32)))


def _score(table: pa.Table, answers: pa.Table, corpus: Corpus, settings: Settings) -> pa.Table:
    """For each batch with tokens here: sums per document; and what is known of the documents."""
    group, number = Group(table), table["g"][0].as_py()
    rows = [(batch, 1, block) for batch, block in group.known]
    if len(group.type):
        hot, split = _splits(group, number, corpus)
        model = log_probabilities(group, hot, _heard(answers, group, split, corpus), corpus, settings)
        count = group.per_word(group.count)
        count[hot] = corpus.learned[split]
        count = count[group.word]
        base = np.log10((count + 0.5) / (corpus.n + 0.5 * (corpus.v + 1)))
        key = group.block.astype(np.int64) << 32 | group.document
        keys, place = np.unique(key, return_inverse=True)
        sums = [np.bincount(place, weights=v[group.type]) for v in (base, model, count > 0)]
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(keys >> 32) != 0]), len(keys)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            numbers = (keys[a:b] & 0xFFFFFFFF).astype(np.uint32)
            values = [np.rint(s[a:b] * f).astype(np.int64) for s, f in zip(sums, (1 << 32, 1 << 20, 1), strict=True)]
            rows.append((int(group.batches[keys[a] >> 32]), 0, packed(steps(numbers), *values)))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["batch", "kind", "block"])


def _collected(table: pa.Table, corpus: Corpus, kind: pa.DataType) -> pa.Table:
    """The documents of one batch."""
    rows = list(zip(table["kind"].to_pylist(), table["block"].to_pylist(), strict=True))
    ids, counts, out = pickle.loads(zstandard.decompress(next(b for k, b in rows if k == 1)))
    base, model, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for block in (b for k, b in rows if k == 0):
        at, *values = unpacked(block)
        at = np.cumsum(at)
        for sums, v in zip((base, model, known), values, strict=True):
            sums[at] += v
    n = len(ids)
    columns = [
        pa.array(ids, kind), pa.array(out, pa.bool_()), pa.array(counts, pa.int64()), pa.array(known), pa.array([corpus.n] * n, pa.int64()),
        pa.array(base / (1 << 32)), pa.array(model / (1 << 20)),
    ]
    return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


@shipped
def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: tuple[int, int] = (5, 1), settings: Settings | None = None) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learned from rows whose crc32(id as text) modulo held_out[0] is not held_out[1].
    """
    s = settings or Settings()
    spark = docs.sparkSession
    rest = F.crc32(F.col(id_column).cast("string").cast("binary")) % held_out[0]
    plain = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.coalesce(rest != held_out[1], F.lit(False)).alias("train"), F.coalesce(rest == held_out[1], F.lit(False)).alias("out"),
    )
    rows = plain.count()
    first = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000)
    counted = plain.mapInArrow(lambda b: _counted(b, first, s.batch_tokens), "g long, block binary")
    totals = counted.groupBy("g").applyInArrow(lambda t: _summed(t, 200), _TOTALS_TYPE).collect()
    n_all, n, v = (sum(r[k] for r in totals) for k in _TOTALS[:3])
    groups = max(1, -(-n_all // s.group_tokens))
    found = sorted((w % (1 << 64), c, t) for r in totals for w, c, t in zip(r["words"], r["counts"], r["learned"], strict=True))
    hot = [x for x in found if 4 * groups * x[1] > n_all] if groups > 1 else []
    splits = np.array([min(groups, -(-4 * groups * x[1] // n_all)) for x in hot], dtype=np.int64)
    corpus = Corpus(
        n, v, groups, max(1, -(-v // s.context_keys)), np.array([x[0] for x in hot], dtype=np.uint64), splits,
        np.array([x[2] for x in hot], dtype=np.int64),
    )
    blocks = plain.mapInArrow(lambda b: _dealt(b, corpus, s.batch_tokens), "g long, kind long, batch long, block binary")
    # Groups are dealt to as many partitions as keep them apart, whatever the session's number.
    by_group = blocks.repartition(max(2 * groups, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g").groupBy("g")

    def exchanged(asked: DataFrame, kept: int, first: bool = False) -> GroupedData:
        return asked.groupBy("q").applyInArrow(lambda t: _answered(t, corpus, s, kept, first), _ANSWERED_TYPE).groupBy("g")

    heard = exchanged(by_group.applyInArrow(lambda t: _count(t, corpus), _ASKED_TYPE), 1, first=True)
    heard = exchanged(by_group.cogroup(heard).applyInArrow(lambda t, a: _sample(t, a, corpus, s, True), _ASKED_TYPE), 1)
    heard = exchanged(by_group.cogroup(heard).applyInArrow(lambda t, a: _sample(t, a, corpus, s, False), _ASKED_TYPE), s.sweeps)
    scored = by_group.cogroup(heard).applyInArrow(lambda t, a: _score(t, a, corpus, s), "batch long, kind long, block binary")
    name, kind = dict(plain.dtypes)["id"], to_arrow_type(plain.schema["id"].dataType)
    return scored.groupBy("batch").applyInArrow(
        lambda t: _collected(t, corpus, kind),
        f"id {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
