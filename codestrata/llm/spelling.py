"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One edit changes a word's letter counts by one in one letter (insertion, deletion) or
by one down and one up (replacement), so near words lie within L1 distance 1 or 2, and
their lengths are equal or differ by one. Words of one length are the points of one k-d
tree. Its upper part is fitted on a bounded sample of the vocabulary, so that a cell
is expected to hold about ``cell`` words; every word is then placed in its cell, by
equality tests on counts. A word's search box is pruned against the cells: it visits
those cells of its own length, and of the next one, that one edit can reach. A cell
is one group (more, if it is too large: its words are dealt to parts that visit each
other, and its visitors to copies); in it the tree goes on down to small leaves, and
points and queries that remain within the distance are compared letter by letter.

What leaves a cell is, for each word, the number of its near words there and the most
frequent of them, so pairs are never written. Letters of À-ÿ share six of the 32 counts;
folding letters together shortens distances only, so nothing is lost.

Forms are followed to their end by doubling: a form occurs at least ``ratio`` times as
often as its word, so chains are short.

Defined results: null text has no words; a deleted letter may leave an empty word,
which is too short to count; rows without id or with equal ids count as any other (the
id enters the hash as text, a null id as no text); an empty table gives an empty
result. Columns that are not named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialize
from .ship import shipped

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DIMENSIONS = 32


class Settings(NamedTuple):
    """``modulus``: one run of so many loses a letter; ``sample``: most words the upper trees are fitted on."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    modulus: int = 31
    sample: int = 200_000
    cell: int = 8192
    visitors: int = 65_536
    leaf: int = 64


# --- words --------------------------------------------------------------------------------


def words_of(name: object, text: str | None, settings: Settings) -> Counter:
    """Words of one text with their numbers, after the deletions that the hash of id and run demands."""
    runs = Counter(RUN.findall((text or "").encode().lower().decode()))
    opening = crc32(f"{'' if name is None else name}:".encode())
    found: Counter = Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), opening)
        if h % settings.modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= settings.least_length:
            found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Words with partial numbers; about 2**18 different ones are summed at a time."""
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
        total.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total.update(words_of(name, text.as_py(), settings))
            if len(total) >= 1 << 18:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, id_column: str, text_column: str, settings: Settings) -> DataFrame:
    """``word, n``: words that are long and frequent enough."""
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    counted = plain.mapInArrow(lambda b: _counted(b, settings), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_count)


# --- vectors and trees --------------------------------------------------------------------

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(26)
_FOLD[0xC0:] = 26 + np.arange(64) % 6


class Words:
    """Words of one length as letters (one byte each), counts and squared norms."""

    def __init__(self, words: list[str]):
        self.size = len(words[0]) if words else 0
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), self.size)
        flat = _FOLD[self.letters].astype(np.int64) + DIMENSIONS * np.arange(len(words))[:, None]
        self.counts = np.bincount(flat.ravel(), minlength=DIMENSIONS * len(words)).reshape(len(words), DIMENSIONS).astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.counts, self.counts)

    def __len__(self) -> int:
        return len(self.letters)


def widest(counts: np.ndarray) -> tuple[int, float] | None:
    """Dimension and threshold of the split (``count <= threshold`` goes left) that divides best; None if all are equal."""
    best = None
    for d in np.argsort(-counts.var(axis=0), kind="stable")[:4].tolist():
        column = counts[:, d]
        middle = np.median(column)
        for threshold in (np.floor(middle), np.ceil(middle) - 1):
            left = np.count_nonzero(column <= threshold)
            balance = min(left, len(column) - left)
            if balance and (best is None or balance > best[0]):
                best = (balance, d, float(threshold))
    return None if best is None else best[1:]


class UpperTree(NamedTuple):
    """Splits of one length; a leaf has dimension -1 and its cell in ``low``."""

    dims: list[int]
    thresholds: list[float]
    low: list[int]
    high: list[int]

    @classmethod
    def fitted(cls, counts: np.ndarray, cells: int, first_cell: int) -> tuple[UpperTree, int]:
        """Splits until ``cells`` parts of the sample are of equal size; the number of the next cell."""
        tree, least = cls([], [], [], []), max(16, len(counts) // max(cells, 1))

        def grow(rows: np.ndarray, cell: int) -> int:
            node = len(tree.dims)
            split = widest(counts[rows]) if len(rows) > least else None
            for column, value in zip(tree, (-1, 0.0, cell, 0) if split is None else (*split, 0, 0), strict=True):
                column.append(value)
            if split is None:
                return cell + 1
            left = counts[rows, split[0]] <= split[1]
            tree.low[node] = len(tree.dims)
            cell = grow(rows[left], cell)
            tree.high[node] = len(tree.dims)
            return grow(rows[~left], cell)

        return tree, grow(np.arange(len(counts)), first_cell)

    def visits(self, counts: np.ndarray, down: int, up: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells that are reached by at most ``down`` letters less and ``up`` more (0 or 1 each)."""
        rows, cells = [], []
        nowhere = np.full(len(counts), -1, np.int8)  # the dimension that lost, and the one that won a letter
        todo = [(0, np.arange(len(counts)), nowhere, nowhere)]
        while todo:
            node, at, less, more = todo.pop()
            d = self.dims[node]
            if d < 0 or not len(at):
                rows.append(at)
                cells.append(np.full(len(at), self.low[node], np.int64))
                continue
            gap = counts[at, d] - self.thresholds[node]  # at most 0: left
            loses = (gap == 1) & ((less == -1) | (less == d)) if down else np.zeros(len(at), bool)
            wins = (gap == 0) & ((more == -1) | (more == d)) if up else np.zeros(len(at), bool)
            left, right = (gap <= 0) | loses, (gap > 0) | wins
            todo.append((self.low[node], at[left], np.where(loses, np.int8(d), less)[left], more[left]))
            todo.append((self.high[node], at[right], less[right], np.where(wins, np.int8(d), more)[right]))
        return np.concatenate(rows), np.concatenate(cells)


class Index(NamedTuple):
    """Upper trees by length; parts of cells that are too large, copies of cells with too many visitors."""

    trees: dict[int, UpperTree]
    parts: dict[int, int]
    copies: dict[int, int]


# --- search in one cell -------------------------------------------------------------------


def _candidates(points: Words, queries: Words, down: int, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points that a query can become with one letter more and ``down`` less, by a k-d tree over the points."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        inside, asking = todo.pop()
        here, own = points.counts[inside], queries.counts[asking]
        losses, gains = np.maximum(own - here.max(axis=0), 0).sum(axis=1), np.maximum(here.min(axis=0) - own, 0).sum(axis=1)
        asking = asking[(losses <= down) & (gains <= 1)]
        if not len(asking):
            continue
        split = widest(here) if len(inside) > leaf else None
        if split is not None:
            left = here[:, split[0]] <= split[1]
            todo += [(inside[left], asking), (inside[~left], asking)]
            continue
        for k in range(0, len(inside), 1024):
            some = inside[k : k + 1024]
            for m in range(0, len(asking), 4096):
                part = asking[m : m + 4096]
                # Steps of one letter: squared distance and L1 distance are the same number.
                apart = queries.norms[part][:, None] + points.norms[some] - 2 * (queries.counts[part] @ points.counts[some].T)
                q, p = np.nonzero(apart <= 1 + down)
                yield some[p], part[q]


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows in which the two words differ by exactly one edit."""
    if short.shape[1] == long.shape[1]:
        return np.count_nonzero(short != long, axis=1) == 1
    size = short.shape[1]
    front = np.cumprod(short == long[:, :size], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return front + back >= size


def near_pairs(points: Words, queries: Words, leaf: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of points and queries one edit apart; with ``own`` both are the same words and each pair comes once."""
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for p, q in _candidates(points, queries, int(points.size == queries.size), leaf):
        if own:
            once = q < p
            p, q = p[once], q[once]
        near = _one_edit(queries.letters[q], points.letters[p])
        found.append((p[near], q[near]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _searched(table: pa.Table, settings: Settings) -> pa.Table:
    """Near words of one group: its own words come with role 0, visitors of the same length with 1, shorter ones with 2."""
    table = table.sort_by([("role", "ascending"), ("word", "ascending")])
    words, n, role = table["word"].to_pylist(), table["n"].to_numpy(), table["role"].to_numpy()
    ends = np.searchsorted(role, [1, 2, 3])
    own, equal, shorter = (Words(words[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True))
    found = []
    if len(own):
        # Copies of a group deal its visitors out; the first compares its own words.
        if table["copy"][0].as_py() == 0:
            found.append(near_pairs(own, own, settings.leaf, own=True))
        for visiting, base in ((equal, ends[0]), (shorter, ends[1])):
            if len(visiting):
                p, q = near_pairs(own, visiting, settings.leaf)
                found.append((p, q + base))
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in (0, 1))
    one, other = np.r_[a, b], np.r_[b, a]
    # Most frequent first, then in the order of letters (words of one role are in order, lengths differ between roles).
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
    columns = [
        pa.array([words[k] for k in one[first].tolist()], pa.string()),
        pa.array(np.diff(np.r_[first, len(one)]), pa.int64()),
        pa.array(n[other[first]], pa.int64()),
        pa.array([words[k] for k in other[first].tolist()], pa.string()),
    ]
    return pa.table(columns, names=["word", "n_near", "form_n", "form"])


# --- distributed --------------------------------------------------------------------------


def _fit(words: DataFrame, settings: Settings) -> dict[int, UpperTree]:
    """Upper trees, from the sizes of all lengths and a bounded sample of words."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, settings.sample / max(sum(sizes.values()), 1))
    picked = words.where(F.pmod(F.xxhash64(F.lit(5), "word"), F.lit(1_000_000)) < int(share * 1_000_000)).select("word")
    by_length: dict[int, list[str]] = {}
    for row in picked.limit(2 * settings.sample).collect():
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    trees, cell = {}, 0
    for length in sorted(sizes):
        sample = Words(sorted(by_length.get(length, [])))
        trees[length], cell = UpperTree.fitted(sample.counts.reshape(-1, DIMENSIONS), -(-sizes[length] // settings.cell), cell)
    return trees


def _placed(batches: Iterator[pa.RecordBatch], index: Index, visiting: bool) -> Iterator[pa.RecordBatch]:
    """``cell, role, word, n``: every word in its own cell, or in those it visits."""
    for batch in batches:
        words = np.array(batch.column(0).to_pylist(), dtype=object)
        n = batch.column(1).to_numpy()
        lengths = np.array([len(w) for w in words], dtype=int)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            counts = Words(words[at].tolist()).counts
            own = np.empty(len(at), np.int64)
            rows, cells = index.trees[length].visits(counts, 0, 0)
            own[rows] = cells
            out = [(np.arange(len(at)), own, 0)]
            if visiting:
                rows, cells = index.trees[length].visits(counts, 1, 1)
                out = [(rows[cells > own[rows]], cells[cells > own[rows]], 1)]
                if length + 1 in index.trees:
                    out.append((*index.trees[length + 1].visits(counts, 0, 1), 2))
            for rows, cells, role in out:
                columns = [pa.array(cells), pa.array(np.full(len(rows), role, np.int32)), pa.array(words[at[rows]], pa.string()), pa.array(n[at[rows]])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "role", "word", "n"])


def _dealt(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Groups ``cell, part, copy`` of every row: own words in each copy, visitors in each part, both as few times as can be."""
    names = ["cell", "part", "copy", "role", "word", "n"]
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []  # row, part, copy, role
        cells, roles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, (cell, role) in enumerate(zip(cells, roles, strict=True)):
            parts, copies = index.parts.get(cell, 1), index.copies.get(cell, 1)
            if parts == copies == 1:
                out.append((row, 0, 0, role))
                continue
            h = crc32(batch.column(2)[row].as_py().encode())
            if role:
                out += [(row, part, h // parts % copies, role) for part in range(parts)]
                continue
            own = h % parts
            out += [(row, own, copy, 0) for copy in range(copies)]
            out += [(row, part, h // parts % copies, 1) for part in range(own + 1, parts)]
        row, part, copy, role = (np.array(c) for c in (zip(*out, strict=True) if out else [[]] * 4))
        take = pa.array(row, pa.int64())
        columns = [batch.column(0).take(take), *(pa.array(c, pa.int32()) for c in (part, copy, role)), batch.column(2).take(take), batch.column(3).take(take)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


@shipped
def near_words(words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``word, n_near, form_n, form``: number of near words and the most frequent of them, for words that have any."""
    s = settings or Settings()
    index = Index(_fit(words, s), {}, {})
    kind = "cell long, role int, word string, n long"
    own = words.mapInArrow(lambda b: _placed(b, index, False), kind)
    visits = materialize(own.unionByName(words.mapInArrow(lambda b: _placed(b, index, True), kind)), "visits")
    # A row for each cell; cells have at least 16 words of the sample or are the only one of their length.
    sizes = visits.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") > 0).alias("visitors"))
    large = sizes.where((F.col("own") > 2 * s.cell) | (F.col("visitors") > s.visitors)).collect()
    dealt = Index(
        {},
        {r["cell"]: -(-r["own"] // s.cell) for r in large if r["own"] > 2 * s.cell},
        {r["cell"]: -(-(r["visitors"] + r["own"]) // s.visitors) for r in large if r["visitors"] + r["own"] > s.visitors},
    )
    groups = visits.mapInArrow(lambda b: _dealt(b, dealt), "cell long, part int, copy int, role int, word string, n long")
    found = groups.groupBy("cell", "part", "copy").applyInArrow(
        lambda table: _searched(table, s), "word string, n_near long, form_n long, form string"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the end of the chain, by doubling."""
    ends = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = ends.join(further, ends["root"] == further["at"], "left")
        if joined.where("next is not null").limit(1).count() == 0:
            return ends
        ends = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


@shipped
def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", settings: Settings | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    s = settings or Settings()
    words = materialize(vocabulary(docs, id_column, text_column, s), "vocabulary")
    near = words.join(near_words(words, s), "word", "left")
    often = F.col("form_n") >= F.col("n") * s.ratio
    rows = materialize(
        near.select(
            "word", F.when(often, F.col("form")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = _roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# --- DuckDB text --------------------------------------------------------------------------


def oracle(settings: Settings | None = None) -> str:
    """DuckDB text of the variants over documents: words that share a pattern with one letter left open."""
    s = settings or Settings()
    run = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
    big = "CAST({} AS UBIGINT)"
    step = f"lambda x, i: xor(x >> 1, (x & 1) * {big.format(3988292384)})"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])), {step})"
    letter = "CASE WHEN ord(d) < 128 THEN [ord(d)] ELSE [195, ord(d) - 64] END"
    data = f"CAST(flatten([{letter} FOR d IN string_split(doc_id || ':' || run, '')]) AS UBIGINT[])"
    crc = f"xor(list_reduce(list_prepend({big.format(4294967295)}, {data}), {byte}), {big.format(4294967295)})"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{run}')) AS run FROM documents) GROUP BY 1, 2),
cut AS (
  SELECT CASE WHEN h % {s.modulus} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n
  FROM (SELECT run, n, CAST({crc} AS BIGINT) AS h FROM runs)),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {s.least_length} GROUP BY word HAVING sum(n) >= {s.least_count}),
open AS (
  SELECT word, n, i, word[: i] AS head, word[i + 2 :] AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM open a JOIN open b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM open a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM open a JOIN words b ON a.head || a.tail = b.word),
near AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, min(struct_pack(less := -other_n, other := other)).other AS form FROM pairs GROUP BY word),
rows AS (
  SELECT words.word, CASE WHEN form_n >= n * {s.ratio} THEN form END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= n * {s.ratio} THEN form_n END AS form_n FROM words LEFT JOIN near USING (word)),
chain(word, here) AS (
  SELECT word, word FROM rows UNION ALL SELECT chain.word, rows.form FROM chain JOIN rows ON rows.word = chain.here WHERE rows.form IS NOT NULL)
SELECT rows.word, rows.form, chain.here AS root, rows.n, rows.n_near, rows.form_n
FROM rows JOIN chain USING (word) JOIN rows AS last ON last.word = chain.here AND last.form IS NULL"""
