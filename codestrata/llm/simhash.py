"""SimHash near-dedup by a self-join of binary tries.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. The bits
are cut into ``BLOCKS`` blocks; two fingerprints that link agree on at least
``BLOCKS - max_bits`` of them, so every fingerprint is dealt once for every
choice of that many blocks and meets each partner under an equal key. Under one
key, a path-compressed binary trie is joined with itself: node pairs are walked
together, the bits that must differ are counted, and a pair is dropped when they
exceed the budget, or linked as a whole when even all open bits fit into it.
Keys with more fingerprints than ``segment`` are split into segments, and each
pair of segments is a group of its own.

Tasks return spanning links (a fingerprint and the smallest one it reached), so
the links of a group grow with its size, not with its square. Components are
joined by ``components.connected``.

Defined results: null text counts as empty; a text without words has fingerprint
zero, which links like any other; fewer words than ``width`` form one shingle;
equal rows share a component; a component without any id has component_id null;
an empty table gives an empty result. Other columns are not read by
``simhash_classes`` and kept as they are by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialize
from .components import connected
from .ship import shipped

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
BLOCKS = 6
NONE = -1
#: The eight bits of a byte, highest first, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


# --- fingerprints -------------------------------------------------------------------------


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, highest first, among big-endian words."""
    ones = np.zeros(64, dtype=np.int64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(columns), 255):  # so many additions leave no byte too small
        ones += SPREAD[columns[at : at + 255]].sum(axis=0).view(np.uint8)
    return ones


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of one text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64
    ).astype(">u8")
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > len(hashes)).tobytes(), "big")


def fingerprints(texts: pa.Array, width: int = 4) -> pa.Array:
    values = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


# --- the tries of one batch of groups -----------------------------------------------------


class Tries:
    """Path-compressed binary tries over sorted runs of fingerprints, one per group."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.values = values
        low, high = starts[:-1], starts[1:]
        self.roots = np.arange(len(low))
        lows, highs, lefts, levels, made = [], [], [], [], 0
        while len(low):
            levels.append((made, made + len(low)))
            made += len(low)
            inner = np.flatnonzero(high - low > 1)
            left = np.full(len(low), NONE)
            left[inner] = made + 2 * np.arange(len(inner))
            lows.append(low)
            highs.append(high)
            lefts.append(left)
            a, b = low[inner], high[inner]
            middle = self._split(a, b)
            low, high = np.stack((a, middle), 1).ravel(), np.stack((middle, b), 1).ravel()
        self.low, self.high, self.left = map(np.concatenate, (lows, highs, lefts))
        self.first = values[self.low]
        self.open = np.zeros(made, np.uint64)
        for start, end in reversed(levels):
            inner = start + np.flatnonzero(self.left[start:end] != NONE)
            x, y = self.left[inner], self.left[inner] + 1
            self.open[inner] = self.open[x] | self.open[y] | (self.first[x] ^ self.first[y])

    def _split(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in each run at which the highest differing bit is set."""
        if not len(low):
            return low
        bits = self.values[low] ^ self.values[high - 1]
        for step in (1, 2, 4, 8, 16, 32):
            bits |= bits >> np.uint64(step)
        bits ^= bits >> np.uint64(1)
        low, high = low.copy(), high - 1  # unset at low, set at high
        while (todo := np.flatnonzero(high - low > 1)).size:
            middle = (low[todo] + high[todo]) // 2
            isset = (self.values[middle] & bits[todo]) != 0
            high[todo] = np.where(isset, middle, high[todo])
            low[todo] = np.where(isset, low[todo], middle)
        return high

    def links(self, budget: int, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs that link; together they span all that is linked."""
        inner = self.roots[self.left[self.roots] != NONE]
        todo = [(inner, inner)]
        while todo:
            a, b = todo.pop()
            if len(a) > block:
                half = len(a) // 2
                todo += [(a[:half], b[:half]), (a[half:], b[half:])]
                continue
            differ, free = self.first[a] ^ self.first[b], self.open[a] | self.open[b]
            alive = np.bitwise_count(differ & ~free) <= budget
            whole = alive & (np.bitwise_count(differ | free) <= budget)
            same = a == b
            yield self.low[a[whole & ~same]], self.low[b[whole & ~same]]
            node = a[whole & same]
            sizes = self.high[node] - self.low[node]
            first = np.repeat(self.low[node], sizes)
            yield first, first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rest = alive & ~whole
            node = a[rest & same]
            left, right = self.left[node], self.left[node] + 1
            x, y = a[rest & ~same], b[rest & ~same]
            swap = np.bitwise_count(self.open[y]) > np.bitwise_count(self.open[x])
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            below = self.left[x]
            a = np.concatenate((left, right, left, below, below + 1))
            b = np.concatenate((left, right, right, y, y))
            if len(a):
                todo.append((a, b))


def spanning(count: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index that each index reaches."""
    label = np.arange(count)
    for a, b in links:
        a, b = label[a], label[b]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (jump := label[label] != label).any():
                label[jump] = label[label][jump]
            a, b = label[a], label[b]
    return label


def _joined(batches: Iterator[pa.RecordBatch], budget: int, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Links of the groups (column g) in a partition that is sorted by group."""

    def solve(group: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((value, group))
        group, value = group[order], value[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])][: len(group)]
        group, value = group[new], value[new]
        starts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        label = spanning(len(value), Tries(value, starts).links(budget))
        moved = label != np.arange(len(value))
        pairs = [pa.array(v[moved].view(np.int64)) for v in (value, value[label])]
        return pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

    group, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        group = np.r_[group, batch.column(0).to_numpy(zero_copy_only=False)]
        value = np.r_[value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if len(group) >= rows:
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield solve(group[:cut], value[:cut])
                group, value = group[cut:], value[cut:]
    if len(group):
        yield solve(group, value)


# --- distributed --------------------------------------------------------------------------


def _masks(max_bits: int) -> list[int]:
    """For every choice of blocks that two linked fingerprints may share, its bits."""
    bounds = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


@shipped
def fingerprint_links(values: DataFrame, max_bits: int = 4, segment: int = 1024) -> DataFrame:
    """Spanning links ``a, b`` of a table of distinct fingerprints (long column fp)."""
    if not 0 <= max_bits < BLOCKS:
        raise ValueError(f"max_bits has to be below {BLOCKS}")
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(max_bits))])
    dealt = values.select("fp", F.explode(keys).alias("key"))
    sizes = dealt.groupBy("key").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(segment)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.xxhash64("key", F.least(F.col("own"), other), F.greatest(F.col("own"), other)),
    )
    met = dealt.join(sizes.select("key", parts.alias("parts")), "key").select("fp", "key", "parts", own.alias("own"))
    groups = met.select(F.explode(pairs).alias("g"), "fp").repartition("g").sortWithinPartitions("g")
    return groups.mapInArrow(lambda batches: _joined(batches, max_bits), "a long, b long")


@shipped
def simhash_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """``id, key, fp, component, component_id`` of every row.

    key: hash of id and text; component: smallest fp reached; component_id:
    smallest id in the component.
    """
    make = F.arrow_udf(lambda texts: fingerprints(texts, width), "long")
    known = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).select(
        "id", F.xxhash64("id", "text").alias("key"), make("text").alias("fp")
    )
    known = materialize(known, "fingerprints")
    distinct = known.groupBy("fp").agg(F.min("id").alias("id"))
    reached = connected(fingerprint_links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    own = distinct.join(reached, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    smallest = own.groupBy("component").agg(F.min("id").alias("component_id"))
    return known.join(own.select("fp", "component").join(smallest, "component"), "fp").select(
        "id", "key", "fp", "component", "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row of each component: the one with the smallest id (rows without id come last)."""
    classes = simhash_classes(docs, id_column, text_column, width, max_bits)
    first = F.struct(F.col("id").isNull(), "id", "key")
    keepers = classes.groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.key").alias("__key"))
    keyed = docs.withColumn("__key", F.xxhash64(id_column, text_column))
    return keyed.join(keepers, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
