"""Removal of repeated byte strings with suffix arrays and longest-previous-factor arrays.

A byte goes if some ``length``-byte string that covers it also starts elsewhere in
the corpus. ``keep="none"`` removes every occurrence, ``keep="first"`` leaves the
first one (smallest id, then place) and removes the later ones.

The work is dealt by content. Every ``length``-byte window picks an anchor, its
64-gram with the smallest hash, so equal windows pick equal anchors. Neighbouring
windows with one anchor are a *context*: a run of window starts and the bytes they
cover, about one per 69 bytes. Anchors that occur once end here. Equal contexts are
counted before any shuffle needs them together; different contexts of one anchor
are put into one buffer, whose suffix array (prefix doubling), LCP array and
longest-previous-factor array (previous and next smaller places in suffix order)
say which windows have an equal one, or an earlier one. An anchor with more than
``limit`` different contexts goes the same exact way by counts: its windows are
hashed and counted one by one, so no group is ever gathered beyond that size.

Only places travel, except for the bytes of contexts to be compared and, twice,
whole texts to the table of their own spans (compressed).

Defined results: null text counts as empty and loses nothing; texts shorter than
``length`` lose nothing; very long texts are cut into overlapping blocks; rows with
equal id and text are separate occurrences under keep="none" and one document
under keep="first"; rows without id come last in order. Other columns are not read
by ``removed_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialize
from .ship import shipped

GRAM = 64
BLOCK = 1 << 20
_PLACE_BITS = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEPS = [np.uint64(x) for x in np.random.default_rng(65).integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- contexts -----------------------------------------------------------------------------


def contexts(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int):
    """Runs of windows with one anchor: text number, first window (in data), count, anchor hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _TABLE[np.frombuffer(data, np.uint8)]
    for power, factor in enumerate(_STEPS):
        step = 1 << power
        h = h[:-step] * factor + h[step:]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    low = (h & ~_PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    have, want = 1, length - GRAM + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    window_ends = np.maximum(ends - length + 1, starts)
    cuts = np.unique(np.concatenate((np.flatnonzero(low[1:] != low[:-1]) + 1, starts, window_ends)))
    cuts = cuts[cuts < len(low)]
    nexts = np.append(cuts[1:], len(low))
    text = np.searchsorted(starts, cuts, "right") - 1
    inside = cuts < window_ends[text]
    cuts, nexts, text = cuts[inside], nexts[inside], text[inside]
    return text, cuts, nexts - cuts, h[(low[cuts] & _PLACE_BITS).astype(np.int64)]


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, starts, ends, text numbers and offsets of their first byte; long texts in overlapping parts."""
    parts, size = [], 0

    def block():
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        return b"".join(p[2] for p in parts), ends - sizes, ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            parts.append((number, at, part))
            size += len(part)
            if size >= BLOCK:
                yield block()
                parts, size = [], 0
    if parts:
        yield block()


def _contexts_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, order = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for data, starts, ends, numbers, offsets in _blocks([t or b"" for t in texts], length):
            text, first, count, anchor = contexts(data, starts, ends, length)
            spans = zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)
            body = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans], dtype=np.uint64)
            columns = [
                anchor.view(np.int64), body.view(np.int64), keys[numbers[text]], order[numbers[text]],
                first - starts[text] + offsets[text], count.astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "key", "ord", "start", "n"])


# --- suffix arrays ------------------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[False, sorted_keys[1:] != sorted_keys[:-1]])
    return rank


class Suffixes:
    """Suffix order of chosen places of ``data`` by their first ``length`` bytes (8 at least)."""

    def __init__(self, data: np.ndarray, places: np.ndarray, length: int):
        self.data, self.length = np.r_[data, np.zeros(2 * length + 8, np.uint8)], length
        n = len(data) + length
        words = np.zeros(n, np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | self.data[j : j + n]
        self.ranks, have = [(8, _dense(words))], 8
        while have < length:
            step = min(have, length - have)
            rank = self.ranks[-1][1]
            rank = _dense(rank * (n + 1) + np.r_[rank[step:], np.zeros(step, np.int64)])
            have += step
            self.ranks.append((have, rank))
        self.order = np.argsort(self.ranks[-1][1][places], kind="stable")
        self.sorted = places[self.order]
        self.lcp = np.r_[0, self.common(self.sorted[:-1], self.sorted[1:])] if len(places) else np.zeros(0, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal leading bytes of suffixes, ``length`` at most."""
        equal = np.where(self.ranks[-1][1][a] == self.ranks[-1][1][b], self.length, 0)
        todo = np.flatnonzero(equal == 0)
        a, b, found = a[todo], b[todo], np.zeros(len(todo), np.int64)
        for size, rank in self.ranks[-2::-1]:
            found += size * (rank[a + found] == rank[b + found])
        going = np.ones(len(todo), bool)
        for _ in range(8):
            going &= self.data[a + found] == self.data[b + found]
            found += going
        equal[todo] = np.minimum(found, self.length)
        return equal


def nearest_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, its common prefix with the closest one before it that has a smaller order; else 0.

    lcp[i] belongs to suffixes i-1 and i. Pointers jump over all that were jumped over before.
    """
    last, low = np.arange(-1, len(order) - 1), lcp.copy()
    while True:
        wrong = np.flatnonzero((last >= 0) & (order[last] > order))
        if not len(wrong):
            return np.where(last >= 0, low, 0)
        over = last[wrong]
        low[wrong], last[wrong] = np.minimum(low[wrong], low[over]), last[over]


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest prefix of each suffix that also starts at a place of smaller order."""
    after = np.r_[lcp[1:], 0]
    before = nearest_smaller(order, lcp)
    return np.maximum(before, nearest_smaller(order[::-1], np.r_[0, after[::-1][1:]])[::-1])


def repeated_windows(bodies: list[bytes], counts: np.ndarray, ranks: np.ndarray, length: int, keep: str) -> np.ndarray:
    """For all windows of the bodies in turn: is there an equal one (keep none), or an equal earlier one."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(counts)
    bases = np.cumsum(counts + length - 1) - (counts + length - 1)
    within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    places = np.repeat(bases, counts) + within
    found = Suffixes(data, places, length)
    if keep == "first":
        order = np.lexsort((within, np.repeat(ranks, counts)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best = longest_previous(rank[found.order], found.lcp)
    else:
        best = np.maximum(found.lcp, np.r_[found.lcp[1:], 0])
    repeated = np.empty(len(places), bool)
    repeated[found.order] = best >= length
    return repeated


def _compared(batches: Iterator[pa.RecordBatch], length: int, keep: str) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows of each context; anchors (first column) come sorted."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        counts = part["n"].to_numpy().astype(np.int64)
        order = np.lexsort([part[c].to_numpy() for c in ("start", "key", "ord")])
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        marks = repeated_windows(part["body"].to_pylist(), counts, ranks, length, keep)
        ends = np.cumsum(counts)
        edge = np.zeros(len(marks) + 1, bool)
        edge[ends - counts] = edge[-1] = True
        change = np.flatnonzero(edge[:-1] | np.r_[True, marks[1:] != marks[:-1]])
        stop = np.append(change[1:], len(marks))[marks[change]]
        change = change[marks[change]]
        owner = np.searchsorted(ends, change, "right")
        lists = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))].astype(np.int32)
        base = (ends - counts)[owner]
        spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array((v - base).astype(np.int32))) for v in (change, stop)]
        h1, h2 = (part[c].combine_chunks() for c in ("h1", "h2"))
        return pa.RecordBatch.from_arrays([h1, h2, *spans], names=["h1", "h2", "froms", "tos"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK:
            part = pa.Table.from_batches(held)
            anchors = part["h1"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            at = 0
            while at < cut:  # about BLOCK bytes at a time, whole anchors
                sizes = np.cumsum(part["n"].to_numpy()[at:cut] + length)
                end = at + int(np.searchsorted(sizes, BLOCK, "right"))
                end = cut if end >= cut else max(int(np.searchsorted(anchors, anchors[end])), int(np.searchsorted(anchors, anchors[at], "right")))
                yield solve(part.slice(at, end - at))
                at = end
            held = part.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if part_rows := sum(b.num_rows for b in held):
        yield solve(pa.Table.from_batches(held).slice(0, part_rows))


def _bodies(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Cut the bytes of each listed context out of its text."""
    for batch in batches:
        rows = {"h1": [], "h2": [], "c": [], "d": [], "ord": [], "key": [], "start": [], "n": [], "body": []}
        for packed, listed in zip(batch.column(0), batch.column(1), strict=True):
            text = zstandard.decompress(packed.as_py())
            for item in listed.as_py():
                for name, value in item.items():
                    rows[name].append(value)
                rows["body"].append(text[item["start"] : item["start"] + item["n"] + length - 1])
        yield pa.RecordBatch.from_pydict(rows, schema=_BODY_SCHEMA)


_BODY_SCHEMA = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("ord", pa.int64()),
     ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("body", pa.binary())]
)
_BODY_TYPE = "h1 long, h2 long, c long, d long, ord long, key long, start long, n int, body binary"
_SPANS_TYPE = "h1 long, h2 long, froms array<int>, tos array<int>"


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            body = row["body"]
            hashes = [xxhash.xxh3_128_digest(body[k : k + length]) for k in range(row["n"])]
            n = row["n"]
            yield pa.RecordBatch.from_pydict({
                "h1": [row["h1"]] * n, "h2": [row["h2"]] * n, "c": [row["c"]] * n, "ord": [row["ord"]] * n,
                "key": [row["key"]] * n, "place": [row["start"] + k for k in range(n)], "off": list(range(n)), "window": hashes,
            }, schema=_WINDOW_SCHEMA)


_WINDOW_SCHEMA = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("c", pa.int64()), ("ord", pa.int64()), ("key", pa.int64()),
     ("place", pa.int64()), ("off", pa.int32()), ("window", pa.binary())]
)
_WINDOW_TYPE = "h1 long, h2 long, c long, ord long, key long, place long, off int, window binary"


# --- distributed --------------------------------------------------------------------------


def _pack(texts: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=1)
    return pa.array([packer.compress((t.as_py() or "").encode()) for t in texts], pa.binary())


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return plain.select(F.xxhash64("id", "text").alias("key"), "id", "text")


def removed_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 200, keep: str = "first",
    limit: int = 2000,
) -> DataFrame:
    """``key, spans`` (byte ranges, not merged) of the texts that lose something; key: hash of id and text."""
    if keep not in ("first", "none") or length < 2 * GRAM:
        raise ValueError(f"keep has to be first or none, length at least {2 * GRAM}")
    keyed = _keyed(docs, id_column, text_column)
    order = F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1)) if keep == "first" else F.lit(0).cast("long")
    occurrences = materialize(
        keyed.select("key", order.alias("ord"), "text").mapInArrow(
            lambda batches: _contexts_of(batches, length), "h1 long, h2 long, key long, ord long, start long, n int"
        ),
        "contexts",
    )
    # Sides of joins on anchors are written first: Spark splits a large key of a join only where both sides are plain shuffles.
    repeated = materialize(occurrences.groupBy("h1").count().where("count > 1").select("h1"), "repeated-anchors")
    again = materialize(occurrences.join(repeated, "h1", "left_semi"), "repeated-contexts")
    distinct = again.groupBy("h1", "h2").agg(
        F.count("*").alias("c"), F.min(F.struct("ord", "key", "start")).alias("first"), F.first("n").alias("n")
    )
    distinct = materialize(distinct, "distinct-contexts")
    several = materialize(distinct.groupBy("h1").agg(F.count("*").alias("d")).where("d > 1"), "several")
    listed = (
        distinct.join(several, "h1")
        .select("h1", "h2", "c", "d", "first.*", "n")
        .groupBy("key")
        .agg(F.collect_list(F.struct("h1", "h2", "c", "d", "ord", "key", "start", "n")).alias("listed"))
    )
    packed = keyed.select("key", F.arrow_udf(_pack, "binary")("text").alias("packed"))
    texts = packed.join(listed, "key").dropDuplicates(["key"])  # equal rows have equal bytes
    bodies = materialize(
        texts.select("packed", "listed").mapInArrow(lambda batches: _bodies(batches, length), _BODY_TYPE), "bodies"
    )
    compared = (
        bodies.where(F.col("d") <= limit)
        .select("h1", "h2", "ord", "key", "start", "n", "body")
        .repartition("h1")
        .sortWithinPartitions("h1")
        .mapInArrow(lambda batches: _compared(batches, length, keep), _SPANS_TYPE)
    )
    windows = materialize(
        bodies.where(F.col("d") > limit).mapInArrow(lambda batches: _window_hashes(batches, length), _WINDOW_TYPE), "windows"
    )
    place = F.struct("ord", "key", "place")
    equal = windows.groupBy("window").agg(F.sum("c").alias("all"), F.min(place).alias("first_place"))
    marked = windows.join(equal, "window").where(place > F.col("first_place") if keep == "first" else F.col("all") > 1)
    counted = marked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("off")).alias("froms"))
    counted = counted.select("h1", "h2", "froms", F.transform("froms", lambda x: x + 1).alias("tos"))
    marks = distinct.join(compared.where("size(froms) > 0").unionByName(counted), ["h1", "h2"], "left")
    marks = materialize(marks.where("c > 1 or froms is not null").drop("n"), "marks")
    whole = F.col("c") > 1
    if keep == "first":
        whole = F.struct("key", "start") != F.struct("first.key", "first.start")
    spans = F.when(whole, F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))))
    spans = spans.otherwise(
        F.zip_with("froms", "tos", lambda a, b: F.struct((F.col("start") + a).alias("a"), (F.col("start") + b + length - 1).alias("b")))
    )
    lost = again.join(marks, ["h1", "h2"]).select("key", spans.alias("spans")).where("size(spans) > 0")
    return lost.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching ranges (rows a, b) as maximal ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.stack((spans[new, 0], np.r_[reach[:-1][new[1:]], reach[-1:]]), 1)


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The ranges without characters that lie in them only in part."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def cut_out(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _ranges(listed: pa.Scalar) -> np.ndarray:
    if not listed.is_valid:
        return np.zeros((0, 2), np.int64)
    items = listed.values
    return merged(np.stack([items.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for packed, listed in zip(batch.column(1), batch.column(2), strict=True):
            text, spans = zstandard.decompress(packed.as_py()), _ranges(listed)
            kept = cut_out(text, spans)
            for name, value in zip(rows, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values())], names=["id", *rows])


@shipped
def removal_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    spans = removed_spans(docs, id_column, text_column, **options)
    packed = _keyed(docs, id_column, text_column).select("key", "id", F.arrow_udf(_pack, "binary")("text").alias("packed"))
    kind = dict(docs.select(F.col(id_column).alias("id")).dtypes)["id"]
    return packed.join(spans, "key", "left").select("id", "packed", "spans").mapInArrow(
        _digest, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


@shipped
def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with shortened texts; characters are removed whole, rows that lose all their text go."""
    spans = removed_spans(docs, id_column, text_column, **options)
    joined = docs.withColumn("__key", F.xxhash64(id_column, text_column)).join(
        spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left"
    )
    cut = F.arrow_udf(shortened, "string").asNondeterministic()  # evaluated once, not again in the filter
    result = joined.withColumn(text_column, cut(text_column, "__spans"))
    gone = F.col("__spans").isNotNull() & ~F.col(text_column).rlike(r"\S")
    return result.where(~gone).select(docs.columns)


def shortened(texts: pa.Array, listed: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts, listed, strict=True):
        if text.is_valid and spans.is_valid:
            data = text.as_py().encode()
            out.append(cut_out(data, whole_characters(data, _ranges(spans))).decode())
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())
