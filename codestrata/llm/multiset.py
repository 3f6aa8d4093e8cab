"""Homomorphic multiset hash of a document's paragraphs.

A fingerprint is a wide vector: 16 lanes of 32 bits, summed from the BLAKE2b hashes
of the paragraphs (lines), and 128 lanes of 32 bits, summed from the word triples
of each paragraph, every one of which adds 1 or -1 to one lane; no text that Spark
holds has enough triples to leave a signed lane. All sums are taken
modulo the lane's power of two. So the vector does not depend on the order of
paragraphs, the vector of a union is the sum of the vectors, and a paragraph is
inserted or deleted by adding or subtracting its own. Vectors are equal for equal
multisets of paragraphs; the cosine of the second part estimates their likeness.

``with_next`` needs the next document in ascending id. Documents are dealt into
blocks of neighbouring ids; the first document of each block is also sent to the
block before. The driver sees bounds of at most ``max_blocks`` blocks, no document.

Defined results: null text counts as empty; ids are ordered with null first, equal
ids by a hash of id and text; after the last document comes the first, which for a
single document is itself; two empty texts are alike to 1, an empty and another
text to 0; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import shipped
from .words import mixed, word_hashes

WIDE, SKETCH = 16, 128
SIZE = 4 * WIDE + 4 * SKETCH
_WEIGHTS = [np.uint64(w) for w in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprint vector of each text, as unsigned lanes."""
    wide = np.zeros((len(texts), WIDE), np.uint32)
    for k, text in enumerate(texts):
        digests = b"".join(hashlib.blake2b(line).digest() for line in text.split(b"\n"))
        wide[k] = np.frombuffer(digests, "<u4").reshape(-1, WIDE).sum(axis=0, dtype=np.uint32)
    data = b"\n".join(texts)
    starts, _, h = word_hashes(data)
    lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
    line = np.searchsorted(lines, starts)
    triple = h * _WEIGHTS[0]
    for step in (1, 2):
        same = np.flatnonzero(line[step:] == line[:-step]) if len(h) > step else np.zeros(0, np.int64)
        triple[same] += h[same + step] * _WEIGHTS[step]
    triple = mixed(triple)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    lane = text * SKETCH + (triple >> np.uint64(57)).astype(np.int64)
    sign = (triple & np.uint64(1)).astype(np.float64) * 2 - 1
    sums = np.bincount(lane, weights=sign, minlength=len(texts) * SKETCH).reshape(len(texts), SKETCH)
    return wide, sums.astype(np.int64).astype(np.uint32)


def written(wide: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [w.astype("<u4").tobytes().hex() + s.astype("<u4").tobytes().hex() for w, s in zip(wide, sketch, strict=True)]


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = bytes.fromhex(fingerprint)
    return np.frombuffer(data[: 4 * WIDE], "<u4"), np.frombuffer(data[4 * WIDE :], "<u4")


def fingerprint(text: str | None) -> str:
    return written(*vectors([(text or "").encode()]))[0]


def combined(one: str, other: str, sign: int = 1) -> str:
    """Fingerprint of the union of two multisets of paragraphs; sign -1 takes the second out."""
    (a, b), (c, d) = read(one), read(other)
    step = np.int64(sign)
    wide = (a.astype(np.int64) + step * c.astype(np.int64)).astype(np.uint32)
    sketch = (b.astype(np.int64) + step * d.astype(np.int64)).astype(np.uint32)
    return written(wide[None], sketch[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two sketches, 0 at least."""
    if np.array_equal(a, b):
        return 1.0
    a, b = (x.astype(np.int32).astype(np.float64) for x in (a, b))
    norm = np.sqrt((a @ a) * (b @ b))
    return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


# --- documents and the next ones ----------------------------------------------------------


def _dealt(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, firsts: list, before: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row under its block; a block's first rows also at the end of the block before."""
    packer = zstandard.ZstdCompressor(level=1)
    names = ["block", "tail", "id", "key", "packed"]
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        block = np.where(known, np.searchsorted(bounds, values, "right"), 0)
        opens = np.array([firsts[b] == i for b, i in zip(block.tolist(), ids.to_pylist(), strict=True)], dtype=bool)
        packed = pa.array([packer.compress((t.as_py() or "").encode()) for t in batch.column(2)], pa.binary())
        for rows, at, tail in ((np.arange(len(block)), block, False), (np.flatnonzero(opens), before[block][opens], True)):
            take = pa.array(rows)
            columns = [pa.array(at, pa.int32()), pa.array(np.full(len(rows), tail)), *(c.take(take) for c in (ids, batch.column(1), packed))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and tail; every row but the tails with the row after it."""

    def solve(rows: list[tuple[object, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [following]
        edited = []
        for text, other in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append((text[: len(text) - half] + other[:half]).encode())
        wide, sketch = vectors([t.encode() for t in texts])
        new_wide, new_sketch = vectors(edited)
        n = len(rows)
        columns = [
            pa.array([i for i, _ in rows], kind),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array(written(wide[:n], sketch[:n])),
            pa.array(written(new_wide, new_sketch)),
            pa.array([1.0 if np.array_equal(wide[k], new_wide[k]) else likeness(sketch[k], new_sketch[k]) for k in range(n)]),
            pa.array([likeness(sketch[k], sketch[k + 1]) for k in range(n)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    kind = pa.int64()
    rows: list[tuple[object, str]] = []
    block, size, closed = None, 0, False
    for batch in batches:
        kind = batch.schema.field(2).type
        columns = (batch.column(k) for k in (0, 1, 2, 4))
        for at, tail, name, packed in zip(*columns, strict=True):
            at, tail = at.as_py(), tail.as_py()
            if at != block:
                block, closed = at, False
            if closed:
                continue  # further rows with the id of the next block's first
            text = zstandard.decompress(packed.as_py()).decode()
            if rows and (tail or size > 1 << 20):
                yield solve(rows, text)
                rows, size = [], 0
            if tail:
                closed = True
            else:
                rows.append((name.as_py(), text))
                size += len(text)


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@shipped
def with_next(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_rows: int = 2000, max_blocks: int = 1 << 16
) -> DataFrame:
    """Fingerprints of every text and of the text whose second half comes from the next document."""
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    ids = plain.select("id")
    known, rows = ids.agg(F.count("id"), F.count("*")).first()
    blocks = min(max_blocks, -(-rows // block_rows) or 1)
    shares = [k / blocks for k in range(1, blocks)]
    found = ids.agg(F.percentile_approx("id", shares, 100 * blocks)).first()[0] if shares and known else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))
    place = F.arrow_udf(lambda v: pa.array(np.searchsorted(bounds, v.to_numpy(zero_copy_only=False), "right"), pa.int32()), "int")
    least = {r["block"]: r["first"] for r in ids.where("id is not null").groupBy(place("id").alias("block")).agg(F.min("id").alias("first")).collect()}
    if known < rows:
        least[0] = None
    filled = sorted(least)
    firsts: list = [least.get(b, "") for b in range(len(bounds) + 1)]  # no id equals a text
    before = np.zeros(len(bounds) + 1, dtype=np.int64)
    for b, previous in zip(filled, [*filled[-1:], *filled[:-1]], strict=True):
        before[b] = previous
    dealt = plain.select("id", F.xxhash64("id", "text").alias("key"), "text").mapInArrow(
        lambda batches: _dealt(batches, bounds, firsts, before), "block int, tail boolean, id long, key long, packed binary"
    )
    ordered = dealt.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", "tail", "id", "key")
    return ordered.mapInArrow(
        _with_next,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
