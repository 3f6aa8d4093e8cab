"""Cost-balanced packing of tokenised documents into sequences of fixed length.

The cost of a piece is estimated as ``linear * n + quadratic * n * n`` (attention
stays inside a piece). A document longer than a sequence first fills sequences of
its own; what is left of all documents is assigned in descending order to the
lowest-cost sequence that has token capacity, and cut where it does not fit. As
many sequences are opened as can be filled; what remains is carried on, and at the
end of a partition laid into sequences whose lengths are powers of two, which need
no padding. So no sequence of this operator is padded.

Tokenising and packing are one narrow step over the input partitions, without a
shuffle; a task holds at most about ``block_tokens`` tokens beside one document.
A task that runs again packs its partition again as a whole.

Defined results: null text counts as empty; an empty text is one piece with the end
id alone; equal rows are packed separately; a null id stays null; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import shipped


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens -------------------------------------------------------------------------------


class WordTokenizer:
    """Ids of texts, equal to those of the tokenizer file, with remembered words.

    The tokenizer drops white space and merges inside its words only, so ids are
    looked up for what stands between white space, and where that is new word by
    word. Texts with characters beyond U+02FF, or with signs that the two pattern
    languages class differently, go to the tokenizer as they are. About
    ``remembered`` units and words are kept.
    """

    WORDS = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")
    ODD = re.compile("[^\u0000-˿]|[\x1c-\x1f\x85ª²³¹º¼-¾İ]")
    END = "</w>"

    def __init__(self, path: str, remembered: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(self.END)]] = True
        # Of words and of units those asked for lately, and those before them.
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.older_known: dict[str, bytes] = {}
        self.older_units: dict[str, bytes] = {}
        self.remembered = remembered

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(ids, dtype=np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(words) and len(ids) == ends[-1]:
            parts = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        else:
            parts = [self.plain(w).tobytes() for w in words]
        self.known.update(zip(words, parts, strict=True))

    def _add(self, units: list[str]) -> None:
        """Ids of units that are not known, from those of their words."""
        half = self.remembered // 2
        if len(self.units) + len(units) > half:
            self.older_units, self.units = self.units, {}
        if len(self.known) > half:
            self.older_known, self.known = self.known, {}
        before = self.older_units.get
        new = []
        for u in units:
            ids = before(u)
            if ids is None:
                new.append(u)
            else:
                self.units[u] = ids
        split = [self.WORDS.findall(u) for u in new]
        known, older = self.known, self.older_known
        missing = {w for words in split for w in words if w not in known}
        known.update((w, older[w]) for w in missing if w in older)
        missing = [w for w in missing if w not in known]
        if missing:
            self._learn(missing)
        self.units.update((u, b"".join([known[w] for w in words])) for u, words in zip(new, split, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 64):
            split = [self._split(t or "") for t in texts[at : at + 64]]
            units = list(chain.from_iterable(own for own in split if own))
            found = list(map(self.units.get, units))
            new = [k for k, ids in enumerate(found) if ids is None]
            if new:
                self._add(list({units[k] for k in new}))  # after this the new ones are known; others may be forgotten
                for k in new:
                    found[k] = self.units[units[k]]
            end = 0
            for text, own in zip(texts[at : at + 64], split, strict=True):
                if own is None:
                    out.append(self.plain(text))
                else:
                    out.append(np.frombuffer(b"".join(found[end : end + len(own)]), np.int32))
                    end += len(own)
        return out

    def _split(self, text: str) -> list[str] | None:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else self.ODD.search(text)
        if odd or self.special.search(text):
            return None
        return text.lower().split()


#: Words and units that a worker keeps, each: some 400 MB, which spare looking up rare words again.
REMEMBERED = 1_200_000
_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_of(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    if (path, remembered) not in _TOKENIZERS:
        _TOKENIZERS[path, remembered] = WordTokenizer(path, remembered)
    return _TOKENIZERS[path, remembered]


# --- packing ------------------------------------------------------------------------------


class Packer:
    """Collects documents and assigns pieces ``(document, start, length, sequence, offset)``."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.left: list[tuple[int, int, int]] = []  # document, start, length
        self.waiting = 0
        self.sequences = 0
        self.pieces: list[tuple[int, int, int, int, int]] = []

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, document: int, tokens: int) -> None:
        whole = tokens // self.capacity
        for k in range(whole):
            self.pieces.append((document, k * self.capacity, self.capacity, self.sequences, 0))
            self.sequences += 1
        if rest := tokens - whole * self.capacity:
            self.left.append((document, whole * self.capacity, rest))
            self.waiting += rest

    def pack(self, sizes: list[int]) -> None:
        """Fill sequences of the given sizes; what does not fit stays."""
        todo = sorted(self.left, key=lambda p: (-self.cost(p[2]), p[0]))
        fill = [0] * len(sizes)
        heap = [(0.0, s) for s in range(len(sizes))]
        self.left = []
        for document, start, length in todo:
            while length and heap:
                spent, s = heapq.heappop(heap)
                part = min(length, sizes[s] - fill[s])
                self.pieces.append((document, start, part, self.sequences + s, fill[s]))
                fill[s] += part
                start, length = start + part, length - part
                if fill[s] < sizes[s]:
                    heapq.heappush(heap, (spent + self.cost(part), s))
            if length:
                self.left.append((document, start, length))
        self.sequences += len(sizes)
        self.waiting = sum(p[2] for p in self.left)

    def pack_full(self) -> None:
        self.pack([self.capacity] * (self.waiting // self.capacity))

    def pack_rest(self) -> None:
        self.pack_full()
        self.pack([1 << k for k in range(self.waiting.bit_length() - 1, -1, -1) if self.waiting >> k & 1])


def _packed(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, linear: float, quadratic: float, end: int, block: int, remembered: int
) -> Iterator[pa.RecordBatch]:
    tokenizer, packer = tokenizer_of(path, remembered), Packer(capacity, linear, quadratic)
    base = TaskContext.get().partitionId() << 33
    ids: list[np.ndarray] = []
    names: list = []
    kind = None

    def flush() -> pa.RecordBatch:
        """The pieces so far; documents with tokens that still wait stay."""
        pieces = np.array(packer.pieces, dtype=np.int64).reshape(-1, 5)
        packer.pieces = []
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        document, start, length, sequence, offset = pieces.T
        # The ids of all pieces, one after the other, from the ids of all documents.
        ends = np.cumsum(length)
        first = (np.cumsum(sizes) - sizes)[document] + start
        data = np.concatenate([*ids, np.zeros(0, "<u4")])[np.arange(int(length.sum())) + np.repeat(first - ends + length, length)]
        cuts = pa.array(np.r_[0, 4 * ends], pa.int64())
        packed = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, cuts.buffers()[1], pa.py_buffer(data.tobytes())])
        rows = [pa.array(names, kind).take(pa.array(document))]
        rows += [pa.array(c) for c in (start, length, sizes[document], sequence + base, offset)]
        rows.append(packed.cast(pa.binary()))
        kept = sorted({p[0] for p in packer.left})
        place = {d: k for k, d in enumerate(kept)}
        ids[:], names[:] = [ids[d] for d in kept], [names[d] for d in kept]
        packer.left = [(place[d], a, n) for d, a, n in packer.left]
        return pa.RecordBatch.from_arrays(rows, names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    held = 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for name, found in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                ids.append(np.append(found, np.int32(end)).astype("<u4"))
                names.append(name)
                packer.add(len(ids) - 1, len(ids[-1]))
                held += len(ids[-1])
                if held >= block:
                    packer.pack_full()
                    yield flush()
                    held = sum(map(len, ids))
    if kind is not None:
        packer.pack_rest()
        yield flush()


@shipped
def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
    capacity: int = 2048, end: int = 1, linear: float = 1.0, quadratic: float = 1 / 1024, block_tokens: int = 1 << 20,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces ``id, start, length, doc_tokens, sequence_id, offset, ids`` (ids: little-endian unsigned 32-bit)."""
    path = tokenizer or default_tokenizer()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = dict(plain.dtypes)["id"]
    return plain.mapInArrow(
        lambda batches: _packed(batches, path, capacity, linear, quadratic, end, block_tokens, remembered),
        f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
