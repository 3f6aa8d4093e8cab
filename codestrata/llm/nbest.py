"""N-best SentencePiece segmentation and decoding.

A text is a lattice of pieces. Forward Viterbi scores give, for every place, the
best way to it; they are exact heuristics for an A-star search that walks back from
the end, so hypotheses leave the agenda in order of their total score and the first
``n`` that reach the start are the n best. Scores are those of the model file;
characters without a piece cost ten less than its lowest ordinary score and are
written as bytes.

No piece of a vocabulary crosses certain boundaries (checked when the model is
loaded), so the lattice of a text is a chain of small ones. Each is solved once and
remembered by its best score, its second best score and the best pieces; of at most
``remembered`` of them, those not asked for lately are forgotten. Only the n - 1 links of the chain whose second way costs least
can differ from their best within the n best of the text; for those the search runs,
and their ways are merged. The order among equal scores is fixed by the text.

Texts are narrow work: one Arrow function per batch, no shuffle; a segmentation may be
decoded in the task that made it. The model file is named by a parameter and has to be
at that path on every executor.

Defined results: a null or empty text has one segmentation without pieces; like the
library, decoding turns the block sign U+2581 of a text into a blank; very long
words are not remembered; equal rows get equal results; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import shipped

BLANK = "▁"
FINE = re.compile(f"{BLANK}*(?:[^\\W\\d_²³¹º¼-¾]+|(?:[^\\w{BLANK}\n]|[\\d_²³¹º¼-¾])+)|{BLANK}+|\n")
COARSE = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Lines and blanks cut a text into these; fine units cut them further.
WIDE = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Way(NamedTuple):
    """One segmentation: its score and its piece ids as little-endian unsigned 32-bit integers."""

    score: float
    data: bytes

    @property
    def ids(self) -> tuple[int, ...]:
        return tuple(np.frombuffer(self.data, "<u4").tolist())


#: The best way through a small lattice and what the second one costs more: score, ids, cost.
#: Plain tuples of plain values; the garbage collector does not go through the many remembered ones.
Best = tuple[float, bytes, float]
SCORE, IDS, COST = map(itemgetter, range(3))


class Memory(dict):
    """What was made for a unit; of about ``most`` the half that was not asked for lately is forgotten."""

    def __init__(self, make: Callable, most: int):
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, unit: str):
        found = self.older.get(unit)
        if found is None:
            found = self.make(unit)
        if len(unit) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


class Lattice:
    """Pieces of one model and the n best ways through texts."""

    def __init__(self, path: str, n: int = 4, remembered: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        normal = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_unknown(i) or m.is_control(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in normal}
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.penalty = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - 10
        self.packed = {p: (s, i.to_bytes(4, "little")) for p, (i, s) in self.pieces.items()}
        #: Every beginning of a piece, with score and id if it is one itself.
        self.openings = {p[:k]: self.packed.get(p[:k]) for p in self.pieces for k in range(1, len(p) + 1)}
        self.longest = max(map(len, self.pieces), default=1)
        self.units = FINE if all(FINE.findall(p) == [p] for p in self.pieces) else COARSE
        #: Pieces by their signs: the lookup of what follows, score and id if the beginning is a piece itself.
        #: A first sign that is no piece stands for its bytes.
        trie: dict = {}
        for piece, (score, data) in self.packed.items():
            node, children = None, trie
            for sign in piece:
                if node is not None:
                    node[0] = node[0] or {}.get
                    children = node[0].__self__
                node = children.setdefault(sign, [None, None, None])
            node[1:] = score, data
        for sign, node in trie.items():
            if node[2] is None:
                node[1:] = self._unknown(sign)
        self.trie = trie.get
        #: What an id stands for by itself, as UTF-8: pieces and ASCII bytes; others (length 0) depend on their neighbours.
        signs = {i: p.replace(BLANK, " ") for p, (i, _) in self.pieces.items()} | {i: chr(b) for b, i in self.bytes.items() if b < 128}
        signs = [signs.get(i, "").encode() for i in range(m.get_piece_size())]
        self.lengths = np.array([len(x) for x in signs])
        self.starts, self.signs = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(signs), np.uint8)
        self.n = n
        self.known, self.solved = Memory(self.best, remembered), Memory(self.solve, remembered // 8)
        self.joined = Memory(self._join, remembered)

    # --- one small lattice

    def _unknown(self, sign: str) -> tuple[float, bytes]:
        ids = [self.bytes[b] for b in sign.encode()] if len(self.bytes) == 256 else [self.unknown]
        return self.penalty, np.array(ids, "<u4").tobytes()

    def _edges(self, text: str) -> list[list[tuple[int, float, bytes]]]:
        """For every end, the pieces that stop there: start, score, id."""
        out: list[list[tuple[int, float, bytes]]] = [[] for _ in range(len(text) + 1)]
        for start in range(len(text)):
            if text[start] not in self.packed:
                out[start + 1].append((start, *self._unknown(text[start])))
            for end in range(start + 1, min(len(text), start + self.longest) + 1):
                part = text[start:end]
                if part not in self.openings:
                    break
                if part in self.packed:
                    out[end].append((start, *self.packed[part]))
        return out

    def best(self, text: str) -> Best:
        """Forward pass for the two best scores of every place, and the best way back."""
        low = float("-inf")
        size = len(text)
        first, second = [0.0] + [low] * size, [low] * (size + 1)
        back, by = [0] * (size + 1), [b""] * (size + 1)
        root = self.trie
        for start in range(size):
            one, two = first[start], second[start]
            further, end = root, start
            for sign in text[start : start + self.longest]:
                node = further(sign)
                if node is None:
                    if end > start:
                        break
                    node = (None, *self._unknown(sign))
                further, score, data = node
                end += 1
                if data is not None:
                    total, other, best = one + score, two + score, first[end]
                    if total > best:
                        first[end] = total
                        back[end] = start
                        by[end] = data
                        total = best
                    if total > other:
                        other = total
                    if other > second[end]:
                        second[end] = other
                if further is None:
                    break
        out, place = [], size
        while place:
            out.append(by[place])
            place = back[place]
        return first[size], b"".join(out[::-1]), first[size] - second[size]

    def solve(self, text: str) -> list[Way]:
        """The n best ways, best first: A-star search from the end."""
        edges = self._edges(text)
        forward = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            forward[end] = max(forward[start] + score for start, score, _ in edges[end])
        # agenda: -(forward + backward score), place, ids from there on, backward score
        agenda: list[tuple[float, int, bytes, float]] = [(-forward[-1], len(text), b"", 0.0)]
        ways: list[Way] = []
        while agenda and len(ways) < self.n:
            _, place, ids, behind = heapq.heappop(agenda)
            if place == 0:
                ways.append(Way(behind, ids))
                continue
            for start, score, own in edges[place]:
                heapq.heappush(agenda, (-(forward[start] + behind + score), start, own + ids, behind + score))
        return ways

    # --- texts

    def _join(self, unit: str) -> Best:
        """Best way through several small lattices; the second one differs in the link where that costs least."""
        parts = [self.known[u] for u in FINE.findall(unit)]
        if len(parts) == 1:
            return parts[0]
        scores, data, more = zip(*parts, strict=True)
        return sum(scores), b"".join(data), min(more)

    def _split(self, text: str) -> list[str]:
        """Wide units of a text."""
        if "  " in text or BLANK in text or text[0] == " ":
            return WIDE.findall(BLANK + text.replace(" ", BLANK))
        out: list[str] = []
        for k, line in enumerate((BLANK + text.replace(" ", " " + BLANK)).split("\n")):
            if k:
                out.append("\n")
            if line:
                out += line.removeprefix(" ").split(" ")
        return out

    def ways(self, text: str | None) -> list[Way]:
        """The n best segmentations of a whole text."""
        if not text:
            return [Way(0.0, b"")]
        if self.units is FINE:
            units = self._split(text)
            parts = list(map(self.joined.__getitem__, units))
        else:
            units = self.units.findall(BLANK + text.replace(" ", BLANK))
            parts = list(map(self.known.__getitem__, units))
        data = list(map(IDS, parts))
        total = sum(map(SCORE, parts))
        more = np.fromiter(map(COST, parts), float, len(parts))
        several = np.arange(len(parts))
        if len(parts) >= self.n:
            several = np.flatnonzero(more <= np.partition(more, self.n - 2)[self.n - 2]) if self.n > 1 else several[:0]
        several = several[np.argsort(more[several], kind="stable")][: self.n - 1]
        merged: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        lists = {k: self.solved[units[k]] for k in sorted(several.tolist())}
        for k, ways in lists.items():
            lost = [(ways[0].score - w.score, j) for j, w in enumerate(ways)]
            merged = sorted((a + b, (*choice, (k, j))) for a, choice in merged for b, j in lost)[: self.n]
        # Ways differ in few places from the best one.
        whole = b"".join(data)
        ends = {k: len(b"".join(data[:k])) for k in lists}
        out = []
        for less, choice in merged:
            at, changed = 0, []
            for k, j in choice:
                if j:
                    changed += [whole[at : ends[k]], lists[k][j].data]
                    at = ends[k] + len(data[k])
            out.append(Way(total - less, b"".join([*changed, whole[at:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Signs of the ids one after the other; texts with parts of a character go to the library."""
        sizes = self.lengths[ids]
        if not sizes.all():
            return self.model.decode(ids.tolist())
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        text = self.signs[at].tobytes().decode()
        return text[1:] if text.startswith(" ") else text


_LATTICES: dict[tuple[str, int], Lattice] = {}


def lattice_of(path: str, n: int) -> Lattice:
    if (path, n) not in _LATTICES:
        _LATTICES[path, n] = Lattice(path, n)
    return _LATTICES[path, n]


def _decoded(lattice: Lattice, data: bytes) -> str:
    return lattice.decode(np.frombuffer(data, "<u4"))


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without cyclic garbage collection: nothing here is cyclic, and a collection goes through all that is remembered."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


@_uncollected()
def _segments_of(lattice: Lattice, part: pa.RecordBatch, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Segmentations of some texts, decoded if ``types`` has ``text``."""
    rows: list[tuple] = []
    for row, text in enumerate(part.column(1).to_pylist()):
        for rank, way in enumerate(lattice.ways(text), 1):
            decoded = [_decoded(lattice, way.data)] if "text" in types else []
            rows.append((row, rank, way.score, len(way.data) // 4, way.data, *decoded))
    columns = dict(zip(("row", *types), zip(*rows, strict=True), strict=True))
    names = part.column(0).take(pa.array(columns["row"], pa.int64()))
    return pa.RecordBatch.from_arrays([names, *(pa.array(columns[k], t) for k, t in types.items())], names=["id", *types])


def _segmented(batches: Iterator[pa.RecordBatch], path: str, n: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    lattice = lattice_of(path, n)
    types = {"rank": pa.int64(), "score": pa.float64(), "n_pieces": pa.int64(), "ids": pa.binary()} | ({"text": pa.string()} if decoded else {})
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            yield _segments_of(lattice, batch.slice(at, 32), types)


@shipped
def encode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None, n: int = 4, decoded: bool = False
) -> DataFrame:
    """``id, rank, score, n_pieces, ids`` (little-endian unsigned 32-bit): up to n rows per text; with ``decoded`` also ``text``, what the ids stand for."""
    path = model or default_model()
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = dict(plain.dtypes)["id"]
    more = ", text string" if decoded else ""
    return plain.mapInArrow(lambda b: _segmented(b, path, n, decoded), f"id {kind}, rank long, score double, n_pieces long, ids binary{more}")


@shipped
def decode(encoded: DataFrame, ids_column: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with the decoded text."""
    path = model or default_model()

    def run(packed: pa.Array) -> pa.Array:
        lattice = lattice_of(path, 1)
        return pa.array([None if v is None else _decoded(lattice, v) for v in packed.to_pylist()], pa.string())

    kept = [c for c in encoded.columns if c != "text"]
    return encoded.select(*kept, F.arrow_udf(run, "string")(ids_column).alias("text"))
