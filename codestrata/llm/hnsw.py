"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Only vectors with equal label (and length) are compared, by cosine in double
precision. Equal vectors are one vertex with a count. Each label is cut by a hash
into shards of about ``shard_rows`` vertices; one task builds the graph of a shard:
vertices enter in batches, get exponentially distributed levels, search their
neighbours from the top layer down and keep diverse ones. Then every block of
vertices of a label queries every shard of it. A query widens its beam as long as
its last entry is still a link, and a block widens all beams until an audit against
a full scan of the shard for a few of its queries passes: ``recall`` of their links and
``near_recall`` of their ten nearest vertices, links or not, so there is always something
to find. Where beams as wide as the shard do not pass, the block scans the shard. So there
is no cap on the number of links. Found pairs are verified in double precision and united by
``components.connected``.

Shards and query blocks bound every task; both sides of the block-shard join are
dealt by label, shard and part, so a label with many rows is many tasks.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing and is its own component; so
does a row without id, whose component and kept are null; repeated rows count as
other vectors; rows that share an id are one vertex of the component graph; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import materialize
from .components import connected
from .ship import shipped

NONE = -1


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    shard_rows: int = 8192
    block_rows: int = 1024
    part_blocks: int = 2
    degree: int = 16
    build_beam: int = 64
    beam: int = 64
    audits: int = 32
    recall: float = 0.995
    near: int = 10
    near_recall: float = 0.9
    seed: int = 3


class Graph:
    """Layered graph over unit vectors (single precision)."""

    def __init__(self, vectors: np.ndarray, settings: Settings):
        self.settings = settings
        self.vectors = vectors
        n, m = len(vectors), settings.degree
        rng = np.random.default_rng(settings.seed)
        level = np.floor(-np.log(rng.random(n) + 1e-12) / np.log(m)).astype(int)
        if n:
            level[0] = level.max()  # the entry vertex
        self.links = [np.full((n, m if k else 2 * m), NONE, np.int32) for k in range(level.max() + 1 if n else 1)]
        done = min(1, n)
        while done < n:  # batches grow with the graph
            size = min(max(done // 4, 1), 256, n - done)
            self._insert(np.arange(done, done + size), level)
            done += size

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        entry = np.zeros((len(new), 1), np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            at = np.flatnonzero(level[new] >= layer)
            beam = self.settings.build_beam if len(at) else 1
            found, _ = self.search_layer(layer, self.vectors[new], entry, beam)
            entry = found[:, : max(1, beam // 8)]
            if not len(at):
                continue
            own = new[at]
            among = np.broadcast_to(own.astype(np.int32), (len(own), len(own)))
            if len(own) > beam:  # of the batch itself, the nearest
                close = np.argpartition(-(self.vectors[own] @ self.vectors[own].T), beam, axis=1)[:, : beam + 1]
                among = own[close].astype(np.int32)
            candidates = np.concatenate((found[at], np.where(among == own[:, None], NONE, among)), axis=1)
            chosen = self._diverse(own, candidates, self.settings.degree)
            self.links[layer][own, : chosen.shape[1]] = chosen
            self._link_back(layer, own, chosen)

    def _diverse(self, vertices: np.ndarray, candidates: np.ndarray, count: int) -> np.ndarray:
        """Up to ``count`` candidates each, those first that are closer to the vertex than to a chosen one."""
        out = np.full((len(vertices), count), NONE, np.int32)
        for low in range(0, len(vertices), 64):
            rows = slice(low, low + 64)
            c = candidates[rows]
            near = np.einsum("qd,qcd->qc", self.vectors[vertices[rows]], self.vectors[c])
            near[(c == NONE) | (c == vertices[rows, None])] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")[:, : 4 * count]
            c, near = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1)
            repeated = (c[:, :, None] == c[:, None, :]) & np.tri(c.shape[1], k=-1, dtype=bool)
            near[repeated.any(axis=2)] = -np.inf
            valid = near > -np.inf
            among = np.einsum("qcd,qed->qce", self.vectors[c], self.vectors[c])
            chosen = np.zeros(c.shape, bool)
            for k in range(c.shape[1]):
                blocked = (np.where(chosen, among[:, k], -np.inf) > near[:, k, None]).any(axis=1)
                chosen[:, k] = valid[:, k] & ~blocked & (chosen.sum(axis=1) < count)
            rank = np.where(chosen, 0, np.where(valid, 1, 2))  # then the nearest of the others
            order = np.argsort(rank, axis=1, kind="stable")[:, :count]
            picked = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(c, order, 1), NONE)
            out[rows, : picked.shape[1]] = picked
        return out

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[layer]
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target != NONE], target[target != NONE]
        near = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        some = rank < links.shape[1]  # more would not be chosen
        vertices = target[first]
        row = np.searchsorted(vertices, target[some])
        more = np.full((len(vertices), int(rank[some].max(initial=0)) + 1), NONE, np.int32)
        more[row, rank[some]] = source[some]
        links[vertices] = self._diverse(vertices, np.concatenate((links[vertices], more), axis=1), links.shape[1])

    def search_layer(self, layer: int, queries: np.ndarray, entry: np.ndarray, beam: int, step: int = 4):
        """The ``beam`` best vertices found per query and their similarities, best first."""
        links, n = self.links[layer], len(self.vectors)
        q = len(queries)
        rows = np.arange(q)[:, None]
        visited = np.zeros((q, n + 1), bool)  # the last column stands for no vertex
        visited[:, n] = True
        entry = np.where(entry == NONE, entry[:, :1], entry)
        entry = np.sort(entry, axis=1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = NONE
        visited[rows, entry] = True
        ids = np.full((q, beam), NONE, np.int32)
        near = np.full((q, beam), -np.inf, np.float32)
        opened = np.zeros((q, beam), bool)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        start = np.einsum("qd,qcd->qc", queries, self.vectors[ids[:, :width]])
        near[:, :width] = np.where(ids[:, :width] == NONE, -np.inf, start)
        while True:
            waiting = np.where(opened, -np.inf, near)
            take = np.argpartition(-waiting, min(step, beam) - 1, axis=1)[:, :step] if beam > step else np.argsort(-waiting, axis=1)
            real = np.take_along_axis(waiting, take, 1) > -np.inf
            active = np.flatnonzero(real.any(axis=1))
            if not len(active):
                break
            take, real = take[active], real[active]
            opened[active[:, None], take] |= real
            source = np.where(real, ids[active[:, None], take], NONE)
            found = np.where(source[:, :, None] == NONE, NONE, links[source]).reshape(len(active), -1)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = NONE
            found[visited[active[:, None], found]] = NONE
            visited[active[:, None], found] = True
            r, c = np.nonzero(found != NONE)
            score = np.full(found.shape, -np.inf, np.float32)
            score[r, c] = np.einsum("nd,nd->n", self.vectors[found[r, c]], queries[active[r]])
            all_near = np.concatenate((near[active], score), axis=1)
            keep = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near[active] = np.take_along_axis(all_near, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], found), axis=1), keep, 1)
            opened[active] = np.take_along_axis(np.concatenate((opened[active], np.zeros(found.shape, bool)), axis=1), keep, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        return np.where(near > -np.inf, ids, NONE), near

    def nearest(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Vertices that a beam ends with, nearest first."""
        entry = np.zeros((len(queries), 1), np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.search_layer(layer, queries, entry, 8)[0]
        return self.search_layer(0, queries, entry, min(beam, len(self.vectors)))[0]

    def links_of(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vertex) pairs of similarity ``least`` or more; full beams of links are widened."""
        n = len(self.vectors)
        out = []
        for low in range(0, len(queries), 256):
            todo, width = np.arange(low, min(low + 256, len(queries))), beam
            while len(todo):
                width = min(width, n)
                entry = np.zeros((len(todo), 1), np.int32)
                for layer in range(len(self.links) - 1, 0, -1):
                    entry = self.search_layer(layer, queries[todo], entry, 8)[0]
                ids, near = self.search_layer(0, queries[todo], entry, width)
                full = (near[:, -1] >= least) if width < n else np.zeros(len(todo), bool)
                r, c = np.nonzero((near >= least) & (ids != NONE) & ~full[:, None])
                out.append((todo[r], ids[r, c]))
                todo, width = todo[full], 2 * width
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def block_links(graph: Graph, ids: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
    """Verified pairs of ids, the beam that passed the audit (0: the shard was scanned), its recall."""
    s = graph.settings
    loose = s.threshold - 1e-4
    single = queries.astype(np.float32)
    sample = np.linspace(0, len(queries) - 1, min(s.audits, len(queries))).astype(int)
    scores = single[sample] @ graph.vectors.T
    true = set(map(tuple, np.argwhere(scores >= loose).tolist()))
    close = np.argsort(-scores, axis=1, kind="stable")[:, : s.near]
    # What is as near as the last of them may stand in its place.
    last = np.take_along_axis(scores, close[:, -1:], 1)
    beam, recall = s.beam, 0.0
    while True:
        a, b = graph.links_of(single, loose, beam)
        place = np.full(len(queries), NONE)
        place[sample] = np.arange(len(sample))
        hit = place[a] != NONE
        recall = len(true & set(zip(place[a[hit]].tolist(), b[hit].tolist(), strict=True))) / len(true) if true else 1.0
        seen = graph.nearest(single[sample], beam)
        as_near = (np.take_along_axis(scores, np.maximum(seen, 0), 1) >= last - 1e-6) & (seen != NONE)
        reached = np.minimum(as_near.sum(axis=1), close.shape[1]).sum() / max(close.size, 1)
        if recall >= s.recall and reached >= s.near_recall:
            break
        if beam >= len(ids):
            parts = [np.nonzero(single[k : k + 256] @ graph.vectors.T >= loose) for k in range(0, len(single), 256)]
            a = np.concatenate([r + 256 * k for k, (r, _) in enumerate(parts)])
            b = np.concatenate([c for _, c in parts])
            beam, recall = 0, 1.0
            break
        beam *= 2
    other = query_ids[a] != ids[b]
    a, b = a[other], b[other]
    keep = np.concatenate(
        [np.einsum("nd,nd->n", queries[a[k : k + 65536]], exact[b[k : k + 65536]]) >= s.threshold for k in range(0, len(a), 65536)]
        or [np.zeros(0, bool)]
    )
    return query_ids[a[keep]], ids[b[keep]], beam, recall


# --- distributed --------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _built(table: pa.Table, settings: Settings, graphs: bool) -> pa.Table:
    order = np.argsort(table["node"].to_numpy(), kind="stable")
    ids, raw = table["node"].to_numpy()[order], _matrix(table["vector"])[order]
    vectors = unit(raw)
    links = Graph(vectors.astype(np.float32), settings).links if graphs else None
    head = [table[c].slice(0, 1) for c in ("label", "dim", "shard")]
    return pa.table([*head, pa.array([pickle.dumps((ids, raw, links), protocol=5)], pa.binary())], names=["label", "dim", "shard", "data"])


def _queried(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block in zip(batch.column(0), batch.column(1), strict=True):
            ids, raw, links = pickle.loads(shard.as_py())
            query_ids, queries, _ = pickle.loads(block.as_py())
            exact = unit(raw)
            graph = Graph.__new__(Graph)
            graph.settings, graph.vectors, graph.links = settings, exact.astype(np.float32), links
            a, b, beam, recall = block_links(graph, ids, exact, query_ids, unit(queries))
            columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), beam, np.int32)), pa.array(np.full(len(a), recall))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "beam", "recall"])


def _vertices(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, DataFrame]:
    """All rows as id, label, vector (null if it cannot link); vertices: equal vectors with count and smallest id."""
    value = F.col(vector_column).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(value, lambda x: x != 0) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull()
    rows = vectors.select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.when(usable, F.col(vector_column)).alias("vector")
    )
    equal = rows.where("vector is not null").groupBy("label", "vector")
    return rows, equal.agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("vector"))


@shipped
def links(vertices: DataFrame, settings: Settings) -> DataFrame:
    """``a, b, beam, recall``: each linked pair of vertices once."""
    s = settings
    sizes = vertices.groupBy("label", "dim").agg(F.count("*").alias("n"))
    placed = vertices.join(sizes, ["label", "dim"]).select(
        "label", "dim", "node", "vector",
        F.ceil(F.col("n") / s.shard_rows).cast("int").alias("shards"), F.ceil(F.col("n") / s.block_rows).cast("int").alias("blocks"),
    )
    kinds = dict(vertices.dtypes)
    built = f"label {kinds['label']}, dim int, shard int, data binary"

    def gathered(count: str, seed: int, graphs: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(count)).cast("int").alias("shard")
        groups = placed.select("label", "dim", "node", "vector", own).groupBy("label", "dim", "shard")
        return groups.applyInArrow(lambda table: _built(table, s, graphs), built)

    parts = F.ceil(F.col("n") / (s.block_rows * s.part_blocks)).cast("int")
    shards = materialize(gathered("shards", 1, True), "shards").join(sizes, ["label", "dim"])
    shards = shards.select("label", "dim", "shard", "data", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    blocks = materialize(gathered("blocks", 2, False), "blocks").join(sizes, ["label", "dim"])
    every = F.sequence(F.lit(0), F.ceil(F.col("n") / s.shard_rows).cast("int") - 1)
    blocks = blocks.select(
        "label", "dim", F.pmod(F.col("shard"), parts).alias("part"), F.col("data").alias("queries"), F.explode(every).alias("shard")
    )
    met = shards.join(blocks.hint("shuffle_hash"), ["label", "dim", "shard", "part"]).select("data", "queries")
    found = met.mapInArrow(lambda batches: _queried(batches, s), "a long, b long, beam int, recall double")
    return found.groupBy("a", "b").agg(F.max("beam").alias("beam"), F.min("recall").alias("recall"))


@shipped
def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    settings: Settings | None = None,
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row."""
    rows, vertices = _vertices(vectors, id_column, vector_column, label_column)
    vertices = materialize(vertices, "vertices")
    pairs = materialize(links(vertices, settings or Settings()).select("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = vertices.select(F.col("node").alias("b"), "copies")
    counted = both.join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    reached = connected(pairs)
    classes = (
        vertices.join(counted, "node", "left").join(reached, "node", "left")
        .select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    joined = rows.join(classes, ["label", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
