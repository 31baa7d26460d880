"""Nearest neighbours by cosine with a navigable small-world graph per shard.

Distinct vectors are dealt into shards of bounded size; each shard's graph is
built in one task and stored as flat arrays (for every level the nodes and a
row of neighbours each).  Blocks of queries search every shard, the results
are scored exactly on the original vectors in double precision and merged.

Scale: a graph never grows with the table, only the number of graphs does;
building is linear in the rows.  Every row is in the index through its vector.

Cases: rows without a vec_id, null vectors, zero vectors and vectors with a null
or non-finite component take no part; shorter vectors are filled up with zeros;
rows equal in id and vector count once, and a row with the query's id is the
query's own; ties go to the smaller vec_id; an empty table gives no rows; a lone
vector has no neighbours and gives none; other columns are not read.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import vectors
from .common import written

#: Rows of a shard, links per node (twice as many on the ground level), list lengths of build and search.
SHARD, LINKS, BUILD, SEARCH = 4096, 16, 64, 80


class Graph:
    """A hierarchical navigable small world over unit vectors (rows of float32)."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 7):
        self.unit, self.links, self.build = np.ascontiguousarray(unit, np.float32), links, build
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(links)).astype(int)
        self.top = int(self.level.max()) if n else -1
        self.near = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(self.top + 1)]
        self.entry, self.reach = -1, -1
        for i in range(n):
            self._insert(i)

    def _walk(self, q: np.ndarray, entry: int, near: np.ndarray) -> int:
        """The node a greedy walk ends at."""
        at, best = entry, float(self.unit[entry] @ q)
        while True:
            out = near[at]
            out = out[out >= 0]
            if not len(out):
                return at
            sims = self.unit[out] @ q
            j = int(sims.argmax())
            if sims[j] <= best:
                return at
            at, best = int(out[j]), float(sims[j])

    def _beam(self, q: np.ndarray, entry: int, near: np.ndarray, width: int) -> list[tuple[float, int]]:
        """Up to ``width`` nodes found near q, as (similarity, node)."""
        seen = np.zeros(len(self.unit), bool)
        seen[entry] = True
        s = float(self.unit[entry] @ q)
        todo, kept = [(-s, entry)], [(s, entry)]
        push, pop, swap = heapq.heappush, heapq.heappop, heapq.heapreplace
        while todo:
            s, at = pop(todo)
            if -s < kept[0][0] and len(kept) >= width:
                break
            out = near[at]
            out = out[out >= 0]
            out = out[~seen[out]]
            if not len(out):
                continue
            seen[out] = True
            sims = self.unit[out] @ q
            if len(kept) >= width:
                good = sims > kept[0][0]
                out, sims = out[good], sims[good]
            for s, j in zip(sims.tolist(), out.tolist()):
                if len(kept) < width:
                    push(kept, (s, j))
                    push(todo, (-s, j))
                elif s > kept[0][0]:
                    swap(kept, (s, j))
                    push(todo, (-s, j))
        return kept

    def _spread(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the nodes, each nearer to the centre than to those taken before it."""
        order = np.argsort(-sims, kind="stable")
        nodes, sims = nodes[order], sims[order]
        if len(nodes) <= most:
            return nodes
        among = self.unit[nodes] @ self.unit[nodes].T
        closest = np.full(len(nodes), -2.0, np.float32)  # to any node taken
        taken = []
        for j in range(len(nodes)):
            if closest[j] < sims[j]:
                taken.append(j)
                if len(taken) == most:
                    break
                np.maximum(closest, among[j], out=closest)
        if len(taken) < most:  # then the nearest of those left
            left = np.ones(len(nodes), bool)
            left[taken] = False
            taken += np.flatnonzero(left)[:most - len(taken)].tolist()
        return nodes[taken]

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry, self.reach = i, int(self.level[i])
            return
        q, at = self.unit[i], self.entry
        for k in range(self.reach, int(self.level[i]), -1):
            at = self._walk(q, at, self.near[k])
        for k in range(min(self.reach, int(self.level[i])), -1, -1):
            near = self.near[k]
            found = self._beam(q, at, near, self.build)
            sims, nodes = np.array([f[0] for f in found], np.float32), np.array([f[1] for f in found], np.int64)
            chosen = self._spread(nodes, sims, self.links)
            near[i, :len(chosen)] = chosen
            for j in chosen.tolist():
                row = near[j]
                free = int((row >= 0).sum())
                if free < len(row):
                    row[free] = i
                else:
                    both = np.append(row, i).astype(np.int64)
                    row[:] = self._spread(both, self.unit[both] @ self.unit[j], len(row))
            at = int(nodes[sims.argmax()])
        if self.level[i] > self.reach:
            self.entry, self.reach = i, int(self.level[i])

    def search(self, q: np.ndarray, width: int = SEARCH) -> np.ndarray:
        """Nodes found near a unit vector, the nearest first."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        q, at = q.astype(np.float32), self.entry
        for k in range(self.reach, 0, -1):
            at = self._walk(q, at, self.near[k])
        found = sorted(self._beam(q, at, self.near[0], width), reverse=True)
        return np.array([f[1] for f in found], np.int64)

    def flat(self) -> dict[str, bytes]:
        """The graph as flat arrays: per level its nodes, then their neighbours."""
        nodes = [np.flatnonzero(self.level >= k).astype(np.int32) for k in range(self.top + 1)]
        head = np.array([self.entry, self.reach, self.links, *map(len, nodes)], np.int32)
        body = [x for k, own in enumerate(nodes) for x in (own, self.near[k][own].ravel())]
        return {"head": head.tobytes(), "graph": np.concatenate([*body, np.zeros(0, np.int32)]).astype(np.int32).tobytes()}

    @classmethod
    def of(cls, unit: np.ndarray, head: bytes, graph: bytes) -> "Graph":
        """A graph from its flat arrays."""
        self = cls.__new__(cls)
        h, body, at = np.frombuffer(head, np.int32), np.frombuffer(graph, np.int32), 0
        self.unit, self.entry, self.reach, self.links = unit.astype(np.float32), int(h[0]), int(h[1]), int(h[2])
        self.near = []
        for k, n in enumerate(h[3:].tolist()):
            wide = 2 * self.links if k == 0 else self.links
            rows = np.full((len(unit), wide), -1, np.int32)
            rows[body[at:at + n]] = body[at + n:at + n + n * wide].reshape(n, wide)
            at += n + n * wide
            self.near.append(rows)
        return self


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def index(held: DataFrame) -> DataFrame:
    """(shard, n, width, vectors, ids, counts, head, graph): one row per shard of (shard, v, ids)."""
    def build(rows: pa.Table) -> pa.Table:
        x = vectors.matrix(rows.column("v").combine_chunks())
        ids = rows.column("ids").combine_chunks()
        order = np.lexsort(x.T[::-1])  # the graph does not depend on how rows arrive
        x, ids = x[order], ids.take(pa.array(order))
        flat = Graph(units(x)).flat()
        made = {"shard": [rows.column("shard")[0].as_py()], "n": [len(x)], "width": [x.shape[1]],
                "vectors": [x.astype("<f8").tobytes()],
                "ids": [np.asarray(ids.flatten(), "<i8").tobytes()],
                "counts": [np.asarray(pc.list_value_length(ids), "<i4").tobytes()], **{k: [v] for k, v in flat.items()}}
        return pa.table(made, schema=pa.schema(
            [("shard", pa.int32()), ("n", pa.int32()), ("width", pa.int32()),
             *((c, pa.binary()) for c in ("vectors", "ids", "counts", "head", "graph"))]))

    return held.groupBy("shard").applyInArrow(
        build, "shard int, n int, width int, vectors binary, ids binary, counts binary, head binary, graph binary")


def _search(k: int, width: int):
    def load(row: dict):
        x = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(row["n"].as_py(), row["width"].as_py())
        ids = np.frombuffer(row["ids"].as_py(), "<i8")
        ends = np.cumsum(np.frombuffer(row["counts"].as_py(), "<i4"))
        graph = Graph.of(units(x), row["head"].as_py(), row["graph"].as_py())
        norms = np.sqrt((x * x).sum(axis=1))
        return lambda queries: run(x, ids, ends, graph, norms, queries)

    def run(x, ids, ends, graph, norms, queries: np.ndarray):
        pos, out, score = [], [], []
        for i, (q, u) in enumerate(zip(queries, units(queries))):
            near = graph.search(u, width)[:4 * (k + 1)]
            exact = (x[near] @ q) / (norms[near] * np.sqrt(q @ q))
            left = k + 1
            listed = []
            for j in np.argsort(-exact, kind="stable").tolist():
                mine = ids[ends[near[j] - 1] if near[j] else 0:ends[near[j]]]
                listed += [(-exact[j], int(v)) for v in mine]
                left -= len(mine)
                if left <= 0 and (len(listed) > 4 * (k + 1)):
                    break
            for s, v in sorted(listed)[:k + 1]:
                pos.append(i)
                out.append(v)
                score.append(-s)
        return np.array(pos, np.int32), np.array(out, np.int64), np.array(score, np.float64)
    return load


def neighbours(embeddings: DataFrame, is_query, k: int = 5, shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) for which ``is_query`` holds."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & vectors.finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = vectors.padded(rows)
    held, n = vectors.shards(written(vectors.classes(rows, k), "vector-classes"), shard)
    graphs = written(index(held), "vector-graphs")
    queries = rows.where(is_query)
    blocks = vectors.query_blocks(queries)
    found = vectors.searched(blocks, graphs, n, "double", _search(k, width))
    return vectors.ranked(found, blocks, queries, k)
