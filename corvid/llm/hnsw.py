"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of their ids. Each shard's
graph is built by one task and kept as flat arrays: a row of neighbours per node
for the bottom layer, and one per node and layer above it. Queries visit every
shard in blocks, and the shards' results are merged by rank.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.llm.frames import release, tidy
from corvid.llm.textbytes import mix
from corvid.sources.tables import materialize, table

#: Rows of a shard, about, and bytes of its vectors at most.
SHARD_ROWS = 1 << 12
SHARD_BYTES = 1 << 24
#: Neighbours of a node in the upper layers; the bottom one has twice as many.
LINKS = 16
#: Nodes that a search holds while the graph is built, and for a query.
EF_BUILD, EF_SEARCH = 64, 96
#: Queries that meet a shard in one task.
QUERY_BLOCK = 1 << 13

INDEX = "dim int, shard int, vec_ids binary, node_ends binary, vectors binary, base binary, upper binary, upper_at binary, entry int, top int"


def levels(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Each node's top layer, by a hash of its id: a layer has one in `links` of the nodes below it."""
    share = (mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(share, 2.0**-53)) / np.log(links)).astype(np.int64)


class Graph:
    """Nodes with unit vectors, and their neighbours in flat arrays (-1: none)."""

    def __init__(self, unit: np.ndarray, upper_at: np.ndarray, base: np.ndarray, upper: np.ndarray, entry: int, top: int):
        self.unit, self.upper_at, self.base, self.upper, self.entry, self.top = unit, upper_at, base, upper, entry, top
        self.base_n, self.upper_n = (base >= 0).sum(1), (upper >= 0).sum(1)
        self.seen, self.turn = np.zeros(len(unit), np.int32), 0

    def place(self, node: int, layer: int) -> tuple[np.ndarray, np.ndarray, int]:
        return (self.base, self.base_n, node) if layer == 0 else (self.upper, self.upper_n, self.upper_at[node] + layer - 1)

    def search(self, q: np.ndarray, starts: list, ef: int, layer: int) -> list:
        """The `ef` nodes (nearness, node) next to `q` that a best-first walk from `starts` finds, nearest first."""
        self.turn += 1
        seen, turn, unit = self.seen, self.turn, self.unit
        links, counts, at = (self.base, self.base_n, None) if layer == 0 else (self.upper, self.upper_n, self.upper_at)
        todo, best = [(-s, n) for s, n in starts], list(starts)
        heapq.heapify(todo)
        heapq.heapify(best)
        for _, n in starts:
            seen[n] = turn
        while todo:
            far, node = heapq.heappop(todo)
            if len(best) >= ef and -far < best[0][0]:
                break
            row = node if at is None else at[node] + layer - 1
            near = links[row, : counts[row]]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            sims = unit[near] @ q
            if len(best) >= ef:
                closer = sims > best[0][0]
                sims, near = sims[closer], near[closer]
            for s, n in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                else:
                    continue
                heapq.heappush(todo, (-s, n))
        return sorted(best, reverse=True)

    def descend(self, q: np.ndarray, down_to: int) -> list:
        """The node where a search of layer `down_to` starts."""
        found = [(float(self.unit[self.entry] @ q), self.entry)]
        for layer in range(self.top, down_to, -1):
            found = self.search(q, found, 1, layer)
        return found

    def choose(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """`most` of `nodes` (nearest first): first those nearer to the new node than to any chosen one, then the nearest of the rest."""
        if len(nodes) <= most:
            return nodes
        vectors = self.unit[nodes]
        open, out = np.ones(len(nodes), bool), []
        for k in range(len(nodes)):
            if open[k]:
                out.append(k)
                if len(out) == most:
                    return nodes[out]
                open &= vectors @ vectors[k] <= sims
        rest = np.ones(len(nodes), bool)
        rest[out] = False
        return nodes[np.concatenate([out, np.flatnonzero(rest)[: most - len(out)]]).astype(np.int64)]

    def link(self, node: int, new: int, layer: int) -> None:
        """Adds `new` to the neighbours of `node`; a full row is chosen anew."""
        links, counts, row = self.place(node, layer)
        n, width = counts[row], links.shape[1]
        if n < width:
            links[row, n], counts[row] = new, n + 1
            return
        every = np.append(links[row], np.int32(new))
        sims = self.unit[every] @ self.unit[node]
        order = np.argsort(-sims, kind="stable")
        links[row] = self.choose(every[order], sims[order], width)

    def insert(self, node: int, level: int, ef: int) -> None:
        q = self.unit[node]
        found = self.descend(q, level)
        for layer in range(min(self.top, level), -1, -1):
            found = self.search(q, found, ef, layer)
            near = np.array([n for _, n in found], np.int32)
            links, counts, row = self.place(node, layer)
            chosen = self.choose(near, np.array([s for s, _ in found], np.float32), self.upper.shape[1])
            links[row, : len(chosen)], counts[row] = chosen, len(chosen)
            for n in chosen.tolist():
                self.link(n, node, layer)
        if level > self.top:
            self.entry, self.top = node, level


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).astype(np.float32)


def build(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """The graph of one shard in flat arrays; equal vectors are one node, which holds their ids in order."""
    every, node = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    ids, node = ids[order], node.ravel()[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (node[1:] == node[:-1])
    ids, node = ids[~again], node[~again]
    begins = np.searchsorted(node, np.arange(len(every)))
    # Nodes in the order of a hash of their first ids, so that no order of the table shows in the graph.
    deal = np.argsort(mix(ids[begins].astype(np.uint64)), kind="stable")
    sizes = np.diff(np.append(begins, len(ids)))[deal]
    ids = ids[np.repeat(begins[deal] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))]
    every, ends = every[deal], np.cumsum(sizes)
    level = levels(ids[ends - sizes])
    at = np.where(level > 0, np.cumsum(level) - level, -1)
    graph = Graph(unit_vectors(every), at, np.full((len(every), 2 * LINKS), -1, np.int32), np.full((int(level.sum()), LINKS), -1, np.int32), 0, int(level[0]))
    for n in range(1, len(every)):
        graph.insert(n, int(level[n]), EF_BUILD)
    return {"vec_ids": ids, "node_ends": ends, "vectors": every, "base": graph.base, "upper": graph.upper, "upper_at": at, "entry": graph.entry, "top": graph.top}


def nearest(index: dict, queries: np.ndarray, own: np.ndarray, k: int, ef: int) -> list[list[tuple[float, int]]]:
    """For each query the `k` nearest (cosine, id) found, but rows of its own id; all if the shard has fewer.

    Walks take `ef` nodes. Cosines are worked out anew in double precision, each
    row's by itself, so equal vectors have equal ones.
    """
    ids, ends, vectors = index["vec_ids"], index["node_ends"], index["vectors"]
    graph = Graph(unit_vectors(vectors), index["upper_at"], index["base"], index["upper"], index["entry"], index["top"])
    norms = np.sqrt((vectors * vectors).sum(1))
    out = []
    for q, me in zip(queries, own.tolist(), strict=True):
        size = np.sqrt((q * q).sum())
        walk = (q / size).astype(np.float32)

        def top(nodes, q=q, me=me, size=size):
            scores = (vectors[nodes] * q).sum(1) / (norms[nodes] * size)
            found = []
            for s, n in zip(scores.tolist(), nodes.tolist(), strict=True):
                found += [(-s, i) for i in ids[ends[n - 1] if n else 0 : ends[n]][: k + 1].tolist() if i != me]
            return sorted(found)[:k]

        found = top(np.array([n for _, n in graph.search(walk, graph.descend(walk, 0), max(ef, k + 1), 0)]))
        if len(found) < k:
            found = top(np.arange(len(vectors)))  # a shard of few rows, or a node that no walk reaches: look at all
        out.append([(-s, i) for s, i in found])
    return out


KINDS = {"vec_ids": np.int64, "node_ends": np.int64, "vectors": np.float64, "base": np.int32, "upper": np.int32, "upper_at": np.int64}


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that can take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.select(F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, shards: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per length of vectors and shard, with its graph in flat arrays."""
    dealt = usable(rows, id, vector).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def one(batches):
        held = [b for b in batches if b.num_rows]
        dims = sorted({d for b in held for d in b.column(2).to_pylist()})
        for dim in dims:
            t = pa.Table.from_batches(held)
            own = t.filter(pc.equal(t["dim"], dim))
            vectors = np.asarray(own["v"].combine_chunks().flatten(), np.float64).reshape(own.num_rows, dim)
            index = build(np.asarray(own["vec_id"], np.int64), vectors)
            row = {"dim": dim, "shard": own["shard"][0].as_py()} | {k: np.ascontiguousarray(index[k], kind).tobytes() for k, kind in KINDS.items()} | {"entry": index["entry"], "top": index["top"]}
            ints = ("dim", "shard", "entry", "top")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k in ints else pa.binary()) for k, x in row.items()], names=list(row))

    # A task for each shard, however few bytes it has.
    return dealt.repartitionById(shards, "shard").mapInArrow(tidy(one), INDEX)


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, blocks: int = 1, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` nearest that its shards find."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable(queries, id, vector).dropDuplicates(["vec_id", "v"]).withColumn("which", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "which"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    held = index.withColumn("block", each(blocks))
    out = pa.schema([("query_id", pa.int64()), ("which", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(key, shard, asked):
        if not shard.num_rows or not asked.num_rows:
            return out.empty_table()
        dim = key[0].as_py()
        index = {k: np.frombuffer(shard[k][0].as_py(), kind) for k, kind in KINDS.items()} | {k: shard[k][0].as_py() for k in ("entry", "top")}
        index |= {"vectors": index["vectors"].reshape(-1, dim), "base": index["base"].reshape(-1, 2 * LINKS), "upper": index["upper"].reshape(-1, LINKS)}
        own, which = np.asarray(asked["vec_id"], np.int64), np.asarray(asked["which"], np.int64)
        found = nearest(index, np.asarray(asked["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim), own, k, ef)
        n = [len(f) for f in found]
        release()
        return pa.table([np.repeat(own, n), np.repeat(which, n), pa.array([i for f in found for _, i in f], pa.int64()), pa.array([s for f in found for s, _ in f], pa.float64())], schema=out)

    keys = ["dim", "shard", "block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, which long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest rows found for each query, by cosine, ties to the smaller id.

    Rows of a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component take no part, as queries or candidates. Candidates have
    the query's number of components and another id; if there are fewer than `k`,
    all are returned. Rows of one id and vector count once; one id with several
    vectors is a query for each. An empty table gives an empty one. Other columns
    are not read, whatever their names.
    """
    some = usable(rows, id, vector).agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    asked = queries.count()
    size = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (some.dim or 1))))
    shards = max(1, -(-some.n // size))
    index = materialize(build_index(rows, shards, id, vector))
    return search_index(index, shards, queries, k, ef, max(1, -(-asked // QUERY_BLOCK)), id, vector)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for each of the embeddings whose id 50 divides."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"))
