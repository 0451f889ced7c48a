"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Equal vectors are one node. Nodes are dealt to bands of lengths within the factor ``BAND``, since a graph
over very unequal lengths is hard to walk, and by hash to shards of about ``SHARD_ROWS`` of a band; a task
builds the graph of one shard: nodes enter in batches, a greedy beam search from the ``STARTS``
longest nodes proposes neighbours, and pruning keeps a neighbour only if no kept one is closer to it
by the factor ``ALPHA``; links back are pruned alike. Inner products are brought to distances by one
more component that gives all nodes of a shard the same length.

The task then asks its graph for the ``k`` nearest of ``TRIALS`` nodes drawn at random, and doubles
the beam from ``BEAM`` on until ``RECALL`` of what brute force finds for them is found; a beam as wide
as the shard is brute force. The graphs and their beams are written to the shared folder. Query
vectors, in blocks of ``BLOCK_ROWS``, search every shard; what a beam holds is scored again in double
precision on the original vectors, and the shards' best are merged.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; nor do rows without an id. Vectors meet only vectors of their length.
A row that repeats another's id, vector or both is a candidate and a query of its own; equal scores
go by the smaller id. A table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.llm.common import small
from sitesight.workspace import keep

SHARD_ROWS, BLOCK_ROWS = 8192, 16384
DEGREE, ROOM, BEAM_BUILD, BEAM, ALPHA = 24, 48, 64, 128, 1.2
BATCH = 512
STARTS, TRIALS, RECALL, BAND = 16, 100, 0.95, 1.5


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (less the query's square) of the ``width`` nearest found from the first nodes; id -1 fills up."""
    square = (points**2).sum(axis=1)
    n, rows = len(queries), np.arange(len(queries))
    ids, gone = np.full((n, width), -1), np.ones((n, width), bool)
    dist = np.full((n, width), np.inf, np.float32)
    seen = np.zeros((n, len(points)), bool)
    starts = min(STARTS, width, len(points))
    ids[:, :starts], gone[:, :starts], seen[:, :starts] = np.arange(starts), False, True
    dist[:, :starts] = square[:starts] - 2 * queries @ points[:starts].T
    while True:
        open_ = np.where(gone[rows], np.inf, dist[rows])
        pick = open_.argmin(axis=1)
        more = np.isfinite(open_[np.arange(len(rows)), pick])
        rows, pick = rows[more], pick[more]
        if not len(rows):
            return ids, dist
        gone[rows, pick] = True
        near = links[ids[rows, pick]]
        at = np.maximum(near, 0)
        new = (near >= 0) & ~seen[rows[:, None], at]
        r, c = np.nonzero(new)
        seen[rows[r], at[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = square[at[r, c]] - 2 * np.einsum("ij,ij->i", points[at[r, c]], queries[rows[r]])
        every = np.concatenate([dist[rows], d], axis=1)
        top = np.argpartition(every, width - 1, axis=1)[:, :width]
        dist[rows] = np.take_along_axis(every, top, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], at], axis=1), top, 1)
        gone[rows] = np.take_along_axis(np.concatenate([gone[rows], ~new], axis=1), top, 1)
        ids[rows] = np.where(np.isfinite(dist[rows]), ids[rows], -1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """At most DEGREE links of each node out of its candidates (-1: none), near and diverse; filled with -1."""
    out = np.full((len(nodes), DEGREE), -1)
    for low in range(0, len(nodes), 256):
        p, c = nodes[low: low + 256], cand[low: low + 256]
        at = np.maximum(c, 0)
        x = points[at]
        d = ((x - points[p][:, None]) ** 2).sum(axis=2)
        d[(c < 0) | (c == p[:, None])] = np.inf
        square = (x**2).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
        rows, left = np.arange(len(p)), d.copy()
        for k in range(DEGREE):
            best = left.argmin(axis=1)
            live = np.isfinite(left[rows, best])
            if not live.any():
                break
            out[low + rows[live], k] = c[rows[live], best[live]]
            near = ALPHA**2 * between[rows, best] <= d
            left[near & live[:, None]] = np.inf
            left[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, seed: int) -> np.ndarray:
    """Links (n, ROOM) of a graph over ``points``; searches start at the first ``STARTS`` nodes."""
    n = len(points)
    links = np.full((n, ROOM), -1, np.int32)
    first = min(STARTS, n)
    order = np.concatenate([np.arange(first), first + np.random.default_rng(seed).permutation(n - first)])
    done = 0
    while done < n:
        batch = order[done: done + (min(done, BATCH) or 64)]
        if done:
            found, _ = beam_search(points, links, points[batch], BEAM_BUILD)
        else:
            found = np.broadcast_to(batch, (len(batch), len(batch)))
        mine = robust_prune(points, batch, found)
        links[batch, :DEGREE] = mine
        links[batch, DEGREE:] = -1
        # links back: appended while there is room, else the node is pruned with the nearest of the new ones
        source, target = np.repeat(batch, DEGREE), mine.ravel()
        source, target = source[target >= 0], target[target >= 0]
        far = ((points[source] - points[target]) ** 2).sum(axis=1)
        sort = np.lexsort((far, target))
        source, target = source[sort], target[sort]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        cand = np.full((len(node), 2 * ROOM), -1)
        cand[:, :ROOM] = links[node]
        fits = place < ROOM
        cand[np.repeat(np.arange(len(node)), count)[fits], ROOM + place[fits]] = source[fits]
        known = (cand[:, ROOM:, None] == cand[:, None, :ROOM]).any(axis=2)
        cand[:, ROOM:][known] = -1
        full = (cand >= 0).sum(axis=1) > ROOM
        packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)[:, :ROOM]
        links[node[~full]] = packed[~full]
        if full.any():
            links[node[full], :DEGREE] = robust_prune(points, node[full], cand[full])
            links[node[full], DEGREE:] = -1
        done += len(batch)
    return links


def _equal_length(x: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)
    scale = 1 / np.sqrt(square.max())
    return np.hstack([x * scale, np.sqrt(np.maximum(0, 1 - square[:, None] * scale**2))]).astype(np.float32)


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries as points: of length 1, the added component zero."""
    return np.hstack([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))]).astype(np.float32)


def wide_enough(x: np.ndarray, points: np.ndarray, links: np.ndarray, seed: int, k: int, beam: int) -> int:
    """The least beam, doubled from ``beam``, that finds ``RECALL`` of the true ``k`` nearest of some nodes."""
    trial = np.random.default_rng(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
    true = x[trial] @ x.T
    worst = -np.partition(-true, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    while beam < len(x):
        found, _ = beam_search(points, links, _asked(x[trial]), beam)
        score = np.where(found >= 0, np.take_along_axis(true, np.maximum(found, 0), 1), -np.inf)
        if np.minimum((score >= worst[:, None]).sum(axis=1), k).mean() >= RECALL * min(k, len(x)):
            return beam
        beam *= 2
    return len(x)


def _build(k: int, beam: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        order = np.lexsort((pdf["node"], -(x**2).sum(axis=1)))
        x, nodes, shard = x[order], pdf["node"].to_numpy(np.int64)[order], int(pdf["shard"].iloc[0])
        points = _equal_length(x)
        links = build_graph(points, shard)
        wide = wide_enough(x, points, links, shard, k, beam)
        return pd.DataFrame({"dim": [x.shape[1]], "shard": [shard], "beam": [wide], "nodes": [nodes.tobytes()], "vecs": [x.tobytes()], "links": [links.tobytes()]})

    return run


def _search(k: int):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "node": [], "score": []}
        if len(graph) and len(queries):
            g = graph.iloc[0]
            nodes, beam = np.frombuffer(g["nodes"], np.int64), int(g["beam"])
            x = np.frombuffer(g["vecs"]).reshape(len(nodes), -1)
            links, points = np.frombuffer(g["links"], np.int32).reshape(len(nodes), ROOM), _equal_length(x)
            q, ids = np.stack(queries["vec"].to_numpy()).astype(np.float64), queries["node"].to_numpy()
            rows = max(1, BATCH * BEAM // max(BEAM, beam))  # what a batch gathers stays of one size
            for low in range(0, len(q), rows):
                part = q[low: low + rows]
                if beam < len(x):
                    found, _ = beam_search(points, links, _asked(part), beam)
                else:
                    found = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
                score = np.einsum("ijk,ik->ij", x[np.maximum(found, 0)], part)
                score[found < 0] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                best = np.take_along_axis(score, top, 1)
                r, c = np.nonzero(np.isfinite(best))
                out["query"].append(ids[low + r])
                out["node"].append(nodes[np.take_along_axis(found, top, 1)[r, c]])
                out["score"].append(best[r, c])
        return pd.DataFrame({name: np.concatenate(v) if v else np.array([], np.int64 if name != "score" else float) for name, v in out.items()})

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each row whose id is divisible by ``every``."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vec", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    # adding 0.0 makes -0.0 and 0.0 the same vector
    rows = rows.withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0))).withColumn("node", F.xxhash64("vec"))
    is_query = F.col("vec_id") % every == 0
    nodes = rows.groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"), F.max(is_query).alias("asks"))
    # the largest component, a column of its own that is computed once, is divided out: no square leaves the range of a double
    nodes = nodes.withColumn("longest", F.array_max(F.transform("vec", F.abs)))
    norm = F.log("longest") + 0.5 * F.log(F.aggregate("vec", F.lit(0.0), lambda s, v: s + (v / F.col("longest")) * (v / F.col("longest"))))
    band = F.floor(norm / math.log(BAND) + 0.5).cast("int")
    nodes = keep(nodes.select("node", "vec", "least", "asks", F.size("vec").alias("dim"), band.alias("band")), "nodes")
    blocks = max(1, -(-nodes.where("asks").count() // BLOCK_ROWS))

    bands = keep(nodes.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "bands")
    # shards are numbered within a length of vectors: those of the bands before, and the part in its own
    first = Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = keep(bands.withColumn("first", F.coalesce(F.sum("shards").over(first), F.lit(0))), "bands")
    dealt = nodes.join(bands, ["dim", "band"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards"))).cast("int"))
    graphs = keep(dealt.select("dim", "shard", "node", "vec").groupBy("dim", "shard").applyInPandas(_build(k + 1, beam), "dim int, shard int, beam int, nodes binary, vecs binary, links binary"), "graphs")
    pieces = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = nodes.where("asks").select("dim", "node", "vec", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    count = bands.groupBy("dim").agg(F.sum("shards").cast("int").alias("count"))
    asks = asks.join(count, "dim").select("dim", "node", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("shard"))
    key = ["dim", "shard", "block"]
    found = pieces.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(_search(k), "query long, node long, score double")
    found = keep(found, "found")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.join(nodes.select("node", "least"), "node").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    first = Window.partitionBy("node").orderBy("vec_id")
    ids = rows.select("node", "vec_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    listed = found.select("query", "node", "score").join(ids, "node").groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score", "node"))).alias("all"))
    listed = keep(listed.select("query", F.slice("all", 1, k + 1).alias("all")), "listed")
    queries = rows.where(is_query).select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    own = F.array_position(F.transform("all", lambda x: (x["node"] == F.col("query")) & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("all", lambda x, i: i != F.col("own") - 1), 1, k)
    out = queries.join(small(listed, 50_000), "query").withColumn("own", own).select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
