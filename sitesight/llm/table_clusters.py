"""Centroid clustering of integer vectors by lookup tables of scalar differences.

Vectors become integers, floor(scale * x), and are stored. In each round a task tabulates, batch by
batch, for each dimension, occurring integer value and centroid, the squared difference; a vector's
distances are then gathers from these tables and their sum. All of it is exact in 64-bit integers,
and a table has at most as many values as its batch has rows, whatever the spread of the data.
A task returns one count and one sum for each cluster, so a round moves tasks x clusters rows
whatever the number of vectors, and the driver holds only the centroids.

Defined results: vectors of another length, null, or with a null or non-finite component take no part.
Starting centroids are the vectors of the smallest id hashes (equal ids: the smaller vector first; null ids
last); with fewer vectors than clusters each vector starts one. A tie goes to the smaller cluster, an
empty cluster keeps its centroid, repeated rows each count, extra columns are ignored, and an empty table
gives no rows. A component of 2**19 or more cannot be summed exactly in 64 bits and raises an error, as an
overflow does in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.workspace import keep

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: The largest size of an integer component: 64 squared differences of twice that fit 64 bits.
LARGEST = 1 << 27


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that take part, as integers."""
    vec = F.col("vec")
    whole = (F.size(vec) == dims) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    too_large = F.raise_error(F.lit(f"a vector component times {scale} is {LARGEST} or more"))
    q = F.transform(vec, lambda v: F.when(F.abs(v * scale) < LARGEST, F.floor(v * scale)).otherwise(too_large.cast("long")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where(vec.isNotNull() & whole).select("vec_id", q.alias("q"))


class Batch:
    """Vectors of one Arrow batch: the integer values that occur in each dimension, and each row's place among them."""

    def __init__(self, q: pa.Array, dims: int):
        grid = q.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        found = [np.unique(grid[:, d], return_inverse=True) for d in range(dims)]
        self.n, self.values, self.places = len(grid), [v for v, _ in found], [p for _, p in found]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid and its squared distance."""
        distance = np.zeros((self.n, len(centroids)), np.int64)
        for values, places, centre in zip(self.values, self.places, centroids.T):
            table = (values[:, None] - centre[None, :]) ** 2
            distance += table[places]
        cluster = distance.argmin(axis=1)
        return cluster, distance[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """(clusters, dimensions): the sums of a batch stay below 2**53, where doubles are exact."""
        return np.stack([np.bincount(cluster, values[places], k) for values, places in zip(self.values, self.places)], axis=1).astype(np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of the rows nearest to each."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for found in batches:
            batch = Batch(found.column(0), dims)
            cluster, _ = batch.nearest(centroids)
            count += np.bincount(cluster, minlength=k)
            total += batch.sums(cluster, k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], schema=schema)

    parts = rows.select("q").mapInArrow(run, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    moved = centroids.copy()
    for c, d, n, s in cells.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        moved[c, d] = int(s) // n
    return moved


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            cluster, distance = Batch(found.column(1), centroids.shape[1]).nearest(centroids)
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], schema=schema)

    return rows.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def starting_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("q", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that takes part, and the final centroids."""
    rows = keep(integers(vectors, dims, scale), "integers")
    centroids = starting_centroids(rows, k, seed).reshape(-1, dims)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _moved(rows, centroids)
    return keep(_assigned(rows, centroids), "assigned"), centroids


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``cluster`` with the inertia of the row's cluster, of all clusters, and its centroid's digest."""
    assigned, centroids = cluster(vectors, k, rounds)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row a cluster: k is a parameter, so this side is small at any size
    facts = assigned.sparkSession.createDataFrame(
        [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def duckdb_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    def nearest(name: str, centres: str) -> str:
        return f"""{name} AS MATERIALIZED (
    SELECT row, min_by(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT v.row, m.c, list_sum([(v.q[i] - m.q[i]) * (v.q[i] - m.q[i]) for i in range(1, {dims + 1})]) AS d
        FROM kept v CROSS JOIN {centres} m) GROUP BY row
)"""

    parts = [f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
    WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
)""", f"""m0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept
    ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q LIMIT {k}
)"""]
    for r in range(1, rounds + 1):
        parts += [nearest(f"a{r}", f"m{r - 1}"), f"""m{r} AS MATERIALIZED (
    SELECT m.c, coalesce(g.q, m.q) AS q FROM m{r - 1} m LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
            SELECT c, i, sum(x) AS s, count(*) AS n FROM (
                SELECT a.c, unnest(range(1, {dims + 1})) AS i, unnest(v.q) AS x FROM a{r} a JOIN kept v USING (row)) GROUP BY c, i)
        GROUP BY c) g USING (c)
)"""]
    parts.append(nearest("last", f"m{rounds}"))
    return "WITH " + ", ".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM last a JOIN kept v USING (row) JOIN m{rounds} m USING (c)
"""
