"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesight.workspace import keep

#: Rows up to which a side of two or three narrow columns may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id's text, modulo ``divisor``; an id of null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor, F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a kept table) with a broadcast hint while it is counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def per_batch(work: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """A function for ``mapInArrow``: ``work`` turns a batch into columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components: (node, label), the label being the least node of the component.

    Alternates large-star and small-star steps on the edge table, which end after about
    log2 of the longest chain. Every step is a shuffle join-free aggregate on a node; a hub's
    edges are only compared with its minimum, which is a map-side combined aggregate joined
    back. Each step's edges are written to the shared folder, so lineage stays short.
    Nodes without an edge to another node are not returned.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = keep(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(rounds):
        two_way = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two_way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two_way.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        after = keep(after, "edges")
        # a star forest: every node has one edge, and no centre has an edge of its own
        many = after.groupBy("u").count().where("count > 1")
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        now = after
        if many.isEmpty() and chained.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
