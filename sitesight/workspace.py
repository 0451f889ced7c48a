"""Shared scratch storage: small written tables that cut lineage and carry true sizes.

A table written here and read back has three uses:

* lineage ends there, so self-joins do not nest earlier plans and a lost executor
  repeats only the work since the last table;
* the optimiser sees the real file size, so a small table is broadcast because it *is*
  small (``spark.sql.autoBroadcastJoinThreshold``) and a large one is not;
* values are fixed, so two readers of one intermediate see the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[tuple[str, str, str], DataFrame] = {}
_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    A checkpoint folder set by code comes next. Only a local session with neither gets a
    temporary folder of its own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="sitesight-")
        base = _own_dirs[context.applicationId]
    return f"{base.rstrip('/')}/{context.applicationId}"


def keep(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only_reads(df: DataFrame) -> bool:
    """Whether ``df`` only selects from files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" +-:").split(" ", 1)[0] for line in plan.splitlines() if line.strip()]
    return nodes[-1:] == ["Relation"] and set(nodes[:-1]) <= {"Project", "Filter"}


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` itself if it only selects from files, else ``keep``: a plan read by several passes runs once."""
    return df if only_reads(df) else keep(df, name)


def still_stored(df: DataFrame) -> bool:
    """Whether the files of a kept table are still in the shared folder."""
    try:
        df.sparkSession.read.schema(df.schema).parquet(*df.inputFiles()[:1])
        return True
    except AnalysisException:
        return False


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores, for steps whose cost is arithmetic and not bytes.

    Adaptive execution sizes partitions by bytes and would put a small table with heavy
    rows into one task; an explicit count is left alone. The hash is an expression of its
    own, because a repartition by columns the rows already lie by would be optimised away.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*keys))


def spread_by(df: DataFrame, rows: int, task_rows: int, *keys: str) -> DataFrame:
    """Hash rows over all cores by ``keys``, in as many parts as ``rows`` needs at ``task_rows`` each.

    What a task holds does not grow with the table, however few shuffle partitions the session has.
    Joins and aggregates on the keys, or on more than them, find the rows in place.
    """
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, -(-rows // task_rows)), *keys)


#: Rows of a large table that one task joins or groups.
TASK_ROWS = 500_000


def by_size(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``spread_by`` where ``rows`` are more than a ``TASK_ROWS`` for each core; fewer are left to the session's plan."""
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return spread_by(df, rows, TASK_ROWS, *keys)


def kept_once(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """``keep`` one table per application and input folder, so later queries read it again."""
    slot = (spark.sparkContext.applicationId, scope, name)
    if slot not in _made or not still_stored(_made[slot]):
        _made[slot] = keep(build(), name)
    return _made[slot]
