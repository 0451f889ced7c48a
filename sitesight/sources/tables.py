"""Readers and writers. Tables are Parquet or CSV folders, or catalog tables.

Schemas are declared, never inferred, and missing columns are an error at read time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesight.functions.scalars import ratio, successes_from_rate

SITE_SCHEMA = T.StructType(
    [
        T.StructField("region", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("tests", T.LongType()),
        T.StructField("rate", T.DoubleType()),
    ]
)

DRAW_SCHEMA = T.StructType(
    [
        T.StructField("param", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("chain", T.IntegerType()),
        T.StructField("draw", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns {lacking}; the table has {df.columns}")
    return df


def add_if_absent(df: DataFrame, name: str, value) -> DataFrame:
    """Create a column only where the table has none of that name."""
    return df if name in df.columns else df.withColumn(name, value)


def read_site_table(
    spark: SparkSession,
    path: str | None = None,
    table: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType = SITE_SCHEMA,
    sheet: str | None = None,
) -> DataFrame:
    """One monthly site table, by folder (``sheet`` is a sub-folder) or by catalog name.

    Columns are found by name, also in CSV, whatever their order; one that the files lack is
    an error here and not a column of nulls.
    """
    if table is not None:
        return require_columns(spark.table(table), schema.fieldNames())
    if sheet:
        path = f"{path.rstrip('/')}/{sheet}"
    return _by_name(spark.read, path, fmt, schema)


def _by_name(reader: DataFrameReader, path: str, fmt: str, schema: T.StructType, *more: Column) -> DataFrame:
    """The columns of ``schema`` out of files that name their own columns.

    CSV is read as text under its header and cast. A value that is no number in a number's
    column fails the read (ANSI casts) rather than becoming null.
    """
    if fmt == "csv":
        reader = reader.option("header", True)
    found = require_columns(reader.format(fmt).load(path), schema.fieldNames())
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *more)


def with_successes(sites: DataFrame) -> DataFrame:
    """Derive ``successes`` from tests and rate unless the table brings it; drop ``rate``."""
    require_columns(sites, ["tests"])
    if "successes" not in sites.columns:
        sites = sites.withColumn("successes", successes_from_rate(F.col("tests"), F.col("rate")))
    return sites.drop("rate").withColumn("rate", ratio(F.col("successes"), F.col("tests")))


def read_result_folder(
    spark: SparkSession, folder: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """All result files below a folder, as one table with the file each row came from.

    Parquet files of different months may lack columns of one another; they are matched
    by name. With a ``schema`` no footer but one is opened to find the columns, and every
    file must have them; without one, CSV columns are text.
    """
    reader = spark.read.option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", True)
    source = F.col("_metadata.file_name").alias("source_file")
    if schema is not None:
        return _by_name(reader, folder, fmt, schema, source)
    if fmt == "parquet":
        reader = reader.option("mergeSchema", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder).select("*", source)


def union_months(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_result(df: DataFrame, path: str, fmt: str = "parquet", by_month: bool = True) -> None:
    """Write a result. By month it replaces the months it brings and leaves the others."""
    writer = df.write.mode("overwrite")
    if by_month and "month" in df.columns:
        writer = writer.partitionBy("month").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_levels(levels: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One sub-folder per level, for example region, municipality and site."""
    for name, df in levels.items():
        write_result(df, f"{path.rstrip('/')}/{name}", fmt, by_month=False)


def read_levels(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def write_draws(draws: DataFrame, path: str, observed: DataFrame | None = None) -> None:
    """Posterior draws, one folder per parameter; the observed counts beside them."""
    draws.write.mode("overwrite").partitionBy("param").parquet(f"{path.rstrip('/')}/draws")
    if observed is not None:
        observed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/observed")


def read_draws(spark: SparkSession, path: str, params: Sequence[str] | None = None) -> DataFrame:
    """Stored draws; the parameter filter prunes folders."""
    draws = spark.read.schema(DRAW_SCHEMA).parquet(f"{path.rstrip('/')}/draws")
    return draws if params is None else draws.where(F.col("param").isin(list(params)))


class RowCountMismatch(RuntimeError):
    """A result has more or fewer rows than its input."""


#: Name of the small file that says which version of a published table holds.
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that holds; None if nothing has been published there."""
    jvm, at, files = _files(spark, f"{path.rstrip('/')}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def _point_to(spark: SparkSession, path: str, name: str) -> None:
    """Replace the pointer in one step: it is written beside and renamed over the old one."""
    jvm, at, files = _files(spark, f"{path.rstrip('/')}/{POINTER}")
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_{POINTER}-{name}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, how)


def _without_old_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions; the one that holds stays in any case."""
    _, at, files = _files(spark, path)
    holds = published_version(spark, path)
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("version-"))
    for name in names[: max(0, len(names) - keep)]:
        if not holds.endswith(f"/{name}"):
            files.delete(_files(spark, f"{path.rstrip('/')}/{name}")[1], True)


def guarded_write(result: DataFrame, source: DataFrame, path: str, fmt: str = "parquet", versions: int = 2) -> int:
    """Publish the result only if it has one row per input row.

    The result is counted while it is written, so it is computed and written once, to a version folder
    of its own under ``path``. If the counts agree, a small pointer file is replaced as the last step.
    Whatever fails before that, the old version holds and is whole; readers who began with it can finish,
    because the newest ``versions`` folders stay. ``read_published`` follows the pointer.
    """
    spark = result.sparkSession
    seen = Observation("written")
    name = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/{name}"
    writer = result.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(folder)
    expected = source.count()
    if seen.get["n"] != expected:
        _, at, files = _files(spark, folder)
        files.delete(at, True)
        raise RowCountMismatch(f"{seen.get['n']} result rows for {expected} input rows")
    _point_to(spark, path, name)
    _without_old_versions(spark, path, versions)
    return expected


def read_published(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """The version of a table that holds now."""
    folder = published_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(folder)
