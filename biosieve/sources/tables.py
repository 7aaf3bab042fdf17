"""Reading and writing tables, one species per output, and incremental result stores."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biosieve.functions.names import species_from_file
from biosieve.session import durable, spread, task_count


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_table(
    spark: SparkSession, path: str, schema: str | T.StructType, row_numbers: bool = False, null_value: str = "NA"
) -> DataFrame:
    """CSV with header under a declared schema.

    The schema is applied by position, so a byte-order mark in the header is harmless.
    ``row_numbers`` drops a leading column of row numbers. ``null_value`` reads as NULL.
    """
    declared = _schema(schema)
    full = T.StructType([T.StructField("_row", T.StringType()), *declared.fields]) if row_numbers else declared
    return spark.read.csv(path, schema=full, header=True, nullValue=null_value).drop("_row")


def read_species_tree(
    spark: SparkSession, path: str, schema: str | T.StructType, row_numbers: bool = False
) -> DataFrame:
    """All per-species CSV files below ``path`` as one table with ``source_file``."""
    declared = _schema(schema)
    full = T.StructType([T.StructField("_row", T.StringType()), *declared.fields]) if row_numbers else declared
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(path, schema=full, header=True, nullValue="NA")
        .withColumn("source_file", F.col("_metadata.file_path"))
        .drop("_row")
    )


def species_from_path(df: DataFrame, path_col: str = "source_file", out: str = "species") -> DataFrame:
    """Add the species name encoded in each row's file name."""
    return df.withColumn(out, species_from_file(path_col))


def _by_species(df: DataFrame, rows_per_file: int) -> DataFrame:
    """``df`` shuffled by species over all tasks, a species of more than ``rows_per_file`` rows being divided."""
    parts = F.ceil(F.col("n") / rows_per_file).alias("_parts")
    crowded = durable(df.groupBy(F.col("species").alias("_crowded")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_file).select("_crowded", parts))
    if crowded.isEmpty():
        return spread(df, "species")
    # maps have no hash; rows equal in all else stay together
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]
    part = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("_parts")), F.lit(0).cast("long"))
    placed = df.join(crowded, F.col("species").eqNullSafe(F.col("_crowded")), "left").withColumn("_part", part)
    return spread(placed, "species", "_part").drop("_crowded", "_parts", "_part")


def write_by_species(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """Write one directory per species.

    Files and not bytes are what takes time, so species are spread over all tasks even where their rows
    would fit into one. A species is one file unless it outgrows ``rows_per_file``; so a dominant species becomes
    several files rather than one slow writer.
    """
    _by_species(df, rows_per_file).write.mode(mode).partitionBy("species").format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true").option("nullValue", "NA")
    writer.format(fmt).save(path)


@contextmanager
def _few_listings(spark: SparkSession):
    """Folders are listed by as many tasks as the cluster keeps busy; by default it is one task for each of up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, task_count(spark))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_by_species(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet store of one directory per species."""
    with _few_listings(spark):
        return spark.read.parquet(path)


def finished_species(spark: SparkSession, path: str) -> DataFrame | None:
    """Species with rows in a result store; only partition names are needed. None before the first run."""
    try:
        with _few_listings(spark):
            store = spark.read.option("basePath", path).schema("species string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return store.select("species").distinct()


def pending_species(records: DataFrame, done: DataFrame | None) -> DataFrame:
    """Records of species without a finished output."""
    if done is None:
        return records
    finished = done.select(F.col("species").alias("_done")).distinct()
    return records.join(finished, F.col("species").eqNullSafe(F.col("_done")), "left_anti")


def append_climate_scores(
    records: DataFrame, done_path: str, score: Callable[[DataFrame], DataFrame]
) -> None:
    """Score only species missing from the store at ``done_path`` and append their results.

    Results are first fixed in durable storage: the store being extended is also an input of the
    plan, and a retried task must not see its own output as finished work.
    """
    todo = pending_species(records, finished_species(records.sparkSession, done_path))
    write_by_species(durable(score(todo)), done_path)
