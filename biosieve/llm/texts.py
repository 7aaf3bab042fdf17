"""Helpers shared by the text operators.

Texts travel to Python as UTF-8 bytes: ``bytes.lower`` lower-cases A-Z only and ``bytes.split`` and
``bytes.strip`` know exactly the white space ``[\\x20\\x09-\\x0D]``, so the fast built-ins follow the rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from biosieve.session import scratch_path


def raw_text(text: str = "text") -> Column:
    """The text as bytes, a missing one as none."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the bytes of ``text``, whatever other columns there are."""
    return docs.select("doc_id", raw_text())


_held: dict[str, Any] = {}  # of one Python worker
_holder = [""]  # the call of ``per_batch`` whose tasks may use it


def _hand_over(call: str) -> None:
    """Drop what tasks of another call have left in this Python worker."""
    if _holder[0] != call:
        _held.clear()
        _holder[0] = call


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """``make()`` once in a Python worker for all tasks of a call of ``per_batch``.

    Workers outlive jobs: what one operator has learnt is dropped when the worker takes a task of another, so it
    takes no memory from the steps that follow.
    """
    if name not in _held:
        _held[name] = make()
    return _held[name]


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it returns the columns named in ``schema``.

    ``rows`` cuts the batches, where ``fn`` gains nothing from many rows, so that few texts are held as objects at once.
    """
    spark_schema: StructType = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)
    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hand_over(call)
        for batch in (b.slice(at, step) for b in batches for step in [rows or max(1, b.num_rows)] for at in range(0, b.num_rows, step)):
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the ids that ``gone`` lists; rows without an id stay."""
    ids = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_gone"], "left_anti")


def stored(df: DataFrame, name: str, *partition_by: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
