"""Column functions for species names and table headers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(col: str | Column, mode: str = "all", to: str = " ") -> Column:
    """Swap ``_`` and space in a name.

    ``mode="all"`` replaces every separator; ``mode="first"`` only the first one, so the two differ
    for names of three or more parts. ``to`` is the separator wanted in the result.
    """
    c = F.col(col) if isinstance(col, str) else col
    old = "_" if to == " " else " "
    if mode == "all":
        return F.replace(c, F.lit(old), F.lit(to))
    if mode == "first":
        return F.regexp_replace(c, f"^([^{old}]*){old}", f"$1{to}")
    raise ValueError(f"unknown mode: {mode}")


def canonical_key(col: str | Column) -> Column:
    """Comparable form of a name: ``_`` as space, runs of blanks collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(clean_name(col), r"\s+", " ")))


def clean_headers(df: DataFrame) -> DataFrame:
    """Lower-case column names with blanks and dots turned into ``_``."""
    return df.toDF(*[re.sub(r"[\s.]+", "_", c.strip()).lower() for c in df.columns])


def promote_header(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """Name columns by the header text of a table whose header arrived as a data row.

    Rows of a distributed table have no order, so the header row is recognised by its content: it
    repeats the name ``key`` in the column of that name.
    """
    named = df.toDF(*names)
    return named.filter(~F.coalesce(F.col(f"`{key}`") == key, F.lit(False)))


def fix_names(df: DataFrame, col: str, fixes: dict[str, str]) -> DataFrame:
    """Replace known odd names, keep every other one (NULL stays NULL)."""
    c = F.col(col)
    fixed = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), fixes.items(), F)
    return df.withColumn(col, fixed.otherwise(c) if fixes else c)


def species_from_file(col: str | Column) -> Column:
    """Species name held in a file path such as ``…/Genus_species.csv``; paths are percent-encoded."""
    c = F.col(col) if isinstance(col, str) else col
    stem = F.regexp_extract(c, r"([^/\\]+)\.csv$", 1)
    # a plus sign stands for itself in a path, but for a blank in the decoder
    stem = F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
    return clean_name(F.nullif(stem, F.lit("")))
