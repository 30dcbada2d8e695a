"""Driver-side schema work: header names, candidates, placeholders, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.storage import literal_table


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip and lower-case the column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def resolve(df: DataFrame, candidates: Sequence[str], required: bool = False, ignore_case: bool = False) -> str | None:
    """First candidate the frame has; an error when required and none is there."""
    have = {(c.lower() if ignore_case else c): c for c in df.columns}
    for candidate in candidates:
        found = have.get(candidate.lower() if ignore_case else candidate)
        if found is not None:
            return found
    if required:
        raise ValueError(f"none of {list(candidates)} found; columns are {df.columns}")
    return None


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def add_missing(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Constant column for each name the frame lacks."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def keep(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*present(df, names))


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*present(df, names))


def require(df: DataFrame, names: Sequence[str], rows: bool = False) -> DataFrame:
    """Raise unless all columns are there (and, if asked, at least one row)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; columns are {df.columns}")
    if rows and df.isEmpty():
        raise ValueError("no rows")
    return df


def file_key(df: DataFrame) -> str:
    """Column that identifies a file: its path, or its name where no path is kept."""
    return "path" if "path" in df.columns else "filename"


def row_order(df: DataFrame) -> list[str]:
    """Columns that identify and order the rows."""
    return [file_key(df), "line_number"]


def describe_columns(df: DataFrame) -> DataFrame:
    """(column, type, position) of the frame as a table."""
    rows = [(name, kind, i) for i, (name, kind) in enumerate(df.dtypes)]
    return literal_table(df.sparkSession, ["column", "type", "position"], rows)
