"""Left joins and aggregates attached to rows.

Aggregates are joined back instead of computed in a full-frame window: the
window would send a whole key to one task, while the aggregate combines on the
map side.  The join is broadcast, or else shuffled with hot keys split by
adaptive execution, according to the real size of the aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.constants import ROOT_CAUSES
from failscope.operators.dedupe import top_per_key
from failscope.sources.columns import present
from failscope.storage import literal_table, sized


def attach(df: DataFrame, keys: Sequence[str], source: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Add per-key aggregates to every row; null for rows with a null key.

    ``source`` is what to aggregate if not ``df``: give the original frame where several
    aggregates are attached one after another, so that none is computed over the joins before it.
    """
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    small = (df if source is None else source).filter(known).groupBy(*keys).agg(*[col.alias(name) for name, col in aggregates.items()])
    return df.join(sized(small), keys, "left").select(*df.columns, *aggregates)


def failure_frequency(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number of FAIL rows of the key, 0 when it has none."""
    counted = df.filter((F.col("status") == "FAIL") & F.col(key).isNotNull()).groupBy(key).agg(
        F.count("status").alias(name))
    return df.join(sized(counted), key, "left").select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                        suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join in which null matches null; other shared columns get the suffixes."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    lefts = left.select(*[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns])
    rights = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return lefts.join(rights, same, "left").drop(*[f"__r_{k}" for k in keys])


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key combination occurs twice."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None,
                suffixes: tuple[str, str] = ("", "_r"), validate: bool = True) -> DataFrame:
    """Left join with one right row per key.

    With ``order`` the first right row per key is kept, which makes the key
    unique; without it the right side is checked.
    """
    if order is not None:
        right = sized(top_per_key(right, keys, order))
    elif validate:
        check_unique(right, keys)
    return null_safe_left_join(left, right, keys, suffixes)


def join_available(left: DataFrame, right: DataFrame, candidates: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join on the candidate keys both sides have, with only ``columns`` from the right.

    Several right rows for a key give several rows.  Without a common key the
    left side is returned as it is.
    """
    keys = [k for k in candidates if k in left.columns and k in right.columns]
    if not keys:
        return left
    return null_safe_left_join(left, right.select(*keys, *present(right, columns)), keys, ("", "_r"))


def label_clusters(df: DataFrame, default: str, labels: dict[int, str] | None = None, cluster: str = "cluster",
                   name: str = "root_cause_label") -> DataFrame:
    """Cluster number -> root cause by a fixed dictionary."""
    pairs = [(int(k), v) for k, v in (labels or ROOT_CAUSES).items()]
    table = literal_table(df.sparkSession, ["__cluster", "__label"], pairs)
    # The dictionary is a literal of a few rows.
    return df.join(F.broadcast(table), F.col(cluster).cast("int") == F.col("__cluster"), "left").select(
        *df.columns, F.coalesce("__label", F.lit(default)).alias(name))


def write_back(df: DataFrame, scored: DataFrame, row_id: str, column: str, default: object) -> DataFrame:
    """Put the result of a subset back by row id; ``default`` on all other rows."""
    return df.join(scored.select(row_id, column), row_id, "left").select(
        *[c for c in df.columns if c != column], F.coalesce(column, F.lit(default)).alias(column))
