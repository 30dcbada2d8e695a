"""Running columns over ordered groups, for groups of any size.

A plain window sends a whole group to one task.  That is fine while the
largest group is small, which :func:`running` checks first.  Beyond the limit
the rows are range-partitioned by (keys, order) into even chunks, the window
runs inside each (key, chunk), and the totals of the earlier (or later) chunks
of the same key are added to it.  Neighbouring chunks share at most one key, so
the table of carried totals has at most two rows per chunk, which is why it may
be broadcast.

The chunk number comes from range sampling, which may differ between two
evaluations of one plan; the chunked rows are therefore written once.

``order`` must be ascending expressions that identify a row within its key
(negate a number for descending, put ``col.isNull()`` before ``col`` for nulls
last), so that results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from failscope.storage import materialize

MAX_GROUP_ROWS = 5_000_000
_ORDER = "__ord"
_CHUNK = "__chunk"


@dataclass(frozen=True)
class _Step:
    kind: str  # "sum", "last" or "next"
    value: Column
    inclusive: bool


@dataclass(frozen=True)
class Running:
    steps: tuple[_Step, ...]
    finish: Callable[..., Column]


def running_sum(value: Column, inclusive: bool = True) -> Running:
    """Sum of the rows up to this one; 0 before the first."""
    return Running((_Step("sum", value, inclusive),), lambda s: s)


def running_count(inclusive: bool = True) -> Running:
    """1-based position (inclusive) or number of earlier rows (exclusive)."""
    return running_sum(F.lit(1).cast("bigint"), inclusive)


def running_mean(value: Column, inclusive: bool = True) -> Running:
    """Mean of the non-null values up to this row; null when there are none."""
    present = F.when(value.isNotNull(), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return Running(
        (_Step("sum", value.cast("double"), inclusive), _Step("sum", present, inclusive)),
        lambda s, n: F.when(n > 0, s / n),
    )


def last_seen(value: Column, inclusive: bool = True) -> Running:
    """Latest non-null value up to this row (forward fill)."""
    return Running((_Step("last", value, inclusive),), lambda v: v)


def next_seen(value: Column) -> Running:
    """Earliest non-null value from this row on (backward fill)."""
    return Running((_Step("next", value, True),), lambda v: v)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all), from one partially aggregated pass."""
    if not keys:
        n = df.count()
        return n, n
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return (row[0] or 0), (row[1] or 0)


def _backwards(window: WindowSpec, order: Sequence[Column]) -> WindowSpec:
    """The rows from each one on, as those up to it in falling order: frames that start at the
    current row are evaluated anew for every row, frames that end there are not."""
    return window.orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)


def _local(step: _Step, rows: WindowSpec, ahead: WindowSpec) -> Column:
    if step.kind == "next":
        return F.last(step.value, ignorenulls=True).over(ahead)
    frame = rows.rowsBetween(Window.unboundedPreceding, 0 if step.inclusive else -1)
    if step.kind == "sum":
        return F.coalesce(F.sum(step.value).over(frame), F.lit(0))
    return F.last(step.value, ignorenulls=True).over(frame)


def _partial(step: _Step, order: Column) -> Column:
    if step.kind == "sum":
        return F.coalesce(F.sum(step.value), F.lit(0))
    pick = F.min_by if step.kind == "next" else F.max_by
    return pick(step.value, F.when(step.value.isNotNull(), order))


def _carry(step: _Step, name: str, of_key: WindowSpec) -> Column:
    if step.kind == "next":
        after = of_key.orderBy(F.col(_CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(name, ignorenulls=True).over(after)
    before = of_key.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    if step.kind == "sum":
        return F.sum(name).over(before)
    return F.last(name, ignorenulls=True).over(before)


def _combine(step: _Step, local: Column, carry: Column) -> Column:
    if step.kind == "sum":
        return local + F.coalesce(carry, F.lit(0))
    return F.coalesce(local, carry)


def chunk_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int, target: int) -> DataFrame:
    """Write ``df`` range-partitioned by (keys, order), numbered by chunk."""
    ordered = df.withColumn(_ORDER, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    # All cores get a chunk at least, however few rows there are.
    chunks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // target))
    spread = ordered.repartitionByRange(chunks, *[F.col(k) for k in keys], F.col(_ORDER))
    return materialize(spread.withColumn(_CHUNK, F.spark_partition_id()), "chunks")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
            max_group_rows: int | None = None, **columns: Running) -> DataFrame:
    """Add running ``columns`` to ``df`` per ``keys`` in ``order``.

    Without keys the order is global and the rows are always chunked.
    """
    limit = max_group_rows or MAX_GROUP_ROWS
    keys = list(keys)
    largest, total = group_sizes(df, keys)
    steps = [(name, i, step) for name, col in columns.items() for i, step in enumerate(col.steps)]

    if keys and largest <= limit:
        rows = Window.partitionBy(*keys).orderBy(*order)
        ahead = _backwards(Window.partitionBy(*keys), order)
        parts = {(name, i): _local(step, rows, ahead) for name, i, step in steps}
        return df.withColumns({
            name: col.finish(*[parts[name, i] for i in range(len(col.steps))]) for name, col in columns.items()
        })

    base = chunk_rows(df, keys, order, total, limit)
    in_chunk = Window.partitionBy(*keys, _CHUNK).orderBy(_ORDER)
    ahead = _backwards(Window.partitionBy(*keys, _CHUNK), [F.col(_ORDER)])
    local = base.withColumns({f"__l_{name}_{i}": _local(step, in_chunk, ahead) for name, i, step in steps})

    totals = base.groupBy(*keys, _CHUNK).agg(
        *[_partial(step, F.col(_ORDER)).alias(f"__p_{name}_{i}") for name, i, step in steps])
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    carried = totals.select(
        *[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)],
        F.col(_CHUNK).alias("__c"),
        F.count(F.lit(1)).over(of_key).alias("__n"),
        *[_carry(step, f"__p_{name}_{i}", of_key).alias(f"__c_{name}_{i}") for name, i, step in steps],
    ).filter("__n > 1")
    # At most two rows per chunk (see the module text), hence safe to broadcast.
    same = [F.col(_CHUNK) == F.col("__c")] + [
        F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(keys)]
    joined = local.join(F.broadcast(carried), reduce(lambda a, b: a & b, same), "left")
    parts = {
        (name, i): _combine(step, F.col(f"__l_{name}_{i}"), F.col(f"__c_{name}_{i}")) for name, i, step in steps}
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[col.finish(*[parts[name, i] for i in range(len(col.steps))]).alias(name)
          for name, col in columns.items()],
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_number",
                      max_group_rows: int | None = None) -> DataFrame:
    """Dense 1..n over the whole frame without a single-task window."""
    return running(df, [], order, max_group_rows, **{name: running_count()})


def first_in_frame(df: DataFrame, keys: Sequence[str], order: Sequence[Column], reach: int, value: Column,
                   name: str, max_group_rows: int | None = None) -> DataFrame:
    """Earliest non-null ``value`` within ``reach`` rows before or after each row.

    Large groups are cut into blocks of row positions; the ``reach`` rows at
    both edges of a block are also given to the neighbouring block.
    """
    limit = max(max_group_rows or MAX_GROUP_ROWS, 2 * reach + 1)
    keys = list(keys)
    largest, _ = group_sizes(df, keys)
    if largest <= limit:
        near = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
        return df.withColumn(name, F.first(value, ignorenulls=True).over(near))

    placed = running(df, keys, order, limit, __pos=running_count(inclusive=False))
    block, at = F.floor(F.col("__pos") / limit), F.col("__pos") % limit
    copies = F.filter(
        F.array(block, F.when(at < reach, block - 1), F.when(at >= limit - reach, block + 1)),
        lambda b: b.isNotNull())
    spread = placed.withColumn("__own", block).withColumn("__block", F.explode(copies))
    near = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(-reach, reach)
    return (
        spread.withColumn(name, F.first(value, ignorenulls=True).over(near))
        .filter("__own = __block").drop("__own", "__block", "__pos")
    )
