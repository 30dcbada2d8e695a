"""Exact, linearly interpolated quantiles with bounded memory.

Spark's ``percentile`` keeps every distinct value of the column in one task.
Here the column is written once, and the wanted ranks are bracketed with ``percentile_approx`` (whose rank error is bounded), the bracket
is counted exactly, and the step repeats inside it until few distinct values
are left.  Each step shrinks a bracket by a few thousand, so two or three
passes over the one column are enough at any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.storage import materialize

SMALL = 200_000
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], small: int | None = None) -> list[float | None]:
    """The values at ``probs`` of the non-null, non-NaN values of ``column``."""
    small = small or SMALL
    value = F.col(column).cast("double")
    x = materialize(df.select(F.when(~F.isnan(value), value).alias("x")).filter("x is not null"), "column")
    n = x.count()
    if n == 0:
        return [None for _ in probs]
    places = [(n - 1) * p for p in probs]
    found = _values_at(x, n, {r for at in places for r in (math.floor(at), math.ceil(at))}, small)
    return [_line(found[math.floor(at)], found[math.ceil(at)], at - math.floor(at)) for at in places]


def _line(low: float, high: float, share: float) -> float:
    return low if low == high else low + (high - low) * share


def _inside(low: float | None, high: float | None) -> Column:
    """Strictly between two values; None stands for no limit."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("x") > low)
    return out & (F.col("x") < high) if high is not None else out


def _values_at(x: DataFrame, n: int, ranks: set[int], small: int) -> dict[int, float]:
    found: dict[int, float] = {}
    # rank -> (low, high, rows up to low, rows strictly between)
    brackets = {r: (None, None, 0, n) for r in ranks}
    while brackets:
        ends = _ends(x, brackets)
        pairs = sorted(set(ends.values()))
        size = x.agg(*[c for i, (low, high) in enumerate(pairs) for c in (
            F.count_if(F.col("x") < low).alias(f"below{i}"), F.count_if(F.col("x") == low).alias(f"low{i}"),
            F.count_if(_inside(low, high)).alias(f"inner{i}"), F.count_if(F.col("x") == high).alias(f"high{i}"),
            F.approx_count_distinct(F.when(_inside(low, high), F.col("x"))).alias(f"distinct{i}"))]).first()
        few: dict[int, tuple] = {}
        for rank in list(brackets):
            low, high = ends[rank]
            i = pairs.index((low, high))
            start = size[f"below{i}"]
            inner = start + size[f"low{i}"]
            after = inner + size[f"inner{i}"]
            if not start <= rank < after + size[f"high{i}"]:
                raise ArithmeticError(f"rank {rank} fell outside its bracket")
            # A run of equal values at either end is settled here, so the next bracket is always smaller.
            if rank < inner or rank >= after:
                found[rank] = low if rank < inner else high
                del brackets[rank]
            elif size[f"distinct{i}"] <= small:
                few[rank] = (low, high, inner)
                del brackets[rank]
            else:
                brackets[rank] = (low, high, inner, size[f"inner{i}"])
        if few:
            wanted = F.lit(False)
            for low, high, _ in set(few.values()):
                wanted = wanted | _inside(low, high)
            # Few distinct values per bracket, checked just above.
            counts = sorted((row[0], row[1]) for row in x.filter(wanted).groupBy("x").count().collect())
            for rank, (low, high, seen) in few.items():
                for value, count in counts:
                    if low < value < high:
                        seen += count
                        if rank < seen:
                            found[rank] = value
                            break
    return found


def _ends(x: DataFrame, brackets: dict[int, tuple]) -> dict[int, tuple[float, float]]:
    """Two values around each rank, by sketches whose rank error is bounded."""
    members: dict[tuple, list[int]] = {}
    for rank, bracket in brackets.items():
        members.setdefault(bracket, []).append(rank)
    sketches = []
    for i, ((low, high, below, inside), ranks) in enumerate(members.items()):
        slack = 2.0 / ACCURACY + 1.0 / inside
        at = [(r - below + 0.5) / inside for r in ranks]
        probs = F.array(*[F.lit(p) for a in at for p in (max(0.0, a - slack), min(1.0, a + slack))])
        sketches.append(F.percentile_approx(F.when(_inside(low, high), F.col("x")), probs, F.lit(ACCURACY)).alias(f"s{i}"))
    row = x.agg(*sketches).first()
    return {rank: (row[i][2 * j], row[i][2 * j + 1])
            for i, ranks in enumerate(members.values()) for j, rank in enumerate(ranks)}
