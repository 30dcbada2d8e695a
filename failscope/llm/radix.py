"""A distributed least-significant-digit radix sort.

Rows carry a ``place`` (any distinct longs at first).  A pass deals them by blocks of
places, counts the digits of each block, turns the counts into global offsets (digit
first, then block) and moves every row to offset + its number among the block's rows of
that digit.  As each pass is stable, the places after the last one are the ranks by the
composite key, whose digits run across the borders of its columns.

A block has a fixed number of places whatever the keys are, so a hot key changes nothing:
no task gets more than a block at a time.  The driver sees one count for each of the
2^``digit_bits`` digits.  Every pass ends in a written table, so a lost executor repeats
one pass at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.storage import drop, materialize

DIGIT_BITS = 14
BLOCK = 1 << 18


def digit_plan(bounds: Sequence[tuple[int, int]], digit_bits: int) -> list[list[tuple[int, int, int, int]]]:
    """For each pass the pieces (column, shift, bits, place in the digit) of its digit.

    ``bounds`` are the least and greatest values of the columns, most significant first;
    a column takes as many bits as its range needs.
    """
    passes, used = [], digit_bits
    for column in reversed(range(len(bounds))):
        low, high = bounds[column]
        width, shift = (high - low).bit_length(), 0
        while shift < width:
            if used == digit_bits:
                passes.append([])
                used = 0
            bits = min(width - shift, digit_bits - used)
            passes[-1].append((column, shift, bits, used))
            shift, used = shift + bits, used + bits
    return passes


def digits(values: Sequence[np.ndarray], lows: Sequence[int], pieces: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = np.zeros(len(values[0]), np.uint64)
    for column, shift, bits, at in pieces:
        value = values[column].view(np.uint64) - np.array(lows[column], np.int64).view(np.uint64)
        out |= ((value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)) << np.uint64(at)
    return out.astype(np.int32)


def sort_places(rows: DataFrame, columns: Sequence[str], digit_bits: int = DIGIT_BITS, block: int = BLOCK) -> DataFrame:
    """The rows with ``place`` from 0 by the long columns, all ascending; no nulls in these.

    ``rows`` has a ``place`` of distinct longs.  Rows equal in all columns get neighbouring
    places, in the order of the places they came with.  An empty table stays empty.
    """
    found = rows.agg(F.count(F.lit(1)), *[f(c) for c in columns for f in (F.min, F.max)]).first()
    n = found[0]
    bounds = [(found[1 + 2 * i] or 0, found[2 + 2 * i] or 0) for i in range(len(columns))]
    lows = [low for low, _ in bounds]
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    height = max(1, min(block, -(-n // parallel)))
    # Without a digit that differs one empty digit still closes the gaps between the places.
    passes = digit_plan(bounds, digit_bits) or [[]]
    names = list(rows.columns)
    schema = rows.schema
    for number, pieces in enumerate(passes):
        moved = materialize(_moved(rows, columns, names, schema, lows, pieces, height, 1 << digit_bits), "radix")
        if number:
            drop(rows)
        rows = moved
    return rows


def _moved(rows: DataFrame, columns: Sequence[str], names: list[str], schema, lows: list[int], pieces: list, height: int, radix: int) -> DataFrame:
    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() // height
            digit = digits([batch.column(1 + i).to_numpy() for i in range(len(columns))], lows, pieces)
            order = np.lexsort((digit, place))
            place, digit = place[order], digit[order]
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (digit[1:] != digit[:-1])][:len(place)])
            yield pa.record_batch({"block": pa.array(place[first]), "digit": pa.array(digit[first]), "n": pa.array(np.diff(np.r_[first, len(place)]))})

    counts = materialize(rows.select("place", *columns).mapInArrow(histogram, "block bigint, digit int, n bigint")
                         .groupBy("block", "digit").agg(F.sum("n").alias("n")), "radix-counts")
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).toArrow()
    start = np.zeros(radix + 1, np.int64)
    start[totals["digit"].to_numpy() + 1] = totals["n"].to_numpy()
    start = np.cumsum(start)[:-1]
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))

    def scatter(block: pa.Table, before: pa.Table) -> pa.Table:
        block = block.drop_columns(["block"]).sort_by("place")
        digit = digits([block[c].to_numpy() for c in columns], lows, pieces)
        order = np.argsort(digit, kind="stable")
        sorted_ = digit[order]
        first = np.searchsorted(sorted_, sorted_, side="left")
        base = start.copy()
        known = before["digit"].to_numpy()
        base[known] += before["before"].to_numpy()
        to = np.empty(len(digit), np.int64)
        to[order] = base[sorted_] + np.arange(len(digit)) - first
        at = block.column_names.index("place")
        return block.set_column(at, block.schema.field(at), pa.array(to)).select(names)

    dealt = rows.withColumn("block", F.expr(f"place div {height}"))
    return dealt.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(scatter, schema)
