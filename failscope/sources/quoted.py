"""CSV with line breaks inside quotes, read by as many tasks as the files have splits.

A line break ends a record where the number of quote characters before it in the file is
even; doubled quotes do not change that.  So the quotes of each split are counted first, and
the parity of all earlier splits of the file says whether a split begins inside a quoted
field.  Then every split cuts its lines into records on its own; the pieces of records that
cross a border, two for each split at most, are put together afterwards.

Quotes are expected as :rfc:`4180` has them: around whole fields, doubled inside.  The two
readings have to see the same splits, which is checked: otherwise the job fails.  Blank lines
between records are skipped, as Spark's reader does.  Line breaks inside fields stay as they
are, whatever ends the lines of the file.  A quote that is never closed leaves the rest of its
file in one record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WHOLE, HEAD, MIDDLE, TAIL = range(4)
_SPLIT = ["file", "start", "length"]


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), start and length of the split, and the line without its line feed."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"), "value")


def splits_inside(lines: DataFrame) -> DataFrame:
    """For each split whether it begins inside a quoted field."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy(*_SPLIT).agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select(*_SPLIT, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int").alias("inside"))


class _Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, file: int, start: int, inside: int):
        self.file, self.start = file, start
        self.parity, self.headless = inside, bool(inside)
        self.open: list[pa.Array] = []
        self.seq = 0

    def rows(self, records: pa.Array, kinds: np.ndarray) -> pa.RecordBatch:
        seq = np.arange(self.seq, self.seq + len(records))
        self.seq += len(records)
        same = np.ones(len(records), np.int64)
        return pa.record_batch({"file": pa.array(same * self.file), "start": pa.array(same * self.start), "seq": pa.array(seq),
                                "kind": pa.array(kinds.astype(np.int32)), "record": records})

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        count = (self.parity + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) & 1
        ends = np.flatnonzero(count == 0)
        self.parity = int(count[-1])
        if not len(ends):
            self.open.append(lines)
            return
        all_lines = pa.concat_arrays([*self.open, lines]) if self.open else lines
        bounds = np.r_[0, ends + 1 + len(all_lines) - len(lines)].astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), all_lines[:bounds[-1]]), pa.scalar(b"\n", pa.binary()))
        kinds = np.full(len(joined), WHOLE)
        kinds[0] = HEAD if self.headless else WHOLE
        self.headless = False
        blank = pc.is_in(joined, value_set=pa.array([b"", b"\r"], pa.binary())).to_numpy(zero_copy_only=False)
        kept = ~blank | (kinds == HEAD)
        self.open = [all_lines[bounds[-1]:]] if bounds[-1] < len(all_lines) else []
        yield self.rows(joined.filter(pa.array(kept)), kinds[kept])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            lines = pa.concat_arrays(self.open)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), pa.scalar(b"\n", pa.binary()))
            yield self.rows(joined, np.array([MIDDLE if self.headless else TAIL]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        file, start, inside = (batch.column(i).to_numpy() for i in range(3))
        if not len(file):
            continue
        cuts = np.r_[0, np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1, len(file)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if cutter is None or (cutter.file, cutter.start) != (file[a], start[a]):
                if cutter is not None:
                    yield from cutter.close()
                cutter = _Cutter(int(file[a]), int(start[a]), int(inside[a]))
            yield from cutter.feed(batch.column(3).slice(a, b - a))
    if cutter is not None:
        yield from cutter.close()


def records(spark: SparkSession, path: str) -> DataFrame:
    """record (its text) and is_header (the first one of a file)."""
    lines = physical_lines(spark, path)
    # One row of four numbers for each split of the input (a few tens of bytes for 128 MB by default).
    known = F.broadcast(splits_inside(lines))
    changed = F.raise_error(F.lit("the splits of the input changed between two readings")).cast("int")
    cut = lines.join(known, _SPLIT, "left").select("file", "start", F.coalesce("inside", changed).alias("inside"), F.col("value").cast("binary")).mapInArrow(
        _pieces, "file bigint, start bigint, seq bigint, kind int, record binary")
    first = (F.col("start") == 0) & (F.col("seq") == 0)
    whole = cut.where(F.col("kind") == WHOLE).select(F.col("record").cast("string").alias("record"), first.alias("is_header"))
    # A record that crosses borders starts with the tail of a split; what follows up to the next tail belongs to it.
    parts = cut.where(F.col("kind") != WHOLE)
    along = Window.partitionBy("file").orderBy("start", "kind")
    owned = parts.withColumn("owner", F.sum((F.col("kind") == TAIL).cast("int")).over(along))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", F.col("record").cast("string").alias("text")))), lambda p: p["text"]), "\n")
    crossing = owned.groupBy("file", "owner").agg(text.alias("record"), F.max(first).alias("is_header")).select("record", "is_header")
    return whole.unionByName(crossing).select(F.regexp_replace("record", r"\r\z", "").alias("record"), "is_header")


#: Types in the order in which they are tried, with the form that a value must have.
_TYPES = [("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("double", ""), ("date", r"^\d{4}-\d{2}-\d{2}$"),
          ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), ("boolean", r"^(?i)(true|false)$")]


def _inferred(rows: DataFrame, names: list[str]) -> str:
    """The narrowest type of each column that all its values have; one pass."""
    value = {i: F.col("r")[f"c{i}"] for i in range(len(names))}
    fits = [F.coalesce(F.bool_and(value[i].isNull() | (value[i].rlike(form) & value[i].try_cast(kind).isNotNull())), F.lit(False)).alias(f"{i}_{kind}")
            for i in value for kind, form in _TYPES]
    some = [F.count(value[i]).alias(f"{i}_n") for i in value]
    found = rows.agg(*fits, *some).first().asDict()
    kinds = [next((kind for kind, _ in _TYPES if found[f"{i}_n"] and found[f"{i}_{kind}"]), "string") for i in value]
    return _ddl(names, kinds)


def _ddl(names: list[str], kinds: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds))


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of the files, each with a header. Without a schema the files are read once more to infer the types."""
    found = records(spark, path)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    body = found.where(~F.col("is_header"))
    if schema is None:
        header = found.where("is_header").agg(F.min("record")).first()[0]
        if header is None:
            return spark.createDataFrame([], StructType())
        names = next(csv.reader([header.replace("\n", " ")]))
        text = _ddl([f"c{i}" for i in range(len(names))], ["string"] * len(names))
        schema = _inferred(body.select(F.from_csv("record", text, options).alias("r")), names)
    ddl = schema if isinstance(schema, str) else _ddl(schema.names, [f.dataType.simpleString() for f in schema.fields])
    return body.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
