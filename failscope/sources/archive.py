"""Log archives: members of ``.tar.gz`` files, laid out by date and suite."""

from __future__ import annotations

import codecs
import io
import itertools
import posixpath
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions.parse import archive_date, archive_suite, file_stem
from failscope.storage import materialize

PIECE_LINES = 20_000


def _open(path: str) -> BinaryIO:
    """Byte stream of a file on a mounted or remote file system."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, name = FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_stream(name)


def _lines(stream: BinaryIO) -> Iterator[str]:
    """Lines of a stream that cannot seek; undecodable bytes are dropped."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("ignore"), translate=True)
    rest = ""
    while data := stream.read(1 << 20):
        *done, rest = (rest + decoder.decode(data)).split("\n")
        yield from done
    *done, rest = (rest + decoder.decode(b"", final=True)).split("\n")
    yield from done
    if rest:
        yield rest


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with _open(path) as stream, tarfile.open(fileobj=stream, mode="r|gz") as tar:
                for member in tar:
                    if not member.isfile():
                        continue
                    name, number, lines = posixpath.basename(member.name), 0, []
                    for line in _lines(tar.extractfile(member)):
                        number += 1
                        lines.append((path, member.name, name, number, line.strip()))
                        if len(lines) == PIECE_LINES:
                            yield _frame(lines)
                            lines = []
                    if lines:
                        yield _frame(lines)


def _frame(lines: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(lines, columns=["archive", "member", "filename", "line_number", "raw_line"])


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every file member.

    Spark lists the archives and spreads them over the tasks; a task streams
    its archives and passes the lines on in small pieces, so neither an archive
    nor a member has to fit in memory.  A gzip stream cannot be split, so one
    archive stays in one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.tar.gz").load(path).select("path")
    return files.mapInPandas(
        _unpack, "archive string, member string, filename string, line_number long, raw_line string")


class _Feed:
    """The lines of one member as a byte stream of known size."""

    def __init__(self, lines: Iterator[bytes]) -> None:
        self.lines, self.rest = lines, b""

    def read(self, size: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < size:
            line = next(self.lines, None)
            if line is None:
                break
            parts.append(line)
            have += len(line)
        data = b"".join(parts)
        self.rest = data[size:]
        return data[:size]


def _target(path: str) -> tuple[FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if not colon:
        return LocalFileSystem(), path
    return (LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else FileSystem.from_uri(quote(path, safe=":/"))


def write_archives(df: DataFrame, path: str, archive: str, member: str, order: Sequence[str], line: str) -> DataFrame:
    """Write one ``<archive>.tar.gz`` below ``path`` for each value of ``archive``, with the lines of each ``member`` in order.

    An archive is written by one task, as a gzip stream has one writer; the members are
    streamed, so neither has to fit in memory.  A finished archive is moved to its name in
    one step, so a task that is lost or runs twice leaves a whole archive.  Null names
    become ``unknown``, a null line is an empty one.  Returns archive, members and lines of
    what was written; it is already written when this returns.
    """
    rows = df.select(
        F.coalesce(F.col(archive).cast("string"), F.lit("unknown")).alias("archive"), F.coalesce(F.col(member).cast("string"), F.lit("unknown")).alias("member"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.encode(F.concat(F.coalesce(line, F.lit("")), F.lit("\n")), "utf-8").alias("line"))
    # A member's header comes before its lines and names its size.
    sizes = rows.groupBy("archive", "member").agg(F.sum(F.octet_length("line")).alias("size"))
    by_order = [f"o{i}" for i in range(len(order))]
    dealt = rows.join(sizes, ["archive", "member"]).repartition("archive").sortWithinPartitions("archive", "member", *by_order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for name, of_archive in itertools.groupby(flat, key=lambda r: r[0]):
            if "/" in name:
                raise ValueError(f"an archive's name may not hold a slash: {name}")
            system, folder = _target(path)
            system.create_dir(folder, recursive=True)
            part, members, lines = f"{folder}/_{uuid.uuid4().hex}.part", 0, 0
            with system.open_output_stream(part) as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
                for (inner, size), of_member in itertools.groupby(of_archive, key=lambda r: r[1:3]):
                    info = tarfile.TarInfo(inner)
                    info.size = size
                    counted = itertools.count(1)
                    tar.addfile(info, _Feed(r[3] for r in of_member if next(counted)))
                    members, lines = members + 1, lines + next(counted) - 1
            system.move(part, f"{folder}/{name}.tar.gz")
            yield pa.record_batch({"archive": [name], "members": pa.array([members]), "lines": pa.array([lines])})

    written = dealt.select("archive", "member", "size", "line").mapInArrow(run, "archive string, members bigint, lines bigint")
    return materialize(written, "archives")


def member_keys(df: DataFrame, filename: str = "filename") -> DataFrame:
    """``run_date`` and ``suite`` from the member's file name."""
    base = file_stem(F.col(filename))
    return df.withColumns({"run_date": archive_date(base), "suite": archive_suite(base)})


def write_partitioned(df: DataFrame, path: str) -> None:
    """Parquet laid out as ``run_date=…/suite=…``.

    Rows are spread by (date, suite, slice of the file's lines), so one large
    suite is written by many tasks, yet small suites do not scatter into many files.
    """
    spread = ["run_date", "suite"]
    if {"filename", "line_number"} <= set(df.columns):
        spread += [F.col("filename"), F.floor(F.col("line_number") / 1_000_000)]
    df.repartition(*spread).write.mode("overwrite").partitionBy("run_date", "suite").parquet(path)
