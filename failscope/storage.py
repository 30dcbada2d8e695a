"""Cutting lineage with a table written to the cluster's shared folder.

The folder is the one the session names in ``spark.checkpoint.dir``, else one below its
warehouse; both are shared by driver and executors.  Tables of a run lie in a folder of
their own, which :func:`release` removes.  A table
(rather than an RDD checkpoint) keeps column pruning and file statistics for
the readers, and survives the loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_RUN = f"run-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/failscope/{_RUN}"


def release(spark: SparkSession) -> None:
    """Remove the tables of this run; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runs what is inside under these settings of the session."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, label: str = "stage", by: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so later branches see one fixed result.

    The shuffle files of the write are freed at its end, as nothing reads them again.
    ``by``: a column whose values get a folder each, so that they are read and dropped alone.
    ``options``: of the writer.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"}):
        write = df.write.mode("errorifexists").options(**(options or {}))
        (write.partitionBy(by) if by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame, part: str | None = None) -> None:
    """Free the disk of a table that :func:`materialize` gave, once nothing reads it any more.

    Its folder is written over with no rows, which needs no file system beside Spark's own.
    ``part``: only the folder of this value, as ``column=value``.
    """
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if f"/{_RUN}/" in path and (part is None or path.endswith(f"/{part}")):
            column = path.rsplit("/", 1)[1].partition("=")
            kept = [x for x in df.schema if not (column[1] and x.name == column[0])]
            df.sparkSession.createDataFrame([], StructType(kept)).write.mode("overwrite").parquet(path)


SMALL_INPUT = 1 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores on an input that is too small to come in enough splits.

    A larger input is returned as it is: its splits are enough, and a shuffle of
    it would cost more than it gives.
    """
    if estimated_bytes(df) > SMALL_INPUT:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def by_content(df: DataFrame) -> DataFrame:
    """Rows dealt by a hash of their values, for fits whose bagging depends on the layout.

    The layout then depends on the rows and ``spark.sql.shuffle.partitions`` alone, not on
    the files, the size or the cores.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind != "vector"]))


def estimated_bytes(df: DataFrame) -> int:
    """Size of the inputs of the plan.

    The estimate for the whole plan is of no use here: without column
    statistics Spark multiplies the sizes of the two sides of a join.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def sized(df: DataFrame) -> DataFrame:
    """Give the planner the true size of a small result of a large input.

    Without column statistics Spark takes an aggregate to be about as large as
    its input, so a join with it starts by shuffling the large side.  Written
    first, its file size is known, and the join is broadcast if (and only if)
    it is below ``spark.sql.autoBroadcastJoinThreshold``.  The aggregate has to
    be computed either way.  Small inputs stay lazy.
    """
    return materialize(df, "sized") if estimated_bytes(df) > SMALL_INPUT else df


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A few constant rows as a frame that needs no Python worker."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
