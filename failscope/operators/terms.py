"""TF-IDF with a vocabulary that stays a table.

The dictionary and the ids of the terms are relations: no task and no driver holds the
vocabulary, so its size has no bound but that of a vector (2^31 - 1).  Ids follow the falling
number of occurrences, then the term.  Terms are counted where the text is read, in blocks of
about ``BLOCK_TERMS`` terms that hold each different term once and the rows' terms as numbers;
only a block's different terms are dealt by term, to get their ids and weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators.ordered import global_row_number
from failscope.operators.vectors import term_stages
from failscope.storage import materialize, spread_small

_ROW = "__row"
BLOCK_TERMS = 1 << 18


def term_blocks(rows: DataFrame, text: str, bigrams: bool, stop_words: Sequence[str]) -> DataFrame:
    """Blocks of rows: rows and size (their ids and numbers of different terms), at and n (place and number of each of these, row by
    row), terms, total and having (the different terms of the block, their occurrences and the rows that have them)."""
    stages, terms = term_stages(text, bigrams, stop_words)
    filled = rows.select(_ROW, F.coalesce(F.col(text), F.lit("")).alias(text))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, lists = table.column(0).to_numpy(), table.column(1).chunk(0)
        row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        coded = lists.flatten().dictionary_encode()
        width = max(len(coded.dictionary), 1)
        key, n = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
        row, at = key // width, key % width
        place, size = np.unique(row, return_counts=True)
        columns = {"rows": (ids[place], pa.int64()), "size": (size, pa.int32()), "at": (at, pa.int32()), "n": (n, pa.int32()),
                   "terms": (coded.dictionary, pa.string()), "total": (np.bincount(at, n, len(coded.dictionary)), pa.int64()),
                   "having": (np.bincount(at, minlength=len(coded.dictionary)), pa.int64())}
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(kind))
        return pa.record_batch({name: one(x, kind) for name, (x, kind) in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())]
            i = 0
            while i < len(batch):
                j = min(len(batch), max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_TERMS - many, side="right")) - 1))
                held.append(batch.slice(i, j - i))
                many += int(ends[j] - ends[i])
                if many >= BLOCK_TERMS or j < len(batch):
                    yield block(held)
                    held, many = [], 0
                i = j
        if many:
            yield block(held)

    packed = PipelineModel(stages=stages).transform(filled).select(_ROW, terms).mapInArrow(
        run, "rows array<bigint>, size array<int>, at array<int>, n array<int>, terms array<string>, total array<bigint>, having array<bigint>")
    return packed.select(F.monotonically_increasing_id().alias("block"), "*")


def dictionary(blocks: DataFrame, max_features: int | None = None) -> DataFrame:
    """id, term, rows (that have it): all terms, or the ``max_features`` with most occurrences."""
    counts = blocks.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("total").alias("n"), F.col("having").alias("rows"))))
    found = counts.toDF("term", "n", "rows").groupBy("term").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    placed = global_row_number(found, [-F.col("n"), F.col("term")], "id")
    kept = placed if max_features is None else placed.where(F.col("id") <= max_features)
    return kept.select((F.col("id") - 1).cast("int").alias("id"), "term", "rows")


def _vectors(size: int):
    """Sorted arrays of ids and weights as sparse vectors of length one; null arrays as empty ones."""

    @F.arrow_udf(VectorUDT())
    def run(ids: pa.Array, weights: pa.Array) -> pa.Array:
        many = pc.fill_null(pc.list_value_length(weights), 0).to_numpy()
        bounds = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
        row, w = np.repeat(np.arange(len(many)), many), weights.flatten().to_numpy(zero_copy_only=False)
        w = w / np.sqrt(np.bincount(row, w * w, len(many)))[row]
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(len(ids), np.int8)), pa.array(np.full(len(ids), size, np.int32)), pa.ListArray.from_arrays(bounds, ids.flatten()),
             pa.ListArray.from_arrays(bounds, pa.array(w))], names=["type", "size", "indices", "values"])

    return run


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of the blocks that has a term of the dictionary: the sorted ids of its terms, and their weights."""
    lists = lambda bounds, values, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
    for batch in batches:
        for k in range(len(batch)):
            rows, size, at, n, pos, ids, idf = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(7))
            width = int(max(at.max(initial=-1), pos.max(initial=-1))) + 1
            id_of, idf_of = np.full(width, -1, np.int64), np.zeros(width)
            id_of[pos], idf_of[pos] = ids, idf
            row, ids, weight = np.repeat(np.arange(len(rows)), size), id_of[at], n * idf_of[at]
            kept = np.flatnonzero(ids >= 0)
            kept = kept[np.lexsort((ids[kept], row[kept]))]
            place, many = np.unique(row[kept], return_counts=True)
            bounds = np.r_[0, np.cumsum(many)]
            yield pa.record_batch([pa.array(rows[place], pa.int64()), lists(bounds, ids[kept], pa.int32()), lists(bounds, weight[kept], pa.float64())],
                                  names=[_ROW, "__ids", "__weights"])


def tfidf_unbounded(df: DataFrame, text: str, max_features: int | None = None, bigrams: bool = True, output: str = "tfidf",
                    stop_words: Sequence[str] = K.SPARK_STOP_WORDS) -> DataFrame:
    """Smoothed TF-IDF with L2 norm of every row of ``df``; a null or empty text has the zero vector."""
    # The row ids are only meaningful within one reading of the input.
    rows = materialize(spread_small(df).withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    blocks = materialize(term_blocks(rows, text, bigrams, stop_words), "blocks")
    terms = materialize(dictionary(blocks, max_features), "dictionary")
    many, size = rows.count(), terms.count()
    idf = F.log((1.0 + many) / (1.0 + F.col("rows"))) + 1.0
    # Written, the dictionary has its true size: the planner sends it to the tasks if it is small, else deals both
    # sides by term, a frequent one's blocks in several parts.
    asked = blocks.select("block", F.posexplode("terms").alias("pos", "term")).join(terms.select("term", "id", idf.alias("idf")), "term")
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("pos", "id", "idf")).alias("a")).select(
        "block", F.col("a")["pos"].alias("pos"), F.col("a")["id"].alias("id"), F.col("a")["idf"].alias("idf"))
    arrays = blocks.select("block", "rows", "size", "at", "n").join(answers, "block").drop("block").mapInArrow(
        _weighted, f"{_ROW} bigint, __ids array<int>, __weights array<double>")
    return rows.join(arrays, _ROW, "left").withColumn(output, _vectors(size)("__ids", "__weights")).select(*df.columns, output)
