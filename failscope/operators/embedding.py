"""Message embeddings from word co-occurrence, fitted in parallel.

Words that stand near the same words get near vectors: co-occurrence counts within a window
become a softened, shifted PMI matrix, ln(1 + n(w, c) N / (n(w) n(c) shift)), whose leading
singular vectors, found by block power iteration, are the word vectors.

The matrix stays a table of entries, dealt once into cells of at most ``CELL`` entries: a
block of columns (words by their hash), and slices of it by row where hot words make it
long.  An iteration brings each cell the vectors of its block, multiplies, and sums the
rows of all cells while streaming over sorted partials.  The driver sees width x width
numbers only (the Gram matrix that makes the block orthogonal); neither it nor any task
holds the vocabulary.  Each iteration ends in a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.storage import drop, materialize

WINDOW, ITERATIONS, SHIFT = 5, 6, 1.0
BLOCK_WORDS, CELL = 1024, 1 << 17
_TINY = 1e-12


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+"), lambda w: w != "")


def cooccurrence(messages: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, col and n: how often two words (by hash) stand within the window of each other.

    ``messages`` has distinct arrays ``words`` and how often each comes (``n``).  The only word
    of a message stands with itself, so that no word is left without an entry.
    """
    at = messages.select("words", "n", F.posexplode("words").alias("i", "word"))
    earlier = F.slice("words", F.greatest(F.col("i") + 1 - window, F.lit(1)), F.least(F.lit(window), F.col("i")))
    later = F.slice("words", F.col("i") + 2, F.lit(window))
    near = F.when(F.size("words") > 1, F.concat(earlier, later)).otherwise(F.col("words"))
    pairs = at.select(F.xxhash64("word").alias("row"), F.explode(near).alias("other"), "n")
    return pairs.groupBy("row", F.xxhash64("other").alias("col")).agg(F.sum("n").alias("n"))


def association(counts: DataFrame, shift: float = SHIFT) -> DataFrame:
    """row, col and value: the softened PMI of the counts; positive, so that every word keeps a vector."""
    total = counts.groupBy(F.col("row").alias("id")).agg(F.sum("n").alias("s"))
    whole = counts.agg(F.sum("n")).first()[0] or 1
    left = counts.join(total.select(F.col("id").alias("row"), F.col("s").alias("a")), "row")
    both = left.join(total.select(F.col("id").alias("col"), F.col("s").alias("b")), "col")
    ratio = F.col("n") * F.lit(float(whole)) / (F.col("a").cast("double") * F.col("b") * shift)
    return both.select("row", "col", F.log1p(ratio).alias("value"))


def _part(column: str, blocks: int) -> Column:
    return F.pmod(F.col(column), F.lit(blocks)).cast("int")


def dealt(entries: DataFrame, blocks: int, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """The entries with their cell (part, slice), and the slices of each part, both written."""
    rows = entries.withColumn("part", _part("col", blocks))
    slices = materialize(rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("slices")), "slices")
    cells = rows.join(slices, "part").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).drop("slices")
    return materialize(cells, "cells"), slices


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel()))


def product(cells: DataFrame, slices: DataFrame, vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """id and v: the matrix of the dealt entries times the vectors (part, id, v), each turned by a width x width matrix first."""
    width = len(turn)

    def multiply(cell: pa.Table, block: pa.Table) -> pa.Table:
        ids = block["id"].to_numpy()
        order = np.argsort(ids)
        known = _matrix(block["v"], width)[order] @ turn
        rows, own = np.unique(cell["row"].to_numpy(), return_inverse=True)
        by_row = np.argsort(own, kind="stable")
        own, at, value = own[by_row], np.searchsorted(ids[order], cell["col"].to_numpy()[by_row]), cell["value"].to_numpy()[by_row]
        out = np.zeros((len(rows), width))
        for i in range(0, len(own), 1 << 16):
            mine = own[i:i + (1 << 16)]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            out[mine[first]] += np.add.reduceat(value[i:i + (1 << 16), None] * known[at[i:i + (1 << 16)]], first, axis=0)
        return pa.table({"id": pa.array(rows), "v": _lists(out)})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(width)
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            if not len(ids):
                continue
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sums, keys = np.add.reduceat(v, first, axis=0), ids[first]
            if last is not None:
                if keys[0] == last:
                    sums[0] += held
                else:
                    keys, sums = np.r_[last, keys], np.vstack([held, sums])
            last, held = keys[-1], sums[-1]
            yield pa.record_batch({"id": pa.array(keys[:-1]), "v": _lists(sums[:-1])})
        if last is not None:
            yield pa.record_batch({"id": pa.array([last]), "v": _lists(held[None, :])})

    spread = vectors.join(slices, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "v")
    partial = cells.groupBy("part", "slice").cogroup(spread.groupBy("part", "slice")).applyInArrow(multiply, "id bigint, v array<double>")
    return partial.repartition("id").sortWithinPartitions("id").mapInArrow(summed, "id bigint, v array<double>")


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum over all rows of v times its transpose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _matrix(batch.column(0), width)
            total += v.T @ v
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.record_batch({"i": pa.array(i.ravel()), "j": pa.array(j.ravel()), "x": pa.array(total.ravel())})

    found = vectors.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((width, width))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["x"].to_numpy()
    return (out + out.T) / 2


def _spectrum(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues, greatest first; what is zero up to rounding counts as zero."""
    value, vector = np.linalg.eigh(square)
    value, vector = value[::-1], vector[:, ::-1]
    return vector, np.where(value > _TINY * max(value[0], _TINY), value, 0.0)


def _powered(value: np.ndarray, power: float) -> np.ndarray:
    return np.where(value > 0, np.where(value > 0, value, 1.0) ** power, 0.0)


def word_vectors(messages: DataFrame, width: int = 100, window: int = WINDOW, iterations: int = ITERATIONS, seed: int = 42,
                 shift: float = SHIFT) -> tuple[DataFrame, np.ndarray, int]:
    """A written table of vectors (part, id, v), the width x width matrix that turns them into word vectors, and the number of blocks."""
    counts = materialize(cooccurrence(messages, window), "cooccurrence")
    words = counts.select("col").distinct()
    blocks = max(1, -(-words.count() // BLOCK_WORDS))
    cells, slices = dealt(association(counts, shift), blocks)
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.xxhash64(F.lit(seed), "id", j) / 2.0**63)
    now = materialize(words.select(F.col("col").alias("id")).select(_part("id", blocks).alias("part"), "id", start.alias("v")), "vectors")
    turn = np.eye(width)
    for _ in range(iterations):
        after = materialize(product(cells, slices, now, turn).select(_part("id", blocks).alias("part"), "id", "v"), "vectors")
        drop(now)
        now = after
        vector, value = _spectrum(gram(now, width))
        turn = vector * _powered(value, -0.5)
    # The last block is M Q with Q orthogonal, so the roots of the Gram's values are singular values of M.
    return now, vector * _powered(value, -0.25), blocks


def message_vectors(df: DataFrame, text: str, width: int = 100, window: int = WINDOW, iterations: int = ITERATIONS, seed: int = 42,
                    output: str = "embedding") -> DataFrame:
    """Embedding of each message as the mean of its word vectors, fitted on the messages themselves.

    Equal messages are fitted once, by their number.  A message without a word has the zero
    vector; a row's other columns are kept as they are.
    """
    texts = df.select(F.col(text).alias("message")).where("message IS NOT NULL").groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    messages = materialize(texts.select("message", F.xxhash64("message").alias("row"), words_of("message").alias("words"), "n")
                           .where(F.size("words") > 0), "messages")
    vectors, turn, blocks = word_vectors(messages.select("words", "n"), width, window, iterations, seed)
    share = messages.select("row", F.size("words").alias("size"), F.explode("words").alias("word")).groupBy(
        "row", F.xxhash64("word").alias("col")).agg((F.count(F.lit(1)) / F.first("size")).alias("value"))
    cells, slices = dealt(share, blocks)
    means = product(cells, slices, vectors, turn).select(F.col("id").alias("row"), F.col("v").alias("__v"))
    found = materialize(messages.select(F.col("message").alias("__message"), "row").join(means, "row").drop("row"), "message-vectors")
    zero = F.array_repeat(F.lit(0.0), width)
    return df.join(found, F.col(text) == F.col("__message"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce("__v", zero).alias(output))
