"""Target-distribution importance resampling over hashed word n-grams.

Features are the runs of one to three words of a text, hashed into ``BUCKETS`` buckets.
The gain of a bucket is the log ratio of its smoothed share in the target texts and in
the raw ones, in thousandths; a text's weight is the sum over its features, taken from
the array of gains.  A Gumbel number from the hash of the id is added, and the rows with
the highest sums are a sample without replacement in proportion to the weights.  Their
ranks come from the radix sort of ``radix``, by the composite key (score, id, features).

The checksum of a run of words is put together from those of its words: appending a word
of n bytes is a linear map of the checksum, kept as a table for each n up to ``LONG``; runs
with a longer word are hashed whole.  Texts are read twice (counting, scoring) and never
shuffled; a counting task sends one row for each bucket.  Before the sort a histogram of
the scores drops the rows that cannot be drawn, exactly.

Defined cases: a null or empty text has no features and weight 0; a null id takes the hash
of ``42:`` and comes after all others in a tie; repeated rows are rows of their own; ties
in score and id go by the number of features; without raw rows the result is empty,
without target texts every gain compares with an empty target.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.llm.radix import sort_places
from failscope.storage import drop, materialize

BUCKETS = 10_000
LONG = 64
LEAST_WORDS, PERCENT = 20, 5
SEED = "42"
SCORE_BINS = 1 << 14
FULL = np.uint32(0xFFFFFFFF)

#: Digits, lower-case letters and all that is not ASCII make up words.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _fed(state: np.ndarray, byte: np.ndarray | int, table: np.ndarray) -> np.ndarray:
    """The running checksum after one more byte."""
    return table[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's byte table, and for each length the images of the four state bytes under so many zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    shifts = np.empty((LONG + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONG):
        shifts[n + 1] = _fed(shifts[n], 0, byte)
    return byte, shifts


def _shifted(state: np.ndarray, length: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    flat = shifts.ravel()
    at = length * 1024
    out = flat[at + (state & np.uint32(255))]
    for i in (1, 2, 3):
        out ^= flat[at + 256 * i + ((state >> np.uint32(8 * i)) & np.uint32(255))]
    return out


def checksums(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of each row; the checksums of the runs of 1, 2 and 3 words from each word on; the number of words left in its row.

    A checksum counts only where so many words are left.
    """
    byte, shifts = tables()
    low = T.LOWER[buf]
    starts, ends = T.spans(WORD[low], off)
    row = T.rows_of(starts, off)
    n_words = np.bincount(row, minlength=len(off) - 1).astype(np.int64)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(row))
    length = ends - starts
    long = length > LONG
    own, live, k = np.zeros(len(starts), np.uint32), np.flatnonzero(~long), 0
    while len(live):
        own[live] = _fed(own[live], low[starts[live] + k], byte)
        k += 1
        live = live[length[live] > k]
    span, runs = np.where(long, 0, length), []
    state = np.full(len(starts), FULL)
    hard = np.zeros(len(starts), bool)
    for size in (1, 2, 3):
        word = np.minimum(np.arange(size - 1, size - 1 + len(starts)), len(starts) - 1)
        if size > 1:
            state = _fed(state, np.uint32(32), byte)
        state = _shifted(state, span[word], shifts) ^ own[word]
        hard |= long[word]
        out = state ^ FULL
        for i in np.flatnonzero(hard & (left >= size)):
            out[i] = zlib.crc32(b" ".join(low[starts[j]:ends[j]].tobytes() for j in range(i, i + size)))
        runs.append(out)
    return n_words, runs, left


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = T.buffers(batch.column(0))
            for i, j in T.portions(off):
                _, runs, left = checksums(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                for size, crc in enumerate(runs, 1):
                    total += np.bincount(crc[left >= size] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    found = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in thousandths, rounded down."""
    s, t = raw.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features and weight of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(1))
            for i, j in T.portions(off):
                n, runs, left = checksums(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                each = sum(np.where(left >= size, gain[crc % np.uint32(len(gain))], 0) for size, crc in enumerate(runs, 1))
                total = np.r_[0, np.cumsum(each)]
                last = np.cumsum(n)
                features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n), pa.array(features), pa.array(total[last] - total[last - n])],
                                      names=["key", "n_words", "n_features", "weight"])

    return documents.select(key, "text").mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """place and rank of the highest ``percent`` of the rows (place, key, n_features, score) by score, ties by key."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    take = percent * n // 100
    width = -(-((high or 0) - (low or 0) + 1) // SCORE_BINS)
    level = ((F.lit(high or 0).cast("long") - F.col("score")) / width).cast("int")
    counted = rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("level")
    reached = np.searchsorted(np.cumsum(counted["n"].to_numpy()), take)
    bound = counted["level"].to_numpy()[min(reached, len(counted) - 1)] if len(counted) else 0
    picked = rows.where(level <= int(bound)) if take else rows.where("false")
    least = F.col("key").isNull().cast("long").alias("no_key")
    picked = picked.select("place", F.col("place").alias("row"), (-F.col("score")).alias("fall"), least,
                           F.coalesce(F.col("key").cast("long"), F.lit(0).cast("long")).alias("key"), "n_features")
    ranked = sort_places(picked, ["fall", "no_key", "key", "n_features"])
    return ranked.where(F.col("place") < take).select(F.col("row").alias("place"), (F.col("place") + 1).alias("rank"))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
             buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score and rank (null: not drawn) of each row; the key is a whole number."""
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed(documents, gain, key).select(
        "*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("place")), "weighed")
    ranks = drawn(scored.where(F.col("n_words") >= least_words).select("place", "key", "n_features", "score"), percent)
    return scored.join(ranks, "place", "left").select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
