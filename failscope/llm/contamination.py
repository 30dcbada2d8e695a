"""Benchmark decontamination: edit-tolerant search by embedding and bit sampling.

Texts and items are sequences of words (lower-cased, punctuation parts them).  An item
leaks if some stretch of a text is within ``RATE`` of its words in edit distance.

* Windows have the size of an item.  By the pigeonhole principle a leak shares a run of
  ``gram`` words with the item (at most three; fewer for short items), so the windows
  are those that line up with such a shared run; no leak is lost by that.
* A window is embedded by the CGK random walk: each step
  emits the current word and moves on or not by a random bit of (walk, step, word).  Few
  edits then mean few differing steps.
* Bit-sampling LSH: each of ``WALKS`` walks has ``SAMPLES`` tables, keyed by ``BITS`` sampled
  steps.  Only steps at which a walk is still inside its window are sampled, as a walk
  that has left it says nothing but the size.  The target is to find 0.99 of the leaks
  with random edits of 20 % of their words, for items of 5 to 200 words.
* Candidates are verified by exact edit distance with free ends, vectorised, in slices.

Items are searched in blocks of ``BLOCK``, whose tables are all that the tasks get; the
texts are read once for each block and never shuffled.

Defined cases: a null or empty text holds nothing; an item without a word is never
found; equal items are found each; repeated rows of an id give one row for each item
with the least edits; null ids are kept as null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T

RATE = 0.2
WALKS, SAMPLES, BITS = 9, 16, 2
MARGIN = 3.0
BLOCK = 4096
SLICE, MATCHES = 1 << 16, 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAD = np.uint64(0)


def tokens(column: pa.Array | np.ndarray, off: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the rows' bounds."""
    buf, off = T.buffers(column) if off is None else (column, off)
    low = T.LOWER[buf]
    starts, ends = T.spans(_WORD[low], off)
    row = T.rows_of(starts, off)
    return T.range_hash(T.prefix_hash(low), starts, ends), np.r_[0, np.cumsum(np.bincount(row, minlength=len(off) - 1))]


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    out = T.mix(word[:max(len(word) - n + 1, 0)] + np.uint64(n))
    for k in range(1, n):
        out = T.mix(out * np.uint64(0x9E3779B97F4A7C15) + word[k:len(word) - n + 1 + k])
    return out


def steps_of(size: np.ndarray) -> np.ndarray:
    """Steps of a walk that are sampled: those below ``size`` never leave the window, further ones only beyond ``MARGIN`` deviations."""
    far = ((np.sqrt(MARGIN * MARGIN + 8.0 * size) - MARGIN) / 2) ** 2
    return np.maximum(size, far.astype(np.int64))


def signatures(word: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """LSH keys (windows by tables) of the windows; words beyond a window, or outside of ``word``, are padding."""
    n = len(start)
    out = np.empty((n, WALKS * SAMPLES), np.uint64)
    steps = steps_of(size)
    padded = np.r_[word, _PAD]
    most = int(steps.max()) if n else 0
    for walk in range(WALKS):
        # Sampled steps are a fraction of the window's steps, the same for all windows of a size.
        u = T.mix(np.arange(SAMPLES * BITS, dtype=np.uint64) + np.uint64(1000 * walk + 17)) >> np.uint64(32)
        at = ((u[None, :] * steps[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        seen = np.zeros((n, SAMPLES * BITS), np.uint64)
        place = np.zeros(n, np.int64)
        last = at.max(axis=1) if n else place
        live = np.arange(n)
        for t in range(most):
            live = live[last[live] >= t]
            if not len(live):
                break
            p = place[live]
            absolute = start[live] + p
            inside = (p < size[live]) & (absolute >= 0) & (absolute < len(word))
            x = np.where(inside, padded[np.where(inside, absolute, len(word))], _PAD)
            hit = at[live] == t
            if hit.any():
                r, c = np.nonzero(hit)
                seen[live[r], c] = x[r]
            place[live] += (T.mix(x + np.uint64((walk << 32) + t + 1)) >> np.uint64(63)).astype(np.int64)
        for k in range(SAMPLES):
            key = T.mix(size.astype(np.uint64) * np.uint64(64) + np.uint64(walk * SAMPLES + k + 1))
            for b in range(BITS):
                key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[:, k * BITS + b])
            out[:, walk * SAMPLES + k] = key
    return out


def edits(word: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], items: np.ndarray, item_bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Least edit distance of each item to a stretch within its range of ``word``.

    ``bounds`` and ``item_bounds`` are starts and ends of the ranges.
    """
    lo, hi = bounds
    a, b = item_bounds
    out = np.zeros(len(lo), np.int64)
    order = np.argsort(b - a, kind="stable")
    for chunk in np.array_split(order, max(1, len(order) // 2048)):
        if not len(chunk):
            continue
        width, height = int((hi - lo)[chunk].max()), int((b - a)[chunk].max())
        col = np.arange(width)
        inside = col[None, :] < (hi - lo)[chunk][:, None]
        text = np.where(inside, np.r_[word, _PAD][np.minimum(lo[chunk][:, None] + col, len(word))], np.uint64(1))
        row = np.zeros((len(chunk), width + 1), np.int32)
        far = np.int32(1 << 20)
        ramp = np.arange(width + 1, dtype=np.int32)
        for i in range(height):
            live = a[chunk] + i < b[chunk]
            letter = items[np.where(live, a[chunk] + i, 0)]
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + 1
            new[:, 1:] = np.minimum(row[:, :-1] + (text != letter[:, None]), row[:, 1:] + 1)
            new[:, 1:][~inside] = far
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
            row = np.where(live[:, None], new, row)
        row[:, 1:][~inside] = far
        out[chunk] = row.min(axis=1)
    return out


@dataclass
class Index:
    """Tables of one block of items."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    allowed: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, item, offset in it
    keys: np.ndarray
    owner: np.ndarray


def index(texts: list[str | None], rate: float = RATE) -> Index:
    word, bounds = tokens(pa.array(texts, pa.string()))
    start, end = bounds[:-1], bounds[1:]
    size = end - start
    allowed = np.floor(rate * size + 1e-9).astype(np.int64)
    run = np.minimum(3, -(-(size - allowed) // (allowed + 1)))
    tables = []
    for n in (1, 2, 3):
        own = np.flatnonzero((run == n) & (size > 0))
        at = np.concatenate([np.arange(start[i], end[i] - n + 1) for i in own]) if len(own) else np.zeros(0, np.int64)
        item = np.repeat(own, (size[own] - n + 1))
        h = grams(word, n)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        tables.append((h[order], item[order], (at - start[item])[order]))
    filled = np.flatnonzero(size > 0)
    sig = signatures(word, start[filled], size[filled])
    keys, owner = sig.ravel(), np.repeat(filled, sig.shape[1])
    order = np.argsort(keys, kind="stable")
    return Index(word, start, end, allowed, tables, keys[order], owner[order])


def _matches(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in keys, position in sorted_keys) of equal keys."""
    left = np.searchsorted(sorted_keys, keys)
    near = np.flatnonzero(sorted_keys[np.minimum(left, len(sorted_keys) - 1)] == keys) if len(sorted_keys) else np.zeros(0, np.int64)
    left = left[near]
    count = np.searchsorted(sorted_keys, keys[near], side="right") - left
    a = np.repeat(near, count)
    return a, np.repeat(left, count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)


def search(buf: np.ndarray, off: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, item, edits and first word of the stretch looked at, for each leak."""
    word, bounds = tokens(buf, off)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    starts, sizes, rows = [], [], []
    for n, (h, item, offset) in zip((1, 2, 3), ix.grams):
        if len(h) and len(word) >= n:
            at, k = _matches(h, grams(word, n))
            whole = row_of[at] == row_of[at + n - 1]
            at, k = at[whole], k[whole]
            starts.append(at - offset[k])
            sizes.append((ix.end - ix.start)[item[k]])
            rows.append(row_of[at])
    none = np.zeros(0, np.int64)
    if not starts:
        return none, none, none, none
    start, size, row = (np.concatenate(x) for x in (starts, sizes, rows))
    # Windows, each once; what lies outside of the row is padding.
    order = np.lexsort((size, start, row))
    start, size, row = start[order], size[order], row[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (size[1:] != size[:-1]) | (row[1:] != row[:-1])] if len(start) else np.zeros(0, bool)
    start, size, row = start[new], size[new], row[new]
    parts = [_verified(word, bounds, (start[i:i + SLICE], size[i:i + SLICE], row[i:i + SLICE]), ix) for i in range(0, len(start), SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (none, none, none, none)


def _verified(word: np.ndarray, bounds: np.ndarray, windows: tuple[np.ndarray, ...], ix: Index) -> tuple[np.ndarray, ...]:
    """``search`` of some windows: their candidates by exact edit distance, about ``MATCHES`` at a time."""
    start, size, row = windows
    sig = signatures(word, start, size)
    met = (np.searchsorted(ix.keys, sig.ravel(), side="right") - np.searchsorted(ix.keys, sig.ravel())).reshape(sig.shape).sum(axis=1)
    part = np.cumsum(met) // MATCHES
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(start)]
    out = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        w, k = _matches(ix.keys, sig[i:j].ravel())
        # Each window and item once.
        w, item = np.divmod(np.unique((i + w // sig.shape[1]) * len(ix.start) + ix.owner[k]), len(ix.start))
        r, slack = row[w], ix.allowed[item] + 1
        lo = np.maximum(start[w] - slack, bounds[r])
        hi = np.minimum(start[w] + (ix.end - ix.start)[item] + slack, bounds[r + 1])
        cost = edits(word, (lo, np.maximum(hi, lo)), ix.word, (ix.start[item], ix.end[item]))
        good = cost <= ix.allowed[item]
        out.append((r[good], item[good], cost[good], (lo - bounds[r])[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks(benchmark: DataFrame, key: str, block: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, ``block`` at a time."""
    n = benchmark.count()
    parts = max(1, -(-n // block))
    numbered = benchmark.select(key, "text", F.pmod(F.xxhash64(key, "text"), F.lit(parts)).alias("part"))
    for p in range(parts if n else 0):
        rows = sorted(((r[0], r[1]) for r in numbered.where(F.col("part") == p).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """key, item key, edits and at_word (where in the text) of each leak."""
    kind, item_kind = documents.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind.simpleString()]
    schema = f"key {kind}, item {item_kind.simpleString()}, edits bigint, at_word bigint"
    out = documents.sparkSession.createDataFrame([], schema)
    for ids, texts in _blocks(benchmark, item_key, block):
        ix = index(texts, rate)

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, ix: Index = ix) -> Iterator[pa.RecordBatch]:
            names = pa.array(ids, arrow_kind)
            for batch in batches:
                buf, off = T.buffers(batch.column(1))
                for i, j in T.portions(off):
                    row, item, cost, at = search(buf[off[i]:off[j]], off[i:j + 1] - off[i], ix)
                    yield pa.record_batch([batch.column(0).take(pa.array(row + i)), names.take(pa.array(item)), pa.array(cost), pa.array(at)],
                                          names=["key", "item", "edits", "at_word"])

        out = out.unionByName(documents.select(key, "text").mapInArrow(run, schema))
    best = out.groupBy("key", "item").agg(F.min(F.struct("edits", "at_word")).alias("best"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item_key), "best.edits", "best.at_word")


def without_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows without a leak, with all their columns; one pass for each block of items."""
    at = documents.columns.index("text")
    out = documents
    for _, texts in _blocks(benchmark, "item_id", block):
        ix = index(texts, rate)

        def run(batches: Iterator[pa.RecordBatch], ix: Index = ix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, off = T.buffers(batch.column(at))
                clean = np.ones(len(batch), bool)
                for i, j in T.portions(off):
                    clean[i + search(buf[off[i]:off[j]], off[i:j + 1] - off[i], ix)[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
