"""Quality rules: boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows and flattened into node
arrays; a pass over the documents computes the statistics and scores a whole Arrow
batch at once.  Nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rule; a row
repeated in the input is judged twice; labels that are null or belong to no document
are left out; without labels of both kinds the trees keep everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T

FIT_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature, and the direction in which the quality may move when it grows (0: free).
FEATURES = {
    "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1, "bang_share": -1, "bar_share": -1, "upper_share": 0,
    "digit_share": 0, "stop_share": 0, "mean_word": 0, "distinct_share": 0, "log_words": 0,
}


def _lut(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL, _BANG, _BAR, _STOP = _lut(SYMBOLS), _lut(b"!"), _lut(b"|"), _lut(b".,;:")
_UPPER, _DIGIT = _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58)))


def _statistics_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    starts, ends, row = T.words(buf, off)
    prefix = T.prefix_hash(buf)
    word = T.range_hash(prefix, starts, ends)
    salt = T.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    n_words = np.bincount(row, minlength=n)
    chars = T.counts(((buf & 0xC0) != 0x80) & ~T.SPACE[buf], off)
    symbols = T.counts(_SYMBOL[buf], off)

    distinct = np.bincount(row[T.repeats(word ^ salt[row])[1]], minlength=n)

    repeated = np.zeros(len(word), bool)
    if len(word) >= 3:
        at = np.flatnonzero(row[2:] == row[:-2])
        key = T.mix(T.mix(word[at] * np.uint64(3) + word[at + 1]) * np.uint64(5) + word[at + 2]) ^ salt[row[at]]
        twice = at[T.repeats(key)[0] > 1]
        for k in range(3):
            repeated[twice + k] = True
    n_repeat = np.bincount(row[repeated], minlength=n)

    first, last, line_row = T.lines(buf, off)
    inked = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~T.SPACE[buf], out=inked[1:])
    full = inked[last] > inked[first]
    first, last, line_row = first[full], last[full], line_row[full]
    again = ~T.repeats(T.range_hash(prefix, first, last) ^ salt[line_row])[1]
    n_dup = np.bincount(line_row[again], minlength=n)

    one, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    features = np.column_stack([
        symbols / one, n_repeat / w, n_dup / np.maximum(np.bincount(line_row, minlength=n), 1),
        T.counts(_BANG[buf], off) / w, T.counts(_BAR[buf], off) / w, T.counts(_UPPER[buf], off) / one,
        T.counts(_DIGIT[buf], off) / one, T.counts(_STOP[buf], off) / w, chars / w, distinct / w, np.log1p(n_words),
    ])
    return np.column_stack([n_words, chars, symbols, n_dup, n_repeat]).astype(np.int64), features


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (``BASE_COLUMNS``) and features (``FEATURES``) of each text."""
    buf, off = T.buffers(column)
    parts = [_statistics_of(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in T.portions(off)]
    if not parts:
        return np.zeros((0, len(BASE_COLUMNS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row."""
        total = np.full(len(x), self.start)
        if len(self.roots):
            for i in range(0, len(x), 4096):
                part = x[i:i + 4096]
                node = np.tile(self.roots, (len(part), 1))
                rows = np.arange(len(part))[:, None]
                for _ in range(self.depth):
                    node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                total[i:i + 4096] += self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Newton boosting on the logistic loss, with monotonic constraints.

    A split on a constrained feature must order the values of its sides, and both
    subtrees are held on their side of the middle between them.
    """
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    if not len(y) or y.min() == y.max():
        start = 50.0 if not len(y) or y.min() == 1 else -50.0
        return Trees(*[np.zeros(0, np.int64)] * 2, *[np.zeros(0)], *[np.zeros(0, np.int64)] * 2, np.zeros(0), start, 0)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])])
    margin = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gain_best, found = 1e-9, None
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        own = len(nodes)
        nodes.append([0, np.inf, own, own, rate * value])
        if level < depth and len(rows) >= 2 * least:
            for f, direction in enumerate(directions):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least) | (direction * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > gain_best:
                    gain_best, found = float(gain[k]), (f, k, float(vl[k]), float(vr[k]))
        if found is None:
            margin[rows] += rate * value
            return own
        f, k, vl, vr = found
        middle, d = (vl + vr) / 2, directions[f]
        side = binned[rows, f] <= k
        left = grow(rows[side], g, h, level + 1, low if d >= 0 else max(low, middle), high if d <= 0 else min(high, middle))
        right = grow(rows[~side], g, h, level + 1, low if d <= 0 else max(low, middle), high if d >= 0 else min(high, middle))
        nodes[own] = [f, cuts[f][k], left, right, 0.0]
        return own

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    table = np.array(nodes)
    ints = table[:, [0, 2, 3]].astype(np.int64)
    return Trees(np.array(roots), ints[:, 0], table[:, 1], ints[:, 1], ints[:, 2], table[:, 4], start, depth)


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id") -> Trees:
    """Trees of the ``fit_rows`` labelled rows with the least hashes of their ids.

    The sample is bounded by the parameter, so it is small enough to be broadcast
    and its features to be fitted on the driver.
    """
    chosen = (labels.where("quality IN (0, 1)").where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64(key), key).limit(fit_rows))
    rows = documents.select(key, "text").join(F.broadcast(chosen), key)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))[1]
            yield pa.record_batch({"x": pa.array(list(x), pa.list_(pa.float64())), "y": batch.column(2)})

    got = sorted((tuple(r["x"]), r["y"]) for r in rows.select(key, "text", F.col("quality").cast("int"))
                 .mapInArrow(features, "x array<double>, y int").collect())
    x = np.array([g[0] for g in got]).reshape(len(got), len(FEATURES))
    return fit_trees(x, np.array([g[1] for g in got], float), list(FEATURES.values()))


def verdicts(column: pa.Array, trees: Trees) -> dict[str, np.ndarray]:
    base, x = statistics(column)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    score = trees.score(x)
    return dict(zip(BASE_COLUMNS, base.T)) | {"base_failed": failed, "kept": ~failed & (score >= 0.5), "score": score}


def judge(documents: DataFrame, trees: Trees, key: str = "doc_id") -> DataFrame:
    """Statistics, base rule and verdict of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = verdicts(batch.column(1), trees)
            yield pa.record_batch([batch.column(0), *map(pa.array, found.values())], names=["key", *found])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(
        run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in BASE_COLUMNS) + ", base_failed boolean, kept boolean, score double"
    ).withColumnRenamed("key", key)


def keep_good(documents: DataFrame, trees: Trees) -> DataFrame:
    """The rows that pass, with all their columns."""

    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), trees)["kept"]))

    return documents.mapInArrow(run, documents.schema)
