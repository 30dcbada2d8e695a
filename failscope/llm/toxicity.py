"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

Both classes have an interpolated Kneser-Ney model of order ``ORDER`` over the bytes
of a word, so that an expression seen once is judged by its stem.  Orders up to
``SHARED`` are counted over both classes together: this is what either model backs
off to.  A word's evidence is the difference of its two log-likelihoods as far as it
exceeds ``NOISE`` (ordinary words differ by chance); a text's evidence is the sum over
its words, normalised by the root of their number.  A logistic curve gives the score;
it is fitted on evidence from models of the other half of the learning rows, as a
model's own rows would look too clear.  A word's evidence depends on the word alone
and is computed once for each task.

The models are fitted on a bounded sample of labelled rows (``FIT_ROWS`` of each
class); every text is scored whole, in one pass without a shuffle.

Defined cases: a null or empty text has no evidence and gets the score of a text
without any toxic word; labels that are null or fit no document are left out, of
contradicting ones the larger counts; without both classes every score is the share of
toxic rows (0 without rows); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T

FIT_ROWS = 2_000
ORDER, SHARED = 6, 2
DISCOUNT = 3.0
NOISE = 2.0
CACHE = 400_000
#: White space and ASCII punctuation part words; every other byte is a letter.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Lookup:
    """Values by sorted 64-bit keys; unknown keys give zeros."""

    keys: np.ndarray
    values: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at] * (self.keys[at] == keys)[:, None]


@dataclass
class Model:
    grams: list[Lookup]     # by order: discounted counts of both classes
    contexts: list[Lookup]  # by order: 1 / total and backoff mass of both classes
    slope: float = 1.0
    middle: float = 0.0
    rate: float = 0.0
    usable: bool = True


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as one buffer, each between two blanks, and their offsets."""
    joined = b"".join(b" " + w + b" " for w in words)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return np.frombuffer(joined, np.uint8), np.r_[0, np.cumsum(sizes)]


def _grams(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the last byte, key, and key of the context of each n-gram of this order within a word."""
    prefix = T.prefix_hash(buf)
    start = np.repeat(off[:-1], np.diff(off))
    last = np.flatnonzero(np.arange(len(buf)) - start >= max(order - 1, 1))  # the first blank is given
    return last, T.range_hash(prefix, last - order + 1, last + 1), T.range_hash(prefix, last - order + 1, last)


def fit_model(words: list[bytes], number: np.ndarray) -> Model:
    """``number`` has the occurrences of each word in the ordinary and the toxic class."""
    buf, off = framed(words)
    weight = np.repeat(number, np.diff(off), axis=0)
    grams, contexts = [], []
    for order in range(ORDER, 0, -1):
        last, key, context = _grams(buf, off, order)
        uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        seen = np.column_stack([np.bincount(inverse, weight[last, c], len(uniq)) for c in (0, 1)])
        if order == ORDER:
            count = seen
        else:  # distinct letters to the left; at a word's start, where there is none, the occurrences
            count = np.zeros_like(seen)
            longer_last, longer_key, _ = _grams(buf, off, order + 1)
            longer, at, back = np.unique(longer_key, return_index=True, return_inverse=True)
            have = np.column_stack([np.bincount(back, weight[longer_last, c], len(longer)) > 0 for c in (0, 1)])
            suffix = T.range_hash(T.prefix_hash(buf), longer_last[at] - order + 1, longer_last[at] + 1)
            place = np.searchsorted(uniq, suffix)
            for c in (0, 1):
                count[:, c] = np.bincount(place, have[:, c], len(uniq))
            start = np.repeat(off[:-1], np.diff(off))
            initial = (last - order + 1 == start[last])[first]
            count[initial] = seen[initial]
        if order <= SHARED:
            count = np.repeat(count.sum(axis=1, keepdims=True), 2, axis=1)
        own, where = np.unique(context[first], return_inverse=True)
        total = np.column_stack([np.bincount(where, count[:, c], len(own)) for c in (0, 1)])
        cut = np.minimum(count, DISCOUNT)
        left = np.column_stack([np.bincount(where, cut[:, c], len(own)) for c in (0, 1)])
        inverse_total = 1.0 / np.maximum(total, 1e-12) * (total > 0)
        grams.append(Lookup(uniq, (count - cut).astype(np.float32)))
        # An unseen context hands everything down: its stored mass is shifted by one, so that zeros mean that.
        contexts.append(Lookup(own, np.hstack([inverse_total, np.where(total > 0, left * inverse_total, 1.0) - 1.0])))
    return Model(grams[::-1], contexts[::-1])


def evidence(words: list[bytes], model: Model) -> np.ndarray:
    """Toxic minus ordinary log-likelihood of each word."""
    if not words:
        return np.zeros(0)
    buf, off = framed(words)
    p = np.full((len(buf), 2), 1.0 / 256)
    for order in range(1, ORDER + 1):
        last, key, context = _grams(buf, off, order)
        ctx = model.contexts[order - 1](context)
        p[last] = model.grams[order - 1](key) * ctx[:, :2] + (ctx[:, 2:] + 1.0) * p[last]
    ratio = np.log(p[:, 1]) - np.log(p[:, 0])
    ratio[off[:-1]] = 0.0
    return np.add.reduceat(ratio, off[:-1])


class WordValues:
    """A value of each distinct word, kept for the words of earlier batches."""

    def __init__(self, compute, width: int = 1):
        self.compute, self.width = compute, width
        self.place: dict[int, int] = {}
        self.values = np.zeros((0, width))

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the distinct words, and the index into them of every word."""
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > CACHE:
            self.place, self.values = {}, np.zeros((0, self.width))
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            at = first[new]
            whole = buf.tobytes()
            fresh = self.compute([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.place.update(zip((keys[i] for i in new), range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, fresh.reshape(len(new), self.width)])
        get = self.place
        return self.values[np.fromiter((get[k] for k in keys), np.int64, len(keys))], inverse


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and rows of the words; a word ends after 64 bytes at the latest."""
    low = T.LOWER[buf]
    starts, ends = T.spans(_LETTER[low], off)
    if len(starts) and (ends - starts).max() > 64:
        pieces = -(-(ends - starts) // 64)
        begin = np.repeat(starts, pieces) + 64 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        starts, ends = begin, np.minimum(begin + 64, np.repeat(ends, pieces))
    return low, starts, ends, T.rows_of(starts, off)


def text_evidence(column: pa.Array, values: WordValues) -> np.ndarray:
    """Length-normalised evidence of each text."""
    buf, off = T.buffers(column)
    out = [np.zeros(0)]
    for i, j in T.portions(off):
        low, starts, ends, row = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        found, inverse = values(low, starts, ends, T.range_hash(T.prefix_hash(low), starts, ends))
        above = np.maximum(found[inverse, 0] - NOISE, 0.0)
        out.append(np.bincount(row, above, j - i) / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1)))
    return np.concatenate(out)


def learn(documents: DataFrame, labels: DataFrame, learning: Column, fit_rows: int = FIT_ROWS, key: str = "doc_id") -> Model:
    """Models of the labelled rows for which ``learning`` (over the key) holds.

    Of each class the ``fit_rows`` rows with the least hashes of their ids; the sample
    is bounded by the parameter, and so are its broadcast and its words.
    """
    known = labels.where("toxic IN (0, 1)").where(F.col(key).isNotNull() & learning).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Model([], [], rate=float(share or 0.0), usable=False)
    sample = known.where("toxic = 1").orderBy(F.xxhash64(key), key).limit(fit_rows).unionByName(
        known.where("toxic = 0").orderBy(F.xxhash64(key), key).limit(fit_rows))
    half = F.pmod(F.xxhash64(key), F.lit(7)) % 2
    rows = documents.select(key, "text").join(F.broadcast(sample), key).select("text", "toxic", half.cast("int").alias("half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(0))
            kind = 2 * batch.column(2).to_numpy(zero_copy_only=False) + batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in T.portions(off):
                low, starts, ends, row = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                uniq, first, inverse = np.unique(T.range_hash(T.prefix_hash(low), starts, ends), return_index=True, return_inverse=True)
                raw, of_word = low.tobytes(), kind[i:j][row]
                yield pa.record_batch([
                    pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()),
                    *[pa.array(np.bincount(inverse[of_word == k], minlength=len(uniq))) for k in range(4)]], names=["word", "a", "b", "c", "d"])

    counted = rows.mapInArrow(count, "word binary, a bigint, b bigint, c bigint, d bigint").groupBy("word").agg(
        *[F.sum(c).alias(c) for c in "abcd"]).toArrow().sort_by("word")
    words = counted["word"].to_pylist()
    if not words:
        return Model([], [], rate=float(share), usable=False)
    number = np.column_stack([counted[c].to_numpy() for c in "abcd"]).astype(float)
    halves = []
    for own in (number[:, 2:], number[:, :2]):
        used = own.sum(axis=1) > 0
        halves.append(fit_model([w for w, u in zip(words, used) if u], own[used]) if used.any() else None)
    model = fit_model(words, number[:, :2] + number[:, 2:])
    return calibrated(model, [h or model for h in halves], rows, float(share))


def calibrated(model: Model, others: list[Model], rows: DataFrame, share: float) -> Model:
    """The logistic curve over the evidence, with the classes weighted as in all labelled rows.

    ``others`` are the models that judge the rows of each half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [WordValues(lambda w, m=m: evidence(w, m)) for m in others]
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = batch.filter(pa.array(half == k))
                yield pa.record_batch({"e": pa.array(text_evidence(part.column(0), values[k])), "y": part.column(1)})

    got = rows.mapInArrow(run, "e double, y int").toArrow().sort_by([("e", "ascending"), ("y", "ascending")])
    e, y = got["e"].to_numpy(), got["y"].to_numpy().astype(float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    middle, spread = float(np.average(e, weights=weight)), float(e.std()) or 1.0
    x, a, b = (e - middle) / spread, 0.0, float(np.log(share / (1 - share)))
    for _ in range(50):  # Newton steps, with a little ridge
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    model.slope, model.middle, model.rate = a / spread, middle - b * spread / a if a else 0.0, share
    return model


def score(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, score and predicted of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = WordValues(lambda w: evidence(w, model))
        for batch in batches:
            if model.usable:
                s = 1.0 / (1.0 + np.exp(-np.clip(model.slope * (text_evidence(batch.column(1), values) - model.middle), -40, 40)))
            else:
                s = np.full(len(batch), model.rate)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["key", "score", "predicted"])

    return documents.select(key, "text").mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
