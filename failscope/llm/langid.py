"""Language ID: unigrams over a fixed vocabulary, marginalised over segmentations.

Each language has a probability for every piece of a public vocabulary; the
probability of a word is the sum over all its segmentations into pieces, found by a
forward pass over its bytes.  The piece probabilities are fitted by expectation
maximisation with the matching backward pass, on the words of a bounded sample of
each language's documents: the words stay in the tasks, which send sums by piece and language.  A word's values depend on the word alone and are computed once for each
task, for all words of one length together; a text adds up those of its words.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with
a null language are not learned from; with no language learned every text is ``und``;
of equally likely languages the least name wins; repeated rows are judged alike; a
word longer than 32 bytes is read in parts of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.llm.toxicity import WordValues
from failscope.storage import drop, materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FIT_ROWS = 10_000
ROUNDS = 3
LONGEST = 32  # bytes of a word part; 32 pieces of probability 1e-8 stay within a double
PIECE = LONGEST  # bytes of the longest piece; no word part is longer
PRIOR = 100.0
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces in lower case, a blank for the word start, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode().lower())
    return sorted(p for p in found if 0 < len(p) <= PIECE)


@dataclass
class Pieces:
    """For each length: sorted hashes of the pieces, and their numbers."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    size: int


def pieces_of(words: list[bytes]) -> Pieces:
    tables = []
    for n in range(1, PIECE + 1):
        own = [(i, w) for i, w in enumerate(words) if len(w) == n]
        buf = np.frombuffer(b"".join(w for _, w in own), np.uint8)
        at = np.arange(len(own)) * n
        key = T.range_hash(T.prefix_hash(buf), at, at + n)
        order = np.argsort(key)
        tables.append((key[order], np.array([i for i, _ in own], np.int64)[order]))
    return Pieces(tables, len(words))


def _lattice(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the words, longest first; their order; and by length the piece that starts at each byte (or ``size``)."""
    order = np.argsort([-len(w) for w in words], kind="stable")
    sizes = np.array([len(words[i]) for i in order], np.int64)
    off = np.r_[0, np.cumsum(sizes)]
    buf = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
    prefix = T.prefix_hash(buf)
    left = np.repeat(off[1:], sizes) - np.arange(len(buf))
    found = np.full((PIECE + 1, len(buf)), pieces.size, np.int32)
    for n in range(1, PIECE + 1):
        keys, numbers = pieces.tables[n - 1]
        at = np.flatnonzero(left >= n)
        if len(keys) and len(at):
            key = T.range_hash(prefix, at, at + n)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            found[n, at[hit]] = numbers[place[hit]]
    return off, order, found


def _forward(off: np.ndarray, found: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[i, w]: probability of the first i bytes of word w, for each language."""
    sizes = np.diff(off)
    most = int(sizes[0]) if len(sizes) else 0
    alpha = np.zeros((most + 1, len(sizes), p.shape[1]))
    alpha[0] = 1.0
    for i in range(1, most + 1):
        m = int(np.searchsorted(-sizes, -i, side="right"))  # words of i bytes at least come first
        for n in range(1, min(i, PIECE) + 1):
            alpha[i, :m] += alpha[i - n, :m] * p[found[n, off[:m] + i - n]]
    return alpha


def word_log_probability(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; ``p`` ends in a row of zeros."""
    if not words:
        return np.zeros((0, p.shape[1]))
    off, order, found = _lattice(words, pieces)
    alpha = _forward(off, found, p)
    sizes = np.diff(off)
    out = np.empty((len(words), p.shape[1]))
    out[order] = np.log(np.maximum(alpha[sizes, np.arange(len(sizes))], 1e-300))
    return out


def expected_counts(words: list[bytes], number: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in each language; ``number`` is words by languages."""
    off, order, found = _lattice(words, pieces)
    alpha = _forward(off, found, p)
    sizes = np.diff(off)
    m_all, most, langs = len(sizes), int(sizes[0]), p.shape[1]
    whole = np.maximum(alpha[sizes, np.arange(m_all)], 1e-300)
    weight = number[order] / whole
    beta = np.zeros_like(alpha)
    beta[sizes, np.arange(m_all)] = 1.0
    counts = np.zeros((pieces.size + 1, langs))
    for i in range(most - 1, -1, -1):
        for n in range(1, min(most - i, PIECE) + 1):
            m = int(np.searchsorted(-sizes, -(i + n), side="right"))
            if not m:
                break
            piece = found[n, off[:m] + i]
            through = p[piece] * beta[i + n, :m]
            beta[i, :m] += through
            flow = alpha[i, :m] * through * weight[:m]
            for c in range(langs):
                counts[:, c] += np.bincount(piece, flow[:, c], pieces.size + 1)
    counts[-1] = 0.0
    return counts


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Counts with a shared prior: pieces that one language lacks keep a little of the others' use."""
    shared = counts.sum(axis=1, keepdims=True) + 0.01
    shared[-1] = 0.0
    out = counts + PRIOR * shared / shared.sum()
    return out / out.sum(axis=0)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and rows of the words, in parts of at most LONGEST - 1 bytes."""
    low = T.LOWER[buf]
    starts, ends = T.spans(~T.SPACE[low], off)
    most = LONGEST - 1
    if len(starts) and (ends - starts).max() > most:
        parts = -(-(ends - starts) // most)
        begin = np.repeat(starts, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        starts, ends = begin, np.minimum(begin + most, np.repeat(ends, parts))
    return low, starts, ends, T.rows_of(starts, off)


@dataclass
class Model:
    langs: list[str]
    vocabulary: list[bytes]
    p: np.ndarray


def learn(documents: DataFrame, learning: Column, path: str = VOCABULARY, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS,
          key: str = "doc_id") -> Model:
    """Piece probabilities of the languages of the learning rows.

    Of each language the ``fit_rows`` rows with the least hashes of their ids are learned
    from; the bound is a parameter, and the words of the sample are what the steps read.
    """
    words = vocabulary(path)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(key), key))
    # A row_number bound is applied in each task before the shuffle, so a large language stays small.
    chosen = documents.where(F.col("lang").isNotNull() & F.col(key).isNotNull() & learning).select(key, "lang").distinct().withColumn("nth", nth).where(
        F.col("nth") <= fit_rows).select(key, "lang")
    # Written, so that the planner sees how few ids these are.
    sample = documents.select(key, "lang", "text").join(materialize(chosen, "chosen"), [key, "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(1))
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            of_row = np.array([names.index(x) for x in langs], np.int64)
            for i, j in T.portions(off):
                low, starts, ends, row = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                own = of_row[i:j][row]
                key_ = T.range_hash(T.prefix_hash(low), starts, ends) ^ T.mix(own.astype(np.uint64))
                _, first, number = np.unique(key_, return_index=True, return_counts=True)
                raw = low.tobytes()
                yield pa.record_batch({
                    "word": pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()),
                    "lang": pa.array([names[k] for k in own[first].tolist()], pa.string()), "n": pa.array(number)})

    counted = sample.select("lang", "text").mapInArrow(count, "word binary, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    # All languages of a word in one task, which then walks its segmentations once.
    table = materialize(counted.repartition("word"), "words")
    langs = [r.lang for r in table.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return Model([], words, np.zeros((len(words) + 1, 0)))
    p = _normalised(np.r_[np.ones((len(words), len(langs))), np.zeros((1, len(langs)))])
    for _ in range(rounds):
        p = _normalised(_expected(table, langs, words, p))
    drop(table)
    return Model(langs, words, p)


def _expected(table: DataFrame, langs: list[str], vocabulary_: list[bytes], p: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in each language over the rows (word, lang, n): summed in the tasks, then by piece and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = pieces_of(vocabulary_), np.zeros_like(p)
        for batch in batches:
            if not len(batch):
                continue
            spelled, place = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            number = np.zeros((len(spelled), len(langs)))
            np.add.at(number, (place, np.searchsorted(langs, batch.column(1).to_pylist())), batch.column(2).to_numpy())
            total += expected_counts([b" " + w for w in spelled.tolist()], number, pieces, p)
        piece, lang = np.nonzero(total)
        yield pa.record_batch({"piece": pa.array(piece.astype(np.int32)), "lang": pa.array(lang.astype(np.int32)), "x": pa.array(total[piece, lang])})

    found = table.mapInArrow(run, "piece int, lang int, x double").groupBy("piece", "lang").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros_like(p)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["x"].to_numpy()
    return out


def predict(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score (its share among the languages) of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.vocabulary)
        values = WordValues(lambda w: word_log_probability([b" " + x for x in w], pieces, model.p), max(len(model.langs), 1))
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            best, share = classify(batch.column(1), values, len(model.langs))
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(share)], names=["key", "lang_pred", "score"])

    return documents.select(key, "text").mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def classify(column: pa.Array, values: WordValues, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language (``langs`` for none) and its share of each text."""
    n = len(column)
    best, share = np.full(n, langs), np.zeros(n)
    if not langs:
        return best, share
    buf, off = T.buffers(column)
    for i, j in T.portions(off):
        part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        low, starts, ends, row = tokens(part, o)
        total = np.zeros((j - i, langs))
        if len(starts):
            found, inverse = values(low, starts, ends, T.range_hash(T.prefix_hash(low), starts, ends))
            total = np.column_stack([np.bincount(row, found[inverse, c], j - i) for c in range(langs)])
        lettered = T.counts(_ASCII_LETTER[part], o) > 0
        for k in np.flatnonzero(~lettered & (T.counts(part >= 128, o) > 0)):
            lettered[k] = any(map(str.isalpha, part[o[k]:o[k + 1]].tobytes().decode("utf-8", "replace")))
        top = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best[i:j] = np.where(lettered, top, langs)
        share[i:j] = np.where(lettered, 1.0 / odds.sum(axis=1), 0.0)
    return best, share
