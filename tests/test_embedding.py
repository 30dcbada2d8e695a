"""Message embeddings: synonyms, agreement with a plain decomposition, odd rows, and partitions."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from failscope.operators import embedding as M

SCHEMA = "id bigint, msg string, row bigint, n bigint, words string"


def frame(spark, messages):
    return spark.createDataFrame([(i, m, 7, 8, "clash") for i, m in enumerate(messages)], SCHEMA)


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_synonyms_are_neighbours(spark):
    """Two words that never meet but stand in the same surroundings come out near; others do not."""
    rng = random.Random(1)
    topics = {"timeout": "socket peer latency retry".split(), "license": "key vendor expiry server".split(), "audio": "codec jitter tone gain".split()}
    other = {"timeout": "deadline", "license": "permit", "audio": "sound"}
    lines = []
    for i in range(900):
        topic = rng.choice(list(topics))
        near = rng.sample(topics[topic], 3)
        near.insert(rng.randrange(4), topic if i % 2 else other[topic])
        lines.append(" ".join(near))
    df = frame(spark, lines + [w for pair in other.items() for w in pair] + ["", None, "!!", "socket peer"])
    got = {r.msg: np.array(r.e) for r in M.message_vectors(df, "msg", width=6, output="e").collect()}
    for word, same in other.items():
        scores = {w: cosine(got[word], got[w]) for pair in other.items() for w in pair if w != word}
        assert max(scores, key=scores.get) == same and scores[same] > 0.8, (word, scores)
    assert not got[""].any() and not got[None].any() and not got["!!"].any() and got["socket peer"].any()


def test_agrees_with_a_plain_decomposition(spark, monkeypatch):
    """Counts, association and inner products of message vectors, with small blocks and cells."""
    monkeypatch.setattr(M, "BLOCK_WORDS", 8)
    monkeypatch.setattr(M, "CELL", 16)
    monkeypatch.setattr(M.dealt, "__defaults__", (16,))
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    lines = [" ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randint(1, 12))) for _ in range(150)] + ["w0 w1 w0"] * 200
    df = frame(spark, lines)
    width, window = 40, 3
    got = {r.msg: np.array(r.e) for r in M.message_vectors(df, "msg", width=width, window=window, output="e").collect()}
    n = Counter()
    for line in lines:
        w = line.split()
        for i, a in enumerate(w):
            for b in w[max(0, i - window):i] + w[i + 1:i + window + 1] if len(w) > 1 else w:
                n[a, b] += 1
    words = sorted({a for a, _ in n})
    at = {w: i for i, w in enumerate(words)}
    counts = np.zeros((len(words), len(words)))
    for (a, b), c in n.items():
        counts[at[a], at[b]] = c
    s = counts.sum(axis=1)
    u, value, _ = np.linalg.svd(np.where(counts > 0, np.log1p(counts * s.sum() / np.outer(s, s)), 0))
    vectors = u * np.sqrt(value)
    mean = {line: np.mean([vectors[at[w]] for w in line.split()], axis=0) for line in set(lines)}
    for _ in range(300):
        a, b = rng.sample(sorted(mean), 2)
        assert abs(np.dot(got[a], got[b]) - np.dot(mean[a], mean[b])) < 1e-6 * np.linalg.norm(mean[a]) * np.linalg.norm(mean[b])


def test_rows_and_partitions(spark):
    df = frame(spark, ["a b c"] * 50 + ["c d", "", None, "é ü", "a b c d " * 3000])
    one = {r.id: r.e for r in M.message_vectors(df, "msg", width=5, output="e").collect()}
    two = M.message_vectors(df.repartition(7), "msg", width=5, output="e")
    assert two.columns == [*df.columns, "e"]
    rows = two.collect()
    assert len(rows) == df.count() and len({tuple(r.e) for r in rows if r.msg == "a b c"}) == 1
    a, b = np.array([one[r.id] for r in rows]), np.array([r.e for r in rows])
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-8)
    assert M.message_vectors(df.where("false"), "msg", width=5).count() == 0
    assert M.message_vectors(df.where(F.col("msg").isNull()), "msg", width=5).where(F.exists("embedding", lambda x: x != 0)).count() == 0
