"""Runs over one large group take seconds, not the square of its size."""

import time

from pyspark.sql import functions as F

from failscope.operators.ordered import last_seen, next_seen, running


def test_backward_fill_of_one_large_group(spark):
    n = 400_000
    df = spark.range(n).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 100_000 == 99_999, F.col("id")).alias("v"))
    start = time.time()
    out = running(df, ["k"], [F.col("id")], a=next_seen(F.col("v")), b=last_seen(F.col("v")))
    row = out.agg(F.sum("a").alias("a"), F.count("b").alias("b")).first()
    assert time.time() - start < 60
    assert row.a == sum(100_000 * (100_000 * k + 99_999) for k in range(4)) and row.b == n - 99_999


def test_global_order_uses_all_cores(spark):
    from failscope.operators import ordered

    df = spark.range(5000)
    chunks = ordered.chunk_rows(df, [], [-F.col("id")], 5000, ordered.MAX_GROUP_ROWS)
    assert chunks.select("__chunk").distinct().count() == spark.sparkContext.defaultParallelism
    assert ordered.global_row_number(df, [-F.col("id")], "i").where("i <> 5000 - id").count() == 0


def test_tables_of_a_run_are_removed(spark, tmp_path):
    from failscope import storage

    kept = storage._RUN
    try:
        storage._RUN = "run-test"
        storage.materialize(spark.range(3), "x")
        path = spark._jvm.org.apache.hadoop.fs.Path(storage.run_dir(spark))
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert system.exists(path)
        storage.release(spark)
        assert not system.exists(path)
    finally:
        storage._RUN = kept


def test_only_the_vocabulary_is_dealt_by_row(spark, monkeypatch):
    """Weights of the frequent terms, with repeated and null ids; the other terms are not written."""
    import math
    from collections import Counter

    from failscope.operators import text as X

    texts = [(1, "a", "port port closed"), (1, "a", "port open"), (1, "b", "open"), (None, "a", "port"), (None, "b", None), (2, None, "open rare word")]
    df = spark.createDataFrame(texts, "id int, g string, t string").repartition(3)
    written, write = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda rows, label: written.append(write(rows, label)) or written[-1])
    got = {(r.id, r.g, r.term): r.weight for r in X.tfidf_weights(df, "id", "g", "t", 2).collect()}
    counts = {}
    for i, g, t in texts:
        counts.setdefault((i, g), Counter()).update(w for w in (t or "").split() if w in ("port", "open"))
    rows_of = Counter(w for c in counts.values() for w in c)
    weight = {(i, g, w): n * (math.log((1 + len(texts)) / (1 + rows_of[w])) + 1) for (i, g), c in counts.items() for w, n in c.items()}
    norm = Counter()
    for (i, _, _), w in weight.items():
        norm[i] += w * w
    assert got.keys() == weight.keys() and all(abs(got[k] - w / norm[k[0]] ** 0.5) < 1e-9 for k, w in weight.items())
    assert len(written) == 1 and sum(len(r["__terms"]) for r in written[0].collect()) == len(weight)
    assert X.tfidf_weights(df.where("false"), "id", "g", "t").count() == 0
