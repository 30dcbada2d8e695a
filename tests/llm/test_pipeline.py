"""The pipeline's stages against plain versions, one after the other."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from failscope.llm import quality  # noqa: E402
from failscope.storage import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == (columns if i < 4 else [*columns, "copy"])
        out[name] = docs.collect()

    good = {r.doc_id for r in out["quality rules"]}
    assert good <= {i for i, r in rows.items() if not brute.quality(r.text)[-1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passing = [i for i in rows if i in labels and not brute.quality(rows[i].text)[-1]]
    assert np.mean([(i in good) == (labels[i] == 1) for i in passing]) > 0.97

    kept = {g[0] for g in brute.groups([(i, rows[i].text) for i in sorted(good)], k=5) if g[3]}
    assert {r.doc_id for r in out["MinHash near-dedup"]} == kept

    order = sorted(kept)
    want = dict(zip(order, brute.without_repeats([rows[i].text for i in order], 200)))
    cut = {r.doc_id: r for r in out["suffix-array dedup"]}
    assert set(cut) == kept
    for i, (size, gone, _, _) in want.items():
        assert cut[i].n_chars == len(cut[i].text)
        assert (cut[i].text == rows[i].text) == (gone == 0) and size - gone - 6 <= len(cut[i].text.encode()) <= size - gone

    items = [" ".join(map(bytes.decode, brute.low_words(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in out["benchmark decontamination"]}
    leaking = {i for i, r in cut.items() if any(x in " ".join(map(bytes.decode, brute.low_words(r.text))) for x in items)}
    assert clean == set(cut) - leaking

    mixed = out["source mixing"]
    assert {r.doc_id for r in mixed} <= clean and len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    sizes = {}
    for r in out["benchmark decontamination"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    aims = brute.targets(sizes)
    taken = {s: sum(len(brute.words(r.text)) for r in mixed if r.source == s) for s in sizes}
    assert abs(sum(taken.values()) - sum(aims.values())) < 0.1 * sum(aims.values())
    assert all(r.copy <= 2 for r in mixed)


def test_run_is_the_stages(spark):
    a = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    b = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    assert a == b and a


def test_odd_documents_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", None, None, 0), (7, "x" * 50_000, "en", "s", 1), (8, None, "en", None, 2)], docs.schema)
    for frame in (docs.unionByName(odd).unionByName(odd), odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, SF), "test-odd")
            frame.count()


def test_quality_stage_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    kept = quality.keep_good(docs, quality.fit(docs, empty)).count()
    assert kept == sum(not brute.quality(r.text)[-1] for r in docs.collect())
