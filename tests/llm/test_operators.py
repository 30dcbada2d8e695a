"""Each corpus operator against a plain version, on small inputs with every odd case."""

import random
import sys
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from failscope.llm import contamination, langid, mixing, neardup, perplexity, preference, quality, suffixdup, toxicity, urls  # noqa: E402
from failscope.llm import textbuf as T  # noqa: E402
from failscope.llm.suffixarray import long_matches, suffix_array  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, th int, score double"


def prose(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(texts, lang="en"):
    return [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or ""), "clash", i, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, white space, long and repeated texts, other alphabets, near copies, columns with clashing names."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(2, 60)
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "one", "ONE two", base, base, base.upper(), " ".join(near),
        prose(3, 80) + " " + passage, passage + "\n" + prose(4, 90), "é" * 400, "é" * 399 + "ß", "the " * 600,
        "ü 日本 \U0001f600 x\u00a0y\u2028z " * 30, prose(5, 20000), "\n".join(["a line", "a line", "", "b & c | <d>"] * 20), "x" * 70_000, None]
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_suffix_array_and_matches():
    rng = np.random.default_rng(7)
    for trial in range(120):
        n, k = int(rng.integers(1, 50)), int(rng.integers(1, 5))
        s = np.r_[rng.integers(1, k + 1, n), 0]
        s = np.r_[np.tile(s[:-1][:4], 7), 0] if trial % 4 == 0 else s
        got = suffix_array(s)
        assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for least in (1, 3, 6):
            places = {}
            for i in range(len(s) - least + 1):
                places.setdefault(tuple(s[i:i + least]), []).append(i)
            want = np.zeros(len(s), bool)
            for p in places.values():
                want[p] = len(p) > 1
            assert (long_matches(s, got, least, np.array([0]), 10_000) == want).all()


def test_quality_statistics(spark, odd):
    trees = quality.fit_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0), list(quality.FEATURES.values()))
    got = by_id(quality.judge(odd, trees), *quality.BASE_COLUMNS, "base_failed", "kept")
    for r in odd.collect():
        want = brute.quality(r.text)
        assert got[r.doc_id] == (*want, not want[-1]), r.doc_id
    assert quality.keep_good(odd, trees).schema == odd.schema
    assert quality.keep_good(odd, trees).count() == sum(not brute.quality(r.text)[-1] for r in odd.collect())
    assert quality.judge(empty(spark), trees).count() == 0


def test_quality_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.1 * rng.standard_normal(3000) < 0.5).astype(float)
    trees = quality.fit_trees(x, y, [-1, 0, 0])
    p = trees.score(x)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.8
    for _ in range(20):
        line = np.repeat(rng.random((1, 3)), 50, axis=0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.score(line)) <= 1e-12).all()
    one = np.full(len(x), -0.0) + trees.start
    for t in trees.roots:  # node by node
        for i in range(0, len(x), 300):
            n = int(t)
            while trees.left[n] != n:
                n = int(trees.left[n] if x[i, trees.feature[n]] <= trees.threshold[n] else trees.right[n])
            one[i] += trees.value[n]
    assert np.allclose(1 / (1 + np.exp(-one[::300])), p[::300])


def test_quality_fit_without_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 0), (3, None, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(odd, labels).score(np.zeros((2, len(quality.FEATURES)))).min() > 0.99


@pytest.mark.parametrize("crowd", [suffixdup.CROWD, 1])
def test_suffix_dedup(spark, odd, crowd):
    texts = [r.text for r in odd.orderBy("doc_id").collect()]
    want = brute.without_repeats(texts, 200)
    spans = suffixdup.intervals(odd, crowd=crowd)
    got = by_id(suffixdup.digest(odd, spans), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i in range(len(texts))] == want
    cut = suffixdup.strip(odd, spans)
    assert cut.columns == odd.columns and cut.count() == len(texts)
    assert cut.where("text IS NULL").count() == 2
    assert suffixdup.dedup(empty(spark)).count() == 0


def test_suffix_dedup_of_many_variants(spark, monkeypatch):
    """One passage in many surroundings, and many near copies: small shards and flushes give the same."""
    monkeypatch.setattr(suffixdup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixdup, "FLUSH", 40)
    passage, base = prose(11, 50), prose(12, 100).split(" ")
    texts = [prose(100 + i, 30) + passage + prose(200 + i, 30) for i in range(40)]
    texts += [" ".join(base[:i] + ["edit"] + base[i + 1:]) for i in range(0, 100, 3)] + [passage] * 5
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    for crowd in (suffixdup.CROWD, 4):
        got = by_id(suffixdup.digest(df, suffixdup.intervals(df, crowd=crowd)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert [got[i] for i in range(len(texts))] == brute.without_repeats(texts, 200)


def test_near_duplicates(spark, odd):
    listed = [(r.doc_id, r.text) for r in odd.collect()]
    got = neardup.near_duplicates(odd)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(brute.groups(listed))
    one = neardup.one_of_each(odd)
    assert one.columns == odd.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in brute.groups(listed) if r[3])
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_in_chains_and_crowds(spark):
    """A crowd of copies around one origin, most pairs of which are below the threshold, and a chain."""
    rng = random.Random(5)
    origin = prose(21, 150).split(" ")
    texts = [" ".join(origin)]
    for i in range(60):
        copy = list(origin)
        for p in rng.sample(range(150), 7):
            copy[p] = f"edit{i}x{p}"
        texts.append(" ".join(copy))
    chain = prose(22, 120).split(" ")
    for i in range(8):
        chain = chain[6:] + prose(300 + i, 6).split(" ")
        texts.append(" ".join(chain))
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame(rows([texts[i] for i in order]), SCHEMA)
    got = neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute.groups([(k, texts[i]) for k, i in enumerate(order)]))


def test_near_duplicates_with_repeated_rows_and_null_ids(spark):
    text = prose(31, 60)
    data = [(5, text), (5, text), (7, text + " more"), (None, text), (9, None), (None, "alone here")]
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in data], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, 5, False), (9, 9, True), (None, None, True)], key=str)
    assert sorted((r.doc_id for r in neardup.one_of_each(df).collect()), key=str) == [5, 9, None]


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 5, 400):
        sets = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        lines = neardup.sketch(np.r_[sets, sets], np.array([0, n, 2 * n]))
        assert (lines != np.iinfo(np.uint64).max).all() and (lines[0] == lines[1]).all()
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.r_[a[:320], rng.integers(0, 1 << 63, 40).astype(np.uint64)]
    lines = neardup.sketch(np.r_[np.sort(a), np.sort(b)], np.array([0, 400, 760]))
    assert abs((lines[0] == lines[1]).mean() - 320 / 440) < 0.12


def test_contamination(spark, odd):
    items = [prose(41, 30), prose(42, 40), "tiny", None, "", prose(41, 30)]
    w = items[0].split(" ")
    edited = w[:9] + ["other"] + w[10:20] + w[21:]
    mostly_not = w[:10] + prose(43, 20).split(" ")
    texts = [prose(50, 200) + " " + items[0].upper() + ". " + prose(51, 50), prose(52, 20) + " " + " ".join(edited) + " " + prose(53, 9),
             prose(54, 40) + " " + " ".join(mostly_not), None, "", "so tiny!", prose(55, 20000) + " " + items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = sorted((r.doc_id, r.item_id, r.edits) for r in contamination.leaks(df, bench).collect())
    assert got == [(0, 0, 0), (0, 5, 0), (1, 0, 2), (1, 5, 2), (5, 2, 0), (6, 1, 0)]
    assert sorted((r.doc_id, r.item_id, r.edits) for r in contamination.leaks(df, bench, block=2).collect()) == got
    clean = contamination.without_leaks(df, bench)
    assert clean.schema == df.schema and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert contamination.leaks(empty(spark), bench).count() == 0
    assert contamination.leaks(df, bench.where("false")).count() == 0
    assert contamination.without_leaks(odd, bench.where("false")).count() == odd.count()


def test_contamination_recall(spark):
    """Leaks with a random edit for every seventh word, against exact edit distance."""
    rng = random.Random(3)
    items = [prose(500 + i, rng.randint(15, 60)) for i in range(60)]
    texts = []
    for i, item in enumerate(items):
        w = item.split(" ")
        for p in rng.sample(range(len(w)), len(w) // 7):
            w[p] = rng.choice(["", "new", w[p] + " more"])
        texts.append(prose(700 + i, 80) + " " + " ".join(w) + " " + prose(800 + i, 80))
    df = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {r.doc_id for r in contamination.leaks(df, bench).collect() if r.doc_id == r.item_id}
    assert len(found) >= 0.95 * len(items)


def test_contamination_keys_tell_windows_apart():
    """Unrelated windows of one size share few keys, however long; leaks with a fifth of their words edited are found."""
    rng, trials, found = random.Random(11), 100, []
    for size in (5, 8, 18, 45, 100, 200):
        items = [[f"w{rng.randrange(5000)}" for _ in range(size)] for _ in range(trials)]
        word, bounds = contamination.tokens(pa.array([" ".join(x) for x in items]))
        sig = contamination.signatures(word, bounds[:-1], np.diff(bounds))
        shared = [bool((sig[i] == sig[j]).any()) for i in range(trials) for j in range(i)]
        assert np.mean(shared) < 0.1
        texts = []
        for item in items:
            w = list(item)
            for _ in range(size // 5):
                p, kind = rng.randrange(len(w)), rng.randrange(3)
                w[p:p + (kind != 1)] = [] if kind == 2 else [f"x{rng.randrange(10 ** 6)}"]
            texts.append(" ".join([*(f"c{rng.randrange(10 ** 6)}" for _ in range(30)), *w, *(f"c{rng.randrange(10 ** 6)}" for _ in range(30))]))
        row, item, cost, _ = contamination.search(*T.buffers(pa.array(texts)), contamination.index([" ".join(x) for x in items]))
        assert (cost <= size // 5).all()
        found.append(len(set(row[row == item])) / trials)
    assert min(found) >= 0.97 and np.mean(found) >= 0.99


def test_mixing_targets(spark):
    rng = random.Random(1)
    for trial in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 1000, 5000]) for i in range(9)} | {None: rng.choice([3, 700])}
        df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute.targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_mixing(spark, odd):
    texts = [prose(i, 1 + i * 7 % 90) for i in range(600)] + [None, ""]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = mixing.taken(df)
    total = {r.source: r for r in got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 0.05 * r.target for r in total.values())
    assert got.where("taken > 2 * size").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.taken(df.repartition(3)).collect()))
    out = mixing.emitted(df)
    assert out.columns == [*df.columns, "copy"]
    copies = {r.doc_id: r.copies for r in mixing.mix(df).select(F.col("key").alias("doc_id"), "copies").collect()}
    assert {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in copies.items() if v}
    assert mixing.taken(empty(spark)).count() == 0 and mixing.emitted(empty(spark)).count() == 0
    assert mixing.taken(odd).count() == odd.count()


def test_toxicity(spark, odd):
    rng = random.Random(2)
    data, labels = [], []
    for i in range(300):
        w = prose(1000 + i, 60).split(" ")
        toxic = i % 3 == 0
        if toxic:
            for p in rng.sample(range(60), 4):
                w[p] = "zqxv" + rng.choice("abcdefgh") + rng.choice("abcdefgh")
        data.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(rows(data), SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(df, known, F.col("doc_id") < 200)
    got = by_id(toxicity.score(df, model), "predicted", "score")
    held = range(200, 300)
    assert sum(got[i][0] == (i % 3 == 0) for i in held) >= 95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for p, s in got.values())
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.learn(df, known.where("false"), F.lit(True))
    assert toxicity.score(df, nothing).where("score <> 0 OR predicted <> 0").count() == 0
    only = toxicity.learn(df, known.where("toxic = 1"), F.lit(True))
    assert toxicity.score(df, only).where("score <> 1").count() == 0


def test_kneser_ney_is_a_distribution():
    words = [b"abcab", b"abd", b"bca", b"aab", b"dcba"]
    model = toxicity.fit_model(words, np.array([[5.0, 1], [4, 0], [0, 6], [9, 9], [1, 1]]))
    for prefix in (b"", b"a", b"ab", b"zz"):
        for column in (0, 1):
            probability = []
            for letter in range(256):
                buf, off = toxicity.framed([prefix + bytes([letter])])
                p = np.full((len(buf), 2), 1.0 / 256)
                for order in range(1, toxicity.ORDER + 1):
                    last, key, context = toxicity._grams(buf, off, order)
                    c = model.contexts[order - 1](context)
                    p[last] = model.grams[order - 1](key) * c[:, :2] + (c[:, 2:] + 1.0) * p[last]
                probability.append(p[1 + len(prefix), column])
            assert abs(sum(probability) - 1) < 1e-5


def test_perplexity(spark, odd):
    texts = [prose(2000 + i % 40, 30 + i % 7) for i in range(120)]
    df = odd.unionByName(spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in rows(texts)], SCHEMA))
    held = F.col("doc_id") % 4 == 1
    got = by_id(perplexity.perplexity(df, held), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    listed = [(r.doc_id, r.text) for r in df.collect()]
    want = brute.base_scores([(t, i % 4 == 1) for i, t in listed])
    for (i, _), (tokens, known, total, base) in zip(listed, want):
        assert got[i][:3] == (tokens, known, total) and abs(got[i][3] - base) < 1e-6 * abs(base)
    held_ids = [i for i, _ in listed if i % 4 == 1 and i >= 1000]
    assert sum(got[i][4] for i in held_ids) > sum(got[i][3] for i in held_ids)
    again = by_id(perplexity.perplexity(df.repartition(3), held), "score")
    assert all(abs(again[i][0] - got[i][4]) < 1e-4 * abs(got[i][4]) for i in again)
    assert perplexity.perplexity(empty(spark), held).count() == 0
    untaught = perplexity.perplexity(odd, F.lit(True)).collect()
    assert len(untaught) == odd.count() and all(r.n_known == 0 and r.score == 0 for r in untaught)


def test_seating_is_a_restaurant():
    """Tables and predictive weight against customers that come in one by one."""
    rng, strength, discount = random.Random(4), 1.0, 0.8
    for n, others, parent in ((30, 0, 0.3), (20, 5, 0.1), (5, 3, 0.05), (2, 40, 0.2), (300, 50, 0.01)):
        plain = []
        for _ in range(2000):
            tables = 1
            for sat in range(1, n):
                new = (strength + discount * (others + tables)) * parent
                tables += rng.random() < new / (new + sat - discount * tables)
            plain.append(tables)
        k = 4000
        got = perplexity.seat(np.full(k, n), np.full(k, float(others)), np.full(k, parent), discount, strength, np.arange(k))
        error = 4 * np.std(plain) * (1 / 2000 + 1 / k) ** 0.5 + 0.01 * np.mean(plain)
        assert abs(got.mean() - np.mean(plain)) < error
        weight = lambda t: n - discount * t + (strength + discount * (others + t)) * parent
        assert abs(weight(got.mean()) - weight(np.mean(plain))) < discount * error
        assert abs(got.std() - np.std(plain)) < 0.12 * np.std(plain) + 0.02


def _probabilities(model):
    """Known words, and for each context with a restaurant the probabilities of all of them and of an unknown word."""
    rows = model.lexicon.toArrow().sort_by("w")
    w, n, customers = (rows[x].to_numpy() for x in ("w", "n", "customers"))
    p, down = (np.column_stack([rows[x].to_numpy() for x in perplexity._numbered(name)]) for name in ("p", "down"))
    pairs = model.pairs.toArrow()
    c, own, v = np.searchsorted(w, pairs["c"].to_numpy()), np.searchsorted(w, pairs["w"].to_numpy()), pairs["v"].to_numpy()
    out = {}
    for i in np.flatnonzero(customers):
        q = np.r_[(down[i] * p).mean(axis=1), (down[i] * model.unknown).mean()]
        mine = c == i
        q[own[mine]] += v[mine] / (model.numbers.strength + customers[i])
        out[int(w[i])] = q
    return w, n, p, out


def test_perplexity_sums_to_one(spark):
    df = spark.createDataFrame(rows([prose(3000 + i, 300, "ab") for i in range(40)]), SCHEMA)
    model = perplexity.learn(df)
    _, _, p, contexts = _probabilities(model)
    assert np.allclose(p.sum(axis=0) + model.unknown, 1) and len(contexts) > 3
    assert all(abs(q.sum() - 1) < 1e-9 and (q > 0).all() for q in contexts.values())


def test_perplexity_against_a_plain_sampler(spark):
    """The averaged predictive probabilities of small counts against Gibbs sweeps over single dishes, one restaurant after another."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=60)) for _ in range(30)]
    model = perplexity.learn(spark.createDataFrame(rows(texts), SCHEMA))
    s = model.numbers
    n = {}
    for text in texts:
        ws = [None, *brute.low_words(text), None]
        for a, b in zip(ws, ws[1:]):
            n[a, b] = n.get((a, b), 0) + 1
    vocabulary = sorted({b for _, b in n}, key=str)
    base, tables, root = 1 / (len(vocabulary) + 1), {pair: 1 for pair in n}, {w: 1 for w in vocabulary}

    def seat(customers, others, parent, discount):
        t = 1
        for sat in range(1, customers):
            new = (s.strength + discount * (others + t)) * parent
            t += rng.random() < new / (new + sat - discount * t)
        return t

    def root_p(w):
        sent = sum(t for (_, b), t in tables.items() if b == w)
        total, held = sum(tables.values()), sum(root.values())
        return (sent - s.root_discount * root[w] + (s.strength + s.root_discount * held) * base) / (s.strength + total)

    mean, kept = {}, 0
    for sweep in range(60):
        for a, b in n:
            tables[a, b] = seat(n[a, b], sum(t for (c, d), t in tables.items() if c == a and d != b), root_p(b), s.discount)
        for w in vocabulary:
            sent = sum(t for (_, b), t in tables.items() if b == w)
            root[w] = seat(sent, sum(root.values()) - root[w], base, s.root_discount)
        if sweep >= 10:
            kept += 1
            for a in {a for a, _ in n}:
                customers, held = sum(x for (c, _), x in n.items() if c == a), sum(t for (c, _), t in tables.items() if c == a)
                for w in vocabulary:
                    own = n.get((a, w), 0) - s.discount * tables.get((a, w), 0)
                    mean[a, w] = mean.get((a, w), 0) + (own + (s.strength + s.discount * held) * root_p(w)) / (s.strength + customers)
    key = lambda w: perplexity.END if w is None else int(perplexity.tokens(*T.buffers(pa.array([w.decode()])))[0][0])
    w, _, _, contexts = _probabilities(model)
    for (a, b), total in mean.items():
        got = contexts[key(a)][np.searchsorted(w, key(b))]
        assert abs(got - total / kept) < 0.02 + 0.1 * total / kept, (a, b, got, total / kept)


def test_discount_and_strength_are_sampled(spark):
    """Restaurants filled with known values: the posterior finds them again; the learned values are no constants."""
    rng = np.random.default_rng(7)
    discount, strength, k = 0.6, 6.0, 400
    n, others, parent, key = [], [], [], []
    tables, customers = [], []
    for u in range(k):
        # One restaurant over a wide base: each table a dish of its own, as the base hardly repeats.
        sizes = []
        for i in range(300):
            p = np.r_[np.array(sizes) - discount, strength + discount * len(sizes)] / (strength + i)
            at = rng.choice(len(p), p=p)
            sizes = [*sizes, 1] if at == len(sizes) else [*sizes[:at], sizes[at] + 1, *sizes[at + 1:]]
        tables.append(len(sizes))
        customers.append(300)
        n += sizes
        others += [len(sizes) - 1] * len(sizes)
        key += [u * 1000 + i for i in range(len(sizes))]
    n, key = np.array(n), np.array(key)
    d, s, seen = 0.8, 1.0, []
    for sweep in range(60):
        # No new tables are opened at a parent's probability of 0, so the seating stays the one drawn above.
        kept, marks = perplexity.seat_marked(n, np.array(others, float), np.zeros(len(n)), d, s, key, np.full(len(key), sweep))
        assert (kept == 1).all()
        sums = perplexity.drawn(np.array(customers), np.array(tables, float), d, s, np.arange(k), np.full(k, sweep))
        d, s = perplexity.sampled(sums, marks.sum(), sweep)
        seen.append((d, s))
    d, s = np.mean(seen[20:], axis=0)
    assert abs(d - discount) < 0.03 and abs(s - strength) < 1.0, (d, s)
    df = spark.createDataFrame(rows([prose(3000 + i, 300, "ab") for i in range(40)]), SCHEMA)
    numbers = perplexity.learn(df).numbers
    assert numbers.strength != 1.0 and numbers.root_strength != 1.0


def test_perplexity_of_rare_contexts(spark, monkeypatch):
    """Every word seen twice as a predecessor has a restaurant, however small its share; slices change little."""
    texts = [prose(3100 + i, 300) + f" left{i % 20} right{i % 20} " + prose(3200 + i, 300) for i in range(60)]
    asked = [f"left{i} right{i}" for i in range(20)] + [f"left{i} right{(i + 1) % 20}" for i in range(20)]
    df = spark.createDataFrame(rows(texts + asked), SCHEMA)
    train, last = df.where("doc_id < 60"), F.col("doc_id") >= 60
    keys = {}
    for text in texts:
        w = [b"", *brute.low_words(text)]
        keys = {**keys, **{x: keys.get(x, 0) + w.count(x) for x in set(w)}}
    model = perplexity.learn(train)
    assert model.lexicon.where("customers > 0").count() == sum(n >= 2 for n in keys.values()) > 500
    got = by_id(perplexity.perplexity(df, last), "score")
    assert all(got[60 + i][0] > got[80 + i][0] + 1 for i in range(20))
    monkeypatch.setattr(perplexity, "SLICE", 3)
    sliced = by_id(perplexity.perplexity(df, last), "score")
    assert all(abs(sliced[i][0] - got[i][0]) < 0.02 * abs(got[i][0]) for i in got)


def test_words_seen_once_have_restaurants(spark):
    """After a word seen once, its own follower has the mass of one customer and the others what that one leaves to the root."""
    key = lambda w: perplexity.END if w is None else int(perplexity.tokens(*T.buffers(pa.array([w])))[0][0])
    asked = ["solo follows", "solo solo", "follows unheard", "follows"]
    for texts in ([prose(3300 + i, 200) for i in range(20)] + [asked[0]], [asked[0]]):
        seen = [x for text in texts for x in brute.low_words(text)]
        assert seen.count(b"solo") == seen.count(b"follows") == 1
        model = perplexity.learn(spark.createDataFrame(rows(texts), SCHEMA))
        s, (w, n, p, contexts) = model.numbers, _probabilities(model)
        root = lambda b: p[np.searchsorted(w, key(b))] if key(b) in w else np.array(model.unknown)

        def after(a, b):
            if key(a) not in w:
                return root(b).mean()
            if key(a) in contexts:
                return contexts[key(a)][np.searchsorted(w, key(b))]
            own = (a, b) in ((None, "solo"), ("solo", "follows"), ("follows", None))
            return (own * (1 - s.discount) + (s.strength + s.discount) * root(b).mean()) / (s.strength + 1)

        assert len(texts) > 1 or abs(sum(after("solo", b) for b in (None, "solo", "follows", "unheard")) - 1) < 1e-9
        got = by_id(perplexity.score(spark.createDataFrame(rows(asked), SCHEMA), model), "score")
        for i, text in enumerate(asked):
            words = [None, *text.split(), None]
            want = sum(np.log10(after(a, b)) for a, b in zip(words, words[1:]))
            assert abs(got[i][0] - want) < 1e-9 * abs(want), (text, got[i][0], want)


def test_perplexity_sums_are_exact(monkeypatch):
    """Sums of pairs, also where two pairs have one key; parts are ranges of the sorted keys."""
    rng = np.random.default_rng(3)
    c, w = rng.integers(-5, 5, 500), rng.integers(-3, 3, 500)
    want = {}
    for a, b in zip(c.tolist(), w.tolist()):
        want[a, b] = want.get((a, b), 0) + 1
    for key in (perplexity.pair_key, lambda c, w: np.zeros(len(c), np.int64)):
        monkeypatch.setattr(perplexity, "pair_key", key)
        a, b, n = perplexity._summed(c, w, np.ones(500, np.int64))
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
    keys = np.sort(rng.integers(-2**63, 2**63 - 1, 5000))
    part = perplexity.part_of(keys, 7)
    assert (np.diff(part) >= 0).all() and set(part) == set(range(7)) and np.bincount(part).min() > 500
    for x in (keys[rng.integers(0, 50, 300)], keys[:0]):
        distinct, at = perplexity._ranked(x)
        assert (distinct == np.unique(x)).all() and (distinct[at] == x).all() and (perplexity._distinct(x) == distinct).all()


def test_perplexity_holds_little(spark, monkeypatch):
    """Pairs are packed blocks, not rows; what a pass has asked is gone before the texts are judged."""
    written, left, write = {}, {}, perplexity.materialize

    def kept(df, label="stage", *args, **named):
        if label == "scores":
            left.update({x: sum(spark.read.parquet(f).count() for f in written[x].inputFiles() if os.path.exists(f.removeprefix("file://"))) for x in ("requests", "blocks")})
        written[label] = write(df, label, *args, **named)
        return written[label]

    monkeypatch.setattr(perplexity, "materialize", kept)
    df = spark.createDataFrame(rows([prose(4000 + i, 300) for i in range(20)]), SCHEMA)
    model = perplexity.learn(df)
    assert 1 <= written["pairs"].count() < 10 < model.pairs.count()
    assert perplexity.score(df, model).count() == 20
    assert left == {"requests": 0, "blocks": 0}


def test_language_id(spark, odd):
    texts = {"aa": [prose(i, 25, "abcdefgh") for i in range(60)], "bb": [prose(i, 25, "hijklmnop") for i in range(60)]}
    data = [(i * 2 + k, t, lang, None, None, None, None, None) for k, (lang, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    df = spark.createDataFrame([*data, (900, "12 34 !", "aa", None, None, None, None, None), (901, None, None, None, None, None, None, None)], SCHEMA)
    model = langid.learn(df, F.col("doc_id") % 4 < 2)
    got = by_id(langid.predict(df, model), "lang_pred", "score")
    held = [r for r in data if r[0] % 4 >= 2]
    assert sum(got[r[0]][0] == r[2] for r in held) >= 0.95 * len(held)
    assert got[900] == ("und", 0.0) and got[901] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(odd, model).where("lang_pred = 'und'").count() == 4
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.predict(df, langid.learn(df.where("lang IS NULL"), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_language_id_learns_rare_languages(spark):
    """The sample is bounded for each language, so a rare one is learned beside a large one."""
    texts = [(prose(i, 25, "abcdefgh"), "aa") for i in range(400)] + [(prose(i, 25, "hijklmnop"), "bb") for i in range(4)]
    df = spark.createDataFrame([(i, t, lang, None, None, None, None, None) for i, (t, lang) in enumerate(texts)], SCHEMA)
    model = langid.learn(df, F.lit(True), fit_rows=3)
    assert model.langs == ["aa", "bb"]
    got = by_id(langid.predict(df, model), "lang_pred")
    assert np.mean([got[i] == (lang,) for i, (_, lang) in enumerate(texts)]) > 0.95 and all(got[i] == ("bb",) for i in range(400, 404))


def test_vocabulary_keeps_long_pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    pieces = {model.id_to_piece(i).replace("▁", " ").encode().lower() for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    long = {p for p in pieces if 16 < len(p) <= langid.LONGEST}
    assert long and long <= set(langid.vocabulary())


def test_segmentations_sum_over_all_ways():
    words = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab"]
    pieces = langid.pieces_of(words)
    p = np.r_[np.random.default_rng(1).random((len(words), 2)), np.zeros((1, 2))]

    def total(text, c):
        return 1.0 if not text else sum(p[i, c] * total(text[len(w):], c) for i, w in enumerate(words) if text.startswith(w))

    tests = [b" ab", b" abab", b" ba", b" a", b" bbaab"]
    got = langid.word_log_probability(tests, pieces, p)
    assert np.allclose(got, [[np.log(total(t, c)) for c in (0, 1)] for t in tests])
    counts = langid.expected_counts(tests, np.ones((len(tests), 2)), pieces, p)
    lengths = counts.T @ np.array([*map(len, words), 0])
    assert np.allclose(lengths, sum(map(len, tests)))


def test_url_rules(spark):
    cases = {
        1: ("https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://A.B.NET/x?y#z", "a.b.net", "/x", "net/", "block"), 3: ("http://example.com/de/#q", "example.com", "/de/", "example.com/de/", "block"),
        4: ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"), 5: ("http://internet/x", "internet", "/x", None, None),
        6: ("http://a.net", "a.net", "", None, None), 7: ("http://a.net?x=/en/", "a.net", "", None, None), 8: (None, "", "", None, None),
        9: ("no scheme", "", "", None, None), 10: ("x://Ü.net//a", "Ü.net", "//a", "net/", "block"), 11: ("a://b://c/d", "b:", "//c/d", None, None),
        12: ("http://" + "h" * 9000 + "/" + "p" * 9000, "h" * 9000, "/" + "p" * 9000, None, None)}
    pages = spark.createDataFrame([(i, c[0], "<p>", "clash", 1) for i, c in cases.items()], "page_id bigint, url string, html string, rule string, host int")
    got = {r.page_id: r for r in urls.judge(pages, urls.labelled_by_rules(pages)).collect()}
    for i, (_, host, path, rule, verdict) in cases.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.where("false"), urls.labelled_by_rules(pages)).count() == 0
    none = urls.judge(pages, urls.labelled_by_rules(pages.where("false")))
    assert none.where("rule IS NULL AND verdict <> 'allow'").count() == 0


def test_url_method_learns(spark):
    data = [(i, f"http://{'casino' if i % 2 else 'museum'}{prose(i, 1)}.com/{prose(i, 1)}") for i in range(200)]
    pages = spark.createDataFrame(data, "page_id bigint, url string")
    labelled = pages.where("page_id < 100").select("url", (F.col("page_id") % 2).cast("int").alias("blocked"))
    got = {r.page_id: r.verdict for r in urls.judge(pages, labelled, rules=()).collect()}
    assert sum((got[i] == "block") == (i % 2 == 1) for i in range(100, 200)) >= 97


def test_preference_pairs(spark):
    turns = [
        ("p", "chosen", 0, "user", "hi"), ("p", "rejected", 0, "user", "hi"), ("p", "chosen", 1, "assistant", None), ("p", "rejected", 1, "assistant", None),
        ("p", "chosen", 2, "user", "more"), ("p", "rejected", 2, "user", "else"), ("p", "chosen", 3, "assistant", "good"), ("p", "chosen", 3, "assistant", "good"),
        ("q", "chosen", 0, None, "x"), ("q", "rejected", 0, None, "x"), ("r", "rejected", 5, "assistant", "only"),
        (None, "chosen", 0, "user", "a"), ("s", "other", 0, "user", "a"), ("s", "chosen", None, "user", "a")]
    df = spark.createDataFrame(turns, "pair_id string, side string, turn bigint, role string, text string")
    got = sorted((r.pair_id, r.part, r.turn, r.content, r.content[r.train_from:r.train_to] if r.trained else None) for r in preference.format_pairs(df).collect())
    line = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert got == sorted([
        ("p", "prompt", 0, line("user", "hi"), None), ("p", "prompt", 1, line("assistant", ""), None), ("p", "chosen", 2, line("user", "more"), None),
        ("p", "rejected", 2, line("user", "else"), None), ("p", "chosen", 3, line("assistant", "good"), "good\n<|end|>"),
        ("q", "prompt", 0, line("user", "x"), None), ("r", "rejected", 5, line("assistant", "only"), "only\n<|end|>")])
    assert preference.format_pairs(df.where("false")).count() == 0


def test_preference_from_conversations(spark):
    data = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (2, 2, "user", "e"),
            (3, 0, "user", "no reply"), (None, 0, "user", "x"), (4, 0, "assistant", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "conv_id bigint, turn bigint, role string, text string, side string")
    got = sorted((r.pair_id, r.part, r.turn) for r in preference.format_pairs(preference.replies_swapped(df)).collect())
    # 1 takes d of 2, 2 takes b of 4, 4 goes on from the start: 1 says b too, so it takes d of 2.
    assert got == [(1, "chosen", 1), (1, "prompt", 0), (1, "rejected", 1), (2, "chosen", 1), (2, "prompt", 0), (2, "rejected", 1),
                   (4, "chosen", 0), (4, "rejected", 0)]
    assert preference.replies_swapped(df.where("conv_id IN (1, 4)")).count() == 0


def test_replies_are_paired_across_gaps_and_equal_runs(spark):
    """Ids far apart and below zero, long runs of one reply, null and very long replies, against a plain walk."""
    rng = random.Random(3)
    ids = sorted(rng.sample(range(-10**6, 10**6), 120)) + [-2**63, 2**63 - 1]
    replies = {k: rng.choice(["same"] * 6 + [None, "", "b", "x" * 70_000]) for k in ids}
    data = [(k, 0, "user", "hi", "clash") for k in ids] + [(k, 1, "assistant", replies[k], "clash") for k in ids] * 2
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, reply string").repartition(5)
    got = {r.pair_id: r.text for r in preference.replies_swapped(df).where("side = 'rejected' AND turn = 1").collect()}
    order, want = sorted(ids), {}
    for i, k in enumerate(order):
        want[k] = next(replies[x] for x in order[i + 1:] + order[:i] if replies[x] != replies[k])
    assert got == want
