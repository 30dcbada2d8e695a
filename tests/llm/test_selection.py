"""Importance resampling, the filter audit and SimHash against plain versions, with every odd case."""

import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from failscope.llm import audit, importance, radix, simhash  # noqa: E402
from failscope.llm import textbuf as T  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, lang string, score double, key string, place int, digest string, fp string, rank int"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prose(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def frame(spark, rows):
    """Documents of (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "en", 0.5, "clash", 7, "x", "y", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " \t\n\x0b\x0c\r", "one", "one", "ONE two", base, base, base.upper(), " ".join(near), "é" * 400, "the " * 600,
        "ü 日本 \U0001f600 x y z " * 30, prose(5, 20000), "b & c | <d>", "x" * 70_000, "x" * 70 + " y " + "z" * 90, None, base + " tail"]
    return [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)] + [
        (6, base, "s0"), (6, prose(9, 60), ""), (None, base, "s1"), (None, prose(8, 70), None), (None, None, "s2"), (3, "one", "s0"), (3, "one", "s0")]


# Importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(_LOWER).decode())
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def resampled(rows, target, buckets=10000, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    listed = [(key, *features(text)) for key, text, _ in rows]
    for _, fs, _ in listed:
        s.update(map(bucket, fs))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    S, N = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (N + buckets)))) for b in range(buckets)]
    out = []
    for key, fs, words in listed:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words >= least])
    asked = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(asked[:percent * len(asked) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_checksums_of_word_runs():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcXYZ é\n\t 日9,.") for _ in range(rng.choice([0, 1, 2, 5, 30, 200]))) for _ in range(200)]
    texts += ["x" * 70_000, None, "a" * 64 + " " + "b" * 65 + " c d", "a"]
    n, runs, left = importance.checksums(*T.buffers(pa.array(texts)))
    at = 0
    for text, words in zip(texts, n):
        found = features(text)[0]
        assert words == features(text)[1]
        want = [zlib.crc32(f.encode()) for f in found]
        got = [int(runs[size][at + i]) for size in (0, 1, 2) for i in range(words - size) if words > size]
        assert got == want
        assert all(left[at + i] == words - i for i in range(words))
        at += words


def test_resampling(spark, odd_rows):
    rows = odd_rows + [(100 + i, prose(i, 15 + i % 11, "abcxyz"), "s") for i in range(300)] + [(400, prose(3, 40), None)] * 2
    target = [prose(900 + i, 30, "xyz") for i in range(20)] + [None, "", "x " * 50]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame(spark, rows), bench, percent=20).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == resampled(rows, target, percent=20)
    again = importance.resample(frame(spark, rows).repartition(7), bench, percent=20).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert importance.resample(frame(spark, []), bench).count() == 0
    alone = importance.resample(frame(spark, rows), bench.where("false")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, alone), key=str) == resampled(rows, [])


def test_resampling_of_a_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = importance.resample(frame(spark, rows), bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == resampled(rows, [r.text for r in bench.collect()])
    assert sum(r.rank is not None for r in got) > 5


def test_drawing_ties(spark):
    """Equal scores, a hot id and rows equal in everything; few score bins."""
    rng = random.Random(6)
    rows = [(i * 3, rng.choice([None, 5, 5, 5, rng.randrange(50)]), rng.randrange(3), rng.choice([7, 7, -9, 2**40])) for i in range(1000)]
    df = spark.createDataFrame(rows, "place bigint, key bigint, n_features bigint, score bigint")
    got = {r.rank: r.place for r in importance.drawn(df, 40).collect()}
    keys = {r[0]: (-r[3], r[1] is None, r[1] or 0, r[2]) for r in rows}
    assert [keys[got[i]] for i in range(1, 401)] == sorted(keys.values())[:400]


# Radix sort


@pytest.mark.parametrize("digit_bits,block", [(7, 10), (14, 1 << 18), (16, 64)])
def test_radix_sort(spark, digit_bits, block):
    rng = np.random.default_rng(digit_bits)
    n = 700
    big = np.r_[rng.integers(-2**63, 2**63 - 1, n - 2), -2**63, 2**63 - 1]
    hot = np.where(rng.random(n) < 0.4, 5, rng.integers(-40, 40, n))
    place = rng.permutation(n) * 1000
    rows = [(int(p), int(h), int(b), i) for i, (p, h, b) in enumerate(zip(place, hot, big))]
    df = spark.createDataFrame(rows, "place bigint, hot bigint, big bigint, id int").repartition(5)
    for columns in (["hot"], ["hot", "big"], ["big", "hot"] if digit_bits > 7 else ["hot", "hot"]):
        got = radix.sort_places(df, columns, digit_bits, block).collect()
        assert sorted(r.place for r in got) == list(range(n))
        want = sorted(rows, key=lambda r: tuple({"hot": r[1], "big": r[2]}[c] for c in columns) + (r[0],))  # stable
        assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r[3] for r in want]
    assert radix.sort_places(df.where("false"), ["hot"]).count() == 0
    same = radix.sort_places(df.where("id < 20").withColumn("hot", F.lit(1).cast("bigint")), ["hot"])
    assert [r.id for r in same.orderBy("place").collect()] == [r[3] for r in sorted(rows[:20])]


def test_digit_plan_covers_every_bit_once():
    plan = radix.digit_plan([(-2**63, 2**63 - 1), (0, 0), (-5, 900)], 14)
    bits = Counter((column, shift + i) for pieces in plan for column, shift, width, _ in pieces for i in range(width))
    assert set(bits.values()) == {1} and sorted(bits) == [(0, i) for i in range(64)] + [(2, i) for i in range(10)]
    assert plan[0][0][0] == 2 and all(at + width <= 14 for pieces in plan for _, _, width, at in pieces)


# Filter audit


def audited(rows, labels):
    """Every order applied to every document."""
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    out = {}
    fails = []
    for key, text, source in rows:
        text = text or ""
        w = brute.words(text)
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        f |= {"E"} if key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows) else set()
        fails.append((source or "", f, key))
    for part in {p for p, _, _ in fails}:
        mine = [(f, key) for p, f, key in fails if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for f, _ in mine) - len(gone), sum(f == {letter} for f, _ in mine),
                    sum(k in good for _, k in gone if k is not None), sum(k in toxic for _, k in gone if k is not None)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit(spark, odd_rows):
    rng = random.Random(8)
    rows = odd_rows + [(200 + i, " ".join(rng.choice(["One", "two", "three", "#4", "five", "six", "SEVEN", prose(i, 30)]) for _ in range(rng.choice([5, 60]))),
                        rng.choice(["s0", "other", None])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(250)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (9999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit(frame(spark, rows), known)
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)
    assert audit.audit(frame(spark, []), known).count() == 0
    assert sorted(map(tuple, audit.audit(frame(spark, rows[:3]), known.where("false")).collect())) == audited(rows[:3], [])


def test_removal_intervals_partition_the_orders():
    for n in (1, 2, 3, 5):
        orders = list(itertools.permutations(range(n)))
        assert [audit.lehmer_rank(o) for o in orders] == list(range(len(orders)))
        for mask in range(1, 1 << n):
            step = {}
            for k, first, after in audit.removal_intervals(mask, n):
                for r in range(first, after):
                    assert r not in step
                    step[r] = k
            assert step == {r: next(i for i, x in enumerate(o) if mask >> x & 1) for r, o in enumerate(orders)}


# SimHash


def fingerprint(text):
    w = (text or "").encode().translate(_LOWER).split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(keys, prints, radius=2):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{p:016x}", least.get(find(i))) for i, (k, p) in enumerate(zip(keys, prints))]


def test_xxh64():
    rng = random.Random(2)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    spans = [(a, a + n) for n in [*range(0, 80), 200, 1000] for a in (0, 1, 7, 13, 4000 - n)]
    starts, ends = np.array(spans).T
    for seed in (0, 42):
        got = simhash.xxh64(np.frombuffer(raw, np.uint8), starts, ends, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b], seed=seed) for a, b in spans]


def test_fingerprints():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ é\n\t 日9,.") for _ in range(rng.choice([0, 1, 2, 5, 30, 400]))) for _ in range(300)]
    texts += ["x" * 70_000, "", None, "a", "a b", "a b ", " a b c", "a\nb", "x" * 100 + " " + "y" * 65 + " z z", "one two three " * 40]
    for part in (texts, texts[-1:], [None], ["z"], ["x", "y"]):
        assert simhash.fingerprints(*T.buffers(pa.array(part, pa.string()))).tolist() == [fingerprint(t) for t in part]


@pytest.mark.parametrize("bucket", [1024, 4, 0])
def test_simhash(spark, odd_rows, bucket):
    base = prose(70, 300).split(" ")
    near = [(500 + i, " ".join(base[:i] + [f"e{i}"] + base[i + 1:]), "s") for i in range(0, 300, 3)]
    rows = odd_rows + near + [(600 + i, prose(700 + i, 40), None) for i in range(40)]
    got = simhash.near_duplicates(frame(spark, rows).repartition(6), bucket=bucket).select("doc_id", "fingerprint", "component_id").collect()
    want = simhash_groups([r[0] for r in rows], [fingerprint(r[1]) for r in rows])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({w[2] for w in want}) < len(rows) - 60
    assert simhash.near_duplicates(frame(spark, []), bucket=bucket).count() == 0


@pytest.mark.parametrize("bucket", [1024, 40, 0])
def test_links_join_all_that_are_near(spark, bucket):
    """Planted fingerprints at every split of two bits over the segments, crowds that share a segment, sign bits."""
    rng = random.Random(9)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for d in (1, 2, 2, 3):
            q = p
            for b in rng.sample(range(64), d):
                q ^= 1 << b
            prints.add(q)
    prints |= {(0x80000001 << 32) | rng.getrandbits(32) for _ in range(150)} | {(rng.getrandbits(32) << 32) | 0xFFFFFFFF for _ in range(150)}
    prints |= {0, 1, 1 << 63, 3 << 62, (1 << 64) - 1} | {(7 << 32) | (1 << i) | (1 << j) for i in range(16) for j in range(16)}
    listed = sorted(prints)
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in listed], "fp bigint").repartition(4)
    at = {p: i for i, p in enumerate(listed)}
    pairs = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, bucket).collect()]
    root = list(range(len(listed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(at[a])] = find(at[b])
    want = {k: g for k, _, g in simhash_groups(list(range(len(listed))), listed)}
    classes = {}
    for i in range(len(listed)):
        classes.setdefault(find(i), set()).add(want[i])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(want.values()))
    assert len(pairs) < 3 * len(listed) if bucket == 1024 else True
