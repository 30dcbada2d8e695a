"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A text's shingles (three words, repeats included) are hashed with XXH64, and bit b of the
fingerprint is set where more than half of the hashes have it.  Texts link at ``RADIUS`` = 2
or fewer differing bits.

The fingerprint is cut into two segments of 32 bits, and each segment indexes all distinct
fingerprints.  Of two differing bits at most one is in the upper segment, or the lower
segments are equal; so a fingerprint looks up the Hamming ball of radius 1 around its upper
segment and of radius 0 around its lower one.  The ball is halved by symmetry: of two
segments that differ in one bit the one where it is clear asks.  All matches are verified on
the complete fingerprints.

Equal fingerprints are one member with its least id, so groups of copies cost nothing.  A
bucket is one segment value with its members and askers; a task verifies a bucket of up to
``BUCKET`` rows by comparing them in vectors and keeps links to one member for each local
component, so no pair list is made.  Members and askers of a larger bucket instead
enumerate the ball around the *rest* of the fingerprint too and are joined on the whole of
it: at most 528 rows for each, whatever the bucket's size, dealt evenly since whole
fingerprints are distinct.  Both ways give the same links.

Defined cases: a null text, or one without words, has fingerprint zero, which links like any
other; repeated rows are copies; a null id gives a null component unless its group has other
ids; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.llm.neardup import components
from failscope.storage import materialize

SHINGLE_WORDS = 3
SEED = 42
BUCKET = 1024
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, PRIMES)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range, all ranges one step further at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[:len(buf)] = buf
    lane8 = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    lane4 = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    length, at = (ends - starts).astype(np.int64), starts.astype(np.int64)
    p1, p2, _, _, p5 = PRIMES
    begun = [np.uint64(x % (1 << 64)) for x in (seed + p1 + p2, seed + p2, seed, seed - p1, seed + p5)]
    h = np.full(len(starts), begun[4])
    live = np.flatnonzero(length >= 32)
    if len(live):
        acc = [np.full(len(live), x) for x in begun[:4]]
        stripes, done = length[live] // 32, 0
        going = np.arange(len(live))
        while len(going):
            p = at[live[going]] + 32 * done
            for i in range(4):
                acc[i][going] = _round(acc[i][going], lane8[p + 8 * i])
            done += 1
            going = going[stripes[going] > done]
        whole = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
        for a in acc:
            whole = (whole ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[live] = whole
        at[live] += 32 * stripes
    h += length.astype(np.uint64)
    for _ in range(3):
        live = np.flatnonzero(at + 8 <= ends)
        if not len(live):
            break
        x = h[live] ^ _round(np.zeros(len(live), np.uint64), lane8[at[live]])
        h[live] = _rotated(x, 27) * _P1 + _P4
        at[live] += 8
    live = np.flatnonzero(at + 4 <= ends)
    h[live] = _rotated(h[live] ^ (lane4[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[live] += 4
    for _ in range(3):
        live = np.flatnonzero(at < ends)
        if not len(live):
            break
        h[live] = _rotated(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def joined_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all rows, each followed by one space; their starts, ends and rows."""
    low = T.LOWER[buf]
    starts, ends, row = T.words(low, off)
    keep = ~T.SPACE[low]
    keep[ends[ends < len(low)]] = True
    text = low[keep]
    text[T.SPACE[text]] = 32
    # A word at a row's very end may have no white space after it in the buffer.
    size = ends - starts
    place = np.cumsum(keep) - keep
    first = place[starts] if len(starts) else np.zeros(0, np.int64)
    if len(starts) and (first[1:] != first[:-1] + size[:-1] + 1).any():
        text = np.full(int(size.sum()) + len(size), 32, np.uint8)
        first = np.r_[0, np.cumsum(size + 1)][:-1]
        inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        text[inside] = low[~T.SPACE[low]]
    return text, first, first + size, row


def fingerprints(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The SimHash of each row."""
    n = len(off) - 1
    text, starts, ends, row = joined_words(buf, off)
    per_row = np.bincount(row, minlength=n)
    number = np.maximum(per_row - k + 1, per_row > 0)
    if not len(starts):
        return np.zeros(n, np.uint64)
    first_word = np.cumsum(per_row) - per_row
    owner = np.repeat(np.arange(n), number)
    first = first_word[owner] + np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
    last = first + np.minimum(k, per_row[owner]) - 1
    h = xxh64(text, starts[first], ends[last])
    out = np.zeros(n, np.uint64)
    filled = np.flatnonzero(number)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    bounds = np.r_[0, np.cumsum(number[filled])]
    ones = np.array([bits[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(bounds[:-1], bounds[1:])])
    out[filled] = np.packbits(2 * ones > number[filled][:, None], axis=1).view(np.uint64).ravel()
    return out


def fingerprinted(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and fp (as a signed long) of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(1))
            for i, j in T.portions(off, limit=1 << 19):
                fp = fingerprints(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.record_batch({"key": batch.column(0).slice(i, j - i), "fp": pa.array(T.as_long(fp))})

    return documents.select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, fp bigint")


def _flips(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``value`` and, for each, one value with one clear bit of the low 32 set."""
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    at, b = np.nonzero((value[:, None] & bit) == 0)
    return at, value[at] | bit[b]


def probes(fps: DataFrame) -> DataFrame:
    """segment (0 upper, 1 lower), bucket, fp and asks for all members and askers of both tables.

    Members of a bucket look among themselves; an asker looks among the members only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1 << 15):
                fp = batch.column(0).slice(i, 1 << 15).to_numpy().view(np.uint64)
                upper, lower = fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)
                at, near = _flips(upper)
                n = len(fp)
                yield pa.record_batch({
                    "segment": pa.array(np.repeat(np.array([0, 1, 0], np.int8), (n, n, len(at)))),
                    "bucket": pa.array(np.r_[upper, lower, near].astype(np.uint32).view(np.int32)),
                    "fp": pa.array(T.as_long(np.r_[fp, fp, fp[at]])), "asks": pa.array(np.repeat([False, True], (2 * n, len(at))))})

    return fps.mapInArrow(run, "segment tinyint, bucket int, fp bigint, asks boolean")


def _near(mine: np.ndarray, theirs: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs of values within the radius, a few rows of the comparison at a time."""
    out, step = [], max(1, (1 << 22) // max(1, len(theirs)))
    for i in range(0, len(mine), step):
        a, b = np.nonzero(np.bitwise_count(mine[i:i + step, None] ^ theirs[None, :]) <= radius)
        out.append(np.column_stack([a + i, b]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n items over the pairs."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def verify(bucket: pa.Table, radius: int) -> pa.Table:
    """Links (a, b) of a bucket: its members as a star for each local component, then one link from each asker to each of these."""
    fp, asks = bucket["fp"].to_numpy().view(np.uint64), bucket["asks"].to_numpy(zero_copy_only=False)
    members, askers = np.unique(fp[~asks]), np.unique(fp[asks])
    own = _near(members, members, radius)
    root = _forest(len(members), own[own[:, 0] < own[:, 1]])
    child = np.flatnonzero(root != np.arange(len(members)))
    found = _near(askers, members, radius)
    found[:, 1] = root[found[:, 1]]
    found = np.unique(found, axis=0)
    # A link to a component stands for one to its least member: they are joined by the star.
    a, b = np.r_[members[child], askers[found[:, 0]]], np.r_[members[root[child]], members[found[:, 1]]]
    return pa.table({"a": pa.array(T.as_long(a)), "b": pa.array(T.as_long(b))})


def balls(rows: DataFrame, radius: int = 2) -> DataFrame:
    """a (the fingerprint that asks) and b (a whole fingerprint that may exist) for rows (segment, bucket, fp, asks).

    A member enumerates the rest of the fingerprint within the radius (and asks for greater ones
    only), an asker, which has spent one bit on its bucket, within one bit less.
    """
    bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
    first, second = np.triu_indices(32, 1)
    masks = [np.zeros(1, np.uint64), bit, bit[first] | bit[second]][:radius + 1]
    reach = {True: np.concatenate(masks[:-1]), False: np.concatenate(masks)[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                upper = part["segment"].to_numpy() == 0
                bucket = part["bucket"].to_numpy().view(np.uint32).astype(np.uint64)
                fp, asks = part["fp"].to_numpy().view(np.uint64), part["asks"].to_numpy(zero_copy_only=False)
                for side in (False, True):
                    for up in (False, True):
                        x = np.flatnonzero((asks == side) & (upper == up))
                        rest = fp[x] & np.uint64(0xFFFFFFFF) if up else fp[x] >> np.uint64(32)
                        near = rest[:, None] ^ reach[side][None, :]
                        other = (bucket[x][:, None] << np.uint64(32)) | near if up else (near << np.uint64(32)) | bucket[x][:, None]
                        row, column = np.nonzero(side | (other > fp[x][:, None]))
                        yield pa.record_batch({"a": pa.array(T.as_long(fp[x][row])), "b": pa.array(T.as_long(other[row, column]))})

    return rows.select("segment", "bucket", "fp", "asks").mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` of each component."""
    rows = materialize(probes(fps), "probes")
    # Only buckets in which two fingerprints can meet: two members, or a member and an asker.
    size = rows.groupBy("segment", "bucket").agg(F.count(F.lit(1)).alias("size"), F.min("asks").alias("empty"))
    met = materialize(size.where("size > 1 AND NOT empty").select("segment", "bucket", "size"), "met")
    small = rows.join(met.where(F.col("size") <= bucket).select("segment", "bucket"), ["segment", "bucket"], "left_semi")
    found = small.groupBy("segment", "bucket").applyInArrow(lambda table: verify(table, 2), "a bigint, b bigint")
    if met.where(F.col("size") > bucket).isEmpty():
        return found
    large = rows.join(F.broadcast(met.where(F.col("size") > bucket).select("segment", "bucket")), ["segment", "bucket"], "left_semi")
    return found.unionByName(balls(large).join(fps.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """key, fingerprint and component_id of each row."""
    rows = materialize(fingerprinted(documents, key), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "fps")
    roots = components(links(fps.select("fp"), bucket), "simhash-star").select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
