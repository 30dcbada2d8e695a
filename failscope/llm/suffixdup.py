"""Exact substring dedup with suffix arrays built by induced sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
elsewhere.  The corpus is cut into shards that cannot lose a match: the window of
LENGTH bytes at a position has an anchor, its least hashed ``GRAM``-byte string, so equal
windows have equal anchors.  The positions that share an anchor form a context (the
bytes their windows cover), and contexts are sharded by the anchor's hash.

* Contexts that occur twice or more, as 128-bit fingerprints, need no text: all their
  positions repeat.  Copies within a task are settled there, before any shuffle, so a
  group of copies sends one row for each task.
* Contexts alone with their anchor hash have no partner at all.
* What is left are the edges of repeats: different contexts under one anchor.  Their
  texts are fetched once, and each shard gets a suffix array (``suffixarray``), whose
  permuted common prefixes tell which positions repeat.
* An anchor with more than ``CROWD`` such contexts is settled by counting fingerprints
  of its single windows, which pre-aggregates and spreads evenly.

Intervals then meet the texts by id and text hash.

Defined cases: a null or empty text has no bytes; a text shorter than LENGTH keeps all;
repeated rows (equal or null ids included) are texts of their own, so they repeat each
other; matches never cross texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from failscope.llm import textbuf as T
from failscope.llm.rows import text_hash
from failscope.llm.suffixarray import long_matches, suffix_array
from failscope.storage import materialize

LENGTH = 200
GRAM = 64
CROWD = 8192
SHARD_BYTES = 2 << 20
FLUSH = 1_000_000


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Contexts of the rows: row, first position, number of positions, anchor hash, context hash."""
    n = len(buf)
    if n < length:
        return {c: np.zeros(0, np.uint64 if c in ("h", "ctx") else np.int64) for c in ("row", "lo", "n", "h", "ctx")}
    prefix = T.prefix_hash(buf)
    _, down = T.powers(n + 1)
    at = n - gram + 1
    key = T.mix((prefix[gram:] - prefix[:at]) * down[:at])
    # The least (hash, position) of each window of gram starts: the leftmost of equal hashes.
    low = (key & ~np.uint64(0xFFFFFFFF)) | np.arange(at, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(anchor)]
    valid = np.arange(len(anchor)) + length <= off[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    end = valid.copy()
    end[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(end)
    a = anchor[first]
    ctx = T.range_hash(prefix, first, last + length) ^ T.mix((a - first).astype(np.uint64) + np.uint64(7))
    return {"row": row[first], "lo": first - off[row[first]], "n": last - first + 1, "h": key[a], "ctx": ctx}


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of a row as one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    shift = row.astype(np.int64) * (int(end.max()) + 2)  # so that the running maximum stays within a row
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start + shift)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return row[at], start[at], (reach - shift)[np.r_[at[1:], len(row)] - 1]


def _schema(kind: str) -> str:
    return f"key {kind}, th bigint, s int, e int, h bigint, ctx bigint, many boolean"


_NAMES = ["key", "th", "s", "e", "h", "ctx", "many"]


def _batch(keys: pa.Array, th: pa.Array, s, e, h=None, ctx=None, many=None) -> pa.RecordBatch:
    n = len(keys)
    longs = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(T.as_long(x))
    return pa.record_batch([
        keys, th, pa.array(np.asarray(s, np.int32)), pa.array(np.asarray(e, np.int32)), longs(h), longs(ctx),
        pa.nulls(n, pa.bool_()) if many is None else pa.array(many)], names=_NAMES)


def _contexts(documents: DataFrame, key: str, length: int, gram: int) -> DataFrame:
    """Open contexts (s, e: positions) and, with a null h, intervals that are settled (s, e: bytes)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        ids: list[pa.Array] = []
        hashes: list[pa.Array] = []
        rows = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, hashes, rows, size
            if held:
                a = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
                keys, th = pa.concat_arrays(ids), pa.concat_arrays(hashes)
                order = np.lexsort((a["ctx"], a["h"]))
                h, ctx = a["h"][order], a["ctx"][order]
                first = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])] if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(first)
                many = np.diff(np.r_[at, len(order)]) > 1
                rep = order[at]
                r = pa.array(a["row"][rep])
                yield _batch(keys.take(r), th.take(r), a["lo"][rep], (a["lo"] + a["n"])[rep], a["h"][rep], a["ctx"][rep], many)
                rest = order[~first]
                row, s, e = merged(a["row"][rest], a["lo"][rest], (a["lo"] + a["n"])[rest] + length - 1)
                r = pa.array(row)
                yield _batch(keys.take(r), th.take(r), s, e)
            held, ids, hashes, rows, size = [], [], [], 0, 0

        for batch in batches:
            buf, off = T.buffers(batch.column(2))
            ids.append(batch.column(0))
            hashes.append(batch.column(1))
            for i, j in T.portions(off):
                part = anchors(buf[off[i]:off[j]], off[i:j + 1] - off[i], length, gram)
                part["row"] = part["row"] + i + rows
                held.append(part)
                size += len(part["h"])
            rows += len(batch)
            if size > FLUSH:
                yield from flush()
        yield from flush()

    return documents.select(key, text_hash(), "text").mapInArrow(run, _schema(kind))


def _settle(rows: pa.Table, mixed: bool, length: int, last: bool) -> tuple[list[pa.RecordBatch], pa.Table, bool]:
    """Decide contexts sorted by (h, ctx) of whole anchors, or of the front part of one anchor.

    Returns the output, what to keep for the next call (of the last context, unless
    ``last``), and whether the anchor kept on has several contexts.
    """
    h = rows["h"].to_numpy().view(np.uint64)
    ctx = rows["ctx"].to_numpy().view(np.uint64)
    many = rows["many"].to_numpy(zero_copy_only=False)
    n = len(h)
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_c = new_h | np.r_[True, ctx[1:] != ctx[:-1]]
    anchor, context = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    copies = np.bincount(context, 1 + many)[context]
    several = np.bincount(anchor[new_c])[anchor] > 1
    several |= mixed & (anchor == 0)
    keep = np.zeros(n, bool)
    if not last:
        keep[np.flatnonzero(context == context[-1])[:2]] = True  # two copies tell as much as all
    covered = (copies > 1) & ~keep
    lonely = (copies == 1) & several & ~keep
    # A partner is of use only where something lonely is left, or may still come.
    wanted = np.bincount(anchor, lonely)[anchor] > 0
    if not last or mixed:
        wanted |= (anchor == anchor[-1]) | (anchor == 0)
    partner = (copies > 1) & new_c & several & wanted
    out = []
    s, e = rows["s"].to_numpy(), rows["e"].to_numpy()
    keys, th = rows["key"].combine_chunks(), rows["th"].combine_chunks()
    for mask, settled in ((covered, True), (lonely | partner, False)):
        at = np.flatnonzero(mask)
        if len(at):
            i = pa.array(at)
            if settled:
                out.append(_batch(keys.take(i), th.take(i), s[at], e[at] + length - 1))
            else:
                out.append(_batch(keys.take(i), th.take(i), s[at], e[at], h[at], ctx[at], copies[at] > 1))
    return out, rows.filter(pa.array(keep)), bool(several[-1])


def _sorted_out(opened: DataFrame, length: int) -> DataFrame:
    """Settled intervals, and contexts that differ from others of their anchor (``many``: needed as partner only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, mixed = None, False
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if carry is None else pa.concat_tables([carry, rows])
            h = rows["h"].to_numpy()
            other = np.flatnonzero(h != h[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and len(rows) > FLUSH // 4:
                out, carry, mixed = _settle(rows, mixed, length, last=False)
                yield from out
                continue
            if cut:
                yield from _settle(rows.slice(0, cut), mixed, length, last=True)[0]
                mixed = False
            carry = rows.slice(cut)
        if carry is not None and len(carry):
            yield from _settle(carry, mixed, length, last=True)[0]

    return opened.repartition("h").sortWithinPartitions("h", "ctx").mapInArrow(run, opened.schema)


def _with_text(documents: DataFrame, edges: DataFrame, key: str, length: int) -> DataFrame:
    """The edge contexts with their bytes; ``hot`` marks crowded anchors."""
    kind = documents.schema[key].dataType.simpleString()
    per_text = edges.groupBy("key", "th").agg(F.collect_list(F.struct("s", "e", "h", "many", "hot")).alias("items"))
    texts = documents.select(F.col(key).alias("id"), text_hash("t"), "text")
    both = texts.join(per_text, F.col("id").eqNullSafe(F.col("key")) & (F.col("t") == F.col("th"))).select("key", "th", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(2))
            whole, items = buf.tobytes(), batch.column(3)
            flat, sizes = items.flatten(), np.diff(items.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), sizes)
            s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
            begin, end = off[row] + s, off[row] + e + length - 1
            at = pa.array(row)
            yield pa.record_batch([
                batch.column(0).take(at), batch.column(1).take(at), flat.field("s"), flat.field("e"), flat.field("h"), flat.field("many"),
                flat.field("hot"), pa.array([whole[a:b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary())],
                names=["key", "th", "s", "e", "h", "many", "hot", "bytes"])

    return both.mapInArrow(run, f"key {kind}, th bigint, s int, e int, h bigint, many boolean, hot boolean, bytes binary")


def shard_intervals(items: pa.Table, length: int) -> pa.RecordBatch | None:
    """Repeated intervals of the contexts of one shard, by its suffix array."""
    raw = items["bytes"].to_pylist()
    sizes = np.array([len(b) for b in raw], np.int64)
    text = np.frombuffer(b"\xff".join(raw), np.uint8).astype(np.int32) + 2
    starts = np.r_[0, np.cumsum(sizes + 1)][:-1]
    text[starts[1:] - 1] = 1
    text = np.r_[text, 0]
    repeated = long_matches(text, suffix_array(text), length, starts, length + int(sizes.max()) + 8)
    s, n = items["s"].to_numpy(), items["e"].to_numpy() - items["s"].to_numpy()
    need = ~items["many"].to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(raw)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = repeated[starts[row] + at] & need[row]
    row, begin, end = merged(row[hit], at[hit], at[hit] + length)
    if not len(row):
        return None
    i = pa.array(row)
    return _batch(items["key"].combine_chunks().take(i), items["th"].combine_chunks().take(i), s[row] + begin, s[row] + end)


def _by_suffix_array(items: DataFrame, length: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shards(tables: list[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
            """All whole anchors of the held rows, in shards; the last anchor stays unless it is final."""
            nonlocal held, size
            rows = pa.Table.from_batches(tables)
            h = rows["h"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            end = len(h) if final else int(cuts[-1])
            volume = np.r_[0, np.cumsum(np.array([len(b) for b in rows["bytes"].to_pylist()]))]
            a = 0
            edges = [int(c) for c in cuts if 0 < c < end] + [end]
            for c, after in zip(edges, edges[1:] + [None]):
                if after is None or volume[after] - volume[a] > SHARD_BYTES:
                    if c > a:
                        found = shard_intervals(rows.slice(a, c - a), length)
                        if found is not None:
                            yield found
                    a = c
            held = rows.slice(end).to_batches()
            size = int(volume[-1] - volume[end])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.column("bytes").nbytes
                if size > 2 * SHARD_BYTES:
                    yield from shards(held, False)
        if held:
            yield from shards(held, True)

    return items.repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _by_windows(items: DataFrame, length: int, kind: str) -> DataFrame:
    """Repeated intervals of crowded anchors, by counts of their windows' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(pa.array(batch.column("bytes").to_pylist(), pa.large_binary()).view(pa.large_string()))
            n = batch.column("e").to_numpy() - batch.column("s").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            prefix = T.prefix_hash(buf)
            begin = off[row] + at
            one = T.range_hash(prefix, begin, begin + length)
            two = T.mix(T.range_hash(prefix, begin, begin + length // 2) * np.uint64(3) + T.range_hash(prefix, begin + length // 2, begin + length))
            i = pa.array(row)
            yield pa.record_batch([
                batch.column("key").take(i), batch.column("th").take(i), pa.array((batch.column("s").to_numpy()[row] + at).astype(np.int32)),
                pa.array(T.as_long(one)), pa.array(T.as_long(two))], names=["key", "th", "s", "f1", "f2"])

    windows = items.select("key", "th", "s", "e", "bytes").mapInArrow(run, f"key {kind}, th bigint, s int, f1 bigint, f2 bigint")
    again = windows.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2")
    return windows.join(again, ["f1", "f2"], "left_semi").select("key", "th", "s", (F.col("s") + length).alias("e"))


def intervals(documents: DataFrame, key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """key, th (text hash) and spans (byte intervals, unmerged) of the texts with repeats."""
    kind = documents.schema[key].dataType.simpleString()
    found = materialize(_contexts(documents, key, length, gram), "contexts")
    sorted_out = materialize(_sorted_out(found.where("h IS NOT NULL"), length), "edges")
    edges = sorted_out.where("h IS NOT NULL")
    crowded = edges.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h", F.lit(True).alias("hot"))
    edges = edges.join(crowded, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    items = _with_text(documents, edges, key, length)
    spans = found.where("h IS NULL").select("key", "th", "s", "e").unionByName(sorted_out.where("h IS NULL").select("key", "th", "s", "e"))
    if not crowded.isEmpty():
        items = materialize(items, "items")
        spans = spans.unionByName(_by_windows(items.where("hot"), length, kind))
    spans = spans.unionByName(_by_suffix_array(items.where("NOT hot"), length, _schema(kind)).select("key", "th", "s", "e"))
    return spans.groupBy("key", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _cut(column: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, int, int]]:
    """Remaining bytes, removed bytes and removed runs of each text."""
    buf, off = T.buffers(column)
    whole = buf.tobytes()
    sizes = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
    flat = spans.flatten()
    sizes = np.where(np.asarray(spans.is_valid()), sizes, 0)
    row, s, e = merged(np.repeat(np.arange(len(spans)), sizes), flat.field("s").to_numpy(), flat.field("e").to_numpy())
    bounds = np.searchsorted(row, np.arange(len(spans) + 1))
    for i in range(len(spans)):
        text = whole[off[i]:off[i + 1]]
        parts, at = [], 0
        for k in range(bounds[i], bounds[i + 1]):
            parts.append(text[at:s[k]])
            at = int(e[k])
        rest = b"".join([*parts, text[at:]])
        yield rest, len(text) - len(rest), int(bounds[i + 1] - bounds[i])


def _joined(documents: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(key).alias("id"), text_hash("t"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("key")) & (F.col("t") == F.col("th")), "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    return joined.select("row", F.coalesce("spans", none).alias("spans"))


def digest(documents: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    kind = documents.schema[key].dataType.simpleString()
    joined = _joined(documents.select(key, "text"), spans, key).select(F.col(f"row.{key}").alias("key"), F.col("row.text").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(rest) + removed, removed, runs, hashlib.sha256(rest).hexdigest()) for rest, removed, runs in _cut(batch.column(1), batch.column(2))]
            columns = list(zip(*got)) or [()] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                                  names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("key", key)


def strip(documents: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with the repeats taken out of their text; a letter cut in two goes as well."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            texts = columns[at]
            kept = [rest.decode("utf-8", "ignore") for rest, _, _ in _cut(texts, batch.column(1))]
            columns[at] = pa.array([k if there else None for there, k in zip(texts.is_valid().to_pylist(), kept)], pa.string())
            yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))])

    schema = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(documents.schema)])
    return _joined(documents, spans, key).mapInArrow(run, schema).toDF(*documents.columns)


def dedup(documents: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    return digest(documents, intervals(documents, key, length), key)
