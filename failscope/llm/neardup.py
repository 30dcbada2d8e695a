"""Near-duplicate documents by fast similarity sketching, banding and exact links.

A document is the set of its distinct two-word shingles.  Its sketch has ``COORDS``
coordinates: in round i every shingle is thrown into one hashed bin, and later rounds,
of which the last ``COORDS`` name the bin themselves, only fill what is still empty;
so every coordinate fills, and most documents need one round.  Bands of ``ROWS``
coordinates name the candidates; every link is confirmed on the full sets.

Equal sets are one class from the start, so groups of copies cost one member.  Within
a bucket of classes each member is first tested with one representative, the member
whose buckets are the fullest (in a group of near copies: their common origin).
Members that stay outside of its component are then tested against all members of the
bucket, in cells of bounded size that give links only.  No pair list of a group is made.
Components are found by alternating large and small stars.

A pair at exactly 0.8 shares no bucket with probability (1 - 0.8^6)^32 = 6e-5.

Defined cases: a null text, or one without words, has an empty set, links with nothing
and is its own component; repeated rows are copies; a null id is null in the result's
component unless its group has other ids, and kept only when the whole group is null;
rows that share an id but not the text are linked by text alone; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.llm.rows import matched, text_hash
from failscope.storage import materialize

COORDS, ROWS = 192, 6
SHINGLE_WORDS = 2
OUTSIDE, SLICE = 512, 2048


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and n + 1 offsets."""
    buf = T.LOWER[buf]
    n = len(off) - 1
    starts, ends, row = T.words(buf, off)
    word = T.range_hash(T.prefix_hash(buf), starts, ends)
    per_row = np.bincount(row, minlength=n)
    short = (per_row < k)[row]
    if len(word) >= k:
        key = word[:len(word) - k + 1].copy()
        for i in range(1, k):
            key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + word[i:len(word) - k + 1 + i])
        whole = (row[:len(row) - k + 1] == row[k - 1:])
        key, owner = key[whole], row[:len(row) - k + 1][whole]
    else:
        key, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short.any():  # fewer words than a shingle has: the whole sequence is one
        position = np.arange(len(word)) - np.r_[0, np.cumsum(per_row)][row]
        part = T.mix(word + position.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))[short]
        rows = np.flatnonzero((per_row > 0) & (per_row < k))
        first = np.r_[0, np.cumsum(per_row[rows])][:-1]
        key = np.r_[key, T.mix(np.add.reduceat(part, first) + per_row[rows].astype(np.uint64))]
        owner = np.r_[owner, rows]
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
    bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
    parts = [np.unique(key[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts) if parts else key, np.r_[0, np.cumsum(sizes)]


def sketch(sets: np.ndarray, bounds: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Coordinates of each non-empty set, one line each (an empty set: all ones)."""
    n = len(bounds) - 1
    out = np.full(n * coords, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * coords):
        if not len(sets):
            break
        h = T.mix(sets ^ T.mix(np.full(1, i + 1, np.uint64)))
        bin_of = ((h >> np.uint64(40)) % np.uint64(coords)).astype(np.int64) if i < coords else i - coords
        np.minimum.at(out, owner * coords + bin_of, (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)))
        open_row = (out.reshape(n, coords) == np.iinfo(np.uint64).max).any(axis=1)
        again = open_row[owner]
        sets, owner = sets[again], owner[again]
    return out.reshape(n, coords)


def _bands(lines: np.ndarray, rows: int) -> np.ndarray:
    count = lines.shape[1] // rows
    key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(lines), 1))
    for r in range(rows):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + lines[:, r:count * rows:rows])
    return T.as_long(key)


def _fingerprints(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    a = np.r_[np.uint64(0), np.cumsum(T.mix(sets))]
    b = np.r_[np.uint64(0), np.cumsum(T.mix(sets ^ np.uint64(0x6A09E667F3BCC909)))]
    two = np.column_stack([a[bounds[1:]] - a[bounds[:-1]], b[bounds[1:]] - b[bounds[:-1]]])
    raw = np.ascontiguousarray(two).tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def sketched(documents: DataFrame, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """key, th (text hash), n (of shingles), fp (of the set; null if empty) and the band keys of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(2))
            for i, j in T.portions(off):
                sets, bounds = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], shingle_words)
                keys = _bands(sketch(sets, bounds), ROWS)
                empty = bounds[1:] == bounds[:-1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)),
                    pa.array(_fingerprints(sets, bounds), pa.binary(), mask=empty), lists], names=["key", "th", "n", "fp", "bands"])

    return documents.select(key, text_hash(), "text").mapInArrow(run, f"key {kind}, th bigint, n bigint, fp binary, bands array<bigint>")


def _sets(documents: DataFrame, nodes: DataFrame, key: str, shingle_words: int) -> DataFrame:
    """fp and full set of the nodes; ``nodes`` has fp and the id of one of its rows."""
    kind = nodes.schema["key"].dataType.simpleString()
    wanted = nodes.select(F.col("key").alias("want")).distinct()
    rows = documents.select(F.col(key).alias("key"), "text").join(wanted, F.col("key").eqNullSafe(F.col("want")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(1))
            for i, j in T.portions(off):
                sets, bounds = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], shingle_words)
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), pa.array(_fingerprints(sets, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(T.as_long(sets)))], names=["key", "fp", "shingles"])

    found = rows.mapInArrow(run, f"key {kind}, fp binary, shingles array<bigint>")
    kept = found.join(nodes.select(F.col("fp").alias("f"), F.col("key").alias("k")),
                      (F.col("fp") == F.col("f")) & F.col("key").eqNullSafe(F.col("k")), "left_semi")
    return kept.dropDuplicates(["fp"]).select("fp", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b"))
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def components(edges: DataFrame, label: str = "star") -> DataFrame:
    """node and root (the least node of its component) of all nodes of the edges (a, b)."""
    now, state = materialize(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), label), None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.*").where("u <> v").distinct(), label)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _close(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """node and root of the classes that exact links join with others.

    ``classes`` has fp, n, key and bands; ``sets_of(nodes)`` gives the full sets.
    """
    rows = classes.select("fp", "n", "key", F.explode("bands").alias("bucket"))
    crowd = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    held = materialize(rows.join(crowd, "bucket"), "buckets")
    fame = materialize(held.groupBy("fp").agg(F.sum("crowd").alias("fame"), F.first("key").alias("key")), "members")
    sets = materialize(sets_of(fame.select("fp", "key")), "sets")
    members = materialize(held.select("bucket", "fp", "n").join(fame.select("fp", "fame"), "fp"), "placed")

    top = members.groupBy("bucket").agg(F.max(F.struct("fame", "fp", "n")).alias("rep"))
    pairs = (members.join(top, "bucket").where("fp <> rep.fp").where(_close(F.col("n"), F.col("rep.n"), percent))
             .select(F.least("fp", "rep.fp").alias("a"), F.greatest("fp", "rep.fp").alias("b")).distinct())
    roots = components(_confirmed(pairs, sets, percent))

    placed = members.join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", "n", "fame", F.coalesce("root", "fp").alias("root"))
    lead = placed.groupBy("bucket").agg(F.max_by("root", F.struct("fame", "fp")).alias("lead"))
    led = placed.join(lead, "bucket").withColumn("out", F.col("root") != F.col("lead"))
    # Only members outside the component of the representative can still gain a link; of two
    # members the one pair is tested; of buckets with the same members one is enough.
    state = led.groupBy("bucket").agg(
        F.max("out").alias("out"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("members"))
    going = state.where(F.col("out") & (F.col("size") > 2)).groupBy("size", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
    open_ = materialize(led.join(going, "bucket", "left_semi").select("bucket", "fp", "root", "out"), "open")
    if open_.isEmpty():
        return roots
    found = materialize(_outside_links(open_, sets, percent), "links")
    return roots if found.isEmpty() else _merged(roots, found)


def _outside_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the outside members of each bucket and its other members.

    A bucket is tested in cells of at most ``OUTSIDE`` by ``SLICE`` members, so a large one is
    spread over tasks; a cell counts common shingles as a product of incidence matrices and
    gives one link for each outside member and component at most, never its pairs.
    """
    every = Window.partitionBy("bucket").orderBy("fp")
    numbered = open_.withColumn("slice", F.floor((F.row_number().over(every) - 1) / SLICE).cast("int"))
    outside = Window.partitionBy("bucket").orderBy("fp")
    queries = open_.where("out").withColumn("block", F.floor((F.row_number().over(outside) - 1) / OUTSIDE).cast("int"))
    size = numbered.groupBy("bucket").agg(F.max("slice").alias("slices")).join(
        queries.groupBy("bucket").agg(F.max("block").alias("blocks")), "bucket")
    against = numbered.join(size, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), "blocks")).alias("block"), "slice", "fp", "root", F.lit(False).alias("asks"))
    asking = queries.join(size, "bucket").select(
        "bucket", "block", F.explode(F.sequence(F.lit(0), "slices")).alias("slice"), "fp", "root", F.lit(True).alias("asks"))
    cells = against.unionByName(asking).join(sets, "fp")

    def test(cell: pa.Table) -> pa.Table:
        asks = cell["asks"].to_numpy(zero_copy_only=False)
        fp, root = cell["fp"].to_pylist(), cell["root"].to_pylist()
        lists = cell["shingles"].combine_chunks()
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(off)
        row = np.repeat(np.arange(len(fp)), sizes)
        flat = flat[off[0]:off[-1]]
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        number = np.zeros(len(fp), np.int64)
        number[mine], number[theirs] = np.arange(len(mine)), np.arange(len(theirs))
        common = np.zeros((len(mine), len(theirs)), np.float32)
        vocabulary = np.unique(flat[asks[row]])
        for v in range(0, len(vocabulary), 8192):
            part = vocabulary[v:v + 8192]
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            left, right = np.zeros((len(mine), len(part)), np.float32), np.zeros((len(theirs), len(part)), np.float32)
            left[number[row[hit & asks[row]]], at[hit & asks[row]]] = 1
            right[number[row[hit & ~asks[row]]], at[hit & ~asks[row]]] = 1
            common += left @ right.T
        linked = 100 * common >= percent * (sizes[mine][:, None] + sizes[theirs][None, :] - common)
        pairs = {}
        for i, j in zip(*np.nonzero(linked)):
            a, b = mine[i], theirs[j]
            if root[a] != root[b]:
                pairs.setdefault((fp[a], root[b]), fp[b])
        return pa.table({"a": pa.array([k[0] for k in pairs], pa.binary()), "b": pa.array(list(pairs.values()), pa.binary())})

    return cells.groupBy("bucket", "block", "slice").applyInArrow(test, "a binary, b binary")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Roots after more links, of which only those between the old components matter."""
    def root_of(frame: DataFrame, column: str) -> DataFrame:
        own = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
        return frame.join(own, F.col(column) == F.col("x"), "left").withColumn(column, F.coalesce("y", column)).drop("x", "y")

    newer = components(root_of(root_of(found, "a"), "b")).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(newer, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    # Classes that had no link before are their own old root.
    fresh = newer.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return moved.unionByName(fresh)


def near_duplicates(documents: DataFrame, percent: int = 80, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """key, n_shingles, component_id and kept of each row."""
    return grouped(documents, percent, key, shingle_words).withColumnRenamed("key", key).drop("th")


def one_of_each(documents: DataFrame, percent: int = 80, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group, with all its columns: the one with the group's least id."""
    decided = grouped(documents, percent, key, shingle_words).select("key", "th", "kept")
    return matched(documents, decided, key).where("kept AND nth = 1").select("row.*")


def grouped(documents: DataFrame, percent: int, key: str, shingle_words: int) -> DataFrame:
    rows = materialize(sketched(documents, key, shingle_words), "sketches")
    # One row for each distinct set; its band keys are the same in every copy.
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    roots = links(classes, lambda nodes: _sets(documents, nodes, key, shingle_words), percent)
    ids = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("key").alias("least"))
    rooted = ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # Groups of one set keep the id of their least copy; only linked sets need the second join.
    named = rooted.join(lowest, "root").select(F.col("fp").alias("f"), "component")
    out = rows.select("key", "th", "n", "fp").join(named, F.col("fp") == F.col("f"), "left")
    component = F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select("key", "th", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("key").eqNullSafe(component).alias("kept"))
