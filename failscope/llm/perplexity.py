"""LM scoring with a hierarchical Pitman-Yor model.

Every word seen as a predecessor (or END, which precedes a text)
has a context restaurant for the words that follow it; all share the root restaurant as
their parent, whose base is uniform over the known words and one unknown word.  After
an unknown word a token sits in the root directly.

The restaurants are a table (context, word, n), never gathered.  A word seen fewer than ``LEAST``
times, so once, has a restaurant of one customer and one table, whatever is sampled, that tells
nothing of discount and strength: its pair counts like all others, its totals need no row.  A dish with one customer
has one table whatever is sampled, so these dishes count in their context's and their
word's totals alone; the repeated dishes are sampled by Gibbs sweeps over table counts.
They are dealt by word, so that a word's root customers are at hand; the totals of their
contexts are joined in by context and exchanged after each round: parallel sweeps given
the totals of the round before.  Contexts and words with more than ``SLICE`` repeated
dishes are dealt in slices of about that size; a slice takes its share of the word's
other tables from the round before.  Random numbers are hashes of (word, context, sweep), so
a lost task samples the same again.  A customer opens a table with weight (strength +
discount * tables of the restaurant, the dish's own included) * the parent's probability,
else joins one of the dish's tables with weight customers - discount * tables of the dish.
The first ``SINGLE`` customers of a dish are seated one by one, later ones in blocks of an
eighth.  Each of the last ``SAMPLES`` sweeps is a seating of all restaurants of its own;
the predictive probabilities of these seatings are averaged, and sum to one over known words
and the unknown word, in each context.  Discount and strength of both levels start from the words and
pairs seen once and twice and from 1, and are sampled after each round but the last by the auxiliary
variables of their posterior (uniform prior of the discount, exponential of the strength).  Which
table a customer joined need not be known for that: of the dish's tables of weight customers -
discount * tables together, the part tables * (1 - discount) is that of the tables' first customers.

Texts are scored in chunks: the distinct words and word pairs of a chunk (a pair by a
64-bit hash) go as sorted, delta-coded blocks to the part of the model that their hash
names, and numbers in the same order come back, so nothing that grows with the corpus is
broadcast or collected.

Defined cases: a null or empty text is the end token alone; without training rows every
token is unknown with probability one; a null id is in no fold's complement and counts as
held out only if the caller's column says so; repeated rows count and are scored alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.storage import drop, materialize, settings

LEAST = 2
ROUNDS, SWEEPS, SAMPLES = 2, 4, 2
SINGLE = 32
SLICE = 1 << 18
CHUNK_BYTES = 4 << 20
#: The model is asked in so many passes over its parts, which bounds the disk of their shuffles.
PASSES = 4
#: Rows that hold texts or packed blocks go through Spark's readers and to Python in small batches: a batch is held whole, several times over.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "64"}
#: Pages of packed blocks are closed when they are full, not after 100 rows at the earliest; readers and writers hold a page in buffers off the heap.
SHORT_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
END = -1


def release() -> None:
    """Gives back what Arrow holds of batches that are done with, as workers live on and keep it."""
    pa.default_memory_pool().release_unused()


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of all rows in order, each row closed by END, and the rows' bounds."""
    low = T.LOWER[buf]
    starts, ends, row = T.words(low, off)
    key = T.as_long(T.range_hash(T.prefix_hash(low), starts, ends))
    key[key == END] = 0
    n = len(off) - 1
    bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=n) + 1)]
    out = np.full(bounds[-1], END, np.int64)
    out[np.arange(len(key)) + row] = key
    return out, bounds


def pair_key(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of (context, word)."""
    return T.as_long(T.mix(T.mix(c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)))


def before(keys: np.ndarray) -> np.ndarray:
    """The context of each token of whole texts: the word before it; END precedes a text."""
    return np.r_[np.full(1, END, np.int64), keys[:-1]][:len(keys)]


def _binary(blocks: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in blocks], pa.binary())


def _joined(column: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """The numbers of all binary values, one after another."""
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]])


def _planes(numbers: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """Numbers as bytes, highest bytes of all first: these are mostly zero, and compress."""
    return numbers.ravel().astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T


def _unplaned(value: pa.Scalar, kind: str = ">u8") -> np.ndarray:
    planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(kind[1:])


def _gaps(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the bytes of their differences."""
    return _planes(np.diff(sorted_keys.view(np.uint64) ^ np.uint64(1 << 63), prepend=np.uint64(0)))


def _ungap(value: pa.Scalar) -> np.ndarray:
    return (np.cumsum(_unplaned(value)) ^ np.uint64(1 << 63)).view(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][:len(x)])


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. (``np.unique`` hashes them, which takes far longer than this sort, and more memory.)"""
    x = np.sort(x)
    return x[_starts(x)]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and the place of each number among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.r_[True, x[1:] != x[:-1]][:len(x)]
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x[new], at


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash. Parts are ranges, so sorted keys are in the order of their parts."""
    return (((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def volume_of(rows: DataFrame) -> int:
    """Bytes of all texts."""
    with settings(rows.sparkSession, LEAN):
        return int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def _summed(c: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of their keys, with their sums."""
    key = pair_key(c, w)
    order = np.argsort(key)
    for again in (False, True):
        k, a, b = key[order], c[order], w[order]
        other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if again or not (other & (k[1:] == k[:-1])).any():
            break
        order = np.lexsort((c, w, key))  # Two pairs have one key.
    first = np.flatnonzero(np.r_[True, other][:len(w)])
    return a[first], b[first], np.add.reduceat(n[order], first) if len(n) else n


PACKED = "part int, c binary, w binary, runs binary, n binary"


def _packed(c: np.ndarray, w: np.ndarray, n: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pairs in the order of their keys as a block for each part, ordered by w."""
    part, found = part_of(pair_key(c, w), parts), []
    cuts = _starts(part)
    for i, j in zip(cuts, np.r_[cuts[1:], len(part)]):
        order = i + np.argsort(w[i:j])
        first = _starts(w[order])
        found.append((c[order], _gaps(w[order][first]), np.diff(np.r_[first, j - i]).astype(np.uint32), _planes(n[order], ">u4")))
    return pa.record_batch([pa.array(part[cuts].astype(np.int32)), *map(_binary, zip(*found) if found else [()] * 4)], names=["part", "c", "w", "runs", "n"])


def _unpacked(block: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c, w and n of a block, ordered by w."""
    w = np.repeat(_ungap(block["w"]), np.frombuffer(block["runs"].as_buffer(), np.uint32))
    return np.frombuffer(block["c"].as_buffer(), np.int64), w, _unplaned(block["n"], ">u4").astype(np.int64)


def _each(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of each packed block."""
    for values in zip(*[table.column(x) for x in ("c", "w", "runs", "n")]):
        yield _unpacked(dict(zip(("c", "w", "runs", "n"), values)))


def pair_counts(training: DataFrame, parts: int, most: int = 600_000) -> DataFrame:
    """How often a word follows another in the training rows, counted in each task first, as a packed block for each part.

    The counts are dealt by a hash of the pair, so in even parts whatever the words.
    """
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        release()
        w, c = np.concatenate(held), np.concatenate([before(x) for x in held])
        return _packed(*_summed(c, w, np.ones(len(w), np.int64)), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            buf, off = T.buffers(batch.column(0))
            for i, j in T.portions(off):
                held.append(tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])[0])
                if sum(map(len, held)) > most:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def merge(group: pa.Table) -> pa.Table:
        release()
        return pa.Table.from_batches([_packed(*_summed(*map(np.concatenate, zip(*_each(group)))), parts)])

    return training.select("text").mapInArrow(run, PACKED).groupBy("part").applyInArrow(merge, PACKED)


def totals(counted: DataFrame, name: str, parts: int, most: int = 600_000) -> DataFrame:
    """For each c or w of packed pairs: customers, and how many pairs it has that were seen once (ones), more often (many), twice (twice).

    The sums of each task are dealt as packed blocks too.
    """

    def summed(key: np.ndarray, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        key = key[order]
        first = _starts(key)
        return key[first], np.array([np.add.reduceat(x[order].astype(np.int64), first) if len(first) else x for x in numbers])

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = map(np.concatenate, zip(*held))
        key, sums = summed(key, [n, n == 1, n > 1, n == 2])
        part = part_of(key, parts)
        cuts = _starts(part)
        ends = np.r_[cuts[1:], len(key)]
        return pa.record_batch([pa.array(part[cuts].astype(np.int32)), _binary([_gaps(key[i:j]) for i, j in zip(cuts, ends)]),
                                _binary([_planes(sums[:, i:j]) for i, j in zip(cuts, ends)])], names=["part", "k", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for c, w, n in _each(batch):
                held.append((c if name == "c" else w, n))
                if sum(len(x) for x, _ in held) > most:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def merge(group: pa.Table) -> pa.Table:
        sums = np.hstack([_unplaned(x).astype(np.int64).reshape(4, -1) for x in group["sums"]])
        key, sums = summed(np.concatenate([_ungap(x) for x in group["k"]]), list(sums))
        return pa.table([key, *sums], names=[name, "customers", "ones", "many", "twice"])

    shape = f"{name} bigint, customers bigint, ones bigint, many bigint, twice bigint"
    return counted.mapInArrow(run, "part int, k binary, sums binary").groupBy("part").applyInArrow(merge, shape)


def listed(counted: DataFrame, repeated: bool) -> DataFrame:
    """c, w, n of the packed pairs that were seen more than once, or else once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, w, n in _each(batch):
                mine = (n > 1) == repeated
                yield pa.record_batch([pa.array(x[mine]) for x in (c, w, n)], names=["c", "w", "n"])

    return counted.mapInArrow(run, "c bigint, w bigint, n bigint")


def _seeded(*parts: np.ndarray) -> np.ndarray:
    return functools.reduce(_next, parts, np.zeros(1, np.uint64))


def _next(seed: np.ndarray, part: np.ndarray) -> np.ndarray:
    return T.mix(seed * np.uint64(0x9E3779B97F4A7C15) + np.asarray(part).astype(np.int64).view(np.uint64))


def _uniform(seed: np.ndarray, number: int) -> np.ndarray:
    """The numbered random number of each seed."""
    return (_next(seed, np.full(1, number)) >> np.uint64(11)).astype(float) / (1 << 53)


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, *seed: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers came in one after another.

    ``others`` are the tables of the restaurant's other dishes, ``parent`` is the parent's probability of the dish.
    """
    return seat_marked(customers, others, parent, discount, strength, *seed, marked=False)[0]


def seat_marked(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float,
                *seed: np.ndarray, marked: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As above, with the number of customers who joined a table by the weight 1 - discount of its first customer."""
    tables, marks = (customers > 0).astype(float), np.zeros(len(customers))
    live, j, step = np.flatnonzero(customers > 1), 1, 0
    # Those of the dishes whose customers have not all come in.
    n, others, parent, key = (x[live] for x in (customers, others, parent, np.broadcast_to(_seeded(*seed), len(customers))))
    own, first = np.ones(len(live)), np.zeros(len(live))
    while len(live):
        size = 1 if j < SINGLE else j // 8
        m = np.minimum(size, n - j)
        new = (strength + discount * (others + own)) * parent
        taken = j + (m - 1) / 2 - discount * own
        opened = np.floor(m * new / (new + taken) + _uniform(key, step))
        if marked:
            first = first + np.floor((m - opened) * np.minimum(own * (1 - discount) / taken, 1) + _uniform(key, -1 - step))
        own = own + opened
        j, step = j + size, step + 1
        more = n > j
        tables[live[~more]], marks[live[~more]] = own[~more], first[~more]
        live, n, others, parent, key, own, first = (x[more] for x in (live, n, others, parent, key, own, first))
    return tables, marks


def drawn(customers: np.ndarray, tables: np.ndarray, discount: float, strength: float, *seed: np.ndarray) -> np.ndarray:
    """Sums over restaurants of the auxiliary variables: tables opened by the strength, tables opened by the discount, and
    -log of a Beta(strength + 1, customers - 1) variable, as the sum of exponentials with rates strength + 1, strength + 2, ..."""
    found = np.zeros(3)
    live, j, step = np.flatnonzero((customers > 1) | (tables > 1)), 1, 0
    customers, tables, key = (x[live] for x in (customers, tables, np.broadcast_to(_seeded(*seed), len(customers))))
    while len(key):
        size = 1 if j < SINGLE else j // 8
        u, v, z = (_uniform(key, 3 * step + k) for k in range(3))
        m = np.clip(tables - j, 0, size)
        by_strength = np.floor(m * strength / (strength + discount * (j + np.maximum(m - 1, 0) / 2)) + u)
        m_log = np.clip(customers - j, 0, size)
        # The sum of many exponentials is taken as normal.
        total = -np.log1p(-v) * m_log if size == 1 else m_log + np.sqrt(m_log) * np.sqrt(-2 * np.log1p(-v)) * np.cos(2 * np.pi * z)
        found += by_strength.sum(), (m - by_strength).sum(), (total / (strength + j + np.maximum(m_log - 1, 0) / 2)).sum()
        j, step = j + size, step + 1
        more = (customers > j) | (tables > j)
        customers, tables, key = (x[more] for x in (customers, tables, key))
    return found


def sampled(sums: np.ndarray, marks: float, *seed: int) -> tuple[float, float]:
    """Discount and strength of a level from the sums of its restaurants' auxiliary variables."""
    rng = np.random.default_rng(seed)
    discount = rng.beta(1 + sums[1], 1 + marks)
    return float(np.clip(discount, 0.01, 0.99)), float(max(rng.gamma(1 + sums[0]) / (1 + sums[2]), 1e-3))


@dataclass
class Setting:
    types: int
    tokens: int
    discount: float = 0.8
    root_discount: float = 0.7
    strength: float = 1.0
    root_strength: float = 1.0

    @property
    def base(self) -> float:
        return 1.0 / (self.types + 1)


@dataclass
class Root:
    """Customers and tables of the root restaurant."""

    customers: float
    tables: float


def root_seats(w: np.ndarray, customers: np.ndarray, tables: np.ndarray, s: Setting, root: Root, tag: np.ndarray,
               marked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Tables and marks of each word in the root."""
    others, base = np.maximum(root.tables - tables, 0), np.full(len(w), s.base)
    return seat_marked(customers, others, base, s.root_discount, s.root_strength, w, np.full(len(w), -2), np.broadcast_to(tag, len(w)), marked=marked)


def sweeps(w: np.ndarray, own: np.ndarray, c: np.ndarray, n: np.ndarray, held: np.ndarray, fixed: np.ndarray, s: Setting, root: Root,
           round_: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables and marks of the dishes after each sweep.

    ``own`` is each dish's place in ``w``, ``held`` the tables of its context, ``fixed`` the
    root customers of the words that these dishes do not send.
    """
    tables, root_tables = np.ones(len(n)), np.ones(len(w))
    for k in range(SWEEPS):
        customers = fixed + np.bincount(own, tables, len(w))
        parent = ((customers - s.root_discount * root_tables) + (s.root_strength + s.root_discount * root.tables) * s.base) / (s.root_strength + root.customers)
        tag = np.full(1, round_ * SWEEPS + k)
        others = np.maximum(held - tables, 0)
        tables, marks = seat_marked(n, others, parent[own], s.discount, s.strength, w[own], c, np.broadcast_to(tag, len(own)),
                                    marked=k == SWEEPS - 1 and round_ < ROUNDS - 1)
        root_tables = root_seats(w, fixed + np.bincount(own, tables, len(w)), root_tables, s, root, tag)[0]
        yield tables, marks


def _numbered(name: str) -> list[str]:
    """A column for each seating that is averaged."""
    return [f"{name}{i}" for i in range(1, SAMPLES + 1)]


def looked_up(dishes: DataFrame, table: DataFrame, key: str, other: str, names: list[str]) -> DataFrame:
    """The dishes with columns of their key's row, dealt by (key, slice).

    A key with more than ``SLICE`` dishes is dealt in slices by the other column. Keys of that
    size are at most one for each ``SLICE`` dishes, and few enough to broadcast.
    """
    slices = F.ceil(F.col("many") / SLICE)
    large = F.broadcast(table.where(F.col("many") > SLICE).select(key, slices.alias("slices")))
    dealt = dishes.join(large, key, "left").withColumn("slice", F.pmod(F.xxhash64(other), F.coalesce("slices", F.lit(1)))).drop("slices")
    spread = table.where("many > 0").select(key, *names, F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))
    return dealt.join(spread, [key, "slice"])


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.Table]:
    """Rows ordered by (w, slice), cut only between these."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size > most:
            table = pa.Table.from_batches(held).combine_chunks()
            w, part = table["w"].to_numpy(), table["slice"].to_numpy()
            cuts = np.flatnonzero((w[1:] != w[:-1]) | (part[1:] != part[:-1]))
            if len(cuts):
                yield table.slice(0, cuts[-1] + 1)
                held, size = table.slice(cuts[-1] + 1).to_batches(), len(table) - int(cuts[-1]) - 1
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def seated(repeated: DataFrame, contexts: DataFrame, words: DataFrame, s: Setting, root: Root, round_: int) -> DataFrame:
    """c, w, n, t1, t2, ... (tables in each of the last sweeps) and marks (in the last one, if the round is not the last) of the repeated dishes after a round."""
    known = looked_up(repeated, contexts, "c", "w", ["held"]).drop("slice")
    known = looked_up(known, words, "w", "c", ["ones", "many", "sent"]).repartition("w", "slice").sortWithinPartitions("w", "slice", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            release()
            w, part, c, n, held, ones, many, sent = (table[x].to_numpy() for x in ("w", "slice", "c", "n", "held", "ones", "many", "sent"))
            if not len(w):
                continue
            new = np.r_[True, (w[1:] != w[:-1]) | (part[1:] != part[:-1])]
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            here = np.bincount(own)
            fixed = ones[first] + sent[first] * (1 - here / many[first])
            last = list(sweeps(w[first], own, c, n, held, fixed, s, root, round_))[-SAMPLES:]
            yield pa.record_batch({"c": pa.array(c), "w": pa.array(w), "n": pa.array(n), **{name: pa.array(t) for name, (t, _) in zip(_numbered("t"), last)}, "marks": pa.array(last[-1][1])})

    tables = ", ".join(f"{name} double" for name in [*_numbered("t"), "marks"])
    return known.select("w", "slice", "c", "n", "held", "ones", "many", "sent").mapInArrow(run, f"c bigint, w bigint, n bigint, {tables}")


def rooted(words: DataFrame, s: Setting, root: Root, round_: int) -> DataFrame:
    """The words with their tables in the root, root1, root2, ..., given the tables sent1, sent2, ... of each seating, and the marks of the last."""
    names = _numbered("sent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, ones = batch.column("w").to_numpy(), batch.column("ones").to_numpy()
            tables, marks, kept = np.ones(len(w)), np.zeros(len(w)), []
            for k, name in enumerate(names):
                # Own table counts of a word move the totals too little to need more than a few sweeps.
                for again in range(SWEEPS - SAMPLES + 1 if k == 0 else 1):
                    tag = np.full(1, (round_ * SWEEPS + k) * SWEEPS + again)
                    tables, marks = root_seats(w, ones + batch.column(name).to_numpy(), tables, s, root, tag, marked=round_ < ROUNDS - 1)
                kept.append(pa.array(tables))
            yield pa.RecordBatch.from_arrays([*batch.columns, *kept, pa.array(marks)], names=[*batch.schema.names, *_numbered("root"), "marks"])

    doubles = ", ".join(f"{name} double" for name in [*names, *_numbered("root"), "marks"])
    return words.select("w", "n", "ones", "many", *names).mapInArrow(run, f"w bigint, n bigint, ones bigint, many bigint, {doubles}")


def resample(s: Setting, seats: DataFrame, contexts: DataFrame, words: DataFrame, root: Root, round_: int) -> None:
    """Draws discount and strength of both levels anew, given the last seating of a round."""
    at, discount, strength = np.full(1, round_), s.discount, s.strength

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, customers, held = (batch.column(i).to_numpy() for i in range(3))
            sums = drawn(customers, held, discount, strength, c, np.full(len(c), -3), np.broadcast_to(at, len(c)))
            yield pa.record_batch([pa.array([x]) for x in sums], names=["opened", "more", "logs"])

    found = contexts.select("c", "customers", "held").mapInArrow(run, "opened double, more double, logs double").agg(
        *[F.coalesce(F.sum(x), F.lit(0.0)) for x in ("opened", "more", "logs")]).first()
    marks, root_marks = (table.agg(F.coalesce(F.sum("marks"), F.lit(0.0))).first()[0] for table in (seats, words))
    of_root = drawn(np.array([root.customers]), np.array([root.tables]), s.root_discount, s.root_strength, np.full(1, -4), at)
    s.discount, s.strength = sampled(np.array(found), marks, round_, 0)
    s.root_discount, s.root_strength = sampled(of_root, root_marks, round_, 1)


@dataclass
class Predictive:
    """What the numbers of a word are worth in each seating; from columns or arrays."""

    numbers: Setting
    roots: list[Root]

    def unknown(self, i: int) -> float:
        s, r = self.numbers, self.roots[i]
        return (s.root_strength + s.root_discount * r.tables) / (s.root_strength + r.customers) * s.base

    def p(self, x, tables, i: int):
        """The root's probability of a word."""
        s = self.numbers
        return (x - s.root_discount * tables) / (s.root_strength + self.roots[i].customers) + self.unknown(i)

    def down(self, held, customers):
        """The mass that a word's restaurant hands to the root; 1 without one."""
        s = self.numbers
        return (s.strength + s.discount * held) / (s.strength + customers)


@dataclass
class Model:
    """``counts``: w, n, customers (of its restaurant; 0 for those of one customer, which have no row) and for each seating its customers (x1, x2, ...) and tables (root1, ...)
    in the root and the tables of its restaurant (held1, ...).  ``counted``: the packed pairs; ``dishes``: c, w and v of the repeated ones.
    The probability of w after c is v / (strength + customers) + mean(down * p)."""

    numbers: Setting
    predictive: Predictive
    counts: DataFrame
    counted: DataFrame
    dishes: DataFrame

    written: tuple[DataFrame, ...] = ()

    @property
    def unknown(self) -> list[float]:
        return [self.predictive.unknown(i) for i in range(SAMPLES)]

    @property
    def lexicon(self) -> DataFrame:
        """w, n, customers, p1, p2, ... and down1, down2, ..."""
        names = zip(*map(_numbered, ("p", "down", "x", "root", "held")))
        return self.counts.select("w", "n", "customers", *[column for i, (p, down, x, root, held) in enumerate(names) for column in (
            self.predictive.p(F.col(x), F.col(root), i).alias(p), self.predictive.down(F.col(held), F.col("customers")).alias(down))])

    @property
    def pairs(self) -> DataFrame:
        """c, w and v, the customers that count after the discount, as a mean over the seatings."""
        return listed(self.counted, False).select("c", "w", F.lit(1 - self.numbers.discount).alias("v")).unionByName(self.dishes)

    def blocks(self, parts: int, most: int = 250_000) -> DataFrame:
        """part, kind, k (keys) and f (numbers) in packed blocks: words with their numbers, pairs seen once without, other pairs with v."""

        def dealt(kind: int, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(k)
            k, f = k[order], f[order]
            part = part_of(k, parts)
            cuts = _starts(part)
            ends = np.r_[cuts[1:], len(k)]
            return pa.record_batch([pa.array(part[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32)),
                                    _binary([_gaps(k[i:j]) for i, j in zip(cuts, ends)]), _binary([_planes(f[i:j].view(np.uint64)) for i, j in zip(cuts, ends)])],
                                   names=["part", "kind", "k", "f"])

        def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += len(batch)
                if size > most:
                    yield [x.to_numpy() for x in pa.Table.from_batches(held).columns]
                    held, size = [], 0
            if size:
                yield [x.to_numpy() for x in pa.Table.from_batches(held).columns]

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for w, *numbers in portions(batches):
                yield dealt(0, w, np.column_stack(numbers))

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, w, n in _each(batch):
                    if (n == 1).any():
                        k = pair_key(c[n == 1], w[n == 1])
                        yield dealt(1, k, np.zeros((len(k), 0), np.int64))

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, w, v in portions(batches):
                yield dealt(2, pair_key(c, w), v)

        shape = "part int, kind int, k binary, f binary"
        lexicon = self.counts.select("w", "n", "customers", *_numbered("x"), *_numbered("root"), *_numbered("held"))
        return lexicon.mapInArrow(words, shape).unionByName(self.counted.mapInArrow(once, shape)).unionByName(
            self.dishes.select("c", "w", "v").mapInArrow(more, shape))


def learn(training: DataFrame, volume: int | None = None) -> Model:
    """``volume``: bytes of all texts, or a little more, where they are known."""
    parts = max(1, -(-(volume_of(training) if volume is None else volume) // CHUNK_BYTES))
    with settings(training.sparkSession, LEAN):
        counted = materialize(pair_counts(training, parts), "pairs", options=SHORT_PAGES)
        contexts = materialize(totals(counted, "c", parts).where(F.col("customers") >= LEAST).drop("twice"), "contexts")
        words = materialize(totals(counted, "w", parts).withColumnRenamed("customers", "n"), "words")
    row = words.agg(*[F.coalesce(x, F.lit(0)) for x in (
        F.sum("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)), F.sum(F.col("ones") + F.col("many")), F.sum("ones"), F.sum("twice"))]).first()
    total, types, once, twice, dishes, single, double = map(int, row)
    s = Setting(types, total, root_discount=float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95)))
    s.discount = float(np.clip(single / max(single + 2 * double, 1), 0.1, 0.95))

    # The start: one table for each dish.
    repeated, root = listed(counted, True), Root(float(dishes), float(types))
    seats = None
    contexts_now = contexts.withColumn("held", (F.col("ones") + F.col("many")).cast("double"))
    words_now = words.withColumn("sent", F.col("many").cast("double"))
    sums = [F.sum(t).alias(t) for t in _numbered("t")]
    known = [F.coalesce(t, F.lit(0.0)) for t in _numbered("t")]
    for round_ in range(ROUNDS):
        old = [x for x in (seats, contexts_now, words_now) if round_]
        seats = materialize(seated(repeated, contexts_now, words_now, s, root, round_), "seats")
        contexts_now = materialize(contexts.join(seats.groupBy("c").agg(*sums), "c", "left").select(
            "c", "customers", "ones", "many", *[(F.col("ones") + t).alias(name) for t, name in zip(known, _numbered("held"))]).withColumn("held", F.col(_numbered("held")[-1])), "contexts")
        sent = words.join(seats.groupBy("w").agg(*sums), "w", "left").select("w", "n", "ones", "many", *[t.alias(name) for t, name in zip(known, _numbered("sent"))])
        words_now = materialize(rooted(sent, s, root, round_).withColumn("sent", F.col(_numbered("sent")[-1])), "words")
        for table in old:
            drop(table)
        found = words_now.agg(*[F.sum(x) for a, b in zip(_numbered("sent"), _numbered("root")) for x in (F.col("ones") + F.col(a), F.col(b))]).first()
        roots = [Root(float(found[2 * i] or 0), float(found[2 * i + 1] or 0)) for i in range(SAMPLES)]
        root = roots[-1]
        # All seatings that are averaged go by the values last drawn.
        if round_ < ROUNDS - 1:
            resample(s, seats, contexts_now, words_now, root, round_)
    of_root = [column.cast("long").alias(name) for x, sent, root_ in zip(*map(_numbered, ("x", "sent", "root")))
               for name, column in ((x, F.col("ones") + F.col(sent)), (root_, F.col(root_)))]
    of_context = [F.col(held).cast("long").alias(held) for held in _numbered("held")]
    counts = words_now.select("w", "n", *of_root).join(contexts_now.select(F.col("c").alias("w"), "customers", *of_context), "w", "left").fillna(
        0, ["customers", *_numbered("held")])
    mean = sum((F.col(t) for t in _numbered("t")), F.lit(0.0)) / SAMPLES
    weighed = seats.select("c", "w", (F.col("n") - s.discount * mean).alias("v"))
    return Model(s, Predictive(s, roots), counts, counted, weighed, (counted, contexts, words, seats, contexts_now, words_now))


def _stream(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and word pairs of a chunk's texts in order, and the bounds of its rows."""
    release()
    buf, off = T.buffers(group["text"])
    words, bounds, total = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for i, j in T.portions(off):
        keys, ends = tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        words.append(keys)
        bounds.append(ends[1:] + total)
        total += len(keys)
    keys = np.concatenate(words)
    return keys, pair_key(before(keys), keys), np.concatenate(bounds)


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted keys; their number where x is not among them."""
    at = np.searchsorted(keys, x)
    return np.where(np.r_[keys, 0][at] == x, at, len(keys)) if len(keys) else np.zeros(len(x), np.int64)


def score(documents: DataFrame, model: Model, key: str = "doc_id", chunk_bytes: int = CHUNK_BYTES, last: bool = False, volume: int | None = None) -> DataFrame:
    """key, n_tokens, n_known, base_score and score of each row; ``last``: the model's own tables are dropped once packed."""
    kind, spark = documents.schema[key].dataType.simpleString(), documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    chunks = max(1, -(-(volume_of(documents) if volume is None else volume) // chunk_bytes))
    # Each chunk asks each part: fewer parts, fewer small requests.
    parts = -(-chunks // 2)
    chunk = F.pmod(F.xxhash64(F.col(key), text), F.lit(chunks)).cast("int").alias("chunk")
    texts = documents.select(chunk, F.col(key).alias("key"), text.alias("text"))
    turn = F.pmod("part", F.lit(PASSES)).alias("turn")
    with settings(spark, LEAN):
        blocks = materialize(model.blocks(parts).withColumn("turn", turn), "blocks", "turn", SHORT_PAGES)
    if last:
        for table in model.written:
            drop(table)
    s, width, single = model.numbers, 2 + 3 * SAMPLES, 1 - model.numbers.discount
    of = model.predictive
    denominator = s.tokens + 0.5 * (s.types + 1)

    def request(group: pa.Table) -> pa.Table:
        """The distinct words and pairs of a chunk for each part."""
        asked = list(map(_distinct, _stream(group)[:2]))
        a, b = (np.searchsorted(part_of(x, parts), np.arange(parts + 1)) for x in asked)
        some = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
        return pa.table([pa.array(np.full(len(some), group["chunk"][0].as_py(), np.int32)), pa.array(some.astype(np.int32)),
                         *[_binary([_gaps(x[ends[i]:ends[i + 1]]) for i in some]) for x, ends in zip(asked, (a, b))]], names=["chunk", "part", "words", "pairs"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """For each request: the numbers of its words; 0, 1 or 2 for each pair (never seen, seen once, more), and v of the last."""
        release()
        kinds, keys, numbers = known["kind"].to_numpy(), [], []
        for k in range(3):
            mine = known.filter(pa.array(kinds == k))
            found = np.concatenate([np.zeros(0, np.int64), *map(_ungap, mine["k"])])
            order = np.argsort(found)
            keys.append(found[order])
            numbers.append(np.concatenate([np.zeros(0, np.uint64), *map(_unplaned, mine["f"])]).reshape(len(found), (width, 0, 1)[k])[order])
        # An unknown word has no customers and no tables.
        rows, row = np.unique(np.vstack([numbers[0], np.zeros((1, width), np.uint64)]).view(f"V{8 * width}").ravel(), return_inverse=True)
        values, value = _ranked(numbers[2].ravel().view(float))
        out: list[tuple] = []
        for words, pairs in zip(map(_ungap, asked["words"]), map(_ungap, asked["pairs"])):
            more, once = _find(keys[2], pairs), _find(keys[1], pairs)
            code = np.where(more < len(keys[2]), 2, np.where(once < len(keys[1]), 1, 0)).astype(np.uint8)
            mine, number = _ranked(row[_find(keys[0], words)])
            vs, v = _ranked(value[more[code == 2]])
            out.append((_planes(rows[mine].view(np.uint64)), _planes(number, ">u4"), code, values[vs], _planes(v, ">u4")))
        return pa.table([asked["chunk"], asked["part"], *map(_binary, zip(*out))] if out else [asked["chunk"], asked["part"], *[pa.array([], pa.binary())] * 5],
                        names=["chunk", "part", "numbers", "number", "code", "vs", "v"])

    def judge(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table({"key": group["key"], **{x: pa.array([], t) for x, t in (
                ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        replies = replies.sort_by("part")
        keys, paired, bounds = _stream(group)
        (word, at), (pair, at_pair) = _ranked(keys), _ranked(paired)
        del keys, paired
        code, v = _joined(replies["code"], np.uint8), np.zeros(len(pair))
        numbers = np.concatenate([_unplaned(x).reshape(-1, width)[_unplaned(i, ">u4")] for x, i in zip(replies["numbers"], replies["number"])]).astype(float)
        if len(numbers) != len(word) or len(code) != len(pair):
            raise RuntimeError("a chunk was answered for other texts than it holds")
        v[code == 1] = single
        v[code == 2] = np.concatenate([np.frombuffer(x.as_buffer(), float)[_unplaned(i, ">u4")] for x, i in zip(replies["vs"], replies["v"])])
        # Before a text stands END, which any text holds.
        n, customers, (x, tables, held) = numbers[:, 0], numbers[:, 1], np.split(numbers[:, 2:].T, 3)
        # A word precedes another as often as it is seen. Where that is once, one customer sits at one table.
        customers, held = (np.where((n > 0) & (n < LEAST), 1, totals) for totals in (customers, held))
        ctx = np.r_[np.searchsorted(word, END), at[:-1]].astype(np.int32)
        prob = np.where(customers > 0, 1 / (s.strength + customers), 0.0)[ctx] * v[at_pair]
        for i in range(SAMPLES):
            prob += of.down(held[i], customers)[ctx] * of.p(x[i], tables[i], i)[at] / SAMPLES
        known, base = (n > 0).astype(np.int64), np.log10((n + 0.5) / denominator)
        sums = (np.add.reduceat(x, bounds[:-1]) for x in (known[at], base[at], np.log10(prob)))
        return pa.table([group["key"], *map(pa.array, (np.diff(bounds), *sums))], names=["key", "n_tokens", "n_known", "base_score", "score"])

    with settings(spark, LEAN):
        asked = texts.groupBy("chunk").applyInArrow(request, "chunk int, part int, words binary, pairs binary")
        requests = materialize(asked.withColumn("turn", turn), "requests", "turn", SHORT_PAGES)
        replies: list[DataFrame] = []
        for i in range(PASSES):
            asked, known = (x.where(F.col("turn") == i).drop("turn") for x in (requests, blocks))
            answered = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "chunk int, part int, numbers binary, number binary, code binary, vs binary, v binary")
            replies.append(materialize(answered, "replies", options=SHORT_PAGES))
            for table in (requests, blocks):
                drop(table, f"turn={i}")
        replied = functools.reduce(DataFrame.unionByName, replies)
        scores = materialize(texts.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(
            judge, f"key {kind}, n_tokens bigint, n_known bigint, base_score double, score double"), "scores")
    for table in replies:
        drop(table)
    return scores.withColumnRenamed("key", key).withColumn("train_tokens", F.lit(s.tokens).cast("long"))


def perplexity(documents: DataFrame, held_out: Column, key: str = "doc_id") -> DataFrame:
    """Scores of all rows from the rows that are not held out."""
    volume = volume_of(documents)
    model = learn(documents.where(~F.coalesce(held_out, F.lit(False))), volume)
    return score(documents, model, key, last=True, volume=volume)
