"""What each filter of a chain removes, in every order of the filters.

A document is known by its mask: the filters it fails.  In an order of the filters it is
removed at the first of them that is in its mask.  Orders are numbered by their Lehmer
code, so all orders that begin alike are an interval of numbers: a mask is removed at step
k by every order whose first k - 1 filters it passes and whose k-th it fails, and each
such beginning is one interval of (n - k)! orders.  The counts of a mask are added where
its intervals start and taken off where they end; prefix sums along the orders
give the removals of all of them without a look at any single order.

Documents are counted by (part, mask, labels) with partial aggregates first, so a task
sees 2^n masks of a part and no more.  Texts are read once and never shuffled; whether a
text has been seen under a smaller id is settled on digests, joined by (digest, id), so
that a text shared by many documents makes no hot key.

Defined cases: a null text is an empty one; a null part is the empty string; a null id is
never smaller or larger than another and has no labels; rows that repeat an id count each;
of several labels of an id one that says 1 is enough; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm import textbuf as T
from failscope.storage import materialize

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#$%&*|", np.uint8)] = True
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_masks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each row fails."""
    starts, ends, row = T.words(buf, off)
    n = np.bincount(row, minlength=len(off) - 1)
    word = T.range_hash(T.prefix_hash(buf), starts, ends)
    _, first = T.repeats(T.mix(word + T.mix(row.astype(np.uint64))))
    distinct = np.bincount(row[first], minlength=len(off) - 1)
    capitals = T.counts((buf >= 65) & (buf <= 90), off)
    points = T.counts((buf & 0xC0) != 0x80, off)
    symbols = T.counts(SYMBOL[buf], off)
    fails = [n < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def judged(documents: DataFrame, part: str = "source", key: str = "doc_id") -> DataFrame:
    """key, part, digest of the text, and the mask of A to D of each row."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.buffers(batch.column(3))
            masks = [text_masks(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in T.portions(off)]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.concatenate(masks) if masks else np.zeros(0, np.int32))],
                                  names=["key", "part", "digest", "mask"])

    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")
    named = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    return documents.select(F.col(key).alias("key"), named, digest, "text").mapInArrow(
        run, f"key {kind}, part string, digest binary, mask int")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """The mask with ``bit`` set where the same text has a smaller id."""
    least = rows.where("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key")).withColumn("least", F.lit(True))
    later = F.col("key").isNotNull() & F.col("least").isNull()
    return rows.join(least, ["digest", "key"], "left").select("key", "part", (F.col("mask") + F.when(later, 1 << bit).otherwise(0)).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, label_key: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic: documents of each mask, and those labelled so."""
    known = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(known, "key", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


def lehmer_rank(order: Sequence[int]) -> int:
    """Number of an order among all, in lexicographic order."""
    n = len(order)
    return sum(math.factorial(n - 1 - i) * sum(later < x for later in order[i + 1:]) for i, x in enumerate(order))


def removal_intervals(mask: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders that remove the mask at that step."""
    passed = [x for x in range(n) if not mask >> x & 1]
    failed = [x for x in range(n) if mask >> x & 1]
    for before in range(len(passed) + 1):
        for start in itertools.permutations(passed, before):
            for last in failed:
                head = (*start, last)
                first = lehmer_rank([*head, *(x for x in range(n) if x not in head)])
                yield before, first, first + math.factorial(n - before - 1)


def totals(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of the audit from the counts by part and mask."""
    n = len(filters)
    orders = math.factorial(n)
    names = ["".join(filters[i] for i in order) for order in itertools.permutations(range(n))]
    acting = np.array(list(itertools.permutations(range(n))), np.int64).reshape(orders, n)
    ends = {m: np.array(list(removal_intervals(m, n)), np.int64) for m in range(1, 1 << n)}

    def run(table: pa.Table) -> pa.Table:
        mask = table["mask"].to_numpy()
        numbers = np.column_stack([table[c].to_numpy() for c in ("n", "good", "toxic")])
        change = np.zeros((n, orders + 1, 3), np.int64)
        for m, count in zip(mask, numbers):
            if m:
                step, first, after = ends[int(m)].T
                np.add.at(change, (step, first), count)
                np.add.at(change, (step, after), -count)
        removed = np.cumsum(change, axis=1)[:, :orders].transpose(1, 0, 2)
        fails = np.array([numbers[(mask >> i & 1) == 1, 0].sum() for i in range(n)])
        alone = np.array([numbers[mask == 1 << i, 0].sum() for i in range(n)])
        share = np.zeros(n, np.int64)
        np.add.at(share, acting, removed[:, :, 0])
        here = removed[:, :, 0]
        columns = dict(zip(COUNTS, (numbers[:, 0].sum() - np.cumsum(here, axis=1), here, fails[acting] - here, alone[acting],
                                    removed[:, :, 1], removed[:, :, 2], share[acting])))
        part = pa.array([table["part"][0].as_py()] * (orders * n), pa.string())
        return pa.table([part, pa.array(np.repeat(names, n).tolist()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), orders)),
                         *(pa.array(c.ravel()) for c in columns.values())], names=["part", "filter_order", "step", *columns])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return counts.groupBy("part").applyInArrow(run, schema)


def audit(documents: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id") -> DataFrame:
    """One row for each part, order of the five filters and step."""
    rows = materialize(judged(documents, part, key), "judged")
    return totals(mask_counts(with_copies(rows, len(FILTERS) - 1), labels, key))


#: The same rows for DuckDB, by looking at every order.
SQL = r"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT b.doc_id, part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN b.doc_id > min(b.doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails FROM base b),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s::INT, 1) AS f, substr(filter_order, 1, s::INT - 1) AS earlier
  FROM orders, range(1, 6) t(s)),
counted AS (SELECT m.part, filter_order, step, f,
    sum(n) FILTER (WHERE contains(fails, f) AND translate(fails, earlier, '') = fails) AS removed,
    sum(n) FILTER (WHERE contains(fails, f) AND translate(fails, earlier, '') <> fails) AS redundant,
    sum(n) FILTER (WHERE fails = f) AS unique_fails,
    sum(good) FILTER (WHERE contains(fails, f) AND translate(fails, earlier, '') = fails) AS good_lost,
    sum(toxic) FILTER (WHERE contains(fails, f) AND translate(fails, earlier, '') = fails) AS toxic_lost,
    sum(n) FILTER (WHERE NOT contains(fails, f) AND translate(fails, earlier, '') = fails) AS kept
  FROM masks m, steps GROUP BY m.part, filter_order, step, f)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted"""
