"""Mixing sources to target weights by systematic sampling.

Targets are a water level over the few source totals.  Within a source every
document expects ``target / source size`` copies; the expected copies are summed
along a fixed order, one random offset is added, and a document is taken once for
each integer that its interval crosses.  The order goes by size class, so that
short and long documents are taken in proportion and the words come out near the
target.

The running sum needs no global sort: documents fall into cells (source, size
class, slice of the key's hash), totals are summed along the classes and cells, and only
rows of one cell meet in a window.  A hot source is spread over ``slices`` cells for
each of at most 256 size classes (quarters of the powers of two).

Defined cases: a null text has size 0; a source of size 0 has target 0; the null
source comes last and is a source like any other; repeated rows are documents of
their own, ordered by the hash of their text; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.rows import matched, text_hash
from failscope.storage import materialize

WEIGHTS = (5, 2, 1)
SLICES = 4096


def with_size(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, th (text hash), source, words of the whole text, and the order's hash."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    return documents.select(F.col(key).alias("key"), text_hash(), "source", words.alias("size"), order.alias("ord"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150) -> DataFrame:
    """Source, source_size and target of each source.

    ``min(cap, level * weight)`` with the one level at which the targets add up;
    sources with the lowest cap for their weight reach it first.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = totals.select("source", "source_size", F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (place % n + 1).cast("int")).cast("long").alias("weight"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * percent / 100.0 - 2 * F.col("before_size")) / F.col("after_weight")
    stepped = weighted.withColumns({
        "before_size": F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "after_weight": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    fits = stepped.withColumn("level", level).withColumn(
        "valid", F.col("level") <= 2 * F.col("source_size") / F.col("weight"))
    # The first level in this order that its source can take; from there on they fall.
    final = fits.withColumn("level", F.max(F.when(F.col("valid"), F.col("level"))).over(whole))
    cap = (2 * F.col("source_size")).cast("double")
    return final.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, seed: str = "mix",
        slices: int = SLICES, key: str = "doc_id") -> DataFrame:
    """key, th, source, size, source_size, target and copies of each document."""
    # Numbers and two digests of each document: the texts are read once for all uses below.
    sized = materialize(with_size(documents, key), "sized")
    digits = len(f"{slices - 1:x}")
    cell = sized.withColumns({
        "class": F.expr("CASE WHEN size = 0 THEN 0 ELSE 4 * length(bin(size)) + shiftright(size, greatest(length(bin(size)) - 3, 0)) % 4 END"),
        "slice": F.conv(F.substring("ord", 1, digits), 16, 10).cast("int") % slices})
    own = Window.partitionBy("source", "class", "slice")
    numbered = cell.withColumn("at", F.row_number().over(own.orderBy("ord", "key")))
    cells = cell.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    # Sums along the classes of a source, then along the slices of a class: 256 and ``slices`` rows at most meet in a task.
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"))
    starts = cells.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(
        firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(
        "source", "class", "slice", (F.col("first") + F.col("within")).alias("before"))
    placed = numbered.join(starts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
                           & (numbered["class"] == starts["class"]) & (numbered["slice"] == starts["slice"]))
    placed = placed.select("key", "th", "source", "size", (F.col("at") + F.col("before")).alias("number"))
    aims = targets(sized, weights, percent).withColumnRenamed("source", "s")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 2.0**32
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("offset") + F.col("number") * F.col("rate")) - F.floor(F.col("offset") + (F.col("number") - 1) * F.col("rate"))
    return (placed.join(aims, F.col("source").eqNullSafe(F.col("s"))).withColumns({"offset": offset, "rate": rate})
            .select("key", "th", "source", "size", "source_size", "target", crossed.cast("long").alias("copies")))


def taken(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix as words taken of each document."""
    return mix(documents, key=key, **options).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all their columns and a ``copy`` number from 1."""
    decided = mix(documents, key=key, **options).where("copies > 0").select("key", "th", "copies")
    rows = matched(documents, decided, key).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_number"))
    name = next(c for c in ("copy", "mix_copy", "mix_copy_number") if c not in documents.columns)
    return rows.select("row.*", F.col("copy_number").alias(name))


#: The same rules for DuckDB over the table ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws('/', doc_id::VARCHAR, md5(coalesce(text, '')))) AS ord FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM totals),
stepped AS (SELECT *,
    coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_size,
    (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS after_weight,
    (sum(source_size) OVER ())::BIGINT AS whole
  FROM weighted WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
levels AS (SELECT *, (whole * 150 / 100.0::DOUBLE - 2 * before_size) / after_weight AS level FROM stepped),
final AS (SELECT *, max(CASE WHEN level <= 2 * source_size::DOUBLE / weight THEN level END) OVER () AS water FROM levels),
aims AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(water * weight, (2 * source_size)::DOUBLE)) AS target FROM final),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY CASE WHEN size = 0 THEN 0 ELSE 4 * length(ltrim(bin(size), '0')) + (size >> greatest(length(ltrim(bin(size), '0')) - 3, 0)) % 4 END, substr(ord, 1, 3), ord, doc_id) AS number FROM sized),
rated AS (SELECT n.doc_id, n.size, a.source_size, a.target, n.number,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix/' || coalesce(n.source, chr(0))), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS offs
  FROM numbered n JOIN aims a ON n.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  ((floor(offs + number * rate) - floor(offs + (number - 1) * rate))::BIGINT * size)::BIGINT AS taken
FROM rated"""
