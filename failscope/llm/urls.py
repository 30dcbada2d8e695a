"""URL filters: explicit rules, and a logistic regression for the other URLs.

The regression runs on hashed character n-grams of host and path.  It is fitted on a
small labelled URL table (bounded by ``fit_rows``) by full-batch gradient steps that
are one expression over arrays in a single row; scoring adds up weights taken from
that array.  Everything is DataFrame functions.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by the method on its (two) features; repeated rows are judged
alike; without labels of both kinds the method allows everything; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]  # verdict, host and path prefix
RULES: tuple[Rule, ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 1024
FIT_ROWS = 2000
STEPS = 30
RATE, RIDGE = 2.0, 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does.

    Of equally long rules the least rule string wins.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def grams(host: Column, path: Column, buckets: int = BUCKETS, n: int = 3) -> Column:
    """Distinct buckets of the character n-grams of ``^host$`` and ``^path$``.

    The hash is a polynomial over code points, with another start for the path.
    """
    def of(text: Column, start: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        letters = F.transform(F.split(framed, ""), lambda c: F.ascii(c).cast("long"))
        last = F.greatest(F.length(framed) - n, F.lit(0))
        hashed = F.lit(start).cast("long")
        return F.transform(F.sequence(F.lit(0), last), lambda i: _poly(letters, i, n, hashed, buckets))

    return F.array_distinct(F.concat(of(host, 7), of(path, 11)))


def _poly(letters: Column, i: Column, n: int, start: Column, buckets: int) -> Column:
    h = start
    for k in range(n):
        h = h * 131 + F.coalesce(F.get(letters, i + k), F.lit(0).cast("long"))
    return (h % buckets).cast("int")


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row with the weights; the last entry is the bias.

    ``labelled`` has url and blocked (0 or 1).  Of a larger table the ``fit_rows`` URLs
    with the least md5 count; a URL labelled both ways counts as blocked.
    """
    url = F.col("url")
    chosen = (labelled.where("url IS NOT NULL AND blocked IN (0, 1)").groupBy("url").agg(F.max("blocked").cast("double").alias("y"))
              .orderBy(F.md5("url"), "url").limit(fit_rows))
    rows = chosen.select(F.struct(F.md5("url").alias("at"), "y", grams(host_of(url), path_of(url), buckets).alias("x")).alias("row"))
    table = rows.agg(F.sort_array(F.collect_list("row")).alias("rows"))
    n = F.size("rows")
    # For each bucket the numbers of the rows that have it.  Aggregates, as a projection would be evaluated in every step.
    held = table.select(F.posexplode("rows").alias("i", "row")).select("i", F.explode("row.x").alias("b"))
    some = held.groupBy("b").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    every = labelled.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(F.broadcast(some), "b", "left")
    posts = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")))),
                                  lambda p: p["ids"]).alias("posts"))
    posted = table.join(F.broadcast(posts))
    zero = F.array_repeat(F.lit(0.0), buckets + 1)

    def step(w: Column, _: Column) -> Column:
        error = F.transform("rows", lambda r: _sigmoid(
            F.aggregate(r["x"], F.get(w, F.lit(buckets)), lambda a, b: a + F.get(w, b))) - r["y"])
        return F.aggregate(F.array(F.struct(error.alias("e"))), zero, lambda _, s: F.concat(
            F.transform("posts", lambda p, b: F.get(w, b) - RATE * (
                F.aggregate(p, F.lit(0.0), lambda a, i: a + F.get(s["e"], i)) / n + RIDGE * F.get(w, b))),
            F.array(F.get(w, F.lit(buckets)) - RATE * F.aggregate(s["e"], F.lit(0.0), lambda a, e: a + e) / n)))

    mixed = F.size(F.array_distinct(F.transform("rows", lambda r: r["y"]))) > 1
    trained = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)
    return posted.select(F.when(mixed, trained).otherwise(zero).alias("weights"), mixed.alias("fitted"))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id",
          buckets: int = BUCKETS, **options: int) -> DataFrame:
    """Key, host, path, rule, verdict, and the method's probability of ``block``.

    The weights are one row of ``buckets + 1`` numbers, which is broadcast.
    """
    url = F.col("url")
    parsed = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("x", grams(F.col("host"), F.col("path"), buckets))
    scored = ruled.join(F.broadcast(fit(labelled, buckets, **options))).withColumn("score", F.when(F.col("fitted"), _sigmoid(
        F.aggregate("x", F.get("weights", F.lit(buckets)), lambda a, b: a + F.get("weights", b)))).otherwise(F.lit(0.0)))
    return scored.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(
        F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The URLs that a rule decides, with its decision as the label."""
    url = F.col("url")
    return pages.select("url", rule_of(host_of(url), path_of(url), rules).alias("fit")).where("fit IS NOT NULL").select(
        "url", (F.col("fit.verdict") == "block").cast("int").alias("blocked"))


_SQL_RULES = "\n    ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'"
    for v, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])))


def _sql_grams(text: str, start: int) -> str:
    letters = f"list_transform(string_split('^' || {text} || '$', ''), lambda c: unicode(c)::BIGINT)"
    return (f"list_transform(range(0, greatest(length({text}) - 1, 0) + 1), lambda i: ((({start} * 131 + coalesce(({letters})[i + 1], 0)) * 131 "
            f"+ coalesce(({letters})[i + 2], 0)) * 131 + coalesce(({letters})[i + 3], 0)) % {BUCKETS})")


#: Rules and method for DuckDB over the table ``pages``.
SQL = f"""
WITH RECURSIVE cut AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {_SQL_RULES} END AS fit,
    list_distinct(list_concat({_sql_grams('host', 7)}, {_sql_grams('path', 11)})) AS x FROM parsed),
chosen AS (SELECT url, max(CASE WHEN starts_with(fit, 'block') THEN 1.0 ELSE 0.0 END)::DOUBLE AS y, any_value(x) AS x
  FROM ruled WHERE fit IS NOT NULL AND url IS NOT NULL GROUP BY url ORDER BY md5(url), url LIMIT {FIT_ROWS}),
numbered AS (SELECT row_number() OVER (ORDER BY md5(url), url) AS i, y, x FROM chosen),
held AS (SELECT i, unnest(x) AS b FROM numbered),
held_by AS (SELECT b, list(i ORDER BY i) AS ids FROM held GROUP BY b),
posts AS (SELECT list(coalesce(ids, []) ORDER BY r.b) AS posts FROM (SELECT unnest(range({BUCKETS})) AS b) r LEFT JOIN held_by s ON r.b = s.b),
one AS (SELECT posts, (SELECT list(x ORDER BY i) FROM numbered) AS xs, (SELECT list(y ORDER BY i) FROM numbered) AS ys,
    (SELECT count(*) FROM numbered) AS n, (SELECT count(DISTINCT y) FROM numbered) > 1 AS fitted FROM posts),
fit(t, w, e) AS (
  SELECT 0, list_transform(range({BUCKETS} + 1), lambda i: 0.0::DOUBLE), list_transform(ys, lambda y: 0.5::DOUBLE - y) FROM one
  UNION ALL
  SELECT t + 1, v, list_transform(range(n), lambda i: 1.0 / (1.0 + exp(-(v[{BUCKETS} + 1] + coalesce(list_sum(list_transform(xs[i + 1], lambda b: v[b + 1])), 0)))) - ys[i + 1])
  FROM (SELECT t, n, xs, ys, list_concat(
      list_transform(range({BUCKETS}), lambda b: w[b + 1] - {RATE} * (coalesce(list_sum(list_transform(posts[b + 1], lambda i: e[i])), 0) / n + {RIDGE} * w[b + 1])),
      [w[{BUCKETS} + 1] - {RATE} * list_sum(e) / n]) AS v FROM fit, one WHERE t < {STEPS})),
trained AS (SELECT w, fitted FROM fit, one WHERE t = CASE WHEN fitted THEN {STEPS} ELSE 0 END),
scored AS (SELECT r.*, CASE WHEN fitted THEN 1.0 / (1.0 + exp(-(w[{BUCKETS} + 1] + coalesce(list_sum(list_transform(x, lambda b: w[b + 1])), 0)))) ELSE 0.0 END AS p
  FROM ruled r, trained)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
  coalesce(split_part(fit, ' ', 1), CASE WHEN p >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(p, 6) AS score
FROM scored"""
