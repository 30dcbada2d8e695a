"""Preference formatting: one prompt, two masked completions.

A pair has a chosen and a rejected conversation.  Their longest common turn prefix
is rendered once as the prompt; the remaining turns of each side are its completion,
of which the loss covers the assistant's turns only.  The result is one row for each
rendered turn, so no conversation is ever gathered in one place, however long: the
first differing turn of a pair is an aggregate, and everything else is row-wise.

Defined cases: rows without pair, side or turn are dropped; of several rows for one
turn the least (role, text), nulls last, counts; a null role renders as ``user``, a null text as
empty, and each equals only another null when turns are compared; a pair with one
side only has that side as its completion after an empty prompt; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.operators.ordered import last_seen, running
from failscope.storage import materialize

HEAD, SEP, TAIL = "<|", "|>\n", "\n<|end|>\n"


def format_pairs(turns: DataFrame) -> DataFrame:
    """Rendered turns of ``turns`` (pair_id, side 'chosen' or 'rejected', turn, role, text).

    Returns pair_id, part (prompt, chosen, rejected), turn, content, trained,
    train_from and train_to (character range of the loss in the content, end
    excluded; both null where nothing is trained).
    """
    said = F.struct(F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")
    chosen = F.col("side") == "chosen"
    grouped = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL AND side IN ('chosen', 'rejected')").groupBy("pair_id", "turn").agg(
        F.min(F.when(chosen, said)).alias("c"), F.min(F.when(~chosen, said)).alias("r"))
    fork = grouped.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("fork"))
    placed = grouped.join(fork, "pair_id", "left").withColumn("common", F.col("fork").isNull() | (F.col("turn") < F.col("fork")))

    def part(name: str, field: str) -> Column:
        return F.struct(F.lit(name).alias("part"), F.col(field)["role"].alias("role"), F.col(field)["text"].alias("text"))

    rows = placed.select("pair_id", "turn", F.inline(F.when(F.col("common"), F.array(part("prompt", "c"))).otherwise(
        F.filter(F.array(F.when(F.col("c").isNotNull(), part("chosen", "c")), F.when(F.col("r").isNotNull(), part("rejected", "r"))),
                 lambda x: x.isNotNull()))))
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    trained = (F.col("part") != "prompt") & (role == "assistant")
    start = F.length(role) + len(HEAD) + len(SEP)
    return rows.select(
        "pair_id", "part", "turn", F.concat(F.lit(HEAD), role, F.lit(SEP), text, F.lit(TAIL)).alias("content"), trained.alias("trained"),
        F.when(trained, start).cast("long").alias("train_from"),
        F.when(trained, start + F.length(text) + len(TAIL.rstrip("\n"))).cast("long").alias("train_to"))


def replies_swapped(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without judgements: the turns ``format_pairs`` takes.

    The chosen side is a conversation up to its last assistant turn; the rejected
    side ends in the next different reply in the order of the ids instead (after the last
    conversation the first ones follow).  Conversations without a reply make no pair, and
    none is made when all replies are equal.  The order is kept in even chunks, so neither
    the gaps between ids nor groups of equal replies matter.
    """
    known = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    last = known.where("role = 'assistant'").groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.min(F.struct(-F.col("turn"), F.col("text").isNull(), "text"))["text"].alias("reply"))
    falling = [F.bitwise_not("conv_id")]
    led = running(last, [], falling, follows=last_seen(F.struct("reply"), inclusive=False))
    turned = F.when(F.col("follows").isNotNull() & ~F.col("follows")["reply"].eqNullSafe(F.col("reply")), F.col("follows"))
    nexts = materialize(running(led.withColumn("turned", turned), [], falling, after=last_seen(F.col("turned"))), "replies")
    # One row: what the conversations of the last run of equal replies go on with.
    first = nexts.agg(F.min_by(F.struct("reply"), "conv_id").alias("start"), F.min_by("after", "conv_id").alias("second")).withColumn("one", F.lit(1))
    wrapped = nexts.withColumn("one", F.lit(1)).join(F.broadcast(first), "one")
    other = F.coalesce("after", F.when(~F.col("start")["reply"].eqNullSafe(F.col("reply")), F.col("start")), F.col("second"))
    swap = wrapped.withColumn("pick", other).where("pick IS NOT NULL").select("conv_id", "last", F.col("pick")["reply"].alias("other"))
    own = known.join(swap.select("conv_id", "last"), "conv_id").where(F.col("turn") <= F.col("last"))
    sides = own.select(
        F.col("conv_id").alias("pair_id"),
        F.explode(F.when(F.col("turn") < F.col("last"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))).alias("side"),
        "turn", "role", "text")
    ended = swap.select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last").alias("turn"),
                        F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return sides.unionByName(ended)


#: Both steps for DuckDB over the table ``conversations``.
SQL = r"""
WITH known AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text NULLS LAST) AS k FROM known WHERE role = 'assistant'),
lasts AS (SELECT conv_id, turn AS last, text AS reply FROM ranked WHERE k = 1),
led AS (SELECT *, CASE WHEN lead(conv_id) OVER o IS NOT NULL AND lead(reply) OVER o IS DISTINCT FROM reply THEN lead(conv_id) OVER o END AS turned
  FROM lasts WINDOW o AS (ORDER BY conv_id)),
nexts AS (SELECT *, first_value(turned IGNORE NULLS) OVER (ORDER BY conv_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM led),
begun AS (SELECT conv_id AS start, reply AS first_reply, after AS second FROM nexts ORDER BY conv_id LIMIT 1),
picked AS (SELECT n.*, coalesce(after, CASE WHEN first_reply IS DISTINCT FROM reply THEN start ELSE second END) AS next_id FROM nexts n, begun),
swap AS (SELECT n.conv_id, n.last, o.reply AS other FROM picked n JOIN lasts o ON o.conv_id = n.next_id),
own AS (SELECT k.*, s.last FROM known k JOIN swap s USING (conv_id) WHERE k.turn <= s.last),
turns AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM own
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM own WHERE turn < last
  UNION ALL SELECT conv_id, 'rejected', last, 'assistant', other FROM swap),
one AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id, side, turn ORDER BY role NULLS LAST, text NULLS LAST) = 1),
wide AS (SELECT coalesce(c.conv_id, r.conv_id) AS pair_id, coalesce(c.turn, r.turn) AS turn,
    c.conv_id IS NOT NULL AS has_c, r.conv_id IS NOT NULL AS has_r, c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext
  FROM (SELECT * FROM one WHERE side = 'chosen') c FULL JOIN (SELECT * FROM one WHERE side = 'rejected') r
    ON c.conv_id = r.conv_id AND c.turn = r.turn),
forked AS (SELECT *, min(CASE WHEN has_c <> has_r OR crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN turn END)
  OVER (PARTITION BY pair_id) AS fork FROM wide),
parts AS (
  SELECT pair_id, 'prompt' AS part, turn, crole AS role, ctext AS text FROM forked WHERE fork IS NULL OR turn < fork
  UNION ALL SELECT pair_id, 'chosen', turn, crole, ctext FROM forked WHERE turn >= fork AND has_c
  UNION ALL SELECT pair_id, 'rejected', turn, rrole, rtext FROM forked WHERE turn >= fork AND has_r),
said AS (SELECT pair_id, part, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM parts)
SELECT pair_id, part, turn, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS content,
  part <> 'prompt' AND role = 'assistant' AS trained,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 END::BIGINT AS train_from,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 END::BIGINT AS train_to
FROM said"""
