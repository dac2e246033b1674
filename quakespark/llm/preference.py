"""Preference formatting of chosen and rejected conversations.

Both conversations of a pair are compared turn by turn. Their longest common prefix is rendered once,
as the prompt; what follows is rendered as the chosen and the rejected completion, each with a mask:
the spans (code points, end exclusive) of what assistants say in it, on which a model may be trained.

Defined results: turns are ordered by turn, role, text; a null role counts as "user", a null text as
empty; repeated rows are repeated turns; a pair with one conversation has an empty other side; two equal
conversations give the whole as prompt and two empty completions with empty masks; rows
without a conversation id belong to no conversation and are left out; an empty table gives no rows.
A conversation, being one training example whose text is one cell of the result, must fit in a task; pairs are
grouped by key alone, so frequent first turns or texts make no large group. Columns beyond conv_id, turn, role
and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column, trained: str) -> Column:
    """'start:end' of the text of every turn of role ``trained``, comma-joined."""
    head = F.length(F.lit(OPEN + MIDDLE))
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda held, turn: F.struct(
            (held["at"] + F.length(rendered(turn))).alias("at"),
            F.when(
                turn["role"] == trained,
                F.concat(held["spans"], F.array(F.concat_ws(":", held["at"] + head + F.length(turn["role"]), held["at"] + head + F.length(turn["role"]) + F.length(turn["text"])))),
            ).otherwise(held["spans"]).alias("spans"),
        ),
        lambda held: F.array_join(held["spans"], ","),
    )
    return start


def format_pairs(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """pairs: pair_id, chosen and rejected (``array<struct<role,text>>``), and more.

    Returns pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.
    """
    chosen, rejected = F.col("chosen"), F.col("rejected")
    shortest = F.least(F.size(chosen), F.size(rejected))
    common = F.aggregate(
        F.arrays_zip(F.slice(chosen, 1, shortest).alias("c"), F.slice(rejected, 1, shortest).alias("r")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda held, both: F.struct(
            (held["n"] + F.when(held["on"] & (both["c"] == both["r"]), 1).otherwise(0)).alias("n"),
            (held["on"] & (both["c"] == both["r"])).alias("on"),
        ),
        lambda held: held["n"],
    )
    cut = pairs.select("pair_id", chosen.alias("chosen"), rejected.alias("rejected"), common.alias("n_common"))
    rest = {k: F.slice(F.col(k), F.col("n_common") + 1, F.greatest(F.size(k) - F.col("n_common"), F.lit(0))) for k in ("chosen", "rejected")}
    return cut.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        render(F.slice(chosen, 1, F.col("n_common"))).alias("prompt"),
        *(render(rest[k]).alias(k) for k in rest),
        *(mask(rest[k], trained).alias(f"{k}_mask") for k in rest),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected) from rows of conv_id, turn, role, text: one shuffle on k."""
    turn = F.struct(
        (F.col("conv_id") % 2).alias("side"), "turn",
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    both = (
        turns.where("conv_id is not null")
        .groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    side = lambda k: F.transform(F.filter("turns", lambda t: F.abs(t["side"]) == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return both.select("pair_id", side(0).alias("chosen"), side(1).alias("rejected"))


ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k,
    coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.k = r.k),
n AS (SELECT pair_id, coalesce(min(k) FILTER (WHERE NOT same), count(*)) AS n_common FROM b GROUP BY pair_id),
x AS (
  SELECT t.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)),
y AS (
  SELECT *, coalesce(sum(length(shown)) FILTER (WHERE k >= n_common) OVER (
    PARTITION BY pair_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 + length(role) AS pos FROM x)
SELECT pair_id, any_value(n_common)::BIGINT AS n_common,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k < n_common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 0 AND k >= n_common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE side = 1 AND k >= n_common), '') AS rejected,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(text))::BIGINT, ',' ORDER BY k)
    FILTER (WHERE side = 0 AND k >= n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(text))::BIGINT, ',' ORDER BY k)
    FILTER (WHERE side = 1 AND k >= n_common AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY pair_id
"""
