"""Preference formatting: shared turns become the prompt, what follows becomes two masked completions.

Only DataFrame functions are used. A conversation is one array of turns, since its rendered text is one value anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role whose words are trained on.
TRAINED = "assistant"


def rendered(turn: Column) -> tuple[Column, Column]:
    """(header, body with its end mark) of a turn; marks inside a text are broken up, so a text can't close its turn."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), plain(turn["role"]), F.lit("|>\n")), F.concat(plain(turn["text"]), F.lit("<|end|>\n"))


def as_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*rendered(t))), "")


def as_mask(turns: Column) -> Column:
    """One digit per character of the text: 1 where it is trained on, 0 elsewhere."""

    def one(t: Column) -> Column:
        header, body = rendered(t)
        digit = F.when(t["role"].eqNullSafe(TRAINED), "1").otherwise("0")
        return F.concat(F.call_function("repeat", F.lit("0"), F.length(header)), F.call_function("repeat", digit, F.length(body)))

    return F.array_join(F.transform(turns, one), "")


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns; null fields equal null fields."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


def preference_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(pair_id, n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask) per row.

    `chosen` and `rejected` are arrays of structs with role and text. Null arrays are empty; equal conversations have empty
    completions; null roles and texts are rendered empty and equal each other; repeated rows stay; other columns are
    ignored; an empty table gives an empty table.
    """
    kind = "array<struct<role:string,text:string>>"
    turns = lambda c: F.coalesce(F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.array().cast(kind))
    p = pairs.select(F.col(id_col).alias("pair_id"), turns(chosen).alias("a"), turns(rejected).alias("b"))
    p = p.withColumn("n_shared", shared_turns(F.col("a"), F.col("b")))
    tail = lambda c: F.slice(c, F.col("n_shared").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    return p.select(
        "pair_id", "n_shared", as_text(F.slice("a", F.lit(1), F.col("n_shared").cast("int"))).alias("prompt"),
        as_text(tail("a")).alias("chosen"), as_mask(tail("a")).alias("chosen_mask"),
        as_text(tail("b")).alias("rejected"), as_mask(tail("b")).alias("rejected_mask"),
    )


def broken_off(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) per conversation of a table (conv_id, turn, role, text).

    Chosen is the conversation; in rejected every answer from turn number conv_id modulo the number of turns on breaks off
    half-way. Turns are in the order of (turn, role, text), nulls first. A turn without a conv_id belongs to no other and is a
    conversation of its own, so however many there are, they never meet in a task.
    """
    turn = F.struct("turn", F.col("role"), F.col("text"))
    named = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    c = named.unionByName(turns.where(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("t")))
    start = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.size("t"))
    half = lambda t: F.substring(t["text"], F.lit(1), F.floor(F.length(t["text"]) / 2).cast("int"))
    worse = lambda t, i: F.when((i >= start) & (t["role"] == TRAINED), half(t)).otherwise(t["text"])
    return c.select(
        F.col("conv_id").alias("pair_id"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"),
        F.transform("t", lambda t, i: F.struct(t["role"].alias("role"), worse(t, i).alias("text"))).alias("rejected"),
    )


_PLAIN = "replace(coalesce({}, ''), '<|', '< |')"
_HEAD = "'<|' || " + _PLAIN.format("t.role") + " || '|>' || chr(10)"
_BODY = _PLAIN.format("t.text") + " || '<|end|>' || chr(10)"
_TEXT = "array_to_string(list_transform({}, lambda t: " + _HEAD + " || " + _BODY + "), '')"
_MASK = "array_to_string(list_transform({}, lambda t: repeat('0', length(" + _HEAD + ")) || repeat(CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END, length(" + _BODY + "))), '')"
SQL = f"""
WITH c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS a
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL SELECT conv_id, [struct_pack(role := role, text := text)] FROM conversations WHERE conv_id IS NULL),
b AS (SELECT conv_id, a, list_transform(range(1, len(a) + 1), lambda i: struct_pack(role := a[i].role,
      text := CASE WHEN i > coalesce(conv_id, 0) % len(a) AND a[i].role = 'assistant' THEN substr(a[i].text, 1, length(a[i].text) // 2) ELSE a[i].text END)) AS b FROM c),
n AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] IS NOT DISTINCT FROM b[i]), false), 0) - 1, len(a))::BIGINT AS n_shared FROM b)
SELECT conv_id AS pair_id, n_shared, {_TEXT.format('a[1:n_shared]')} AS prompt,
  {_TEXT.format('a[n_shared + 1:]')} AS chosen, {_MASK.format('a[n_shared + 1:]')} AS chosen_mask,
  {_TEXT.format('b[n_shared + 1:]')} AS rejected, {_MASK.format('b[n_shared + 1:]')} AS rejected_mask
FROM n
"""
