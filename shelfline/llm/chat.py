"""Chat formatting after cumulative snapshots are collapsed.

Logs often hold a conversation several times, each time some turns longer. The print of the
first n turns is the sum of the prints of (place, role, text) of those turns, a rolling value
that needs no long strings, so the passes over the turns carry numbers only; a conversation whose whole print is the print of the first turns of a
longer one is a snapshot of it and goes. Of conversations equal in all turns the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stage
from shelfline.operators.running import BLOCK, blocked, over_blocks

#: How a turn is rendered.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def _numbers(text: Column) -> list[Column]:
    """Two 60-bit numbers of a text."""
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, start, 15), 16, 10).cast("long") for start in (1, 16)]


def marked(turns: DataFrame) -> DataFrame:
    """``turns`` with numbers for each: first and second of its content (NULL differs from every text), mark with its turn too."""
    parts = [F.coalesce(F.concat(F.lit("+"), x), F.lit("-")) for x in ("role", "text")]
    first, second = _numbers(F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts))
    return turns.withColumns({"first": first, "second": second, "mark": F.xxhash64("turn", "role", "text")})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, mark, first and second of each turn (of ``marked``) with n, its place in the conversation from 1, and the
    prints one and two of the conversation up to it. Texts stay where they are."""
    light = turns.select("conv_id", "turn", "first", "second", "mark", F.xxhash64("role", "text").alias("_tie"), F.lit(1).cast("long").alias("_one"))
    rows = blocked(light, ["conv_id"], ["turn", "_tie"])
    numbered = over_blocks(rows, ["conv_id"], ["turn", "_tie"], {"n": ("sum", "_one")}).drop("turn", "_tie", "_one")
    one, two = (x.cast("decimal(38,0)") for x in _numbers(F.concat_ws(":", "n", "first", "second")))
    numbered = numbered.withColumns({"_one": one, "_two": two})
    return over_blocks(numbered, ["conv_id"], ["n"], {"one": ("sum", "_one"), "two": ("sum", "_two")}).drop("_one", "_two", BLOCK)


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    return marked(conversations.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()]).filter("conv_id is not null"))


def maximal(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(turns of ``prefixes``, ids of the conversations that no other repeats or continues, with their n_turns)."""
    turns = stage(prefixes(_turns(conversations, conv_col, turn_col, role_col, text_col)), "prefixes")
    last = turns.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    ended = turns.select("conv_id", "n", "one", "two").join(last, "conv_id")
    whole = ended.filter("n = n_turns").groupBy("n_turns", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    inner = ended.filter("n < n_turns").select(F.col("n").alias("n_turns"), "one", "two").distinct()
    return turns, whole.join(inner, ["n_turns", "one", "two"], "left_anti").select("conv_id", "n_turns")


def render(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, n, n_turns and rendered, a row per turn of the conversations that stay.

    Turns follow each other by ``turn``, NULL first; turns of one number by a hash of their
    content. A turn in place n of n_turns is rendered by TEMPLATE; a NULL role is "unknown", a
    NULL text empty, yet neither equals that value when conversations are compared. A repeated row is a turn
    of its own. Rows with a NULL conversation id are left out. Rows stay turns, so a conversation of
    any length is never gathered in one place; concatenated by n they are its text. An
    empty table gives an empty result; other columns are not looked at.
    """
    turns, kept = maximal(conversations, conv_col, turn_col, role_col, text_col)
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    start, rest = TEMPLATE.split("{role}")
    middle, end = rest.split("{text}")
    rendered = F.concat(F.lit(start), role, F.lit(middle), text, F.lit(end))
    # Equal turns of a conversation are one text; only texts that stay are moved.
    same = ["conv_id", "mark", "first", "second"]
    kept = stage(kept, "kept")
    texts = _turns(conversations, conv_col, turn_col, role_col, text_col).join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = texts.select(*same, rendered.alias("rendered")).dropDuplicates(same)
    return turns.join(kept, "conv_id").select(*same, "n", "n_turns").join(texts, same).select("conv_id", "n", "n_turns", "rendered")


SQL = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations),
growing AS (
  SELECT conv_id, n, list(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-'))
         OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM turns),
printed AS (
  SELECT conv_id, n, md5(array_to_string(so_far, chr(2))) AS print, max(n) OVER (PARTITION BY conv_id) AS n_turns FROM growing),
whole AS (
  SELECT min(conv_id) AS conv_id, n_turns, print FROM printed WHERE n = n_turns GROUP BY n_turns, print),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM printed p WHERE p.n < p.n_turns AND p.n = w.n_turns AND p.print = w.print))
SELECT t.conv_id, t.n::BIGINT AS n, k.n_turns::BIGINT AS n_turns,
       '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) AS rendered
FROM turns t JOIN kept k ON t.conv_id = k.conv_id
"""
