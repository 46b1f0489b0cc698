"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source has a weight; targets share the size of all sources by weight. A source whose
target would pass ``epochs`` times its size is clamped there and the excess goes to the others
by weight, until none passes. A target is then taken as whole repetitions of the source and a
rest: documents in a seeded order until the rest is full, the last one in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import WORD, exact_words, placed, stage

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix"
#: Documents of a source whose order is settled in one group, on average.
GROUP_DOCS = 4096


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, place, docs, source_size, target) per source of ``sizes`` (source, size).

    Sources are placed by code point, NULL last; weights repeat along that order. Without any
    words all targets are 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = placed(per_source, [F.col("source").asc_nulls_last()], "place", "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    plan = plan.withColumns({"weight": weight, "cap": F.col("source_size") * epochs})
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    # Clamped sources stay clamped, so each round only has to learn three numbers.
    clamped_size, free, clamped_rows = 0, plan.agg(F.sum("weight")).first()[0] or 0, 0
    while True:
        left = total - clamped_size
        clamped = F.col("cap").cast("double") * float(free) <= float(left) * F.col("weight")
        if not free:
            clamped = F.lit(True)
        seen = plan.agg(
            F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("weight"))), F.count(F.when(clamped, F.lit(1)))
        ).first()
        if seen[2] == clamped_rows:
            break
        clamped_size, free, clamped_rows = seen[0], seen[1] or 0, seen[2]
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(free or 1))
    return plan.select("source", "place", "docs", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``documents``.

    Size is the number of words, 0 for a NULL text. NULL is a source of its own. Rows of one id
    are separate documents, next to each other in the seeded order, the shorter first. Rows without words
    are taken 0 times. An empty table gives an empty result; other columns are not looked at.
    ``carry`` adds ``row``, a struct of all input columns.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if carry else []
    sizes = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        exact_words(F.col(f"`{text_col}`")).alias("size"),
        *row,
    )
    sizes = stage(sizes, "sizes")
    goal = targets(sizes.select("source", "size"), weights, epochs).withColumnRenamed("source", "_source")
    # Hex digits of the order that make groups of about GROUP_DOCS documents.
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("docs") / GROUP_DOCS) / F.log(F.lit(16.0)))).cast("int")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumns({"digits": digits, "whole": whole})
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5))
    docs = sizes.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("order", order_key(F.col("doc_id"), seed))
    docs = docs.withColumn("group", F.substring("order", F.lit(1), F.col("digits")))

    groups = docs.groupBy("place", "group").agg(F.sum("size").alias("group_size"))
    earlier = Window.partitionBy("place").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("place", "group", F.coalesce(F.sum("group_size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "group").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(starts, ["place", "group"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    carried = ["row", "whole"] if carry else []
    return docs.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), *carried)


def mixed_documents(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``documents`` as the mix takes them: a row per repetition, the columns as they were.

    A repetition in part keeps the first words, joined by blanks.
    """
    taken = mix_sources(documents, text_col=text_col, carry=True, **options)
    part = F.col("taken") - F.col("whole") * F.col("size")
    copies = (F.col("whole") + F.when(part > 0, 1).otherwise(0)).cast("int")
    rows = taken.filter((F.col("size") > 0) & (copies > 0)).withColumns({"part": part, "copies": copies})
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    text = F.col(f"row.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.col("part").cast("int"))), " ")
    in_part = (F.col("copy") > F.col("whole")) & (F.col("part") < F.col("size"))
    kept = F.when(in_part, cut_text).otherwise(text)
    return rows.select(*[kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, {EPOCHS} * sum(size)::BIGINT AS cap,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_caps,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources),
clamped AS (
  SELECT *, cap::DOUBLE * free::DOUBLE <= (total - lower_caps)::DOUBLE * weight AS is_clamped FROM filled),
goals AS (
  SELECT source, source_size, CASE WHEN is_clamped THEN cap::DOUBLE
         ELSE (total - coalesce(sum(cap) FILTER (is_clamped) OVER (), 0))::DOUBLE * weight / (sum(weight) FILTER (NOT is_clamped) OVER ())::DOUBLE END AS target
  FROM clamped),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals),
docs AS (
  SELECT doc_id, size, source_size, target, whole, floor(target - whole * source_size + 0.5)::BIGINT AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken FROM docs
"""
