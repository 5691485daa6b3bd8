"""Random and stratified drawing of questions under a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 1000


def draw_scope(questions: DataFrame, bridge: DataFrame | None = None, subjects=(), chapters=(), units=(), tags=(), tag_mode="any", excluded=(), usage="all", usage_cutoff=None) -> DataFrame:
    """Questions in the given subjects, chapters, units and tags (none: any) with that use, without the excluded ids.

    excluded is a list of ids, or a table (id) of any size; a null id excludes nothing.
    """
    from quillbank.operators.listing import tagged, usage_condition

    out = questions
    for column, values in (("subject", subjects), ("chapter", chapters), ("unit", units)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if isinstance(excluded, DataFrame):
        out = out.join(excluded.select("id"), "id", "left_anti")
    elif excluded:
        out = out.where(~F.col("id").isin(*excluded))
    if usage != "all":
        out = out.where(usage_condition(usage, usage_cutoff))
    return tagged(out, bridge, tuple(tags), tag_mode) if tags else out


def analyse(candidates: DataFrame) -> DataFrame:
    """(question_type, n) of the candidates, and their total under a null type."""
    return candidates.rollup("question_type").agg(F.count("*").alias("n"))


def seeded_order(seed: int | None) -> Column:
    """md5 of seed and id, so that a draw can be repeated; without a seed at random."""
    return F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


def draw_total(candidates: DataFrame, total: int, seed: int | None = None) -> DataFrame:
    """`total` questions, or all if there are fewer."""
    if not 1 <= total <= MOST:
        raise ValueError(f"from 1 to {MOST} questions")
    return candidates.withColumn("draw_key", seeded_order(seed)).orderBy("draw_key", "id").limit(total)


def draw_by_type(candidates: DataFrame, quotas: dict[str, int], seed: int | None = None) -> DataFrame:
    """For each type as many questions as its quota says, or all it has, with their place in `draw_rank`.

    A type's best are found in every task first, so a type with most of all questions is not gathered.
    """
    if not 1 <= sum(quotas.values()) <= MOST or min(quotas.values()) < 0:
        raise ValueError(f"quotas of 0 and more, from 1 to {MOST} in all")
    wanted = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    keyed = candidates.where(F.col("question_type").isin(*quotas)).withColumn("draw_key", seeded_order(seed))
    keyed = keyed.withColumn("draw_rank", F.row_number().over(Window.partitionBy("question_type").orderBy("draw_key", "id")))
    return keyed.where(F.col("draw_rank") <= max(quotas.values())).where(F.col("draw_rank") <= wanted[F.col("question_type")])
