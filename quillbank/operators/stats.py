"""Counts over taxonomy, tags and types, and the statistics page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered
from quillbank.functions.text import percent_text


def counted(dimension: DataFrame, facts: DataFrame, key: str, name: str = "questions") -> DataFrame:
    """Every row of the dimension with its number of facts, 0 included."""
    n = facts.groupBy(key).agg(F.count("*").alias(name))
    return dimension.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def tag_distribution(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """(tag_id, questions): distinct questions of each tag; tags without any, and unknown tags, come too."""
    n = bridge.select("question_id", "tag_id").distinct().groupBy("tag_id").agg(F.count("*").alias("questions"))
    return tags.select("tag_id").join(n, "tag_id", "full_outer").withColumn("questions", F.coalesce("questions", F.lit(0)))


def distribution(facts: DataFrame, key: str, none: str = "__uncategorized__") -> DataFrame:
    """(key, questions, share_of_most, running_share) without empty groups, the uncategorised last.

    The windows run over the groups, of which there are as many as keys.
    """
    label = F.coalesce(F.col(key).cast("string"), F.lit(none))
    n = facts.groupBy(label.alias(key)).agg(F.count("*").alias("questions"))
    order = Window.orderBy(F.col(key) == none, key)
    total = F.sum("questions").over(Window.partitionBy())
    return n.withColumns(
        {
            "share_of_most": F.col("questions") / F.max("questions").over(Window.partitionBy()),
            "running_share": F.sum("questions").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total,
        }
    )


def ranking(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Groups by falling count, then by key in binary order, with their place."""
    n = facts.groupBy(*keys).agg(F.count("*").alias("questions"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("questions"), *keys)))


def unit_ranking(facts: DataFrame) -> DataFrame:
    """(unit, questions, place): units of facts (chapter, unit); those without a unit are unassigned:<chapter>."""
    unit = F.coalesce("unit", F.concat(F.lit("unassigned:"), F.coalesce(F.col("chapter").cast("string"), F.lit(""))))
    return ranking(facts.select(unit.alias("unit")), ["unit"])


def type_counts(facts: DataFrame, key: str) -> DataFrame:
    """(key, types): for each key a map from question type to its number of facts, in order of the types.

    Facts without a type are not counted, but their key has a row; counts are made before maps, which are as long as
    there are types.
    """
    n = facts.groupBy(key, "question_type").agg(F.count("*").alias("n"))
    entry = F.when(F.col("question_type").isNotNull(), F.struct("question_type", "n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("types"))


def headline(facts: DataFrame, now, days: int) -> DataFrame:
    """One row: all, added and used in the last days, never used, and the share of those. Facts: created_at, last_used_at."""
    since = F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    within = lambda c: F.coalesce((F.col(c) >= since).cast("long"), F.lit(0))
    out = facts.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(within("created_at")), F.lit(0)).alias("added"),
        F.coalesce(F.sum(within("last_used_at")), F.lit(0)).alias("used"),
        F.count_if(F.col("last_used_at").isNull()).alias("never_used"),
    )
    return out.withColumn("never_used_percent", percent_text(F.col("never_used"), F.col("total")))


def taxonomy_tree(subjects: DataFrame, chapters: DataFrame) -> DataFrame:
    """Subjects (subject_id, subject) with the array of their chapters (subject_id, chapter) by name."""
    inner = chapters.groupBy("subject_id").agg(F.array_sort(F.collect_list("chapter")).alias("chapters"))
    out = subjects.join(inner, "subject_id", "left")
    return out.withColumn("chapters", F.coalesce("chapters", F.array().cast("array<string>")))


def in_order(dimension: DataFrame) -> DataFrame:
    """dimension (id, sort_order, ...) with the place of each row, from 1, by sort_order and id (nulls first)."""
    return numbered(dimension, [F.asc("sort_order"), F.asc("id")], "place").withColumn("place", F.col("place") + 1)


#: Fixed value: the language whose order of names the reports use.
NAMES = "zh"


def by_name(dimension: DataFrame, key: str = "name", collation: str = NAMES) -> DataFrame:
    """dimension (id, name, ...) with the place of each row, from 1, by name in the order of a language, then id."""
    return numbered(dimension, [F.asc(F.collate(F.col(key), collation)), F.asc("id")], "place").withColumn("place", F.col("place") + 1)


def ranking_by_name(facts: DataFrame, names: list[str], sort_order: str | None = None, collation: str = NAMES) -> DataFrame:
    """Groups of facts by falling count, then sort_order (nulls last) if there is one, then each of the names in the order of a language.

    The window runs over the groups, of which there are as many as names; names that a language takes for equal are told
    apart in binary order.
    """
    keys = [*names, *([sort_order] if sort_order else [])]
    n = facts.groupBy(*keys).agg(F.count("*").alias("questions"))
    order = [F.desc("questions"), *([F.asc_nulls_last(sort_order)] if sort_order else []), *(F.asc(F.collate(F.col(c), collation)) for c in names), *names]
    return n.withColumn("place", F.row_number().over(Window.orderBy(*order)))
