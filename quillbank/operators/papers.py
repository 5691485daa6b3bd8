"""Order, sections and contents of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def renumbered(items: DataFrame, type_order: list[str]) -> DataFrame:
    """items (paper_id, position, question_type, item_id) with new positions: by type in that order, then as before."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(t) for t in type_order)), F.col("question_type")), F.lit(0))
    rank = F.when(rank == 0, len(type_order) + 1).otherwise(rank)
    order = Window.partitionBy("paper_id").orderBy(rank, "position", "item_id")
    return items.withColumn("new_position", F.row_number().over(order) - 1)


def sections(items: DataFrame) -> DataFrame:
    """(paper_id, section, question_type, first_position, items): runs of one type in the order of positions."""
    order = Window.partitionBy("paper_id").orderBy("position", "item_id")
    before = F.lag("question_type").over(order)
    starts = F.when(F.row_number().over(order) == 1, 1).otherwise((~F.col("question_type").eqNullSafe(before)).cast("int"))
    marked = items.withColumn("start", starts)
    marked = marked.withColumn("section", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("paper_id", "section").agg(F.first("question_type").alias("question_type"), F.min("position").alias("first_position"), F.count("*").alias("items"))


def swapped(items: DataFrame, paper_id, item_id, step: int) -> DataFrame:
    """items after one of them changed places with the next (step 1) or previous (-1) of its type."""
    order = Window.partitionBy("paper_id", "question_type").orderBy("position", "item_id")
    near = items.where(F.col("paper_id") == paper_id)
    near = near.withColumns({"other": F.lead("item_id", step).over(order) if step > 0 else F.lag("item_id", -step).over(order), "other_position": F.lead("position", step).over(order) if step > 0 else F.lag("position", -step).over(order)})
    pair = near.where((F.col("item_id") == item_id) & F.col("other").isNotNull())
    moves = pair.select(F.col("item_id").alias("item_id"), F.col("other_position").alias("moved")).union(pair.select(F.col("other"), F.col("position")))
    out = items.join(F.broadcast(moves), "item_id", "left")
    return out.withColumn("position", F.coalesce("moved", "position")).drop("moved")


def added(items: DataFrame, additions: DataFrame) -> DataFrame:
    """Questions to append (paper_id, question_id, ordinal): those that the paper has not, the first of each."""
    new = additions.join(items.select("paper_id", "question_id"), ["paper_id", "question_id"], "left_anti")
    return new.groupBy("paper_id", "question_id").agg(F.min("ordinal").alias("ordinal"))


def used_at(questions: DataFrame, items: DataFrame, saved_at_ms: int) -> DataFrame:
    """questions after papers with these items were saved: last_used_at_ms moves, the version does not."""
    used = items.select(F.col("question_id").alias("id")).distinct().withColumn("__used", F.lit(True))
    out = questions.join(used, "id", "left")
    return out.withColumn("last_used_at_ms", F.when(F.col("__used"), F.lit(saved_at_ms)).otherwise(F.col("last_used_at_ms"))).drop("__used")


def publications(local: DataFrame, published: DataFrame) -> DataFrame:
    """Local papers and cloud publications in one list (paper_id, title, items, origin); unpublished rows are left out.

    The publication's title counts before the local one.
    """
    shown = published.where(F.coalesce(F.col("published"), F.lit(True)))
    both = local.withColumnRenamed("title", "local_title").join(shown.select("paper_id", F.col("title").alias("cloud_title"), F.lit(True).alias("cloud")), "paper_id", "full_outer")
    origin = F.when(F.col("cloud").isNull(), "local").when(F.col("local_title").isNull(), "cloud").otherwise("both")
    return both.select("paper_id", F.coalesce("cloud_title", "local_title", F.lit("")).alias("title"), F.coalesce("items", F.lit(0)).alias("items"), origin.alias("origin"))


def replaced(items: DataFrame, wanted: DataFrame, types: DataFrame) -> DataFrame:
    """items (paper_id, item_id, question_id, question_type, ...) with other questions in place of some.

    wanted (paper_id, item_id, new_id) holds where the new question has the item's type in types (new_id, new_type), and
    the paper has it in no item. Two items of a paper that ask for one question: the smaller item_id gets it.
    """
    asked = wanted.join(types, "new_id").join(items.select("paper_id", "item_id", "question_type"), ["paper_id", "item_id"])
    asked = asked.where("new_type = question_type").join(items.select("paper_id", F.col("question_id").alias("new_id")), ["paper_id", "new_id"], "left_anti")
    one = asked.groupBy("paper_id", "new_id").agg(F.min("item_id").alias("item_id"))
    out = items.join(one, ["paper_id", "item_id"], "left")
    return out.withColumn("question_id", F.coalesce("new_id", "question_id")).select(*items.columns)


def recovery_saved(slots: DataFrame, saves: DataFrame) -> DataFrame:
    """slots (owner, content, revision) after saves (owner, content, at): the latest of an owner stays, one revision for each."""
    new = saves.groupBy("owner").agg(F.max_by("content", F.struct("at", "content")).alias("__content"), F.count("*").alias("__n"))
    both = slots.join(new, "owner", "full_outer")
    return both.select("owner", F.coalesce("__content", "content").alias("content"), (F.coalesce("revision", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("revision"))


def recovery_cleared(slots: DataFrame, reads: DataFrame) -> DataFrame:
    """slots after owners cleared what they had read: content goes where the revision (owner, revision) is still the same."""
    out = slots.join(reads.select("owner", F.col("revision").alias("__read")), "owner", "left")
    return out.withColumn("content", F.when(~F.coalesce(F.col("__read") == F.col("revision"), F.lit(False)), F.col("content"))).drop("__read")


def with_items(papers: DataFrame, items: DataFrame) -> DataFrame:
    """papers (paper_id, ...) with the array `items` of their items (paper_id, position, question_id), by position."""
    found = items.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", "question_id"))).alias("items"))
    empty = F.array().cast(found.schema["items"].dataType.simpleString())
    return papers.join(found, "paper_id", "left").withColumn("items", F.coalesce("items", empty))
