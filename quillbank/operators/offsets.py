"""Places in paragraphs whose parts are replaced and which are then merged: images, tables and formulas keep their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = ["doc_id", "paragraph_index"]


def _lists(replacements: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, edits): replacements of a paragraph in order, without those that overlap an earlier one."""
    edit = F.struct("start", "end", "text")
    lists = replacements.where("start >= 0 and end >= start").groupBy(*_PLACE).agg(F.array_sort(F.collect_set(edit)).alias("all"))
    kind = "array<struct<start:int,end:int,text:string>>"
    fits = lambda kept, x: F.when(F.size(kept) == 0, F.lit(True)).otherwise(F.element_at(kept, -1)["end"] <= x["start"])
    kept = F.aggregate(F.col("all").cast(kind), F.array().cast(kind), lambda kept, x: F.when(fits(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return lists.select(*_PLACE, kept.alias("edits"))


def _replaced(text: Column, edits: Column) -> Column:
    """text with each of the edits made; one that ends beyond the text is left out."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, x: Column) -> Column:
        parts = F.concat(state["parts"], F.array(F.substr(text, state["at"] + 1, x["start"] - state["at"]), F.coalesce(x["text"], F.lit(""))))
        return F.struct(x["end"].alias("at"), parts.alias("parts"))

    done = F.aggregate(edits, start, step)
    return F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1, F.length(text)))


def _moved(offset: Column, edits: Column) -> Column:
    """Where a place of the old text is in the new one: a place inside of a replaced part is at the end of its replacement."""
    length = lambda x: F.length(F.coalesce(x["text"], F.lit("")))

    def shift(x: Column) -> Column:
        whole = x["start"] + length(x) - F.greatest(x["end"], F.lit(0))
        inside = (x["start"] < offset) & (offset < x["end"])
        return F.when(x["end"] <= offset, F.when((x["start"] == offset) & (x["end"] == offset), 0).otherwise(whole)).when(inside, x["start"] + length(x) - offset).otherwise(0)

    return offset + F.aggregate(edits, F.lit(0), lambda total, x: total + shift(x))


def replaced_paragraphs(paragraphs: DataFrame, replacements: DataFrame) -> DataFrame:
    """(doc_id, paragraph_index, text, edits, start, end) of paragraphs (doc_id, paragraph_index, text) after replacements.

    replacements (doc_id, paragraph_index, start, end, text): parts of a paragraph, from 0, and what stands there instead.
    Of overlapping ones the first counts; those that leave their paragraph are left out. start and end are the places of
    a paragraph in the merged text of its document, whose paragraphs, in order of their index, are joined by a newline.
    A null text is empty. A document's paragraphs meet in one task, as a document is one file.
    """
    edits = paragraphs.join(_lists(replacements), _PLACE, "left")
    old = F.coalesce("text", F.lit(""))
    inside = F.filter(F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,text:string>>")), lambda x: x["end"] <= F.length(old))
    out = edits.withColumn("edits", inside).withColumn("text", _replaced(old, F.col("edits")))
    order = Window.partitionBy("doc_id").orderBy("paragraph_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(order) - 1
    return out.withColumn("end", end).select(*_PLACE, "text", "edits", (F.col("end") - F.length("text")).alias("start"), "end")


def rebased(anchors: DataFrame, replaced: DataFrame, offset: str = "offset") -> DataFrame:
    """anchors (doc_id, paragraph_index, offset, ...) with `place`, where they are in the merged text of replaced_paragraphs().

    An offset beyond its paragraph, or null, stands at its end. Anchors of a paragraph that is not there have no place.
    """
    out = anchors.join(replaced.select(*_PLACE, "text", "edits", "start", "end"), _PLACE, "left")
    moved = _moved(F.greatest(F.col(offset), F.lit(0)), F.col("edits"))
    place = F.when(F.col("start").isNotNull() & F.col(offset).isNotNull(), F.least(F.col("start") + moved, F.col("end"))).otherwise(F.col("end"))
    return out.withColumn("place", place).select(*anchors.columns, "place")


def rebased_tables(tables: DataFrame, replaced: DataFrame) -> DataFrame:
    """tables (doc_id, table_id, first, last) with the start and end of their paragraphs in the merged text.

    Of first and last only paragraphs that are there count; a table without any has no place.
    """
    rows = tables.select("doc_id", "table_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("paragraph_index"))
    ends = rows.join(replaced.select(*_PLACE, "start", "end"), _PLACE).groupBy("doc_id", "table_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return tables.join(ends, ["doc_id", "table_id"], "left")


def merged_texts(replaced: DataFrame) -> DataFrame:
    """(doc_id, text): the merged text of each document."""
    lines = replaced.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))).alias("x"))
    return lines.select("doc_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
