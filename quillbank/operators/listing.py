"""Filtered and paged listings of questions and papers."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.functions.text import matches_keyword


@dataclass(frozen=True)
class QuestionFilters:
    """What a listing is restricted to; empty values do not restrict."""

    keyword: str = ""
    subject: str | None = None
    chapter: str | None = None
    unit: str | None = None
    unassigned_unit: bool = False
    question_type: str | None = None
    tags: tuple = ()
    tag_mode: str = "any"
    usage: str = "all"
    usage_cutoff: object = None
    deleted: bool = False
    page: int = 1
    page_size: int = 20
    search_columns: tuple[str, ...] = field(default=("stem_plain", "options_plain", "answer_plain", "explanation_plain", "tags_plain"))

    def __post_init__(self) -> None:
        if self.tag_mode not in ("any", "all") or self.usage not in ("all", "never", "before"):
            raise ValueError("tag_mode is any or all, usage all, never or before")
        if self.usage == "before" and self.usage_cutoff is None:
            raise ValueError("usage before needs a cut-off")


def usage_condition(usage: str, cutoff, column: str = "last_used_at") -> Column:
    """all, never used, or never used since the cut-off."""
    if usage == "all":
        return F.lit(True)
    never = F.col(column).isNull()
    return never if usage == "never" else never | (F.col(column) < F.lit(cutoff))


def tagged(questions: DataFrame, bridge: DataFrame, tags: tuple, mode: str = "any") -> DataFrame:
    """Questions (id) that have any or all of `tags` in bridge (question_id, tag_id); no tags: all questions."""
    tags = tuple(dict.fromkeys(tags))
    if not tags:
        return questions
    found = bridge.where(F.col("tag_id").isin(*tags)).select(F.col("question_id").alias("id"), "tag_id")
    if mode == "all":
        found = found.groupBy("id").agg(F.count_distinct("tag_id").alias("n")).where(F.col("n") == len(tags))
    return questions.join(found.select("id"), "id", "left_semi")


def filtered(questions: DataFrame, filters: QuestionFilters, bridge: DataFrame | None = None) -> DataFrame:
    """Questions that pass the filters. Only columns that a filter needs must be there."""
    out = questions
    if "deleted_at_ms" in questions.columns:
        out = out.where(F.col("deleted_at_ms").isNotNull() if filters.deleted else F.col("deleted_at_ms").isNull())
    if filters.keyword.strip():
        columns = [F.col(c) for c in filters.search_columns if c in questions.columns]
        out = out.where(matches_keyword(columns, filters.keyword))
    for column, value in (("subject", filters.subject), ("chapter", filters.chapter), ("unit", filters.unit), ("question_type", filters.question_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if filters.unassigned_unit:
        out = out.where(F.col("unit").isNull())
    if filters.usage != "all":
        out = out.where(usage_condition(filters.usage, filters.usage_cutoff))
    return tagged(out, bridge, filters.tags, filters.tag_mode) if bridge is not None else out


def paged(df: DataFrame, order: list[Column], page: int, page_size: int, most: int = 100) -> DataFrame:
    """One page in a total order, with the number of all rows in `total`; page and size are clamped to 1 and `most`."""
    page, size = max(1, page), min(max(1, page_size), most)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def list_questions(questions: DataFrame, filters: QuestionFilters, bridge: DataFrame | None = None) -> DataFrame:
    """A page of the questions that pass, the latest changed first (in the bin: the latest deleted), then by id."""
    latest = "deleted_at_ms" if filters.deleted and "deleted_at_ms" in questions.columns else "updated_at"
    return paged(filtered(questions, filters, bridge), [F.desc(latest), F.asc("id")], filters.page, filters.page_size)


def list_papers(papers: DataFrame, items: DataFrame, status: str | None = None, title: str = "", page: int = 1, page_size: int = 100) -> DataFrame:
    """A page of papers with their item counts, saved ones by when they were saved, others by their last change.

    A title is looked for in its compatibility-normalised form.
    """
    out = papers if status is None else papers.where(F.col("paper_status") == status)
    if title.strip():
        out = out.where(matches_keyword([F.col("title")], unicodedata.normalize("NFKC", title)))
    counts = items.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("item_count"))
    when = F.when(F.col("paper_status") == "saved", F.col("saved_at")).otherwise(F.col("updated_at"))
    found = paged(out, [when.desc_nulls_last(), F.asc("id")], page, page_size, 500)
    return found.join(counts, "id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def fetch_by_ids(df: DataFrame, ids: list, most: int = 100) -> DataFrame:
    """Rows of the given distinct ids with their place in the list; asking for a missing id is for the caller to see."""
    if len(ids) > most or len(set(ids)) != len(ids):
        raise ValueError(f"at most {most} distinct ids")
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, id {df.schema['id'].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), "id").orderBy("position")


def missing_ids(df: DataFrame, ids: list) -> DataFrame:
    """Those of the given ids that have no row."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in ids], f"id {df.schema['id'].dataType.simpleString()}")
    return wanted.join(df.select("id"), "id", "left_anti")


def with_resources(questions: DataFrame, references: DataFrame) -> DataFrame:
    """Questions with the array `resources` of their references (question_id, node_id, resource_id, slot, option_id)."""
    one = F.struct("node_id", "resource_id", "slot", "option_id")
    found = references.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("resources"))
    empty = F.array().cast(found.schema["resources"].dataType.simpleString())
    return questions.join(found, "id", "left").withColumn("resources", F.coalesce("resources", empty))


def hydrated(questions: DataFrame, options: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions with arrays of their options (by position) and tags (by name, each with its number of questions)."""
    option = options.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("options"))
    counts = tags.join(bridge.groupBy("tag_id").agg(F.count_distinct("question_id").alias("questions")), "tag_id", "left")
    named = bridge.select("question_id", "tag_id").distinct().join(counts, "tag_id")
    named = named.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "questions"))).alias("tags"))
    out = questions.join(option, "id", "left").join(named, "id", "left")
    empty = [F.array().cast(t.simpleString()) for t in (option.schema["options"].dataType, named.schema["tags"].dataType)]
    return out.withColumns({"options": F.coalesce("options", empty[0]), "tags": F.coalesce("tags", empty[1])})


def with_tags_plain(questions: DataFrame, bridge: DataFrame, tags: DataFrame) -> DataFrame:
    """questions with `tags_plain` made anew: the names of their tags by name, joined by spaces; blank without tags.

    bridge (question_id, tag_id), tags (tag_id, name); repeated rows of the bridge count once, two tags of one name
    twice, and tags without a name not at all.
    """
    named = bridge.select("question_id", "tag_id").distinct().join(tags.select("tag_id", "name"), "tag_id")
    plain = named.groupBy(F.col("question_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("tags_plain"))
    return questions.drop("tags_plain").join(plain, "id", "left").withColumn("tags_plain", F.coalesce("tags_plain", F.lit("")))


def with_names(questions: DataFrame, subjects: DataFrame, chapters: DataFrame, units: DataFrame, types: DataFrame) -> DataFrame:
    """questions (subject_id, chapter_id, unit_id, question_type, ...) with the names of all four.

    subjects (subject_id, name), chapters (chapter_id, name), units (unit_id, name), types (code, name). Questions whose
    subject, chapter or type is not there are left out; an unknown or null unit has no name.
    """
    named = lambda df, key, to: df.select(F.col(key), F.col("name").alias(f"{to}_name"))
    out = questions.join(named(subjects, "subject_id", "subject"), "subject_id").join(named(chapters, "chapter_id", "chapter"), "chapter_id")
    out = out.join(named(units, "unit_id", "unit"), "unit_id", "left")
    return out.join(named(types, "code", "type").withColumnRenamed("code", "question_type"), "question_type")


def summaries(questions: DataFrame) -> DataFrame:
    """questions for lists: stem_json with version, markup and plain text only; answer and explanation blank."""
    html = F.coalesce(F.get_json_object("stem_json", "$.html"), F.lit(""))
    stem = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), html.alias("html"), F.col("stem_plain").alias("plainText")))
    return questions.withColumns({"stem_json": stem, "answer_json": F.lit(""), "explanation_json": F.lit("")})


def stem_summaries(questions: DataFrame, ids: list, most: int = 32) -> DataFrame:
    """(id, stem_plain, stem_html) of those of at most `most` distinct ids that are live."""
    if len(ids) > most or len(set(ids)) != len(ids):
        raise ValueError(f"at most {most} distinct ids")
    found = questions.where(F.col("deleted_at_ms").isNull() & F.col("id").isin(*ids)) if ids else questions.where("false")
    return found.select("id", "stem_plain", F.coalesce(F.get_json_object("stem_json", "$.html"), F.lit("")).alias("stem_html"))


def after_key(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The `size` rows that follow the key `last` (null: the first ones), in order of the key."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)
