"""Changes to the bank: rules, batch edits with undo, the bin, taxonomy order and guards, types, filters, papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.text import type_key
from quillbank.operators.history import edited_tags

MOST_OPTIONS, MOST_TAGS, MOST_BYTES = 26, 100, 12 << 20
STEP = 1024


def rule_violations(behavior: Column, options: Column, tags: Column, content_bytes: Column) -> Column:
    """Names of the rules that a question breaks, in a fixed order; null arrays count as empty."""
    none = F.array().cast("array<string>")
    options, tags = F.coalesce(options, none), F.coalesce(tags, none)
    filled = F.size(F.filter(options, lambda x: F.trim(x) != ""))
    choice = F.coalesce(behavior.isin("single_choice", "multiple_choice"), F.lit(False))
    rules = {
        "too many options": F.size(options) > MOST_OPTIONS,
        "too few options": choice & (filled < 2),
        "empty option": choice & (filled < F.size(options)),
        "options of no choice": ~choice & (F.size(options) > 0),
        "too many tags": F.size(tags) > MOST_TAGS,
        "repeated tag": F.size(F.array_distinct(tags)) < F.size(tags),
        "too large": F.coalesce(content_bytes, F.lit(0)) > MOST_BYTES,
    }
    return F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())


def batch_edited(questions: DataFrame, edits: DataFrame, tag_mode: str, now_ms: int, reset_usage: bool = False) -> DataFrame:
    """questions (id, tags, chapter_id, last_used_at_ms, content_version, updated_at_ms, deleted_at_ms, ...) after edits.

    edits (id, expected_version, tags, chapter_id): a null chapter keeps the old one. Rows of another version or in the
    bin do not change; edit_conflicts() has them, and an edit is all or nothing if that is empty first.
    """
    e = edits.select("id", F.col("expected_version").alias("__v"), F.col("tags").alias("__tags"), F.col("chapter_id").alias("__chapter"))
    out = questions.join(e, "id", "left")
    hit = F.coalesce((F.col("__v") == F.col("content_version")) & F.col("deleted_at_ms").isNull(), F.lit(False))
    none = F.array().cast(questions.schema["tags"].dataType)
    changed = {
        "tags": edited_tags(F.coalesce("tags", none), F.coalesce("__tags", none), tag_mode),
        "chapter_id": F.coalesce("__chapter", "chapter_id"),
        "last_used_at_ms": F.lit(None).cast("long") if reset_usage else F.col("last_used_at_ms"),
        "updated_at_ms": F.lit(now_ms).cast("long"),
        "content_version": F.col("content_version") + 1,
    }
    kinds = {c: questions.schema[c].dataType.simpleString() for c in changed}
    return out.withColumn("__hit", hit).withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c)).cast(kinds[c]) for c, x in changed.items()}).select(*questions.columns)


def edit_conflicts(questions: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id, expected_version, ...) with `reason`: missing, in the bin, another version."""
    found = edits.join(questions.select("id", "content_version", "deleted_at_ms", F.lit(True).alias("__there")), "id", "left")
    reason = F.when(F.col("__there").isNull(), "missing").when(F.col("deleted_at_ms").isNotNull(), "in the bin").when(~F.col("expected_version").eqNullSafe(F.col("content_version")), "another version")
    return found.withColumn("reason", reason).where("reason is not null").select(*edits.columns, "reason")


def undo_rows(questions: DataFrame, edits: DataFrame, batch_id: str) -> DataFrame:
    """What undone() needs: the rows before the edit, with the version that they have after it."""
    before = F.to_json(F.struct("tags", "chapter_id", "last_used_at_ms"))
    return questions.join(edits.select("id"), "id", "left_semi").select(F.lit(batch_id).alias("batch_id"), "id", (F.col("content_version") + 1).alias("version_after"), before.alias("before"))


def undone(questions: DataFrame, undo: DataFrame, now_ms: int) -> DataFrame:
    """questions after an edit is taken back, where nothing has changed since; that too is a new version."""
    shape = ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in ("tags", "chapter_id", "last_used_at_ms"))
    out = questions.join(undo.select("id", "version_after", F.from_json("before", shape).alias("__b")), "id", "left")
    hit = F.coalesce(F.col("version_after") == F.col("content_version"), F.lit(False))
    changed = {c: F.col(f"__b.{c}") for c in ("tags", "chapter_id", "last_used_at_ms")} | {"updated_at_ms": F.lit(now_ms).cast("long"), "content_version": F.col("content_version") + 1}
    return out.withColumn("__hit", hit).withColumns({c: F.when(F.col("__hit"), x).otherwise(F.col(c)).cast(questions.schema[c].dataType.simpleString()) for c, x in changed.items()}).select(*questions.columns)


def binned(questions: DataFrame, ids: DataFrame, now_ms: int | None) -> DataFrame:
    """questions after live ones of ids (id) went into the bin, or came back from it if now_ms is None."""
    out = questions.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    moves = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("deleted_at_ms").isNull() if now_ms is not None else F.col("deleted_at_ms").isNotNull())
    return out.withColumn("deleted_at_ms", F.when(moves, F.lit(now_ms)).otherwise(F.col("deleted_at_ms")).cast("long")).select(*questions.columns)


def purged(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """questions without those of ids (id) that are in the bin; live ones stay."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    out = questions.join(gone, "id", "left")
    return out.where(F.col("__gone").isNull() | F.col("deleted_at_ms").isNull()).select(*questions.columns)


def reordered(rows: DataFrame, requested: DataFrame, parent: str) -> DataFrame:
    """rows (id, parent, sort_order) in the requested order (id, ordinal): steps of STEP, from the first.

    A parent whose requested ids are not exactly its own keeps its order; order_mismatches() has them.
    """
    bad = order_mismatches(rows, requested, parent).select(parent).distinct()
    asked = requested.join(rows.select("id", parent), "id").join(bad, parent, "left_anti")
    place = F.row_number().over(Window.partitionBy(parent).orderBy("ordinal", "id"))
    out = rows.join(asked.select("id", (place * STEP).alias("__order")), "id", "left")
    return out.withColumn("sort_order", F.coalesce("__order", "sort_order").cast("long")).drop("__order").select(*rows.columns)


def order_mismatches(rows: DataFrame, requested: DataFrame, parent: str) -> DataFrame:
    """(parent, id, problem) of an order that names only some of a parent's rows, a row twice, or rows that are not there."""
    asked = requested.groupBy("id").agg(F.count("*").alias("n"))
    both = rows.select("id", parent).withColumn("__there", F.lit(True)).join(asked, "id", "full_outer")
    named = both.where("n is not null and __there").select(parent).distinct()
    problem = F.when(F.col("__there").isNull(), "unknown").when(F.col("n").isNull(), "left out").when(F.col("n") > 1, "twice")
    marked = both.withColumn("problem", problem).where("problem is not null")
    return marked.where("problem <> 'left out'").unionByName(marked.where("problem = 'left out'").join(named, parent, "left_semi")).select(parent, "id", "problem")


def next_positions(parents: DataFrame, children: DataFrame, key: str, step: int = STEP) -> DataFrame:
    """(key, position) at which each parent's next child goes: a step past the last, or the first step."""
    last = children.groupBy(key).agg(F.max("sort_order").alias("last"))
    return parents.select(key).join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + step).cast("long").alias("position"))


def delete_guards(rows: DataFrame, key: str, uses: dict[str, DataFrame]) -> DataFrame:
    """(key, one count for each use, deletable): how many rows of each use (key) there are."""
    out = rows.select(key)
    for name, df in uses.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    free = F.lit(True)
    for name in uses:
        free = free & (F.col(name) == 0)
    return out.withColumn("deletable", free)


def taken_names(types: DataFrame, aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names (code, name) that a name or alias (code, name) of another type has already."""
    keyed = lambda df: df.select(F.col("code").alias("taken_by"), type_key(F.col("name")).alias("__key"))
    known = keyed(types).unionByName(keyed(aliases)).dropDuplicates()
    hits = wanted.withColumn("__key", type_key(F.col("name"))).join(known, "__key").where("taken_by <> code")
    return hits.groupBy("code", "name").agg(F.min("taken_by").alias("taken_by"))


def same_names(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names (id, name) that another row (id, name) has already, capitals and small letters alike; taken_by is the least such id."""
    known = rows.select(F.col("id").alias("taken_by"), F.col("name").alias("__name"))
    hits = wanted.join(known, F.collate(F.trim("name"), "UTF8_LCASE") == F.collate(F.trim("__name"), "UTF8_LCASE")).where(~F.col("id").eqNullSafe(F.col("taken_by")))
    return hits.groupBy("id", "name").agg(F.min("taken_by").alias("taken_by"))


def saved_filters(existing: DataFrame, given: DataFrame, most: int = 100) -> DataFrame:
    """Filters (name, definition, updated_at_ms) after an upsert by name; only the newest `most` stay, as the report is."""
    both = existing.select("name", "definition", "updated_at_ms", F.lit(0).alias("__new")).unionByName(given.select("name", "definition", "updated_at_ms", F.lit(1).alias("__new")))
    latest = both.groupBy("name").agg(F.max_by(F.struct("definition", "updated_at_ms"), F.struct("__new", "updated_at_ms")).alias("x"))
    return latest.select("name", "x.*").orderBy(F.desc("updated_at_ms"), "name").limit(most)


def template_catalogue(templates: DataFrame, settings: DataFrame) -> DataFrame:
    """templates (template_id, ...) with is_default by the one row of settings (default_template_id)."""
    one = settings.agg(F.first("default_template_id", ignorenulls=True).alias("__default"))
    out = templates.crossJoin(F.broadcast(one))
    return out.withColumn("is_default", F.col("template_id").eqNullSafe(F.col("__default"))).drop("__default")


def reordered_within_type(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items (paper_id, item_id, question_type, position) with the wanted order (item_id, ordinal) inside each type.

    Each type keeps the places that it has; items that are not named come after the named ones, as before.
    """
    group = Window.partitionBy("paper_id", "question_type")
    out = items.join(wanted, "item_id", "left")
    out = out.withColumn("__slot", F.row_number().over(group.orderBy("position", "item_id"))).withColumn("__turn", F.row_number().over(group.orderBy(F.asc_nulls_last("ordinal"), "position", "item_id")))
    slots = out.select("paper_id", "question_type", F.col("__slot").alias("__turn"), F.col("position").alias("new_position"))
    return out.withColumnRenamed("__slot", "__at").join(slots, ["paper_id", "question_type", "__turn"]).select(*items.columns, "new_position")


def copied_paper(papers: DataFrame, items: DataFrame, paper_id, new_id: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The rows of a paper and its items under a new id, as an unsaved draft; item ids are digests of new and old ids."""
    paper = papers.where(F.col("id") == F.lit(paper_id)).withColumns({"id": F.lit(new_id), "paper_status": F.lit("draft"), "row_version": F.lit(1), "created_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms), "saved_at_ms": F.lit(None)})
    paper = paper.select(*(F.col(c).cast(papers.schema[c].dataType) for c in papers.columns))
    item = items.where(F.col("paper_id") == F.lit(paper_id)).withColumns({"id": F.substring(F.sha2(F.concat_ws("/", F.lit(new_id), F.col("id").cast("string")), 256), 1, 32), "paper_id": F.lit(new_id)})
    return paper, item.select(*(F.col(c) for c in items.columns))


def page_faults(pages: DataFrame) -> DataFrame:
    """Faults in pages read one by one (page, total, id): totals that differ, ids that came twice, rows that are missing."""
    one = pages.agg(F.min("total").alias("low"), F.max("total").alias("high"), F.count("id").alias("n"), F.count_distinct("id").alias("ids"))
    fault = F.filter(F.array(F.when(F.col("low") != F.col("high"), "total changed"), F.when(F.col("ids") < F.col("n"), "repeated id"), F.when(F.col("ids") < F.col("high"), "missing rows")), lambda x: x.isNotNull())
    return one.select(F.explode(fault).alias("fault"))


def merged_counters(counters: Column, into: str, retired: list[str]) -> Column:
    """A map of counts in which the retired keys are added to one; a count of nothing is 0."""
    total = F.lit(0)
    for key in (into, *retired):
        total = total + F.coalesce(F.try_element_at(counters, F.lit(key)), F.lit(0))
    rest = F.map_filter(counters, lambda k, v: ~k.isin(into, *retired))
    return F.map_concat(rest, F.create_map(F.lit(into), total.cast("long")))
