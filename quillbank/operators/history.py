"""Versions, retention, receipts, drafts, edits and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered

SMALL_TABLE = 100_000  # keys that are broadcast; more are joined by shuffle


def newest(df: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """The `keep` newest rows of each key, with their place; what is beyond goes."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= keep)


def beyond_retention(df: DataFrame, key: list[str], order: list[Column], keep: int) -> DataFrame:
    """The rows that newest() leaves out, with their place. A key with most of all rows is not gathered in one task."""
    placed = numbered(df, [*(F.asc_nulls_first(k) for k in key), *order], "__position")
    start = placed.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.min("__position").alias("__start"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = placed.join(F.broadcast(start) if start.count() <= SMALL_TABLE else start, same)
    return out.withColumn("place", (F.col("__position") - F.col("__start") + 1).cast("int")).where(F.col("place") > keep).select(*df.columns, "place")


def latest(df: DataFrame, key: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """For each key the given columns of its last row in the order of `by`; pre-aggregated in each task."""
    last = F.max_by(F.struct(*columns), F.struct(*by)).alias("last")
    return df.groupBy(*key).agg(last).select(*key, *(F.col(f"last.{c}").alias(c) for c in columns))


def stale_drafts(drafts: DataFrame, current: DataFrame) -> DataFrame:
    """drafts (draft_id, kind, target_id, base_version) with `stale`: an edit whose target is gone or another version."""
    out = drafts.join(current.select(F.col("id").alias("target_id"), "content_version"), "target_id", "left")
    stale = (F.col("kind") == "question_edit") & ~F.coalesce(F.col("base_version") == F.col("content_version"), F.lit(False))
    return out.withColumn("stale", stale)


def upserted(table: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """table after creates and updates: changes (id, expected_version, ...) replace rows of that version.

    A change whose row has another version is not applied; conflicts() has it. Created rows start at version 1.
    """
    values = [c for c in table.columns if c not in ("id", "content_version", "updated_at_ms") and c in changes.columns]
    new = changes.select("id", "expected_version", *(F.col(c).alias(f"__{c}") for c in values))
    both = table.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), "id", "full_outer")
    created = F.col("__old").isNull()
    applied = F.coalesce(F.col("__new"), F.lit(False)) & (created | F.coalesce(F.col("content_version") == F.col("expected_version"), F.lit(False)))
    out = both.where(~created | F.col("expected_version").isNull())
    out = out.withColumns({c: F.when(applied, F.col(f"__{c}")).otherwise(F.col(c)) for c in values})
    out = out.withColumn("updated_at_ms", F.when(applied, F.lit(now_ms)).otherwise(F.col("updated_at_ms")))
    version = F.when(applied, F.coalesce(F.col("content_version"), F.lit(0)) + 1).otherwise(F.col("content_version"))
    return out.withColumn("content_version", version.cast(table.schema["content_version"].dataType)).select(*table.columns)


def conflicts(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose expected version is not the row's, or that update a row that is not there."""
    found = changes.join(table.select("id", F.col("content_version").alias("found_version")), "id", "left")
    return found.where(~F.col("expected_version").eqNullSafe(F.col("found_version")))


def split_replays(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """requests (operation_id, request_hash) with `outcome`: new, replay (same hash on record) or conflict (another)."""
    known = receipts.select("operation_id", F.col("request_hash").alias("known_hash"))
    out = requests.join(known, "operation_id", "left")
    outcome = F.when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") == F.col("request_hash"), "replay").otherwise("conflict")
    return out.withColumn("outcome", outcome).drop("known_hash")


def overwrite_plan(items: DataFrame) -> DataFrame:
    """(target_id, signatures, representative, duplicates, conflict) of items (target_id, ordinal, signature).

    One signature for a target: its first item stands for all; several: a conflict.
    """
    out = items.groupBy("target_id").agg(F.count_distinct("signature").alias("signatures"), F.min("ordinal").alias("representative"), F.count("*").alias("n"))
    return out.select("target_id", "signatures", "representative", (F.col("n") - 1).alias("duplicates"), (F.col("signatures") > 1).alias("conflict"))


def edited_tags(current: Column, given: Column, mode: str) -> Column:
    """Tag arrays after an edit: keep, append, replace or remove."""
    if mode not in ("keep", "append", "replace", "remove"):
        raise ValueError(f"unknown mode {mode!r}")
    made = {"keep": current, "append": F.array_union(current, given), "replace": F.array_distinct(given), "remove": F.array_except(current, given)}
    return F.array_sort(made[mode])


def orphans(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str], rule: str) -> DataFrame:
    """(rule, violations): how many rows of child have no parent."""
    p = parent.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(parent_key))).distinct()
    on = [child[c] == p[f"__{i}"] for i, c in enumerate(child_key)]
    return child.join(p, on, "left_anti").agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))


def repeated(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    """(rule, violations): how many values of a key that should be unique are not."""
    several = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return several.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))


def snapshots(questions: DataFrame, options: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, snapshot): each question (id, ...) as one JSON document, with its options by position and its tags in order."""
    option = options.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*(c for c in options.columns if c != "question_id")))).alias("options"))
    tags = bridge.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    out = questions.join(option, "id", "left").join(tags, "id", "left")
    none = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c, df in (("options", option), ("tags", tags))}
    return out.withColumns(none).select("id", F.to_json(F.struct(*questions.columns, "options", "tags")).alias("snapshot"))


def undo_counts(batches: DataFrame) -> DataFrame:
    """(batch, items): the number of items in the JSON arrays of undo_json; what is no array counts as none."""
    return batches.groupBy("batch").agg(F.sum(F.coalesce(F.json_array_length("undo_json"), F.lit(0))).cast("long").alias("items"))


def pending_total(*kinds: DataFrame) -> DataFrame:
    """One row: the number of all drafts of several kinds."""
    out = None
    for df in kinds:
        n = df.agg(F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out.agg(F.sum("n").alias("pending"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not among the done ones."""
    return items.join(done.select(key), key, "left_anti")


def recent(batches: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """The `most` latest batches (batch_id, created_at_ms) with their numbers of items (batch_id); ties to the larger id."""
    found = batches.orderBy(F.desc_nulls_last("created_at_ms"), F.desc("batch_id")).limit(most)
    counts = items.groupBy("batch_id").agg(F.count("*").alias("items"))
    return found.join(counts, "batch_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def drafts_saved(drafts: DataFrame, saves: DataFrame, questions: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(drafts, outcomes) after autosaves: of several saves (draft_key, kind, target_id, base_version, payload, ordinal) of
    a key the last counts.

    drafts: (draft_key, kind, target_id, base_version, payload, created_at_ms, updated_at_ms), one for a key. A save
    replaces the draft of its key, which keeps its time of creation, or makes a new one. outcomes (draft_key, outcome):
    `other kind` if the key has a draft of another kind; `no target` if an edit names no question (id) that is there;
    `extra target` if another kind names one; else `saved`. A stale base version is saved, as stale_drafts() tells it.
    """
    last = latest(saves, ["draft_key"], ["ordinal"], ["kind", "target_id", "base_version", "payload"])
    old = drafts.select("draft_key", F.col("kind").alias("__kind"), F.col("created_at_ms").alias("__created"))
    there = questions.select(F.col("id").alias("target_id"), F.lit(True).alias("__there")).distinct()
    decided = last.join(old, "draft_key", "left").join(there, "target_id", "left")
    edits = F.col("kind") == "question_edit"
    outcome = F.when(F.col("__kind") != F.col("kind"), "other kind").when(edits & F.col("__there").isNull(), "no target").when(~edits & F.col("target_id").isNotNull(), "extra target").otherwise("saved")
    decided = decided.withColumn("outcome", outcome)
    stamp = F.lit(now_ms).cast("long")
    new = decided.where("outcome = 'saved'").withColumns({"created_at_ms": F.coalesce("__created", stamp), "updated_at_ms": stamp})
    kept = drafts.join(new.select("draft_key"), "draft_key", "left_anti").select(*drafts.columns)
    return kept.unionByName(new.select(*(F.col(c).cast(drafts.schema[c].dataType) for c in drafts.columns))), decided.select("draft_key", "outcome")
