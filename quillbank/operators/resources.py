"""Stored files by content, their references, and backups that are due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def stored(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Files to add (sha256, path, content, byte_size, mime_type): one for each content that `existing` (sha256) has not.

    incoming (content binary, mime_type). Contents are hashed before the shuffle, which the hash alone decides; of equal
    contents one stays.
    """
    hashed = incoming.where("content is not null").withColumn("sha256", F.sha2("content", 256))
    new = hashed.join(existing.select("sha256").distinct(), "sha256", "left_anti")
    one = new.groupBy("sha256").agg(F.min_by(F.struct("content", "mime_type"), F.coalesce("mime_type", F.lit(""))).alias("x"))
    path = F.concat(F.lit("images/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"))
    return one.select("sha256", path.alias("path"), F.col("x.content").alias("content"), F.octet_length("x.content").cast("long").alias("byte_size"), F.col("x.mime_type").alias("mime_type"))


def reference_changes(recorded: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(*key, change): references that contents hold but are not recorded (`add`), and the reverse (`remove`)."""
    r, a = recorded.select(*key).distinct(), actual.select(*key).distinct()
    return a.join(r, key, "left_anti").withColumn("change", F.lit("add")).unionByName(r.join(a, key, "left_anti").withColumn("change", F.lit("remove")))


def resource_ids(references: DataFrame) -> DataFrame:
    """(question_id, resource_id, uses): the resources of each question once, with how often it shows them.

    references (question_id, resource_id); those without a question or resource are left out.
    """
    return references.where("question_id is not null and resource_id is not null").groupBy("question_id", "resource_id").agg(F.count("*").alias("uses"))


def inconsistencies(references: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource_id, problem): referenced but `missing`, there but not `ready`, or `unreferenced`."""
    used = references.select("resource_id").distinct().withColumn("__used", F.lit(True))
    there = resources.select(F.col("id").alias("resource_id"), "availability_status").withColumn("__there", F.lit(True))
    both = used.join(there, "resource_id", "full_outer")
    problem = F.when(F.col("__there").isNull(), "missing").when(F.col("__used").isNull(), "unreferenced").when(~F.col("availability_status").eqNullSafe(F.lit("ready")), "not ready")
    return both.select("resource_id", problem.alias("problem")).where("problem is not null")


def backups_due(settings: DataFrame, records: DataFrame, now_ms: int) -> DataFrame:
    """settings (scope, interval_days) with last_ms, next_due_ms and whether a backup is due: records (scope, backup_kind, status, completed_at_ms).

    Only completed automatic backups count; without one a backup is due at once. An interval below one day counts as one.
    """
    last = records.where("backup_kind = 'automatic' and status = 'completed'").groupBy("scope").agg(F.max("completed_at_ms").alias("last_ms"))
    out = settings.join(last, "scope", "left")
    due = F.coalesce(F.col("last_ms") + F.greatest(F.col("interval_days"), F.lit(1)) * DAY_MS, F.lit(now_ms)).cast("long")
    return out.withColumn("next_due_ms", due).withColumn("due", F.col("next_due_ms") <= now_ms)


def summary(questions: DataFrame, papers: DataFrame, resources: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row: live questions, saved papers, ready resources, and templates where they are given."""
    live = questions.agg(F.count_if(F.col("deleted_at_ms").isNull()).alias("live_questions"))
    saved = papers.agg(F.count_if(F.col("paper_status") == "saved").alias("saved_papers"))
    ready = resources.agg(F.count_if(F.col("availability_status") == "ready").alias("ready_resources"))
    out = live.crossJoin(saved).crossJoin(ready)
    return out if templates is None else out.crossJoin(templates.agg(F.count("*").alias("templates")))


def audit_rows(changes: DataFrame, action: str, entity_type: str, now_ms: int) -> DataFrame:
    """Log rows for changes (entity_id, summary); ids are digests, so that a rerun logs the same."""
    key = F.sha2(F.concat_ws("\u001f", F.lit(action), F.lit(entity_type), F.col("entity_id").cast("string"), F.lit(str(now_ms))), 256)
    return changes.select(key.alias("id"), F.lit(now_ms).cast("long").alias("occurred_at_ms"), F.lit("info").alias("level"), F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), F.col("entity_id").cast("string").alias("entity_id"), F.lit("succeeded").alias("outcome"), "summary")
