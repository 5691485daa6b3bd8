"""Content of questions replaced as a whole: imported overwrites with receipts, and versions restored from history.

A bank is a dict of tables: questions (id, ..., content_version, updated_at_ms, deleted_at_ms), options (question_id,
position, text), tags (question_id, tag_id), refs (question_id, resource_id), history (question_id, content_version,
saved_at_ms, snapshot), and receipts (operation_id, request_hash, result_json, created_at_ms, completed_at_ms). What
becomes of each operation is decided once, in one table, and all other tables follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import materialised
from quillbank.operators.history import newest, snapshots

MOST_ITEMS = 100
KEPT_VERSIONS = 50
_OWN = ("id", "content_version", "updated_at_ms", "deleted_at_ms")
_LISTS = {"options": ("position", "text"), "tags": ("tag_id",), "refs": ("resource_id",)}


def _content(questions: DataFrame, given: DataFrame) -> list[str]:
    return [c for c in questions.columns if c not in _OWN and c in given.columns]


def content_replaced(bank: dict[str, DataFrame], changes: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """The bank after changes (question_id, content columns, options, tags, refs), which are all to be made.

    options, tags and refs are arrays of texts and ids, in order; a null one is empty. Every question changed is a
    version on, and its new state goes to the history, of which the newest KEPT_VERSIONS of a question stay.
    """
    questions = bank["questions"]
    values = _content(questions, changes)
    new = changes.select(F.col("question_id").alias("id"), *(F.col(c).alias(f"__{c}") for c in values), F.lit(True).alias("__hit"))
    both = questions.join(new, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    made = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in values}
    made |= {"content_version": F.col("content_version") + F.col("__hit").cast("int"), "updated_at_ms": F.when(F.col("__hit"), F.lit(now_ms)).otherwise(F.col("updated_at_ms"))}
    out = dict(bank)
    out["questions"] = both.withColumns({c: x.cast(questions.schema[c].dataType) for c, x in made.items()}).select(*questions.columns)
    touched = changes.select("question_id")
    for name, columns in _LISTS.items():
        old = bank[name]
        rows = changes.select("question_id", F.posexplode(name).alias("position", columns[-1]))
        rows = (rows if name == "options" else rows.drop("position").distinct()).select(*(F.col(c).cast(old.schema[c].dataType) for c in ("question_id", *columns)))
        out[name] = old.select("question_id", *columns).join(touched, "question_id", "left_anti").unionByName(rows)
    only = lambda df, key: df.join(touched.select(F.col("question_id").alias(key)), key, "left_semi")
    written = snapshots(only(out["questions"], "id"), only(out["options"], "question_id"), only(out["tags"], "question_id"))
    version = only(out["questions"], "id").select("id", "content_version")
    fresh = written.join(version, "id").select(F.col("id").alias("question_id"), "content_version", F.lit(now_ms).cast("long").alias("saved_at_ms"), "snapshot")
    kept = newest(only(bank["history"], "question_id").unionByName(fresh), ["question_id"], [F.desc("content_version"), F.desc("saved_at_ms")], KEPT_VERSIONS).drop("place")
    out["history"] = bank["history"].join(touched, "question_id", "left_anti").unionByName(kept)
    return out


def request_hashes(items: DataFrame) -> DataFrame:
    """(operation_id, request_hash) of the items of operations, in order of client_id; the same content, the same hash."""
    text = F.to_json(F.struct(*sorted(c for c in items.columns if c != "operation_id")), {"ignoreNullFields": "false"})
    whole = F.array_join(F.array_sort(F.collect_list(F.sha2(text, 256))), "")
    return items.groupBy("operation_id").agg(F.sha2(whole, 256).alias("request_hash"))


def overwrite_outcomes(bank: dict[str, DataFrame], items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(operation_id, request_hash, outcome) of operations, given by items (operation_id, client_id, question_id, expected_version, ...).

    replay: the same request has a receipt; conflict: the receipt is of another request; invalid: more than `most`
    items, or a client or question named twice or not at all, or a version that is missing or below 1; version: a
    question is gone, in the bin, at another version, or claimed by a valid operation of a smaller id; else applied.
    Operations are bounded by `most`, and those with more are told by counts, so no list of items grows beyond it.
    """
    sized = items.groupBy("operation_id").agg(
        F.count("*").alias("n"), F.count_distinct("client_id").alias("clients"), F.count_distinct("question_id").alias("targets"),
        F.min(F.coalesce(F.col("expected_version") >= 1, F.lit(False))).alias("versions"),
    )
    fine = sized.select("operation_id", ((F.col("n") <= most) & (F.col("clients") == F.col("n")) & (F.col("targets") == F.col("n")) & F.col("versions")).alias("fine"))
    small = items.join(sized.where(F.col("n") <= most).select("operation_id"), "operation_id", "left_semi")
    asked = fine.join(request_hashes(small), "operation_id", "left").join(bank["receipts"].select("operation_id", F.col("request_hash").alias("known")), "operation_id", "left")
    asked = materialised(asked)
    current = bank["questions"].select(F.col("id").alias("question_id"), F.col("content_version").alias("now"), F.col("deleted_at_ms").isNull().alias("live"))
    open_items = small.join(asked.where("fine and known is null").select("operation_id"), "operation_id", "left_semi").select("operation_id", "question_id", "expected_version")
    checked = open_items.join(current, "question_id", "left")
    as_read = F.coalesce(F.col("live") & (F.col("now") == F.col("expected_version")), F.lit(False))
    valid = checked.groupBy("operation_id").agg(F.min(as_read).alias("as_read")).where("as_read")
    claims = open_items.join(valid, "operation_id", "left_semi")
    first = claims.groupBy("question_id").agg(F.min("operation_id").alias("first"))
    won = claims.join(first, "question_id").groupBy("operation_id").agg(F.min(F.col("first") == F.col("operation_id")).alias("won")).where("won")
    out = asked.join(won, "operation_id", "left")
    replay = F.when(F.col("known") == F.col("request_hash"), "replay").otherwise("conflict")
    outcome = F.when(~F.col("fine"), "invalid").when(F.col("known").isNotNull(), replay).when(F.col("won"), "applied").otherwise("version")
    return out.select("operation_id", "request_hash", outcome.alias("outcome"))


def overwritten(bank: dict[str, DataFrame], items: DataFrame, now_ms: int, most: int = MOST_ITEMS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the bank, outcomes) after operations of imported overwrites; an operation is applied as a whole or not at all.

    items: (operation_id, client_id, question_id, expected_version, content columns, options, tags, refs). An applied
    operation leaves a receipt, so that the same call on the new bank changes nothing.
    """
    decided = materialised(overwrite_outcomes(bank, items, most))
    applied = decided.where("outcome = 'applied'")
    changes = materialised(items.join(applied.select("operation_id"), "operation_id", "left_semi"))
    out = content_replaced(bank, changes, now_ms)
    result = F.to_json(F.array_sort(F.collect_list(F.struct("client_id", "question_id", (F.col("expected_version") + 1).alias("content_version")))))
    receipts = changes.groupBy("operation_id").agg(result.alias("result_json")).join(applied, "operation_id")
    stamp = lambda c: F.lit(now_ms).cast("long").alias(c)
    out["receipts"] = bank["receipts"].unionByName(receipts.select("operation_id", "request_hash", "result_json", stamp("created_at_ms"), stamp("completed_at_ms")))
    return out, decided


def restored(bank: dict[str, DataFrame], requests: DataFrame, known_tags: DataFrame, now_ms: int, gone: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the bank, outcomes) after versions (question_id, content_version, expected_version) come back from the history.

    The snapshot is read by the schema of the tables. outcomes: (question_id, outcome, lost): missing if there is no
    such version or no question, version if the question is at another one than expected, lost if tags of the snapshot
    are not among known_tags (tag_id) any more, which are then listed, or if `gone`, a condition on the columns of
    questions, holds for it; else restored, which is a new version. References to files stay as they are. A question is
    restored once; of several requests the one for the latest version counts.
    """
    questions = bank["questions"]
    one = requests.withColumn("__k", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("content_version"), "expected_version"))).where("__k = 1").drop("__k")
    kind = lambda c: bank["tags"].schema["tag_id"].dataType.simpleString() if c == "tags" else "struct<position:int,text:string>"
    shape = "struct<" + ",".join([*(f"{f.name}:{f.dataType.simpleString()}" for f in questions.schema), *(f"{c}:array<{kind(c)}>" for c in ("options", "tags"))]) + ">"
    old = bank["history"].select("question_id", "content_version", F.from_json("snapshot", shape).alias("old"))
    current = questions.select(F.col("id").alias("question_id"), F.col("content_version").alias("now"))
    found = one.join(old, ["question_id", "content_version"], "left").join(current, "question_id", "left")
    tags = found.select("question_id", F.explode("old.tags").alias("tag_id")).join(known_tags.select("tag_id"), "tag_id", "left_anti")
    lost = tags.groupBy("question_id").agg(F.array_sort(F.collect_set("tag_id")).alias("lost"))
    found = found.join(lost, "question_id", "left").withColumn("lost", F.coalesce("lost", F.array().cast(lost.schema["lost"].dataType)))
    values = [c for c in questions.columns if c not in _OWN]
    found = found.select("question_id", "expected_version", "now", "lost", F.col("old").isNotNull().alias("there"), *(F.col(f"old.{c}").alias(c) for c in values), F.col("old.options").alias("__options"), F.col("old.tags").alias("tags"))
    missing = ~F.col("there") | F.col("now").isNull()
    outcome = F.when(missing, "missing").when(~F.col("now").eqNullSafe(F.col("expected_version")), "version").when((F.size("lost") > 0) | F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)), "lost").otherwise("restored")
    found = materialised(found.withColumn("outcome", outcome))
    refs = bank["refs"].groupBy("question_id").agg(F.array_sort(F.collect_set("resource_id")).alias("refs"))
    changes = found.where("outcome = 'restored'").join(refs, "question_id", "left")
    changes = changes.select("question_id", *values, F.transform(F.array_sort("__options"), lambda x: x["text"]).alias("options"), "tags", "refs")
    return content_replaced(bank, materialised(changes), now_ms), found.select("question_id", "outcome", "lost")
