"""Imported rows: names become ids, answers are brought into one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.functions.text import name_key, nfkc, type_key


def choice_answer(answer: Column, true_false: Column) -> Column:
    """Letters of a choice joined by 、; true and false words in one form; anything else trimmed."""
    plain = F.trim(nfkc(answer))
    letters = F.array_join(F.array_distinct(F.regexp_extract_all(F.upper(plain), F.lit("[A-Z]"), 0)), "、")
    word = F.when(F.rlike(plain, F.lit("(?i)^(?:正确|对|是|√|true)$")), "正确").when(F.rlike(plain, F.lit("(?i)^(?:错误|错|否|×|false)$")), "错误")
    listed = F.rlike(plain, F.lit(r"(?i)^[A-Z\s,，、;；]+$")) & (letters != "")
    return F.coalesce(F.when(true_false, word), F.when(listed, letters), F.trim(answer))


def suggested_behavior(type_name: Column) -> Column:
    """Behaviour that an unknown type's name suggests."""
    key = type_key(type_name)
    out = F.when(F.rlike(key, F.lit("多选|多项")), "multiple_choice").when(F.rlike(key, F.lit("单选|选择")), "single_choice")
    return out.when(F.rlike(key, F.lit("填空")), "fill_blank").when(F.rlike(key, F.lit("判断|正误|是非")), "single_choice").otherwise("open_response")


def resolved(rows: DataFrame, subjects: DataFrame, chapters: DataFrame, units: DataFrame, types: DataFrame, default_subject=None, default_chapter=None, default_unit=None) -> DataFrame:
    """rows (question_type, subject_name, chapter_name, unit_name, options, answer, ...) with ids by name.

    subjects (subject_id, name), chapters (chapter_id, subject_id, name), units (unit_id, chapter_id, name) and types
    (code, name, behavior, default_options) are looked up by key. A blank subject is the default; a blank chapter is the
    default one only under the default subject; a null unit column is the default unit only in the default chapter, a
    blank one is unassigned. Default options fill an empty choice; other types have no options.
    """
    by_name = lambda df, *columns: df.select(*columns, name_key(F.col("name")).alias("__key")).dropDuplicates([*columns[1:], "__key"])
    kinds = types.select("code", "behavior", "default_options", F.explode(F.array_distinct(F.array(type_key(F.col("name")), type_key(F.col("code"))))).alias("__key")).dropDuplicates(["__key"])
    out = rows.withColumn("__key", type_key(F.coalesce("question_type", F.lit("")))).join(kinds, "__key", "left").drop("__key")
    out = out.withColumn("unknown_type", F.when(F.col("code").isNull(), F.coalesce(F.nullif(F.trim("question_type"), F.lit("")), F.lit("未填写题型"))))
    out = out.withColumn("behavior", F.coalesce("behavior", suggested_behavior(F.coalesce("question_type", F.lit("")))))
    out = out.withColumn("__key", name_key(F.coalesce("subject_name", F.lit("")))).join(by_name(subjects, "subject_id"), "__key", "left")
    out = out.withColumn("subject_id", F.when(F.col("__key") == "", F.lit(default_subject)).otherwise(F.col("subject_id")))
    out = out.withColumn("__key", name_key(F.coalesce("chapter_name", F.lit("")))).join(by_name(chapters, "chapter_id", "subject_id"), ["__key", "subject_id"], "left")
    chapter = F.when(F.col("subject_id").eqNullSafe(F.lit(default_subject)), F.lit(default_chapter))
    out = out.withColumn("chapter_id", F.when(F.col("__key") == "", chapter).otherwise(F.col("chapter_id")))
    out = out.withColumn("__key", name_key(F.col("unit_name"))).join(by_name(units, "unit_id", "chapter_id"), ["__key", "chapter_id"], "left").drop("__key")
    unit = F.when(F.col("chapter_id").eqNullSafe(F.lit(default_chapter)), F.lit(default_unit))
    out = out.withColumn("unit_id", F.when(F.col("unit_name").isNull(), unit).otherwise(F.col("unit_id")))
    choice = F.col("behavior").isin("single_choice", "multiple_choice")
    options = F.filter(F.transform("options", lambda x: F.trim(x)), lambda x: x != "")
    options = F.when(F.size(options) > 0, options).otherwise(F.coalesce("default_options", F.array().cast("array<string>")))
    out = out.withColumn("options", F.when(choice, options).otherwise(F.array().cast("array<string>")))
    answer = choice_answer(F.col("answer"), F.col("code").eqNullSafe(F.lit("true_false")))
    return out.withColumn("answer", F.when(choice, answer).otherwise(F.trim("answer"))).withColumn("code", F.coalesce("code", F.lit("short_answer"))).drop("default_options")
