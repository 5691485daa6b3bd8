"""The report of a duplicate scan: groups of equal and of similar questions that touch a scope, in its fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbank.functions.tables import materialised, numbered
from quillbank.functions.text import stem_preview
from quillbank.operators.dedup import SUSPECTED, WINDOW, near_pairs, without_ignored

SCOPE_MOST = 5000
FINGERPRINT_VERSION = 2


class ScopeTooLarge(ValueError):
    """A scan of more questions than the caller allows."""


def comparable_fingerprint(fingerprint: Column, version: Column, comparable: Column, id_: Column) -> Column:
    """The fingerprint where it is of the present version and may be compared, else a stand-in that no other row has.

    A null fingerprint, version or mark counts as not comparable.
    """
    sound = fingerprint.isNotNull() & (version == FINGERPRINT_VERSION) & F.coalesce(comparable, F.lit(False))
    return F.when(sound, F.concat(F.lit("f:"), fingerprint)).otherwise(F.concat(F.lit("id:"), id_.cast("string")))


def exact_report(questions: DataFrame) -> DataFrame:
    """(group_id, kind, similarity, member) of questions (id, created, print, in_scope): groups of one print with a row in scope.

    A group is named after its first member by created, id. It has a row for each member; groups are pre-aggregated and
    never gathered.
    """
    groups = questions.groupBy("print").agg(F.count("*").alias("n"), F.max("in_scope").alias("touched"), F.min(F.struct("created", "id"))["id"].alias("first"))
    groups = groups.where("n > 1 and touched").select("print", F.concat(F.lit("exact:"), F.col("first").cast("string")).alias("group_id"))
    found = questions.select("print", F.col("id").alias("member")).join(groups, "print")
    return found.select("group_id", F.lit("exact").alias("kind"), F.lit(100).alias("similarity"), "member")


def suspected_report(questions: DataFrame, ignores: DataFrame, window: int = WINDOW, least: int = SUSPECTED) -> DataFrame:
    """(group_id, kind, similarity, member): the two rows of each pair of near_pairs() that is not ignored at its versions.

    ignores (left_id, right_id, left_version, right_version), the smaller id left.
    """
    near = near_pairs(questions.withColumnRenamed("print", "fingerprint"), F.col("in_scope"), window, least)
    pairs = without_ignored(near, questions, ignores)
    name = F.concat_ws(":", F.lit("suspected"), F.col("left_id").cast("string"), F.col("right_id").cast("string"))
    return pairs.select(name.alias("group_id"), F.lit("suspected").alias("kind"), "similarity", F.explode(F.array("left_id", "right_id")).alias("member"))


def scan_report(questions: DataFrame, scope: Column, ignores: DataFrame, most: int | None = SCOPE_MOST, window: int = WINDOW, least: int = SUSPECTED) -> DataFrame:
    """(place, group_id, kind, similarity, member_place, member, stem_preview, content_version) of a scan of the bank.

    questions (id, text, stem, length, created, updated, content_version, fingerprint, fingerprint_version, comparable,
    and what `scope` needs), live rows with distinct ids that are not null; a scope that is null does not hold. Exact
    groups come first, by group_id, then suspected pairs, the most similar first, then by group_id; `place` numbers
    groups and `member_place` their members, by created and id, both from 0. Groups count if one of their members is in
    scope. A scope of more than `most` rows is refused (None: never). An empty bank or scope gives no rows. Places are
    numbers of total orders that no single task holds, so a group may be of any size.
    """
    wanted = ("id", "text", "stem", "length", "created", "updated", "content_version")
    print_ = comparable_fingerprint(F.col("fingerprint"), F.col("fingerprint_version"), F.col("comparable"), F.col("id"))
    rows = questions.select(*wanted, print_.alias("print"), F.coalesce(scope, F.lit(False)).alias("in_scope"))
    if most is not None and rows.where("in_scope").limit(most + 1).count() > most:
        raise ScopeTooLarge(f"a scan takes at most {most} questions")
    groups = materialised(exact_report(rows).unionByName(suspected_report(rows, ignores, window, least)))
    about = rows.select(F.col("id").alias("member"), "created", stem_preview(F.col("stem")).alias("stem_preview"), "content_version")
    order = [F.asc("kind"), F.desc("similarity"), F.asc("group_id")]
    members = numbered(groups.join(about, "member"), [*order, F.asc("created"), F.asc("member")], "at")
    firsts = members.groupBy("kind", "similarity", "group_id").agg(F.min("at").alias("first"))
    firsts = numbered(firsts, order, "place").select("group_id", "first", "place")
    out = members.join(firsts, "group_id").withColumn("member_place", F.col("at") - F.col("first"))
    return out.select("place", "group_id", "kind", "similarity", "member_place", "member", "stem_preview", "content_version")
