"""Multi-party chat formatting: each conversation once for every participant, with that one as the assistant.

DataFrame expressions only. A conversation of at most ROWS turns is gathered whole, in one shuffle, and gives one row for
each participant. Of larger ones every turn gets its number in the order of the conversation, without a task that holds
all of it, and pieces of ROWS consecutive turns are rendered; the pieces of a conversation, one after the other, are the
whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered
from quillbank.llm._cluster import SMALL_TABLE, materialised

ROWS = 4096
CONTEXT = ("system",)
#: What is written for characters of a name that would end it.
_NAME = {"%": "%25", "|": "%7C", "<": "%3C", ">": "%3E", "\n": "%0A"}


def escaped_text(text: Column) -> Column:
    """Text in which no marker can begin: every <| is <|| (and is read back by the opposite)."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def escaped_name(name: Column) -> Column:
    """A name without the characters of markers and line ends, which are percent-encoded."""
    for old, new in _NAME.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def rotate_perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, rows: int = ROWS) -> DataFrame:
    """(conv_id, perspective, piece, n_turns, rendered, mask, masked_chars) of `turns` (conv_id, turn, role, text).

    For every participant (each role of the conversation but those in `context`) the dialogue is rendered with that
    speaker as assistant, every other as user with its name, and context turns as they are. mask has a 1 for each turn
    to learn from, in order, and masked_chars is the number of their characters, as rendered. The order is turn (null
    last), role, text. A conversation of n turns has ceil(n / rows) pieces, numbered from 0; what is rendered of them,
    one after the other, is the dialogue, and so with the masks. Each piece comes for every participant of the whole
    conversation. Context turns are in their own place only. Texts and names are escaped, so none of them can be taken
    for a marker. Repeated rows stay. Null roles are "unknown", null texts empty, null conv_ids one conversation.
    Conversations without participants, and empty tables, give no rows. Other columns are left out.
    """
    clean = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"), F.col("role"), F.col("text"))
    gathered = F.array_sort(F.collect_list(turn)).alias("turns")

    large = clean.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > rows)
    large = materialised(large.select(F.col("conv_id").alias("c"), "n"))
    many = large.count()
    side = F.broadcast(large) if many <= SMALL_TABLE else large
    small = clean.join(side, clean["conv_id"].eqNullSafe(side["c"]), "left_anti") if many else clean
    whole = small.groupBy("conv_id").agg(gathered)
    who = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: ~r.isin(*context)))
    out = whole.select("conv_id", F.lit(0).cast("long").alias("piece"), "turns", F.explode(who).alias("perspective"))
    if many:
        mine = clean.join(side, clean["conv_id"].eqNullSafe(side["c"]))
        # Equal rows are spread by a random last key: which of them is which makes no difference.
        placed = numbered(mine, [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text"), F.rand(7).asc()])
        start = placed.groupBy(F.col("c").alias("c2")).agg(F.min("position").alias("start"))
        start = F.broadcast(start) if many <= SMALL_TABLE else start
        placed = placed.join(start, placed["c"].eqNullSafe(start["c2"]))
        parts = placed.withColumn("piece", F.floor((F.col("position") - F.col("start")) / rows)).groupBy("conv_id", "piece").agg(gathered)
        # Participants meet the numbers of pieces first, so that no task gathers all pieces of a conversation.
        roles = mine.where(~F.col("role").isin(*context)).select("c", F.col("role").alias("perspective")).distinct()
        numbers = side.select(F.col("c").alias("c3"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / rows))).alias("p"))
        wanted = roles.join(numbers, roles["c"].eqNullSafe(numbers["c3"])).select("c", "p", "perspective")
        both = parts.join(wanted, parts["conv_id"].eqNullSafe(wanted["c"]) & (parts["piece"] == wanted["p"]))
        out = out.unionByName(both.select(*out.columns))

    def line(t):
        role = F.when(t["role"].isin(*context), t["role"]).when(t["role"] == F.col("perspective"), "assistant")
        return F.concat(F.lit("<|"), role.otherwise(F.concat(F.lit("user name="), escaped_name(t["role"]))), F.lit("|>\n"), escaped_text(t["text"]), F.lit("<|end|>\n"))

    def learned(t):
        return F.when(t["role"] == F.col("perspective"), 1).otherwise(0)

    return out.select(
        "conv_id",
        "perspective",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", line), "").alias("rendered"),
        F.array_join(F.transform("turns", lambda t: learned(t).cast("string")), "").alias("mask"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + learned(t) * F.length(escaped_text(t["text"]))).alias("masked_chars"),
    )


def op2_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH clean AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, replace(text, '<|', '<||') AS shown,
         replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') AS name,
         (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // 4096 AS piece
  FROM clean),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM clean WHERE role <> 'system')
SELECT c.conv_id, w.perspective, c.piece, count(*) AS n_turns,
       string_agg('<|' || CASE WHEN c.role = 'system' THEN c.role WHEN c.role = w.perspective THEN 'assistant'
                  ELSE 'user name=' || c.name END || '|>' || chr(10) || c.shown || '<|end|>' || chr(10), ''
                  ORDER BY c.turn NULLS LAST, c.role, c.text) AS rendered,
       string_agg(CASE WHEN c.role = w.perspective THEN '1' ELSE '0' END, '' ORDER BY c.turn NULLS LAST, c.role, c.text) AS mask,
       CAST(sum(CASE WHEN c.role = w.perspective THEN length(c.shown) ELSE 0 END) AS BIGINT) AS masked_chars
FROM placed c JOIN who w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
GROUP BY c.conv_id, w.perspective, c.piece
"""
