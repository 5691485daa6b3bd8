"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

The words of a source are dealt to shards of bounded size (a large source has many), and a shard is cut into blocks of
`block` words, its documents in a seeded order. Each source has a target number of words; blocks are awarded by highest
quotients target / (2 k + 1), first to the sources and then, by their sizes, to the shards of each. A shard takes all its
blocks as often as its quota holds them, and then a run of them from a seeded place on (round its end), so that few
documents are cut. What a document gives follows from its place in the shard in closed form, so there is one shuffle of
(doc_id, size) and no text moves. A source of fewer than FINE blocks has its quota settled in blocks of a FINE-th.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered
from quillbank.llm._cluster import materialised

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD_WORDS = 1 << 20
SHARD_ROWS = 1 << 17
FINE = 64
SEED = 17
SMALL_TABLE = 100_000  # rows (of a few numbers and a name) that are broadcast; more are joined by shuffle
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words wanted of each source: all sizes together shared by weights (repeated in turn), none above most * size.

    What is above goes to the others by their weights, until none is above.
    """
    total = sum(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: most * sizes[i] / weight[i])
    out, left, open_weight = [0.0] * len(sizes), float(total), sum(weight[i] for i in order)
    for at, i in enumerate(order):
        if left * weight[i] <= most * sizes[i] * open_weight:
            for j in order[at:]:
                out[j] = left * weight[j] / open_weight
            break
        out[i] = float(most * sizes[i])
        left, open_weight = left - out[i], open_weight - weight[i]
    return out


def sainte_lague(wanted: list[float], seats: int) -> list[int]:
    """Seats by the `seats` highest quotients wanted / (2 k + 1), k = 0, 1, ...; ties to the first.

    A divisor is searched for at which all but a few seats are awarded; those few go one by one.
    """
    if seats <= 0 or not any(x > 0 for x in wanted):
        return [0] * len(wanted)
    given = lambda d: [max(0, math.ceil((x / d - 1) / 2)) if x > 0 else 0 for x in wanted]  # noqa: E731  quotients above d
    low, high = 0.0, max(wanted) * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(given(middle)) > seats:
            low = middle
        else:
            high = middle
    out = given(high)
    left = seats - sum(out)
    if left > 0:
        next_ones = [(-x / (2 * n + 1), i) for i, (x, n) in enumerate(zip(wanted, out, strict=True)) if x > 0]
        heapq.heapify(next_ones)
        for _ in range(left):
            i = next_ones[0][1]
            out[i] += 1
            heapq.heapreplace(next_ones, (-wanted[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(shards: DataFrame) -> DataFrame:
    """shards (source, shard, words, quota) with `seats`: the source's quota dealt to its shards by highest quotients.

    A shard's seats differ from its share of the quota by at most half a seat for each shard, times its share of the
    words; so only quotients near there are looked at, about five for each shard, and numbered in the order of all
    without a task that holds them. Ties go to the smaller shard. Shards without words get none.
    """
    whole = shards.groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("all"), F.count_if(F.col("words") > 0).alias("n"))
    known = shards.join(whole, shards["source"].eqNullSafe(whole["s"])).drop("s").where("words > 0")
    share = F.col("words") / F.col("all")
    middle, margin = F.floor(share * F.col("quota")), F.ceil(share * F.col("n") / 2) + 2
    known = materialised(known.withColumns({"low": F.greatest(F.lit(0).cast("long"), middle - margin), "high": middle + margin + 1}).drop("all", "n"))
    open_ = known.groupBy(F.col("source").alias("s")).agg((F.first("quota") - F.sum("low")).alias("left"))
    tried = known.select("source", "shard", "words", F.explode(F.sequence("low", "high")).alias("k"))
    tried = tried.withColumn("quotient", F.col("words") / (2 * F.col("k") + 1))
    placed = numbered(tried, [F.asc_nulls_last("source"), F.desc("quotient"), F.asc("shard"), F.asc("k")])
    start = placed.groupBy(F.col("source").alias("s")).agg(F.min("position").alias("start"))
    open_ = open_.join(start.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    won = placed.join(open_, placed["source"].eqNullSafe(open_["s"])).where(F.col("position") - F.col("start") < F.col("left"))
    won = won.groupBy(F.col("source").alias("s"), F.col("shard").alias("h")).agg(F.count("*").alias("more"))
    low = known.select(F.col("source").alias("s1"), F.col("shard").alias("h1"), "low")
    out = shards.join(low, shards["source"].eqNullSafe(low["s1"]) & (shards["shard"] == low["h1"]), "left").drop("s1", "h1")
    out = out.join(won, out["source"].eqNullSafe(won["s"]) & (out["shard"] == won["h"]), "left").drop("s", "h")
    return out.withColumn("seats", F.coalesce("low", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("low", "more")


def _units(taken_blocks: Column, blocks: Column, phase: Column, at: Column) -> Column:
    """How many of the first `at` blocks are chosen, if the run of taken_blocks from the block `phase` on is, round the end."""
    over = F.greatest(F.lit(0).cast("long"), phase + taken_blocks - blocks)
    return F.least(at, over) + F.least(F.greatest(at - phase, F.lit(0).cast("long")), taken_blocks - over)


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, full, begin, blocks, chosen, phase) for each row of `docs`.

    taken is the number of words that the mix takes of the row, repeats counted: `full` times all of it, and the words
    whose place (begin, begin + 1, ... in its shard) lies in a chosen block. It is at most most * size. Null texts have
    size 0. A null source is the last source. Rows that repeat a doc_id count each. Columns other than doc_id, source
    and text are left out but for those in `carry`. Sources, of which there is one row each, are apportioned on the
    driver, and their shards in Spark. Rows of size 0 take nothing and are in no shard (begin and the like are 0).
    """
    spark = docs.sparkSession
    extra = [F.col(x) for x in carry]
    sized = materialised(docs.select(*extra, F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("print")))
    sums = {r["source"]: (r["n"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count_if(F.col("size") > 0).alias("rows")).collect()}
    names = sorted((x for x in sums if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sums)
    wanted = targets([sums[x][0] for x in names], weights, most)
    quotas = sainte_lague(wanted, round(sum(wanted) / block))
    about = []
    for x, t, q in zip(names, wanted, quotas, strict=True):
        words, rows = sums[x]
        own = block if words >= FINE * block else max(1, words // FINE)
        about.append((x, words, t, q if own == block else round(t / own), own, max(1, -(-words // SHARD_WORDS), -(-rows // SHARD_ROWS))))
    about = spark.createDataFrame(about, "source string, source_size long, target double, quota long, block long, shards long")
    few = F.broadcast if len(names) <= SMALL_TABLE else lambda df: df
    sized = sized.join(few(about), sized["source"].eqNullSafe(about["source"])).drop(about["source"])
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "print"), F.col("shards")).cast("int"))
    empty, sized = sized.where("size = 0"), sized.where("size > 0")

    plan = shard_quotas(sized.groupBy("source", "shard", "quota", "block").agg(F.sum("size").alias("words")))
    take = F.least(F.col("seats") * F.col("block"), most * F.col("words"))
    plan = plan.withColumns({"full": F.floor(take / F.col("words")), "blocks": F.ceil(F.col("words") / F.col("block"))})
    rest = F.round((take - F.col("full") * F.col("words")) / F.col("block")).cast("long")
    plan = plan.select(F.col("source").alias("s"), F.col("shard").alias("h"), "full", "blocks", F.least("blocks", rest).alias("chosen"))
    plan = materialised(plan)
    few = F.broadcast if plan.count() <= SMALL_TABLE else lambda df: df
    placed = sized.join(few(plan), sized["source"].eqNullSafe(plan["s"]) & (sized["shard"] == plan["h"])).drop("s", "h")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "print")
    placed = placed.withColumn("begin", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("phase", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest("blocks", F.lit(1))))
    taken = F.when(F.col("chosen") > 0, _words_before(F.col("begin") + F.col("size")) - _words_before(F.col("begin"))).otherwise(0)
    placed = placed.withColumn("taken", (F.col("full") * F.col("size") + taken).cast("long"))
    columns = [*carry, "doc_id", "source", "size", "source_size", "target", "taken", "full", "begin", "block", "blocks", "chosen", "phase"]
    none = {x: F.lit(0).cast("long") for x in ("taken", "full", "begin", "blocks", "chosen", "phase")}
    return placed.select(*columns).unionByName(empty.withColumns(none).select(*columns))


def _words_before(at: Column) -> Column:
    """How many words in chosen blocks come before the place `at`."""
    number = F.floor(at / F.col("block"))
    before = _units(F.col("chosen"), F.col("blocks"), F.col("phase"), number)
    after = _units(F.col("chosen"), F.col("blocks"), F.col("phase"), number + 1)
    return before * F.col("block") + F.when(after > before, at % F.col("block")).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: a row taken in full comes that often, unchanged, and then once
    more with the words of its chosen blocks only, joined by one space, if there are any; unchanged, if they are all.

    A row without words has nothing to give and does not come. n_chars, where there is such a column, is the new text's.
    """
    names = docs.columns
    mark = "__" + max([x for x in names if x.startswith("__")], key=len, default="")  # begins no name of docs
    keyed = materialised(docs.withColumn(f"{mark}row", F.monotonically_increasing_id()))
    sizes = mixed_sizes(keyed.select(f"{mark}row", "doc_id", "source", "text"), weights, most, block, seed, (f"{mark}row",))
    inner = ("size", "taken", "full", "begin", "block", "blocks", "chosen", "phase")
    joined = keyed.join(sizes.select(f"{mark}row", *(F.col(x).alias(f"{mark}{x}") for x in inner)), f"{mark}row")
    value = lambda x: F.col(f"{mark}{x}")
    words = F.regexp_extract_all("text", F.lit(WORD), 0)

    def chosen(_: Column, i: Column) -> Column:
        number = F.floor((value("begin") + i) / value("block"))
        args = value("chosen"), value("blocks"), value("phase")
        return _units(*args, number + 1) > _units(*args, number)

    part = F.when(value("taken") > value("full") * value("size"), F.array_join(F.filter(words, chosen), " "))
    part = F.when(value("taken") == (value("full") + 1) * value("size"), F.col("text")).otherwise(part)  # all of it
    rest = F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>"))
    out = joined.where(value("taken") > 0).withColumn("text", F.explode(F.concat(F.array_repeat(F.col("text"), value("full").cast("int")), rest)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")
