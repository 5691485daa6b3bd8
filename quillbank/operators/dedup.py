"""Exact and near duplicates of questions, the ignore list, and merging."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered
from quillbank.functions.text import bigrams, dice_percent

WINDOW = 256
SUSPECTED = 82


def exact_groups(questions: DataFrame) -> DataFrame:
    """(fingerprint, members, size) of questions (id, fingerprint, created) of which several are the same.

    A row holds all members of a group; exact_members() has a row for each instead, for groups of any size.
    """
    members = F.transform(F.array_sort(F.collect_list(F.struct("created", "id"))), lambda x: x["id"])
    return questions.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(members.alias("members"), F.count("*").alias("size")).where(F.col("size") > 1)


def exact_members(questions: DataFrame) -> DataFrame:
    """(id, fingerprint, size, first): questions of which several are the same, and the first of each group by created, id.

    Groups are pre-aggregated; their members never meet in one row or task, but for the shuffle of a join that Spark
    splits where a group is large.
    """
    groups = questions.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint")
    several = groups.agg(F.count("*").alias("size"), F.min(F.struct("created", "id"))["id"].alias("first")).where(F.col("size") > 1)
    return questions.select("id", "fingerprint").join(several, "fingerprint").select("id", "fingerprint", "size", "first")


def first_occurrence(items: DataFrame) -> DataFrame:
    """items (ordinal, fingerprint) with `first`, the ordinal of an earlier row of the same fingerprint, or null."""
    least = items.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("ordinal").alias("first"))
    out = items.join(least, "fingerprint", "left")
    return out.withColumn("first", F.when(F.col("first") < F.col("ordinal"), F.col("first")))


def pair_similarity(pairs: DataFrame, texts: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """pairs with `similarity`, the bigram Dice percentage of texts (id, text) of their two ids."""
    grams = texts.select("id", F.explode(bigrams(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))
    size = texts.select("id", F.size(bigrams(F.col("text"))).alias("size"))
    a = pairs.select(left, right).join(grams.withColumnsRenamed({"id": left, "n": "n1"}), left)
    shared = a.join(grams.withColumnsRenamed({"id": right, "n": "n2"}), [right, "gram"]).groupBy(left, right).agg(F.sum(F.least("n1", "n2")).alias("shared"))
    out = pairs.join(shared, [left, right], "left")
    out = out.join(size.withColumnsRenamed({"id": left, "size": "s1"}), left).join(size.withColumnsRenamed({"id": right, "size": "s2"}), right)
    similarity = dice_percent(F.coalesce("shared", F.lit(0)), F.col("s1"), F.col("s2"))
    return out.withColumn("similarity", similarity).drop("shared", "s1", "s2")


def gram_bag(text: str) -> np.ndarray:
    """The bigrams of a text as whole numbers in order, the k-th of a kind apart from the others, so that bags are sets."""
    codes = np.frombuffer((text + "\0" if len(text) == 1 else text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = np.sort((codes[:-1] << np.uint64(21) | codes[1:]) << np.uint64(22))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    place = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    return grams | place.astype(np.uint64)


def shared_between(left: list[np.ndarray], right: list[np.ndarray], tokens: int = 1 << 17) -> np.ndarray:
    """How many bigrams each bag of `left` has in common with each of `right`, repeats counted."""
    shared = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return shared
    known, owner = np.concatenate(left), np.repeat(np.arange(len(left)), [len(x) for x in left])
    order = np.argsort(known, kind="stable")
    known, first, count = np.unique(known[order], return_index=True, return_counts=True)
    owner, ends = owner[order], np.cumsum([len(x) for x in right])
    start = 0
    while start < len(right) and len(known):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + tokens, "right")))
        found = np.concatenate(right[start:stop])
        of = np.repeat(np.arange(stop - start), [len(x) for x in right[start:stop]])
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        at, of = at[hit], of[hit]
        n = count[at]
        places = np.arange(n.sum()) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        cells = owner[places] * (stop - start) + np.repeat(of, n)
        shared[:, start:stop] = np.bincount(cells, minlength=len(left) * (stop - start)).reshape(len(left), -1)
        start = stop
    return shared


CHUNK = 64


def _best_in_chunk(probes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The most similar candidate of each probe, of equal ones the first; the probes' candidates are in order."""
    left, right = ([gram_bag(t or "") for t in texts] for texts in (probes["text"], others["other_text"]))
    place = {c: j for j, c in enumerate(others["other"].tolist())}
    shared = shared_between(left, right)
    sizes, found = np.array([len(x) for x in right], np.int64), []
    for i, (key, candidates) in enumerate(zip(probes["key"], probes["candidates"], strict=True)):
        at = np.array([place[c] for c in candidates], np.int64)
        total = len(left[i]) + sizes[at]
        fits = (sizes[at] > 0) & (len(left[i]) > 0)
        score = np.where(fits, np.minimum(100, (200 * shared[i, at] + total // 2) // np.maximum(total, 1)), 0)
        best = int(score.argmax())
        found.append((key, candidates[best], int(score[best]), len(at)))
    return pd.DataFrame(found, columns=["key", "candidate", "similarity", "n"])


def best_candidates(pairs: DataFrame, probes: DataFrame, others: DataFrame) -> DataFrame:
    """(key, candidate, similarity, n) for each key of pairs (key, candidate, rank): the most similar, of equal ones the first.

    probes (key, text, length), others (candidate, text); n is the number of candidates, which has to be bounded. Probes
    go to tasks in chunks of neighbouring lengths, whose candidates are much the same, so each text goes to a few chunks
    and only the best pairs leave a task.
    """
    chunks = numbered(probes.select("key", "text", "length"), [F.asc("length"), F.asc("key")]).withColumn("chunk", F.floor(F.col("position") / CHUNK))
    lists = pairs.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("candidates"))
    mine = chunks.select("key", "text", "chunk").join(lists, "key")
    theirs = mine.select(F.col("chunk").alias("asking"), F.explode("candidates").alias("candidate")).distinct().join(others.select("candidate", "text"), "candidate")
    theirs = theirs.select("asking", F.col("candidate").alias("other"), F.col("text").alias("other_text"))  # names of their own, as both may come from one table
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    shape = f"key {kind(probes, 'key')}, candidate {kind(others, 'candidate')}, similarity int, n long"
    return mine.groupBy("chunk").cogroup(theirs.groupBy("asking")).applyInPandas(_best_in_chunk, shape)


def window_candidates(questions: DataFrame, scope: Column | None = None, window: int = WINDOW) -> DataFrame:
    """(id, candidate, rank): for each question (id, length, updated) in scope its `window` nearest lengths.

    Nearest among those at most `window` places away in the order of length, latest change and id. Positions are
    numbered without a single-task sort, and only neighbouring blocks of `window` positions meet.
    """
    placed = numbered(questions.select("id", "length", "updated", (scope if scope is not None else F.lit(True)).alias("in_scope")), [F.asc("length"), F.desc("updated"), F.asc("id")])
    block = F.floor(F.col("position") / window)
    mine = placed.where("in_scope").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    other = placed.select(F.col("id").alias("candidate"), F.col("length").alias("length2"), F.col("updated").alias("updated2"), F.col("position").alias("position2"), block.alias("block"))
    near = mine.join(other, "block").where((F.col("id") != F.col("candidate")) & (F.abs(F.col("position") - F.col("position2")) <= window))
    order = Window.partitionBy("id").orderBy(F.abs(F.col("length") - F.col("length2")), F.desc("updated2"), "candidate")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= window).select("id", "candidate", "rank")


def shared_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shared, sizes): how many bigrams each text has in common with each, repeats counted, and how many it has."""
    tokens, owners = [], []
    for i, text in enumerate(texts):
        grams = Counter([text + "\0"] if len(text) == 1 else [text[k : k + 2] for k in range(len(text) - 1)])
        mine = [(g, k) for g, n in grams.items() for k in range(n)]  # the k-th of a kind, so that bags are sets
        tokens += mine
        owners += [i] * len(mine)
    sizes = np.bincount(owners, minlength=len(texts)) if owners else np.zeros(len(texts), int)
    number: dict = {}
    column = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
    owners, shared = np.array(owners, np.int64), np.zeros((len(texts), len(texts)))
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    for low in range(0, len(number), 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        m = np.zeros((len(texts), min(4096, len(number) - low)), np.float32)
        m[owners[part], column[part] - low] = 1
        shared += m @ m.T
    return np.rint(shared).astype(np.int64), sizes


def _near(window: int, least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Suspected pairs of a block's own rows in scope with rows of this and the neighbouring blocks."""
        shared, sizes = shared_grams(group["text"].fillna("").tolist())
        length, position = group["length"].to_numpy(), group["position"].to_numpy()
        latest = -group["updated"].rank(method="dense", na_option="bottom").to_numpy()
        ids, prints = group["id"].tolist(), group["fingerprint"].tolist()
        name = np.argsort(np.argsort(np.array(ids, dtype=object) if isinstance(ids[0], str) else np.array(ids), kind="stable"), kind="stable")
        total = sizes[:, None] + sizes[None]
        score = np.where((sizes[:, None] == 0) | (sizes[None] == 0), 0, np.minimum(100, (200 * shared + total // 2) // np.maximum(total, 1)))
        found = []
        for i in np.flatnonzero((group["own"] & group["in_scope"]).to_numpy()):
            near = np.flatnonzero((np.abs(position - position[i]) <= window) & (position != position[i]))
            near = near[np.lexsort((name[near], latest[near], np.abs(length[near] - length[i])))][:window]
            for j in near[score[i][near] >= least]:
                if prints[i] is None or prints[i] != prints[j]:
                    a, b = sorted((ids[i], ids[j]))
                    found.append((a, b, min(99, int(score[i][j]))))
        return pd.DataFrame(found, columns=["left_id", "right_id", "similarity"])

    return run


def near_pairs(questions: DataFrame, scope: Column | None = None, window: int = WINDOW, least: int = SUSPECTED) -> DataFrame:
    """(left_id, right_id, similarity) of suspected duplicates: questions (id, text, length, updated, fingerprint).

    Candidates are those of window_candidates(). They are compared where a block of `window` positions meets its two
    neighbours, so only suspected pairs leave a task. A pair counts once, whichever of the two is in scope. Exact
    duplicates are left out; the similarity stops at 99. Ids are distinct.
    """
    rows = questions.select("id", "text", "length", "updated", "fingerprint", (scope if scope is not None else F.lit(True)).alias("in_scope"))
    placed = numbered(rows, [F.asc("length"), F.desc("updated"), F.asc("id")])
    block = F.floor(F.col("position") / window)
    dealt = placed.withColumn("__own", block).withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    dealt = dealt.withColumn("own", F.col("block") == F.col("__own")).drop("__own")
    kind = questions.schema["id"].dataType.simpleString()
    found = dealt.groupBy("block").applyInPandas(_near(window, least), f"left_id {kind}, right_id {kind}, similarity int")
    return found.distinct()


def best_match(probes: DataFrame, bank: DataFrame, window: int = WINDOW) -> DataFrame:
    """(probe_id, candidate, similarity, status): the most similar of each probe's `window` nearest lengths in the bank.

    Both have (id, text, length), the bank also `updated`; a probe's question_id, if there is one, is no candidate. Nearest: by length difference, latest change, id. Of equal
    similarities the first in that order counts. status is suspected from SUSPECTED on, else none. Lengths are bounded
    by the number of compared code points, so their counts are one short row; of each length only the `window` latest
    rows can be candidates.
    """
    probes = probes if "question_id" in probes.columns else probes.withColumn("question_id", F.lit(None).cast(bank.schema["id"].dataType))
    nearest = _length_candidates(probes.select("length").distinct(), bank, window, walk=False)
    best = best_of_lengths(probes.select(F.col("id").alias("key"), "text", "length", F.col("question_id").alias("own")), nearest, bank, window)
    status = F.when(F.col("similarity") >= SUSPECTED, "suspected").otherwise("none")
    return best.select(F.col("key").alias("probe_id"), "candidate", F.least("similarity", F.lit(99)).cast("int").alias("similarity"), status.alias("status"))


def _length_candidates(lengths: DataFrame, bank: DataFrame, window: int, walk: bool) -> DataFrame:
    """(length, candidate, rank): the first `window` + 1 rows of the bank for each distinct length, one for a row left out.

    By distance of length, then latest change, id; or, with `walk`, by a walk outwards from the place in the order of
    length, latest change first, id, where of equal distances the shorter side comes first. What is near depends on
    the length alone, so it is found once for each length, however many rows have it.
    """
    least = window + 1
    counts = bank.groupBy("length").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("length", "n")).alias("lengths"))
    at = lengths.select(F.col("length").alias("own_length")).crossJoin(F.broadcast(counts))
    far = F.array_sort(F.transform("lengths", lambda x: F.struct(F.abs(x["length"] - F.col("own_length")).cast("long").alias("d"), x["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    step = lambda a, x: F.when(a["n"] < least, F.struct((a["n"] + x["n"]).alias("n"), x["d"].alias("d"))).otherwise(a)
    at = at.withColumn("radius", F.aggregate(far, start, step)["d"])
    close = F.filter("lengths", lambda x: F.abs(x["length"] - F.col("own_length")) <= F.col("radius"))
    at = at.select("own_length", F.explode(F.transform(close, lambda x: x["length"])).alias("length"))
    distance, above = F.abs(F.col("length") - F.col("own_length")), F.col("length") >= F.col("own_length")
    right, left = Window.partitionBy("length").orderBy(F.desc("updated"), "id"), Window.partitionBy("length").orderBy("updated", F.desc("id"))
    first = bank.select("length", "id", "updated").withColumn("k", F.row_number().over(right)).where(F.col("k") <= least)
    if walk:
        last = bank.select("length", "id", "updated").withColumn("k", F.row_number().over(left)).where(F.col("k") <= least)
        both = first.withColumn("side", F.lit(True)).unionByName(last.withColumn("side", F.lit(False))).withColumnRenamed("id", "candidate")
        near = at.join(both.hint("merge"), "length").where(above == F.col("side"))
        order = [distance, above, F.col("k")]
    else:
        near = at.join(first.withColumnRenamed("id", "candidate").hint("merge"), "length")
        order = [distance, F.desc("updated"), F.col("candidate")]
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("own_length").orderBy(*order)))
    return near.where(F.col("rank") <= least).select(F.col("own_length").alias("length"), "candidate", "rank")


def _best_of_lengths(window: int):
    def run(probes: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        """Each probe with the candidates of its length, its own row aside."""
        near: dict = {}
        for c, places in zip(others["other"].tolist(), others["places"], strict=True):
            for x in places:
                near.setdefault(x["length"], []).append((x["rank"], c))
        near = {length: [c for _, c in sorted(found)] for length, found in near.items()}
        lists = [[c for c in near.get(length, ()) if str(c) != own][:window] for length, own in zip(probes["length"].tolist(), probes["own"], strict=True)]
        some = [bool(x) for x in lists]
        return _best_in_chunk(probes[some].assign(candidates=[x for x in lists if x]), others)

    return run


def best_of_lengths(probes: DataFrame, nearest: DataFrame, bank: DataFrame, window: int) -> DataFrame:
    """(key, candidate, similarity, n) as best_candidates(), for probes (key, text, length, own) and candidates by length.

    nearest (length, candidate, rank). A chunk of probes gets each candidate of its lengths once, with its text; lists
    of single probes are made in the chunk. The bank is shuffled, never sent to the driver.
    """
    # The own id is text, as pandas has no whole numbers beside nulls.
    chunks = numbered(probes.select("key", "text", "length", F.col("own").cast("string").alias("own")), [F.asc("length"), F.asc("key")]).withColumn("chunk", F.floor(F.col("position") / CHUNK))
    texts = bank.select(F.col("id").alias("candidate"), "text").hint("merge").join(nearest.select("candidate").distinct(), "candidate", "left_semi")
    theirs = nearest.join(texts.select("candidate", F.col("text").alias("other_text")).hint("merge"), "candidate")
    theirs = chunks.select(F.col("chunk").alias("asking"), "length").distinct().join(theirs, "length")
    theirs = theirs.groupBy("asking", F.col("candidate").alias("other")).agg(F.first("other_text").alias("other_text"), F.collect_list(F.struct("length", "rank")).alias("places"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    shape = f"key {kind(probes, 'key')}, candidate {kind(bank, 'id')}, similarity int, n long"
    mine = chunks.select("key", "text", "length", "own", "chunk")
    return mine.groupBy("chunk").cogroup(theirs.groupBy("asking")).applyInPandas(_best_of_lengths(window), shape)


def _exact_rows(items: DataFrame, bank: DataFrame, order: list[Column]) -> DataFrame:
    """(ordinal, same): the first row of the bank with an item's fingerprint that is not the item's own question.

    Of each fingerprint two rows are enough, so copies in the bank do not multiply those of the items.
    """
    asked = items.where(F.col("fingerprint").isNotNull()).select("ordinal", "question_id", "fingerprint")
    known = bank.hint("merge").join(asked.select("fingerprint").distinct(), "fingerprint", "left_semi")
    two = known.withColumn("k", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))).where("k <= 2")
    hits = asked.join(two.select("fingerprint", F.col("id").alias("same"), "k").hint("merge"), "fingerprint").where(~F.col("same").eqNullSafe(F.col("question_id")))
    return hits.groupBy("ordinal").agg(F.min(F.struct("k", "same"))["same"].alias("same"))


def earlier_pairs(items: DataFrame, window: int = WINDOW, wanted: DataFrame | None = None) -> DataFrame:
    """(ordinal, candidate, apart, longer): earlier items that can be among the `window` nearest in length of an item.

    Items (ordinal, length) with distinct ordinals; wanted (ordinal) restricts those that look for candidates. By divide
    and conquer over the places of the ordinals: on each level the items of a right half look for candidates in the left
    half beside it, all of which are earlier, and over all levels an item meets every earlier one once. A left half is in
    order of length, so an item needs `window` places to either side of its own there, which it reads from blocks of
    that many places: about window * log2(n) rows for an item, and no pair of the others.
    """
    placed = numbered(items.select("ordinal", "length"), [F.asc("ordinal")], "p")
    levels = max(1, (max(placed.count(), 1) - 1).bit_length())
    half = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    half = half.withColumns({"pair": F.expr("shiftright(p, level + 1)"), "right": F.expr("shiftright(p, level) & 1")})
    by = Window.partitionBy("level", "pair").orderBy("length")
    runs = half.groupBy("level", "pair", "length").agg(F.sum(1 - F.col("right")).alias("n")).withColumn("upto", F.sum("n").over(by))
    left = numbered(half.where("right = 0").select("level", "pair", "length", "ordinal"), [F.asc("level"), F.asc("pair"), F.asc("length"), F.asc("ordinal")], "place")
    start = left.groupBy("level", "pair").agg(F.min("place").alias("start"))
    left = left.join(start, ["level", "pair"]).join(runs, ["level", "pair", "length"])
    # Of one length later ordinals come first, seen from either side: places from below, and with each run reversed.
    below = F.col("place") - F.col("start")
    left = left.select("level", "pair", F.col("ordinal").alias("candidate"), F.col("length").alias("other"), below.alias("below"), (2 * F.col("upto") - F.col("n") - 1 - below).alias("above"))
    asks = half.where("right = 1").select("level", "pair", "length", "ordinal")
    asks = asks if wanted is None else asks.join(wanted.select("ordinal"), "ordinal", "left_semi")
    asks = asks.join(runs.select("level", "pair", "length", "upto"), ["level", "pair", "length"])
    out = None
    for side, low, high in (("below", F.col("upto") - window, F.col("upto") - 1), ("above", F.col("upto"), F.col("upto") + window - 1)):
        many = asks.withColumns({"low": F.greatest(low, F.lit(0)), "high": high}).where("high >= 0")
        many = many.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / window), F.floor(F.col("high") / window))))
        blocks = left.select("level", "pair", "candidate", "other", F.col(side).alias("at"), F.floor(F.col(side) / window).alias("block"))
        near = many.join(blocks, ["level", "pair", "block"]).where("at between low and high")
        near = near.select("ordinal", "candidate", F.abs(F.col("other") - F.col("length")).alias("apart"), (F.col("other") > F.col("length")).alias("longer"))
        out = near if out is None else out.unionByName(near)
    return out


def _earlier_candidates(items: DataFrame, window: int, wanted: DataFrame) -> DataFrame:
    """(ordinal, candidate, rank): of the items before, those nearest in length; shorter or equal, then later ones first."""
    order = Window.partitionBy("ordinal").orderBy("apart", "longer", F.desc("candidate"))
    near = earlier_pairs(items, window, wanted).withColumn("rank", F.row_number().over(order))
    return near.where(F.col("rank") <= window).select("ordinal", "candidate", "rank")


def check_batch(items: DataFrame, bank: DataFrame, mode: str = "full", window: int = WINDOW) -> DataFrame:
    """(ordinal, status, candidate, earlier, similarity, evaluated) of each row of a batch.

    items: (ordinal, text, length, fingerprint) and, where a row is a question of the bank already, its question_id;
    bank: (id, text, length, updated, fingerprint). Null fingerprints are not comparable. `candidate` is a bank id,
    `earlier` the ordinal of a row of the batch. Mode full: the first exact row of the bank, else the first of the batch,
    else the most similar of the bank's nearest lengths; exact: without the last; import: the batch alone, first its
    exact rows, else the most similar of the rows before (only if suspected).
    """
    if mode not in ("full", "exact", "import"):
        raise ValueError(f"no such mode: {mode}")
    if "question_id" not in items.columns:
        items = items.withColumn("question_id", F.lit(None).cast(bank.schema["id"].dataType))
    out = first_occurrence(items.select("ordinal", "fingerprint")).select("ordinal", F.col("first").alias("same_batch"))
    none = F.lit(None).cast(bank.schema["id"].dataType)
    if mode == "import":
        out = out.withColumn("same_bank", none)
    else:
        same = _exact_rows(items, bank, [F.asc("length"), F.desc("updated"), F.asc("id")])
        out = out.join(same.withColumnRenamed("same", "same_bank"), "ordinal", "left")
    exact = F.col("same_bank").isNotNull() | F.col("same_batch").isNotNull()
    if mode == "exact":
        out = out.withColumns({"near": none, "value": F.lit(None).cast("int"), "n": F.lit(0).cast("long")})
    else:
        rest = items.join(out.where(~exact).select("ordinal"), "ordinal", "left_semi")
        if mode == "import":
            near = _earlier_candidates(items, window, rest).withColumnRenamed("ordinal", "key")
            best = best_candidates(near, rest.select(F.col("ordinal").alias("key"), "text", "length"), items.select(F.col("ordinal").alias("candidate"), "text"))
        else:
            nearest = _length_candidates(rest.select("length").distinct(), bank, window, walk=True)
            best = best_of_lengths(rest.select(F.col("ordinal").alias("key"), "text", "length", F.col("question_id").alias("own")), nearest, bank, window)
        out = out.join(best.select(F.col("key").alias("ordinal"), F.col("candidate").alias("near"), F.col("similarity").alias("value"), "n"), "ordinal", "left")
    suspected = F.coalesce(F.col("value") >= SUSPECTED, F.lit(False))
    shown = suspected if mode == "import" else F.col("near").isNotNull()
    near, earlier = F.when(shown, F.col("near")), F.when(F.col("same_bank").isNull(), F.col("same_batch"))
    return out.select(
        "ordinal",
        F.when(exact, "exact").when(suspected, "suspected").otherwise("none").alias("status"),
        (F.col("same_bank") if mode == "import" else F.coalesce("same_bank", near)).alias("candidate"),
        (F.coalesce(earlier, near) if mode == "import" else earlier).alias("earlier"),
        F.when(exact, 100).when(shown, F.least("value", F.lit(99))).cast("int").alias("similarity"),
        F.when(exact, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("evaluated"),
    )


def check_drafts(drafts: DataFrame, bank: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ordinal, status, candidate, similarity) of single drafts (ordinal, question_id, text, length, fingerprint).

    The latest changed row of the bank with the same fingerprint counts first, the draft's own question aside; else the
    most similar of the `window` nearest lengths, which is shown even where it is not suspected.
    """
    latest = _exact_rows(drafts, bank, [F.asc(-F.col("updated")), F.asc("id")])
    rest = drafts.join(latest, "ordinal", "left_anti")
    near = best_match(rest.select(F.col("ordinal").alias("id"), "text", "length", "question_id"), bank, window)
    out = drafts.select("ordinal").join(latest, "ordinal", "left").join(near.withColumnRenamed("probe_id", "ordinal"), "ordinal", "left")
    exact = F.col("same").isNotNull()
    return out.select(
        "ordinal",
        F.when(exact, "exact").otherwise(F.coalesce("status", F.lit("none"))).alias("status"),
        F.coalesce("same", "candidate").alias("candidate"),
        F.when(exact, 100).otherwise(F.col("similarity")).cast("int").alias("similarity"),
    )


def ignore_outcomes(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (left_id, right_id, left_version, right_version) with `outcome`: what becomes of the wish to ignore them.

    versions (id, content_version, fingerprint). A pair whose versions are others by now, or of which a side is gone, is
    refused, and so is one that is exact; the others are ignored for these versions.
    """
    side = lambda name: versions.select(F.col("id").alias(f"{name}_id"), F.col("content_version").alias(f"__{name}"), F.col("fingerprint").alias(f"__{name}_print"))
    out = requests.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    as_read = (F.col("__left") == F.col("left_version")) & (F.col("__right") == F.col("right_version"))
    outcome = F.when(~F.coalesce(as_read, F.lit(False)), "versions differ").when(F.col("__left_print") == F.col("__right_print"), "exact").otherwise("ignored")
    return out.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def without_ignored(pairs: DataFrame, versions: DataFrame, ignores: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) that are not ignored; an ignore holds only for the versions it was given for."""
    v = versions.select("id", "content_version")
    full = pairs.join(v.withColumnsRenamed({"id": "left_id", "content_version": "left_version"}), "left_id")
    full = full.join(v.withColumnsRenamed({"id": "right_id", "content_version": "right_version"}), "right_id")
    return full.join(ignores, ["left_id", "right_id", "left_version", "right_version"], "left_anti")


def merged_tags(members: DataFrame, bridge: DataFrame, most: int = 100) -> DataFrame:
    """(group_id, keeper, tags): the union of the tags of each group's members (group_id, id), kept by the smallest id."""
    keeper = members.groupBy("group_id").agg(F.min("id").alias("keeper"))
    tags = members.join(bridge.withColumnRenamed("question_id", "id"), "id").groupBy("group_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    return keeper.join(tags, "group_id", "left").withColumn("too_many", F.coalesce(F.size("tags") > most, F.lit(False)))


def merged(questions: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """questions after groups (group_id, id) were merged: all members a version on, all but the smallest id in the bin."""
    keeper = members.groupBy("group_id").agg(F.min("id").alias("keeper"))
    marks = members.join(keeper, "group_id").select("id", "keeper")
    out = questions.join(marks, "id", "left")
    hit = F.col("keeper").isNotNull()
    out = out.withColumn("content_version", F.when(hit, F.col("content_version") + 1).otherwise(F.col("content_version")))
    return out.withColumn("deleted_at_ms", F.when(hit & (F.col("keeper") != F.col("id")), F.lit(now_ms)).otherwise(F.col("deleted_at_ms"))).drop("keeper")


#: How many questions and tags one request to merge may have.
MOST_MEMBERS, MOST_TAGS = 500, 100


def _mergeable(questions: DataFrame, requests: DataFrame, most_members: int | None) -> DataFrame:
    """(id, group_id, keeper) of the groups of 2 to `most_members` distinct live members whose versions are all as read.

    requests may name a keeper_id for a group, which has to be a member, the same in all rows; else the smallest id is
    kept. They may give a kind: a group that is exact in any row needs one fingerprint, which is not null, in all its
    members; other kinds than exact and suspected do not merge.
    """
    named, kinds = "keeper_id" in requests.columns, "kind" in requests.columns
    prints = F.col("fingerprint") if kinds else F.lit("")
    versions = questions.select("id", "content_version", F.col("deleted_at_ms").isNull().alias("live"), prints.alias("__print"))
    asked = requests.select("group_id", "id", "expected_version", *(["keeper_id"] if named else []), *(["kind"] if kinds else [])).dropDuplicates(["group_id", "id"])
    members = asked.join(versions, "id", "left")
    fine = F.coalesce(F.col("live") & (F.col("content_version") == F.col("expected_version")), F.lit(False))
    if kinds:
        fine = fine & F.coalesce(F.col("kind").isin("exact", "suspected"), F.lit(False))
    keeper = F.max("keeper_id") if named else F.min("id")
    member = (F.max((F.col("keeper_id") == F.col("id")).cast("int")) == 1) & (F.min("keeper_id") == F.max("keeper_id")) & (F.count("keeper_id") == F.count("*")) if named else F.lit(True)
    alike = (F.count_if(F.col("kind") == "exact") == 0) | ((F.count("__print") == F.count("*")) & (F.min("__print") == F.max("__print"))) if kinds else F.lit(True)
    groups = members.groupBy("group_id").agg(F.min(fine).alias("fine"), F.count("*").alias("n"), keeper.alias("keeper"), member.alias("member"), alike.alias("alike"))
    groups = groups.where(F.col("fine") & (F.col("n") >= 2) & F.col("member") & F.col("alike"))
    groups = groups if most_members is None else groups.where(F.col("n") <= most_members)
    return members.select("id", "group_id").join(groups.select("group_id", "keeper"), "group_id")


def merge_checked(questions: DataFrame, requests: DataFrame, now_ms: int, most_tags: int = MOST_TAGS, most_members: int | None = MOST_MEMBERS) -> DataFrame:
    """questions (id, tags, content_version, deleted_at_ms) after the groups of requests (group_id, id, expected_version) merged.

    A group merges as a whole or not at all: it needs 2 to `most_members` (None: any number of) live members at the
    versions that were read, and at most `most_tags` tags together. The keeper, which requests may name, else the smallest
    id, keeps all tags, the others go to the bin, and all are a version on. Of exact groups all members need one
    fingerprint (see _mergeable()).
    """
    members = _mergeable(questions, requests, most_members)
    # Tags are united as sets, so that no row holds those of all members of a large group.
    each = members.join(questions.select("id", F.explode_outer("tags").alias("tag")), "id")
    tags = each.groupBy("group_id").agg(F.array_sort(F.collect_set("tag")).alias("__tags"))
    members = members.join(tags.where(F.size("__tags") <= most_tags), "group_id").drop("group_id")
    out = questions.join(members, "id", "left")
    hit, keeps = F.col("keeper").isNotNull(), F.col("keeper") == F.col("id")
    changed = {
        "tags": F.when(hit & keeps, F.col("__tags")).otherwise(F.col("tags")),
        "deleted_at_ms": F.when(hit & ~keeps, F.lit(now_ms)).otherwise(F.col("deleted_at_ms")),
        "content_version": F.col("content_version") + hit.cast("int"),
    }
    return out.withColumns({c: x.cast(questions.schema[c].dataType) for c, x in changed.items()}).select(*questions.columns)


def merge_undo_rows(questions: DataFrame, requests: DataFrame, most_members: int | None = MOST_MEMBERS) -> DataFrame:
    """What merge_undone() needs, from before the merge: (id, keeper, version_after, tags) of all members."""
    members = _mergeable(questions, requests, most_members)
    return members.join(questions.select("id", (F.col("content_version") + 1).alias("version_after"), "tags"), "id").select("id", "keeper", "version_after", "tags")


def merge_undone(questions: DataFrame, undo: DataFrame) -> DataFrame:
    """questions after merges are taken back, group by group: where no member has changed since. That is a version on."""
    now = undo.join(questions.select("id", "content_version"), "id", "left")
    same = F.min(F.coalesce(F.col("content_version") == F.col("version_after"), F.lit(False)))
    fine = now.groupBy("keeper").agg(same.alias("fine")).where("fine")
    back = undo.join(fine.select("keeper"), "keeper").select("id", F.col("tags").alias("__tags"), F.lit(True).alias("__hit"))
    out = questions.join(back, "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    changed = {
        "tags": F.when(F.col("__hit"), F.col("__tags")).otherwise(F.col("tags")),
        "deleted_at_ms": F.when(~F.col("__hit"), F.col("deleted_at_ms")),
        "content_version": F.col("content_version") + F.col("__hit").cast("int"),
    }
    return out.withColumns({c: x.cast(questions.schema[c].dataType) for c, x in changed.items()}).select(*questions.columns)
