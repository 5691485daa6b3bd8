"""Hard negatives by a pivot table.

With M the largest length of all vectors, x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q becomes q' = (q, 0), so
that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the inner product is a Euclidean distance. The distances of all vectors to a few
pivots are stored. By the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) for every pivot p,
which brackets the score of a pair without looking at it.

Vectors are dealt by nearest pivot and distance to it into groups of some megabytes, and into blocks inside a group, so
that both have narrow ranges of distances. An anchor meets groups in the order of the highest score that their ranges
allow, in waves of growing size, as long as that score reaches what it has found so far and the lowest one does not
exceed what it looks for. Inside a task the same brackets leave out blocks, then rows where they leave out most, and
what survives is checked by exact integer products. Positives and negatives are two such searches: the first without
bounds among rows of the anchor's label, the second among the others in a window of scores for each positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbank.llm._cluster import materialised, partitions
from quillbank.llm._vectors import floored, matrices, products

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
PIVOTS = 16
SAMPLE = 512  # vectors by seeded hash, from which the pivots are chosen
BLOCK_ROWS = 4096
GROUP_BYTES = 64 << 20
ANCHOR_BLOCK = 256
WAVE = 16  # each wave goes to so many times the groups of the one before
PROBED = 32  # rows of a block by which the share of survivors is judged
GATHERED = 8  # how many times the cost of a row in a matrix product a single survivor has


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each time the one farthest from those chosen so far, ties to the first."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    apart = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def augmented(rows: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more component that makes each square length `square`."""
    return np.concatenate([rows, np.sqrt(np.maximum(0.0, square - (rows**2).sum(1)))[:, None]], 1)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of augmented rows to augmented pivots."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1) if len(rows) else np.zeros((0, len(pivots)))


def bracket(own: np.ndarray, low: np.ndarray, high: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest and lowest score that pivot distances between low and high allow, with slack for rounding.

    own: an anchor's distances to the pivots; squares: the sum of its square length and the largest one.
    """
    near = np.maximum(np.maximum(own - high, low - own), 0.0).max(-1)
    far = (own + high).min(-1)
    slack = 1e-9 * squares + 1e-6
    return (squares - near**2) / 2 + slack, (squares - far**2) / 2 - slack


class Block:
    """Vectors of about the same distances to the pivots."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, apart: np.ndarray) -> None:
        self.ids, self.labels, self.rows, self.apart = ids, labels, rows, apart
        self.low, self.high = apart.min(0), apart.max(0)
        self.only = labels[0] if (labels == labels[0]).all() else None

    def _count(self, counts: dict[str, int] | None, how: str, n: int) -> None:
        if counts is not None:
            counts[how] = counts.get(how, 0) + n

    def survivors(self, own: np.ndarray, square: float, floor: float, ceiling: float) -> np.ndarray:
        """Rows whose bracket meets the wanted scores of one anchor, by one pivot after the other."""
        at = np.arange(len(self.rows))
        for p in range(self.apart.shape[1]):
            d = self.apart[at, p, None]
            top, bottom = bracket(own[p : p + 1], d, d, np.full(len(at), square))
            at = at[(top >= floor) & (bottom <= ceiling)]
        return at

    def meet(self, anchors: Anchors, k: int, counts: dict[str, int] | None = None) -> None:
        """Brings the best of this block's rows to the anchors that look for them."""
        top, bottom = bracket(anchors.own, self.low, self.high, anchors.squares)
        wanted = ((top[:, None] >= anchors.floor) & (bottom[:, None] <= anchors.high)).any(1)
        if self.only is not None:
            wanted &= (anchors.labels == self.only) == anchors.same
        at = np.flatnonzero(wanted)
        self._count(counts, "block", (len(wanted) - len(at)) * len(self.rows))
        if not len(at):
            return
        # Where nearly all rows survive, as some rows in even steps tell, telling them apart does not pay.
        floor, ceiling = anchors.floor[at].min(1), anchors.high[at].max(1)
        probe = self.apart[None, :: max(1, len(self.rows) // PROBED)]
        top, bottom = bracket(anchors.own[at, None], probe, probe, anchors.squares[at, None])
        few = GATHERED * ((top >= floor[:, None]) & (bottom <= ceiling[:, None])).sum(1) < probe.shape[1]
        for j in np.flatnonzero(few).tolist():
            some = self.survivors(anchors.own[at[j]], float(anchors.squares[at[j]]), float(floor[j]), float(ceiling[j]))
            self._count(counts, "row", len(self.rows) - len(some))
            self._count(counts, "verified", len(some))
            anchors.take(at[j : j + 1], self.ids[some], self.labels[some], products(anchors.rows[at[j : j + 1]], self.rows[some]), k)
        whole = at[~few]
        self._count(counts, "verified", len(whole) * len(self.rows))
        if len(whole):
            anchors.take(whole, self.ids, self.labels, products(anchors.rows[whole], self.rows), k)


class Anchors:
    """Some anchors with the windows of scores that they look for, and the best found in each so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, pivots: np.ndarray, square: float, same: bool, floor: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.labels, self.rows, self.same = ids, labels, rows, same
        self.own = distances(np.concatenate([rows, np.zeros((len(rows), 1))], 1), pivots)
        self.squares = (rows**2).sum(1) + square
        self.floor, self.high = floor.copy(), high
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def take(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> None:
        """Keeps the k best of each window among rows with these scores, ties to the smaller id; raises the floors."""
        near = scores.astype(np.float64)
        near[(labels[None] == self.labels[at][:, None]) != self.same] = np.nan
        near[ids[None] == self.ids[at][:, None]] = np.nan
        for s in range(self.floor.shape[1]):
            fit = near >= self.floor[at, s][:, None]
            fit &= near <= self.high[at, s][:, None]
            for j in np.flatnonzero(fit.any(1)).tolist():
                i, some = int(at[j]), np.flatnonzero(fit[j])
                found, score = ids[some], scores[j, some]
                if (i, s) in self.best:
                    found, score = np.concatenate([self.best[i, s][0], found]), np.concatenate([self.best[i, s][1], score])
                order = np.lexsort((found, -score))[:k]
                self.best[i, s] = found[order], score[order]
                if len(order) == k:
                    self.floor[i, s] = max(self.floor[i, s], float(score[order[-1]]))


_BLOCK = "grp int, kind int, width int, vec_id long, label long, ids binary, labels binary, body binary, apart binary, floor binary, high binary, low array<double>, top array<double>, label_low long, label_high long"
_BLOCKS = pa.schema(
    [("grp", pa.int32()), ("kind", pa.int32()), ("width", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64())]
    + [(c, pa.binary()) for c in ("ids", "labels", "body", "apart", "floor", "high")]
    + [("low", pa.list_(pa.float64())), ("top", pa.list_(pa.float64())), ("label_low", pa.int64()), ("label_high", pa.int64())]
)


def _placed(pivots: dict[int, np.ndarray], square: float):
    """Adds to each row its distances to the pivots, the nearest one and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch, "v"):
                apart = distances(augmented(rows, square), pivots[rows.shape[1]])
                cell = apart.argmin(1)
                bounds = pa.array(np.arange(0, apart.size + 1, apart.shape[1]), pa.int32())
                taken = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "label", "v")]
                columns = [*taken, pa.ListArray.from_arrays(bounds, pa.array(apart.reshape(-1))), pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "apart", "cell", "near"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order as blocks of at most BLOCK_ROWS of one width; the group is the partition."""
    from pyspark import TaskContext

    group = TaskContext.get().partitionId()
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def out(width: int) -> pa.RecordBatch:
        ids, labels, rows, apart = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
        values = [group, 0, width, None, None, ids.tobytes(), labels.tobytes(), rows.tobytes(), apart.tobytes(), None, None, apart.min(0).tolist(), apart.max(0).tolist(), int(labels.min()), int(labels.max())]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)

    for batch in batches:
        (places, lists), ids, labels = zip(*matrices(batch, "apart"), strict=True), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        apart = dict(zip(np.concatenate(places).tolist(), (x for m in lists for x in m), strict=True)) if len(places) > 1 else lists[0][np.argsort(places[0])]
        for at, rows in matrices(batch, "v"):
            width = rows.shape[1]
            mine = np.array([apart[i] for i in at.tolist()]) if isinstance(apart, dict) else apart[at]
            for lo in range(0, len(at), BLOCK_ROWS):
                part = at[lo : lo + BLOCK_ROWS]
                held.setdefault(width, []).append((ids[part], labels[part], rows[lo : lo + BLOCK_ROWS], mine[lo : lo + BLOCK_ROWS]))
                if sum(len(x[0]) for x in held[width]) >= BLOCK_ROWS:
                    yield out(width)
    for width in list(held):
        yield out(width)


def _asked(summary: dict[int, tuple[np.ndarray, ...]], pivots: dict[int, np.ndarray], square: float, same: bool, first: int, last: int):
    """For each anchor a row for each group from place `first` to `last` of its order that it still needs.

    summary: for each width the groups, the ranges of their distances and of their labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            windows = {c: dict(x for at, m in matrices(batch, c) for x in zip(at.tolist(), m, strict=True)) for c in ("floor", "high")}
            for at, rows in matrices(batch, "v"):
                width = rows.shape[1]
                if width not in summary:
                    continue
                groups, low, top, label_low, label_high = summary[width]
                own = distances(np.concatenate([rows, np.zeros((len(rows), 1))], 1), pivots[width])
                squares = (rows**2).sum(1) + square
                out: dict[str, list] = {f.name: [] for f in _BLOCKS}
                for i, place in enumerate(at.tolist()):
                    label = labels[place]
                    fit = (label_low <= label) & (label <= label_high) if same else (label_low != label) | (label_high != label)
                    best, worst = bracket(own[i], low, top, np.full(len(groups), squares[i]))
                    order = np.lexsort((groups, -best, ~fit))[: int(fit.sum())][first:last]
                    floor, high = windows["floor"][place], windows["high"][place]
                    needed = order[((best[order, None] >= floor) & (worst[order, None] <= high)).any(1)]
                    values = {"kind": 1, "width": width, "vec_id": int(ids[place]), "label": int(label), "body": rows[i].tobytes(), "floor": floor.tobytes(), "high": high.tobytes()}
                    out["grp"] += groups[needed].tolist()
                    for name in out:
                        if name != "grp":
                            out[name] += [values.get(name)] * len(needed)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _BLOCKS], schema=_BLOCKS)

    return run


_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _searched(pivots: dict[int, np.ndarray], square: float, same: bool, k: int):
    """The best k of each window of each anchor among the blocks of its group, which come before the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, waiting = None, {}, []

        def met() -> Iterator[pa.RecordBatch]:
            rows = [(r, blocks.get(r["width"], [])) for r in waiting]
            waiting.clear()
            for key in sorted({(r["width"], len(r["floor"])) for r, _ in rows}):
                some = [r for r, _ in rows if (r["width"], len(r["floor"])) == key]
                number = lambda c: np.array([r[c] for r in some], np.int64)
                real = lambda c: np.stack([np.frombuffer(r[c], np.float64) for r in some])
                anchors = Anchors(number("vec_id"), number("label"), real("body"), pivots[key[0]], square, same, real("floor"), real("high"))
                for block in blocks.get(key[0], []):
                    block.meet(anchors, k)
                for (i, s), (ids, scores) in anchors.best.items():
                    columns = [np.full(len(ids), anchors.ids[i]), np.full(len(ids), s), ids, scores]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != group:
                    yield from met()
                    group, blocks = row["grp"], {}
                if row["kind"] == 0:
                    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                    blocks.setdefault(row["width"], []).append(Block(ids, labels, np.frombuffer(row["body"], np.float64).reshape(len(ids), -1), np.frombuffer(row["apart"], np.float64).reshape(len(ids), -1)))
                    continue
                waiting.append(row)
                if len(waiting) == ANCHOR_BLOCK:
                    yield from met()
        yield from met()

    return run


class PivotTable:
    """Vectors (vec_id, label, v) with their distances to the pivots, in groups."""

    def __init__(self, rows: DataFrame, group_bytes: int = GROUP_BYTES, pivots: int = PIVOTS) -> None:
        spark = rows.sparkSession
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        size = rows.agg(F.count("*").alias("n"), F.max(length).alias("square"), F.max(F.size("v")).alias("width"), F.collect_set(F.size("v")).alias("widths")).first()
        self.square = size["square"] or 0.0
        # The sample is bounded; a width that is not in it has the origin as its only pivot.
        sample = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id", F.lit(20240302)), "vec_id", "v").select("v").limit(SAMPLE).collect()]
        of = {w: np.array([x for x in sample if len(x) == w]).reshape(-1, w) for w in size["widths"]}
        self.pivots = {w: augmented(choose_pivots(x, pivots), self.square) for w, x in of.items()}
        bytes_a_row = 8 * ((size["width"] or 0) + pivots + 2)
        # As many groups as bytes ask for, or as there are tasks, if blocks are filled.
        self.groups = max(1, -(-size["n"] * bytes_a_row // group_bytes), min(partitions(spark), -(-size["n"] // BLOCK_ROWS)))
        placed = rows.select("vec_id", "label", "v").mapInArrow(_placed(self.pivots, self.square), "vec_id long, label long, v array<double>, apart array<double>, cell int, near double")
        order = [F.size("v"), "label", "cell", "near", "vec_id"]
        self.tables = materialised(placed.repartitionByRange(self.groups, *order).sortWithinPartitions(*order).mapInArrow(_packed, _BLOCK))
        self.summary = self._summary()

    def _summary(self) -> dict[int, tuple[np.ndarray, ...]]:
        """For each width: groups, ranges of their distances to the pivots and of their labels; a row for each group."""
        ends = self.tables.select("grp", "width", "label_low", "label_high", F.posexplode(F.arrays_zip("low", "top")).alias("p", "x"))
        ends = ends.groupBy("grp", "width", "p").agg(F.min("x.low").alias("low"), F.max("x.top").alias("top"), F.min("label_low").alias("a"), F.max("label_high").alias("b"))
        rows = ends.groupBy("grp", "width").agg(F.sort_array(F.collect_list(F.struct("p", "low", "top"))).alias("x"), F.min("a").alias("a"), F.max("b").alias("b")).orderBy("grp").collect()
        out = {}
        for width in {r["width"] for r in rows}:
            some = [r for r in rows if r["width"] == width]
            out[width] = tuple(np.array(x) for x in ([r["grp"] for r in some], [[y["low"] for y in r["x"]] for r in some], [[y["top"] for y in r["x"]] for r in some], [r["a"] for r in some], [r["b"] for r in some]))
        return out

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, slot, rank, vec_id, score): the best k rows in each window of the anchors (vec_id, label, v, floor, high).

        floor and high are arrays of the windows' ends, both inclusive. same: among rows of the anchor's label, or of
        other labels. An anchor's own vec_id does not count. Scores fall with the rank, ties go to the smaller vec_id.
        """
        n = partitions(anchors.sparkSession)
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        found, first, last = None, 0, 1
        while found is None or first < self.groups:
            now = anchors
            if found is not None:
                # The k-th best score of a window is its floor from here on.
                full = found.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
                raised = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("raised"))
                now = now.join(raised, now["vec_id"] == raised["anchor_id"], "left").withColumn("floor", F.transform("floor", lambda x, s: F.greatest(x, F.coalesce(F.col("raised")[s.cast("int")], x))))
            asked = now.select("vec_id", "label", "v", "floor", "high").mapInArrow(_asked(self.summary, self.pivots, self.square, same, first, last), _BLOCK)
            both = self.tables.unionByName(asked).repartition(max(n, self.groups), "grp").sortWithinPartitions("grp", "kind")
            some = both.mapInArrow(_searched(self.pivots, self.square, same, k), "anchor_id long, slot int, vec_id long, score long")
            some = some if found is None else found.select("anchor_id", "slot", "vec_id", "score").unionByName(some)
            found = materialised(some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            first, last = last, last * (1 + WAVE)
        return found.select("anchor_id", "slot", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    rows: vec_id, embedding, label. Rows whose id, label or vector is null, and vectors that are empty or hold null or
    non-finite components, take no part. Scores are integer inner products of floor(256 x), below 2**53;
    vectors of different widths do not meet. An anchor's positives are the first of its label, its negatives for each
    those of other labels with 50 * positive_score <= 100 * negative_score <= 95 * positive_score, so none where the
    positive score is below zero. Rows that repeat a vec_id are candidates each, and come back each; as anchors the
    least label and vector of an id count, and rows of an anchor's id are neither its positives nor its negatives. An
    anchor without positives or without negatives in its window gives no rows, nor does an empty table. Other columns
    are left out.
    """
    sound = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), floored(F.col("embedding"), SCALE).alias("v")).where("vec_id is not null and label is not null and size(v) > 0")
    table = PivotTable(sound, group_bytes)
    asked = sound.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    asked = materialised(asked)
    ends = lambda x: F.array(F.lit(x))
    near = table.search(asked.withColumns({"floor": ends(-math.inf), "high": ends(math.inf)}), True, positives)
    # The ends of the windows, in whole numbers: half the positive score, up, and 19 / 20 of it, down.
    window = F.expr("struct(cast((score + 1) div 2 as double) as floor, cast((19 * score) div 20 as double) as high)")
    near = near.where("score >= 0").withColumn("window", window)
    wanted = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "window"))).alias("x"))
    wanted = wanted.select(F.col("anchor_id").alias("vec_id"), F.transform("x", lambda x: x["window"]["floor"]).alias("floor"), F.transform("x", lambda x: x["window"]["high"]).alias("high"))
    hard = table.search(asked.join(wanted, "vec_id"), False, negatives)
    # Scores fall with the rank, so those below zero come last and a window's place is its positive's rank less one.
    hard = hard.select("anchor_id", (F.col("slot") + 1).alias("place"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(hard, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; labels of ids divisible by 7 are off by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
