"""Hard negatives from vantage-point trees over norm-augmented vectors.

Rows are cut into blocks, each with a tree of its own. With M the largest norm of a block, a vector x gets one more component,
sqrt(M*M - |x|*|x|), and an anchor q gets 0: the squared distance of the two is M*M + |q|*|q| - 2qx, so rows by falling inner
product are rows by rising distance, and a window of scores is an annulus around the anchor. A node of the tree keeps a
vantage point (the one farthest from its parent's) and the least and largest distance from it in either half of its rows; by
the triangle inequality an anchor's distance to the vantage points bounds its distance to every leaf on both sides. Leaves are
visited nearest first, those outside of the annulus never, until the next leaf can't hold a better row than the k found.
Bounds are doubles with a margin; scores are exact integers while they stay below 2^53 (beyond, a score is the double nearest
to it).

Trees are written once and searched twice for each block of at most about ANCHORS anchors, which goes to the executors whole:
for the positives, then for the negatives of every positive's window. A task keeps its k best of all its blocks, and a window
that keeps k rows an anchor merges the tasks' lists.

Of rows with equal vector and label a block keeps those of the KEPT smallest ids: a positive or negative has at most k before
it, so no result is lost, and a large group of copies fills no tree. Edge cases: rows with a null label, a null vector, or a
null or non-finite component take no part; a missing component counts as 0 (vectors of other lengths, empty vectors); rows
that repeat id, label and vector, or an id with the same score, are one; other rows of the anchor's id are neither its positives nor
its negatives; a null id counts as -2^63 and is null in the result; anchors without positive or without negative in the window have no row; an
empty table gives none; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import NO_ID, id_column, materialise, read_table, schema

#: Rows of a tree and of a leaf, anchors that travel at once and that are searched at once, and ids kept of equal rows.
BLOCK, LEAF, ANCHORS, AT_ONCE = 16384, 64, 20_000, 512
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 3, 50, 95
KEPT = max(POSITIVES, NEGATIVES) + 1
NOWHERE = np.iinfo(np.int64).min


def rows_of(df: DataFrame, vec_id: str, label: Column, vector: str, anchor: Column) -> DataFrame:
    """(id, label, anchor, vector as whole numbers) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = df.where(label.isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(id_column(df, vec_id).alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _segments(count: int) -> list[np.ndarray]:
    """Level by level, where the halves of `count` rows begin and end, until they fit into a leaf."""
    levels = [np.array([0, count])]
    while np.diff(levels[-1]).max() > LEAF:
        ends = levels[-1]
        levels.append(np.sort(np.concatenate([ends, (ends[:-1] + ends[1:]) // 2])))
    return levels


_TREE = "ids binary, labels binary, points binary, dim int, width int, vantages binary, bounds binary"
_TREE_TYPES = pa.schema([*((c, pa.binary()) for c in ("ids", "labels", "points")), ("dim", pa.int32()), ("width", pa.int32()), ("vantages", pa.binary()), ("bounds", pa.binary())])


def _plant(ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    """One row: the rows of a block in the order of its tree's leaves, vantage points and bounds level by level."""
    order = np.lexsort((ids, labels, *points.T[::-1]))
    ids, labels, points = ids[order], labels[order], points[order]
    same = np.zeros(len(ids), dtype=bool)
    same[1:] = (labels[1:] == labels[:-1]) & (points[1:] == points[:-1]).all(axis=1)
    keep = ~(same & (ids == np.concatenate([ids[:1], ids[:-1]])))
    ids, labels, points, same = ids[keep], labels[keep], points[keep], same[keep]
    begins = np.flatnonzero(~same)
    keep = np.arange(len(ids)) - np.repeat(begins, np.diff(begins, append=len(ids))) < KEPT
    ids, labels, points = ids[keep], labels[keep], points[keep]
    exact = points.astype(np.float64)
    norms = (exact * exact).sum(axis=1)
    extra = np.sqrt(norms.max() - norms)
    order, vantages, bounds = np.arange(len(ids)), [], []
    levels = _segments(len(ids))
    for ends, halves in zip(levels[:-1], levels[1:], strict=True):
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            here, vantage, middle = order[a:b], order[b - 1], halves[2 * k + 1] - a
            squares = norms[vantage] + norms[here] - 2 * (exact[here] @ exact[vantage]) + (extra[here] - extra[vantage]) ** 2
            far = np.sqrt(np.maximum(squares, 0))
            by = np.argsort(far, kind="stable")
            order[a:b], far = here[by], far[by]
            vantages.append(points[vantage])
            bounds.append((far[0], far[middle - 1], far[middle], far[-1]))
    width = next(w for w in (2, 4, 8) if np.abs(points).max(initial=0) < 2 ** (8 * w - 1))
    whole = [points[order], np.array(vantages, dtype=np.int64).reshape(-1, points.shape[1])]
    whole = [x.astype(f"<i{width}").tobytes() for x in whole]
    row = [ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), whole[0], points.shape[1], width, whole[1], np.array(bounds, dtype="<f8").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _TREE_TYPES, strict=True)], schema=_TREE_TYPES)


def _pad(points: np.ndarray, dim: int) -> np.ndarray:
    return points if points.shape[1] >= dim else np.pad(points, ((0, 0), (0, dim - points.shape[1])))


def trees(rows: DataFrame) -> DataFrame:
    """A tree for every BLOCK rows of a partition."""

    def run(batches):
        held: list[tuple] = []

        def planted():
            dim = max(p.shape[1] for *_, p in held)
            return _plant(*(np.concatenate(x) for x in zip(*[(i, lab, _pad(p, dim)) for i, lab, p in held], strict=True)))

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))))
            if sum(len(i) for i, *_ in held) > BLOCK - 2000:
                yield planted()
                held = []
        if held:
            yield planted()

    return rows.select("id", "label", "vector").mapInArrow(run, schema(_TREE))


class Tree:
    def __init__(self, ids: bytes, labels: bytes, points: bytes, dim: int, width: int, vantages: bytes, bounds: bytes):
        whole = lambda x: np.frombuffer(x, dtype=f"<i{width}").reshape(-1, dim).astype(np.float64)
        ids, labels = np.frombuffer(ids, dtype="<i8"), np.frombuffer(labels, dtype="<i8")
        points, self.vantages, self.bounds = whole(points), whole(vantages), np.frombuffer(bounds, dtype="<f8").reshape(-1, 4)
        self.largest, self.dim = (points * points).sum(axis=1).max(), dim
        ends = _segments(len(ids))[-1]
        self.depth = len(_segments(len(ids))) - 1
        # Leaves of equal size: a place past a leaf's end repeats its last row and counts for nothing.
        place = ends[:-1, None] + np.arange(np.diff(ends).max())
        self.real = place < ends[1:, None]
        place = np.minimum(place, ends[1:, None] - 1)
        self.ids, self.labels, self.points = ids[place], labels[place], points[place]

    def leaf_bounds(self, anchors: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the least score that a row of each leaf can have."""
        base = (self.largest + squares)[:, None]
        far = np.sqrt(np.maximum(base - 2 * (anchors @ self.vantages.T), 0))
        margin = 1e-9 * (np.sqrt(base) + 1)
        near, most = np.zeros((len(anchors), 1)), np.full((len(anchors), 1), np.inf)
        for level in range(self.depth):
            node = slice(2**level - 1, 2 ** (level + 1) - 1)
            d, (inner_min, inner_max, outer_min, outer_max) = far[:, node], self.bounds[node].T
            low = [np.maximum(near, np.maximum(d - big, small - d)) for small, big in ((inner_min, inner_max), (outer_min, outer_max))]
            high = [np.minimum(most, d + big) for big in (inner_max, outer_max)]
            near, most = (np.stack(x, axis=2).reshape(len(anchors), -1) for x in (low, high))
        largest = (base - np.maximum(near - margin, 0) ** 2) / 2
        return np.floor(largest + 1e-9 * base + 0.5), np.ceil((base - (most + margin) ** 2) / 2 - 1e-9 * base - 0.5)

    def search(self, query: dict[str, np.ndarray], chosen: np.ndarray, best_score: np.ndarray, best_id: np.ndarray) -> None:
        """Enter the rows of this tree into the lists of the chosen anchors, (anchor, window, rank), by score, then id."""
        full = query["points"][chosen]
        dim, squares = min(full.shape[1], self.dim), (full * full).sum(axis=1)
        anchors = _pad(full[:, :dim], self.dim)
        most, least = self.leaf_bounds(anchors, squares)
        low, high = query["low"][chosen], query["high"][chosen]  # (anchor, window)
        order = np.argsort(-most, axis=1, kind="stable")
        for visit in range(order.shape[1]):
            leaf = order[:, visit]
            row = np.arange(len(leaf))
            worst = np.maximum(best_score[chosen, :, -1], low)
            able = (most[row, leaf][:, None] >= worst) & (least[row, leaf][:, None] <= high)
            if not (most[row, leaf][:, None] >= worst).any():
                return
            on = np.flatnonzero(able.any(axis=1))
            if not len(on):
                continue
            leaf = leaf[on]
            score = np.matmul(self.points[leaf], anchors[on, :, None])[:, :, 0].astype(np.int64)
            fits = self.real[leaf] & (self.ids[leaf] != query["ids"][chosen[on], None])
            fits &= (self.labels[leaf] == query["labels"][chosen[on], None]) == query["same"]
            fits = fits[:, None] & (score[:, None] >= worst[on][:, :, None]) & (score[:, None] <= high[on][:, :, None]) & able[on][:, :, None]
            a, w = np.nonzero(fits.any(axis=2))
            if not len(a):
                continue
            into = (chosen[on[a]], w)
            scores = np.concatenate([best_score[into], np.where(fits[a, w], score[a], NOWHERE)], axis=1)
            ids = np.concatenate([best_id[into], self.ids[leaf[a]]], axis=1)
            k = best_score.shape[2]
            by = np.lexsort((ids, -1 - scores), axis=1)
            scores, ids = np.take_along_axis(scores, by, axis=1), np.take_along_axis(ids, by, axis=1)
            # A row that two trees hold counts once: equal entries lie side by side.
            twice = np.zeros(scores.shape, dtype=bool)
            twice[:, 1:] = (scores[:, 1:] == scores[:, :-1]) & (ids[:, 1:] == ids[:, :-1])
            by = np.argsort(twice, axis=1, kind="stable")[:, :k]
            scores = np.where(np.take_along_axis(twice, by, axis=1), NOWHERE, np.take_along_axis(scores, by, axis=1))
            best_score[into], best_id[into] = scores, np.take_along_axis(ids, by, axis=1)


_FOUND = "query int, window int, id long, score long"
_FOUND_TYPES = pa.schema([("query", pa.int32()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def nearest(forest: DataFrame, query: dict, k: int) -> DataFrame:
    """(query, window, rank, id, score): the k rows of highest score in every window of every anchor. `query` holds points, ids and
    labels of the anchors, the windows' lowest and highest scores, and whether rows of the same label are wanted."""

    def run(batches):
        n, windows = query["low"].shape
        score, ident = np.full((n, windows, k), NOWHERE), np.zeros((n, windows, k), dtype=np.int64)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(batch.num_columns)), strict=True):
                tree = Tree(*(x.as_py() for x in row))
                for first in range(0, n, AT_ONCE):
                    tree.search(query, np.arange(first, min(n, first + AT_ONCE)), score, ident)
        a, w, r = np.nonzero(score > NOWHERE)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(w, pa.int32()), pa.array(ident[a, w, r]), pa.array(score[a, w, r])], schema=_FOUND_TYPES)

    found = forest.mapInArrow(run, schema(_FOUND)).distinct()
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its POSITIVES best rows
    of the same label, the NEGATIVES best rows of other labels whose score is LOWEST to HIGHEST percent of the positive's."""
    spark = df.sparkSession
    rows = rows_of(df, vec_id, F.col("label") if label is None else label, vector, anchor)
    forest = materialise(trees(rows), "trees")
    asked = rows.where("anchor")
    blocks = 1 + asked.count() // ANCHORS
    out = spark.createDataFrame([], schema("anchor long, positive long, rank int, id long, positive_score long, score long"))
    for block in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "label", "vector").distinct().toArrow()
        if not here.num_rows:
            continue
        ids, n = here["id"].to_numpy(), here.num_rows
        query = {"points": matrix(here["vector"]).astype(np.float64), "ids": ids, "labels": here["label"].to_numpy(), "same": True}
        anywhere = {"low": np.full((n, 1), NOWHERE + 1), "high": np.full((n, 1), 2**62)}
        near = nearest(forest, query | anywhere, POSITIVES).toPandas()  # at most POSITIVES rows an anchor of the block
        if near.empty:
            continue
        low, high = np.ones((n, POSITIVES), dtype=np.int64), np.zeros((n, POSITIVES), dtype=np.int64)
        at = near["query"].to_numpy(), near["rank"].to_numpy() - 1
        low[at], high[at] = -(-LOWEST * near["score"].to_numpy() // 100), HIGHEST * near["score"].to_numpy() // 100
        found = nearest(forest, query | {"low": low, "high": high, "same": False}, NEGATIVES)
        asked_for = [(int(q), int(r) - 1, int(ids[q]), int(i), int(s)) for q, r, i, s in zip(near["query"], near["rank"], near["id"], near["score"], strict=True)]
        names = spark.createDataFrame(asked_for, schema("query int, window int, anchor long, positive long, positive_score long"))
        out = out.unionByName(found.join(F.broadcast(names), ["query", "window"]).select("anchor", "positive", "rank", "id", "positive_score", "score"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        null("anchor").alias("anchor_id"), null("positive").alias("positive_id"), "rank", null("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
