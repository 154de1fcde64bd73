"""Hard-negative mining by dual-tree search, exact in integers.

Rows with integer vectors stand in one index table, ordered by label, cell and a running number: a cell is the nearest pivot, a leaf centre of a tree
over a bounded sample. Ranges of this order are the tasks' shares, so no label or cell is one task's, however large it is; each batch of rows that
a task reads is grown into a tree (by label first, then halves along the longest spread) down to leaves of LEAF rows.

Anchors are taken in shards of SHARD components, each one a tree of the same kind that all tasks get (16 MB of components; the shards are bounded by
this, the number of passes grows with the anchors). Both trees are walked together. A node is a centre and a radius; for any anchor and row of a pair
of nodes the inner product lies in centre * centre -+ (|centre| * other radius, both ways, + radius * radius). Pairs whose interval lies wholly under
what each anchor of the node still needs, or wholly over what it may take, go with all anchors of the group at once, as do pairs without
(or with nothing but) equal labels. Leaf pairs that stay are scored exactly.

What an anchor needs starts at its bound from the sample, a subset of the rows, and rises with what the task has found. A task hands on the best
few of each anchor; a window merges them. The first walk finds the positives, the second the negatives of each within the range of scores.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of unequal length count as filled up
with zeros; inner products that may reach 2^53 are an error. Equal scores go by the smaller id. Repeated rows count each, as positives
and as negatives; repeated anchor rows are one anchor, and no row with the anchor's own id is its positive. An anchor without positives, or a positive
without negatives in range, gives no row. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, new_path, pieces_of, stored
from .vector_codes import matrix, whole_numbers

SCALE = 256
#: Rows of the sample that pivots and first bounds come from; rows of a leaf; components of the anchors of a shard and of a batch.
SAMPLE, LEAF, SHARD = 4096, 64, 1 << 21
#: Finds that a task holds before it sorts them and raises its bounds.
HELD = 1 << 17


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes: centre, radius, range of rows, children (-1 for a leaf), labels as 64 hashed bits and whether there is but one."""

    order: np.ndarray
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bits: np.ndarray
    label: np.ndarray
    single: np.ndarray


def _halves(x: np.ndarray, labels: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Places of the rows, such that the first half is one side: by label where there are several, else along the line between two far rows."""
    if labels.min() != labels.max():
        return np.argsort(labels, kind="stable")
    one = x[((x - centre) ** 2).sum(1).argmax()]
    other = x[((x - one) ** 2).sum(1).argmax()]
    return np.argsort(x @ (other - one), kind="stable")


def grown(x: np.ndarray, labels: np.ndarray) -> Tree:
    """The tree of rows x (float64)."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    bit = np.uint64(1) << (labels % 64).astype(np.uint64)
    while todo:
        start, stop, parent, side = todo.pop()
        at = order[start:stop]
        own, lab = x[at], labels[at]
        centre = own.mean(0)
        me = len(nodes)
        nodes.append([centre, np.sqrt(((own - centre) ** 2).sum(1).max()), start, stop, -1, -1, np.bitwise_or.reduce(bit[at]), lab[0], lab.min() == lab.max()])
        if parent >= 0:
            nodes[parent][4 + side] = me
        if stop - start > LEAF:
            by = _halves(own, lab, centre)
            order[start:stop] = at[by]
            middle = start + (stop - start) // 2
            if lab.min() != lab.max():  # at the change of label that is nearest to the middle
                changes = start + 1 + np.flatnonzero(np.diff(lab[by]))
                middle = int(changes[np.abs(changes - middle).argmin()])
            todo += [(start, middle, me, 0), (middle, stop, me, 1)]
    centre, radius, start, stop, left, right, bits, label, single = (np.array(c) for c in zip(*nodes, strict=True))
    return Tree(order, centre, np.sqrt((centre**2).sum(1)), radius, start, stop, left, right, bits, label, single)


@dataclass
class Wanted:
    """Anchors in the order of their tree, each with as many requests: the best k rows with least <= score <= most, of its own label or of others."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    tree: Tree
    least: np.ndarray  # anchors x requests
    most: np.ndarray
    k: int
    same: bool


class Walk:
    """The dual-tree search of a task: rows come in batches, what it finds is held until the end."""

    def __init__(self, wanted: Wanted):
        self.w, self.least = wanted, wanted.least.copy()
        self.norms = np.sqrt((wanted.x**2).sum(1))
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held, self.scored, self.pairs = 0, 0, 0

    def settle(self) -> None:
        """Keep the best k of each request and raise its bound to the last of them."""
        if not self.found:
            return
        request, score, ident = (np.concatenate(c) for c in zip(*self.found, strict=True))
        by = np.lexsort((ident, -score, request))
        request, score, ident = request[by], score[by], ident[by]
        first = np.r_[True, request[1:] != request[:-1]]
        rank = np.arange(len(request)) - np.maximum.accumulate(np.where(first, np.arange(len(request)), 0))
        keep, last = rank < self.w.k, rank == self.w.k - 1
        flat = self.least.reshape(-1)
        flat[request[last]] = np.maximum(flat[request[last]], score[last])
        self.found, self.held = [(request[keep], score[keep], ident[keep])], 0

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node of the anchors' tree the least and the most score that any request in it takes."""
        t = self.w.tree
        low, high = np.empty(len(t.start)), np.empty(len(t.start))
        least, most = self.least.min(1), np.where(np.isfinite(self.least) | (self.least < 0), self.w.most, -np.inf).max(1)
        for i in range(len(t.start) - 1, -1, -1):  # children come after their parent
            if t.left[i] < 0:
                low[i], high[i] = least[t.start[i] : t.stop[i]].min(), most[t.start[i] : t.stop[i]].max()
            else:
                low[i], high[i] = min(low[t.left[i]], low[t.right[i]]), max(high[t.left[i]], high[t.right[i]])
        return low, high

    def _leaf_pairs(self, t: Tree) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of leaves (of anchors, of rows) that no interval rules out."""
        a, (low, high) = self.w.tree, self._bounds()
        i, j, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(i):
            middle = np.einsum("nd,nd->n", a.centre[i], t.centre[j])
            slack = a.norm[i] * t.radius[j] + t.norm[j] * a.radius[i] + a.radius[i] * t.radius[j]
            slack += 1e-9 * (1 + slack + a.norm[i] * t.norm[j])  # rounding
            self.pairs += len(i)
            fits = (a.bits[i] & t.bits[j]) != 0 if self.w.same else ~(a.single[i] & t.single[j] & (a.label[i] == t.label[j]))
            keep = fits & (middle + slack >= low[i]) & (middle - slack <= high[i])
            i, j = i[keep], j[keep]
            leaf_a, leaf_t = a.left[i] < 0, t.left[j] < 0
            done = leaf_a & leaf_t
            out.append((i[done], j[done]))
            i, j, leaf_a, leaf_t = i[~done], j[~done], leaf_a[~done], leaf_t[~done]
            down = ~leaf_a & (leaf_t | (a.radius[i] > t.radius[j]))
            i, j = np.r_[a.left[i[down]], a.right[i[down]], i[~down], i[~down]], np.r_[j[down], j[down], t.left[j[~down]], t.right[j[~down]]]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def take(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        w, a, t = self.w, self.w.tree, grown(x, labels)
        ids, labels, x = ids[t.order], labels[t.order], x[t.order]
        i, j = self._leaf_pairs(t)
        by = np.argsort(j, kind="stable")
        i, j = i[by], j[by]
        n = w.least.shape[1]
        for group in np.split(np.arange(len(j)), np.flatnonzero(np.diff(j)) + 1) if len(j) else []:
            leaf = j[group[0]]
            who = np.concatenate([np.arange(a.start[k], a.stop[k]) for k in i[group]])
            middle, slack = w.x[who] @ t.centre[leaf], self.norms[who] * t.radius[leaf]
            slack += 1e-9 * (1 + slack + np.abs(middle))
            who = who[(middle + slack >= self.least[who].min(1)) & (middle - slack <= w.most[who].max(1))]
            if not len(who):
                continue
            rows = slice(t.start[leaf], t.stop[leaf])
            score = w.x[who] @ x[rows].T
            self.scored += score.size
            equal = w.labels[who][:, None] == labels[rows]
            fits = equal & (w.ids[who][:, None] != ids[rows]) if w.same else ~equal
            for r in range(n):
                at, row = np.nonzero(fits & (score >= self.least[who, r][:, None]) & (score <= w.most[who, r][:, None]))
                if len(at):
                    self.found.append((who[at] * n + r, score[at, row], ids[rows][row]))
                    self.held += len(at)
            if self.held > HELD:
                self.settle()
        self.settle()


def search(index: DataFrame, wanted: Wanted, width: int) -> DataFrame:
    """anchor (its place in wanted), request, vec_id, score: the best k of each request by share of the index, merged."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, n = Walk(sent.value), sent.value.least.shape[1]
        for batch in batches:
            for b in pieces_of(batch, max(LEAF, SHARD // (4 * width)), SHARD * 8):
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i4").reshape(-1, width)
                walk.take(b.column(0).to_numpy(), b.column(1).to_numpy(), x.astype(np.float64))
        if walk.found:
            request, score, ident = walk.found[0]
            yield pa.RecordBatch.from_arrays([pa.array((request // n).astype(np.int32)), pa.array((request % n).astype(np.int32)), pa.array(ident), pa.array(score.astype(np.int64))], ["anchor", "request", "vec_id", "score"])

    part = index.select("vec_id", "label", "x").mapInArrow(run, "anchor int, request int, vec_id long, score long")
    best = Window.partitionBy("anchor", "request").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted.k)


def _bounded(x: np.ndarray, labels: np.ndarray, ids: np.ndarray, sample: tuple[np.ndarray, ...], least: np.ndarray, most: np.ndarray, k: int, same: bool) -> np.ndarray:
    """least, raised to the k-th best score that each request has in the sample."""
    s_ids, s_labels, s_x = sample
    out = least.copy()
    for at in range(0, len(x), 256):
        to = slice(at, at + 256)
        score, equal = x[to] @ s_x.T, labels[to][:, None] == s_labels
        fits = equal & (ids[to][:, None] != s_ids) if same else ~equal
        for r in range(least.shape[1]):
            inside = np.where(fits & (score >= least[to, r][:, None]) & (score <= most[to, r][:, None]), score, -np.inf)
            if inside.shape[1] >= k:
                out[to, r] = np.maximum(out[to, r], np.partition(inside, -k, axis=1)[:, -k])
    return out


def indexed(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, x (components as 32-bit integers), in ranges of label, cell and running number, as a stored table."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    half = (pivots**2).sum(1) / 2

    def make():
        def step(b):
            x = matrix(b.column(2), width)
            cell = (x.astype(np.float64) @ sent.value.T - half).argmax(1)
            return {"vec_id": b.column(0), "label": b.column(1), "cell": cell.astype(np.int32), "place": np.arange(len(x), dtype=np.int32), "x": [v.tobytes() for v in x.astype("<i4")]}

        return step

    cells = map_batches(rows.select("vec_id", "label", "q"), make, "vec_id long, label long, cell int, place int, x binary")
    order = ["label", "cell", "place"]
    return stored(cells.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "x"), "index")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, q (array<long>). Of each row for which anchors holds: its best `positives` rows of the same label, and of each of these the best
    `negatives` rows of other labels whose score is low to high percent of the positive's.
    """
    spark, schema = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = rows.where("vec_id is not null and label is not null and q is not null")
    sample = rows.orderBy(F.xxhash64("vec_id", "q")).select("vec_id", "label", "q").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    longest, most = rows.agg(F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    width = max(1, longest)
    if width * (most or 0) ** 2 >= 1 << 53:
        raise ValueError("inner products may reach 2^53")
    s_x = matrix(sample.column("q").combine_chunks(), width).astype(np.float64)
    known = (sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), s_x)
    tree = grown(s_x, np.zeros(len(s_x), np.int64))
    index = indexed(rows, tree.centre[tree.left < 0], width)
    asked = index.where(anchors).dropDuplicates(["vec_id", "label", "x"])
    shards = max(1, -(-asked.count() // max(1, SHARD // width)))
    asked = stored(asked.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards))), "anchors")
    path = new_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for shard in range(shards):
        own = asked.where(F.col("shard") == shard).select("vec_id", "label", "x").toArrow()  # SHARD components, give or take the hash
        if own.num_rows:
            _mined(index, own, known, width, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mined(index: DataFrame, own: pa.Table, known: tuple[np.ndarray, ...], width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """mine() for the anchors of a shard."""
    x = np.frombuffer(b"".join(own.column("x").to_pylist()), "<i4").reshape(-1, width).astype(np.float64)
    ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
    tree = grown(x, labels)
    ids, labels, x = ids[tree.order], labels[tree.order], x[tree.order]
    least, most = np.full((len(x), 1), -np.inf), np.full((len(x), 1), np.inf)
    bound = _bounded(x, labels, ids, known, least, most, positives, True)
    best = stored(search(index, Wanted(ids, labels, x, tree, bound, most, positives, True), width), "positives")
    got = best.select("anchor", "rank", "score").toArrow()  # `positives` rows for each anchor of the shard
    at, p = (got.column("anchor").to_numpy(), got.column("rank").to_numpy() - 1), got.column("score").to_numpy()
    least, most = np.full((len(x), positives), np.inf), np.full((len(x), positives), -np.inf)
    least[at], most[at] = -(-low * p // 100), high * p // 100
    least = np.where(least <= most, least, np.inf)
    bound = _bounded(x, labels, ids, known, least, most, negatives, False)
    found = search(index, Wanted(ids, labels, x, tree, bound, most, negatives, False), width)
    names = index.sparkSession.createDataFrame(pa.table({"anchor": pa.array(range(len(ids)), pa.int32()), "anchor_id": ids}))
    pairs = best.select("anchor", (F.col("rank") - 1).alias("request"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(F.broadcast(names), "anchor")
    out = found.join(pairs, ["anchor", "request"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def of_embeddings(vectors: DataFrame) -> DataFrame:
    """mine() of a table of embeddings: components in 256ths, labels of every seventh id moved on by one, every fiftieth id an anchor."""
    rows = whole_numbers(vectors, SCALE)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def oracle() -> str:
    """of_embeddings() in DuckDB's SQL."""
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER () AS an FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0)),
s AS MATERIALIZED (SELECT an, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(v.q)) + 1), lambda i: a.q[i] * v.q[i])), 0) AS BIGINT) AS score FROM a, v),
p AS (SELECT an, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) AS slot FROM s WHERE same AND vec_id <> anchor_id QUALIFY slot <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY an, slot ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (an) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
