"""Alignment of sequences: exact dynamic time warping, its path, distances, curve warping."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import pieces, written

MCD_FACTOR = 10 * 2**0.5 / 2.302585092994046


def dtw_cost(a: Column, b: Column) -> Column:
    """Least sum of |x - y| over all monotone paths, as a column for short arrays: a fold over the rows that keeps one row of costs, and copies it for each cell."""
    inf = F.lit(float("inf"))

    def row(before: Column, x: Column, first: Column) -> Column:
        # left, diagonal and up of each cell; the first row has only left, the first cell none
        def cell(acc: Column, y: Column) -> Column:
            j = F.size(acc)
            up = F.coalesce(F.get(before, j), inf)
            diagonal = F.when(j > 0, F.coalesce(F.get(before, j - 1), inf)).otherwise(inf)
            left = F.when(j > 0, F.coalesce(F.get(acc, j - 1), inf)).otherwise(inf)
            best = F.when(first & (j == 0), F.lit(0.0)).otherwise(F.least(up, diagonal, left))
            return F.concat(acc, F.array(F.abs(x - y) + best))

        return F.aggregate(b, F.array().cast("array<double>"), cell)

    costs = F.aggregate(a, F.array().cast("array<double>"), lambda acc, x: row(acc, x, F.size(acc) == 0))
    return F.element_at(costs, -1)


def _totals(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Least costs of reaching each cell of a tile of Euclidean distances of frames, in a matrix with the row above (its first value is the corner) and the column before."""
    n, m = len(x), len(y)
    total = np.empty((n + 1, m + 1))
    total[0], total[1:, 0] = top, left
    # along anti-diagonals all cells are independent
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        cost = np.sqrt(((x[i] - y[j]) ** 2).sum(-1))
        total[i + 1, j + 1] = cost + np.minimum(np.minimum(total[i, j + 1], total[i + 1, j]), total[i, j])
    return total


def _steps_back(total: np.ndarray, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
    """The cells from (i, j) back to the edge of the tile, and the cell beyond it (-1 above or before); of equal steps the diagonal first, then up, then left."""
    i, j, path = i + 1, j + 1, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        steps = ((i - 1, j - 1), (i - 1, j), (i, j - 1))
        i, j = min(steps, key=lambda s: total[s])
    return path, i - 1, j - 1


def _begin(n: int, m: int, first_row: bool, first_column: bool, top: list | None, left: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The row above and the column before a tile; outside of the matrix only the corner of its first cell can be come from."""
    above = np.full(m + 1, np.inf) if first_row else np.asarray(top, float)
    if first_row and first_column:
        above[0] = 0.0
    return above, np.full(n, np.inf) if first_column else np.asarray(left, float)


def _frames(values: list) -> np.ndarray:
    return np.array([list(v) for v in values], float)


_PATHS = pa.schema([("pair_id", pa.int64()), ("cost", pa.float64()), ("path", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))])


def dtw_paths(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, a, b: array<array<double>>) to pair_id, cost, path: Euclidean distances of frames. A pair is one row and its matrix one task's: for pairs of
    a few thousand frames; longer ones go through tiled_paths."""

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch)):
            out = []
            for pair_id, a, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                x, y = _frames(a), _frames(b)
                total = _totals(x, y, *_begin(len(x), len(y), True, True, None, None))
                path = _steps_back(total, len(x) - 1, len(y) - 1)[0][::-1]
                out.append({"pair_id": pair_id, "cost": float(total[-1, -1]), "path": [{"i": i, "j": j} for i, j in path]})
            yield pa.RecordBatch.from_pylist(out, _PATHS)

    return pairs.select("pair_id", "a", "b").mapInArrow(run, "pair_id long, cost double, path array<struct<i:int,j:int>>")


#: Frames of a side of a tile: its matrix has 32 MB.
TILE = 2048


def _slices(frames: DataFrame, name: str, values: str, tile: int) -> DataFrame:
    """frames(pair_id, k, v) in slices of a tile's side: pair_id, name (the slice's number), values (its frames in order)."""
    rows = frames.groupBy("pair_id", F.floor(F.col("k") / tile).cast("int").alias(name)).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))  # `tile` frames
    return rows.select("pair_id", name, F.transform("s", lambda s: s["v"]).alias(values))


_TILES = "pair_id long, ti int, tj int, bottom array<double>, right array<double>"
_STEPS = "pair_id long, at_i int, at_j int, cost double, path array<struct<i:int,j:int>>"


def tiled_paths(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """pair_id, cost, i, j: the cells of the cheapest path of each pair, as dtw_paths finds it, for sequences of any length.

    a, b: (pair_id, k, v array<double>), a row for each frame, k from 0. The matrix of costs is cut into tiles. Tiles of one anti-diagonal don't depend on each other:
    they are the rows of a step, and hand on their last row and column alone, so of the whole matrix only the edges of tiles are kept, as written tables. From the
    last cell the path is followed back a tile at a time; each one on its way is worked out again from its edges. Steps are as many as there are anti-diagonals of tiles.
    """
    a, b = written(_slices(a, "ti", "x", tile), "slices-a"), written(_slices(b, "tj", "y", tile), "slices-b")
    ends = a.groupBy("pair_id").agg(F.max("ti").alias("last_i")).join(b.groupBy("pair_id").agg(F.max("tj").alias("last_j")), "pair_id")
    waves = ends.agg(F.max(F.col("last_i") + F.col("last_j"))).first()[0]
    if waves is None:
        return a.select("pair_id", F.lit(0.0).alias("cost"), F.lit(0).alias("i"), F.lit(0).alias("j")).limit(0)
    none = a.sparkSession.createDataFrame([], _TILES)
    edges: dict[int, DataFrame] = {-1: none}

    def with_edges(tiles: DataFrame, wave: int) -> DataFrame:
        above = edges[wave - 1].select("pair_id", (F.col("ti") + 1).alias("ti"), "tj", F.col("bottom").alias("top"))
        before = edges[wave - 1].select("pair_id", "ti", (F.col("tj") + 1).alias("tj"), F.col("right").alias("left"))
        return tiles.join(above, ["pair_id", "ti", "tj"], "left").join(before, ["pair_id", "ti", "tj"], "left")

    def forward(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = _frames(r.x), _frames(r.y)
                total = _totals(x, y, *_begin(len(x), len(y), r.ti == 0, r.tj == 0, r.top, r.left))
                yield pd.DataFrame([(r.pair_id, r.ti, r.tj, total[-1].tolist(), total[1:, -1].tolist())], columns=["pair_id", "ti", "tj", "bottom", "right"])

    def backward(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y, oi, oj = _frames(r.x), _frames(r.y), r.ti * tile, r.tj * tile
                total = _totals(x, y, *_begin(len(x), len(y), r.ti == 0, r.tj == 0, r.top, r.left))
                path, i, j = _steps_back(total, r.at_i - oi, r.at_j - oj)
                cells = [{"i": oi + p, "j": oj + q} for p, q in path]
                yield pd.DataFrame([(r.pair_id, oi + i, oj + j, float(total[r.at_i - oi + 1, r.at_j - oj + 1]), cells)], columns=["pair_id", "at_i", "at_j", "cost", "path"])

    for wave in range(waves + 1):
        tiles = a.withColumn("tj", F.lit(wave) - F.col("ti")).join(b, ["pair_id", "tj"])
        edges[wave] = written(with_edges(tiles, wave).mapInPandas(forward, _TILES), f"tiles{wave}")
    # the last frame of each side
    heads = a.select("pair_id", F.col("ti").alias("last_i"), F.size("x").alias("n")).join(ends, ["pair_id", "last_i"]).join(b.select("pair_id", F.col("tj").alias("last_j"), F.size("y").alias("m")), ["pair_id", "last_j"])
    at = heads.select("pair_id", (F.col("last_i") * tile + F.col("n") - 1).alias("at_i"), (F.col("last_j") * tile + F.col("m") - 1).alias("at_j"))
    found = []
    for wave in range(waves, -1, -1):
        rows = at.where("at_i >= 0 and at_j >= 0").withColumns({"ti": F.floor(F.col("at_i") / tile).cast("int"), "tj": F.floor(F.col("at_j") / tile).cast("int")})
        here = rows.where(F.col("ti") + F.col("tj") == wave).join(a, ["pair_id", "ti"]).join(b, ["pair_id", "tj"])
        steps = written(with_edges(here, wave).mapInPandas(backward, _STEPS), f"path{wave}")
        found.append(steps)
        at = written(rows.where(F.col("ti") + F.col("tj") < wave).select("pair_id", "at_i", "at_j").unionByName(steps.select("pair_id", "at_i", "at_j")), "cells")
    steps = reduce(DataFrame.unionByName, found)
    cost = steps.groupBy("pair_id").agg(F.max("cost").alias("cost"))  # that of the last cell; costs never fall along a path
    return steps.select("pair_id", F.explode("path").alias("p")).select("pair_id", "p.i", "p.j").join(cost, "pair_id").select("pair_id", "cost", "i", "j")


def mel_cepstral_distortion(paths: DataFrame) -> DataFrame:
    """Mean distance along the path, in dB."""
    return paths.select("pair_id", (F.lit(MCD_FACTOR) * F.col("cost") / F.size("path")).alias("mcd"))


def warped_curve(paths: DataFrame, curve: DataFrame, n: DataFrame) -> DataFrame:
    """The mean of the source values that a path leads to each target place; holes are filled forward.

    paths(pair_id, path), curve(pair_id, i, v), n(pair_id, n): gives pair_id, j, v.
    """
    from .segments import forward_filled

    steps = paths.select("pair_id", F.explode("path").alias("p")).select("pair_id", "p.i", "p.j")
    means = steps.join(curve, ["pair_id", "i"]).groupBy("pair_id", "j").agg(F.avg("v").alias("v"))
    places = n.select("pair_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return forward_filled(places.join(means, ["pair_id", "j"], "left"), "v", "j", "pair_id").select("pair_id", "j", F.col("filled").alias("v"))


def pairwise_distances(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, a, b: array<double>) to all |a_i - b_j| of a pair."""
    rows = pairs.select("pair_id", F.posexplode("a").alias("i", "x"), "b").select("pair_id", "i", "x", F.posexplode("b").alias("j", "y"))
    return rows.select("pair_id", "i", "j", F.abs(F.col("x") - F.col("y")).alias("d"))
