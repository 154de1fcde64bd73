"""Alignment by tiles against the whole matrix, and on a matrix that no task could hold."""

import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from speechmill.operators import align


def _rows(spark, sequences):
    return spark.createDataFrame([(p, k, [float(c) for c in v]) for p, x in sequences.items() for k, v in enumerate(x)], "pair_id long, k int, v array<double>")


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_tiles_give_the_path_of_the_whole_matrix(spark, tile):
    rng = np.random.default_rng(tile)
    a, b = {}, {}
    for p, (n, m) in enumerate([(1, 1), (1, 9), (10, 1), (20, 13), (7, 7), (14, 21)]):
        a[p], b[p] = rng.integers(0, 3, (n, 2)), rng.integers(0, 3, (m, 2))  # few values, so many ties
    whole = spark.createDataFrame([(p, a[p].astype(float).tolist(), b[p].astype(float).tolist()) for p in a], "pair_id long, a array<array<double>>, b array<array<double>>")
    want = {r.pair_id: (r.cost, [(s.i, s.j) for s in r.path]) for r in align.dtw_paths(whole).collect()}
    got = {}
    for r in align.tiled_paths(_rows(spark, a), _rows(spark, b), tile).orderBy("pair_id", "i", "j").collect():
        got.setdefault(r.pair_id, (r.cost, []))[1].append((r.i, r.j))
    assert got == want


def test_path_of_a_matrix_by_hand(spark):
    whole = spark.createDataFrame([(1, [[0.0], [1.0], [2.0]], [[0.0], [2.0]])], "pair_id long, a array<array<double>>, b array<array<double>>")
    row = align.dtw_paths(whole).first()
    assert row.cost == 1.0 and [(p.i, p.j) for p in row.path] == [(0, 0), (1, 0), (2, 1)]


def test_long_sequences(spark):
    """9,000 x 9,000 frames: 0.6 GB as one matrix, 32 MB a tile here."""
    n = 9000
    one = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.col("id").cast("int").alias("k"), F.array(F.sin(F.col("id") / 50)).alias("v"))
    late = one.withColumn("v", F.array(F.sin((F.col("k") - 20) / 50)))
    began = time.time()
    path = align.tiled_paths(one, late).toPandas()
    assert time.time() - began < 180
    assert path.i.min() == path.j.min() == 0 and path.i.max() == path.j.max() == n - 1
    middle = path[(path.i > 1000) & (path.i < 8000)]
    assert abs((middle.j - middle.i).median() - 20) <= 1


def test_no_pairs(spark):
    none = _rows(spark, {1: [[0.0]]}).where("false")
    assert align.tiled_paths(none, none).count() == 0
