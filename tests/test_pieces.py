"""What a task holds as Python objects is a few rows of a batch."""

import pyarrow as pa

from speechmill import shared


def test_a_batch_goes_by_a_few_rows():
    batch = pa.RecordBatch.from_pydict({"x": list(range(200))})
    parts = list(shared.pieces(batch))
    assert [p.num_rows for p in parts] == [64, 64, 64, 8] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(200))


def test_long_alignment_takes_tiles_of_full_size(spark, monkeypatch):
    from speechmill.operators import align
    from speechmill.plans import QUERIES

    sides = []
    own = align.tiled_paths
    monkeypatch.setattr(align, "tiled_paths", lambda a, b, tile=align.TILE: sides.append(tile) or own(a, b, tile))
    assert QUERIES["m1_tiled_path"](spark, "/root/testdata/sf0.001").count() > 0 and sides == [align.TILE]


def test_words_are_said_once(spark):
    """Transliteration works out a word's sounds once, not again for each test of them, and turns go over several tasks."""
    from speechmill.functions import text as X
    from speechmill.plans import QUERIES
    from pyspark.sql import functions as F

    assert X.transliterate(F.col("said"))._jc.toString().count("regexp_extract_all(said,") == 1
    for name in ("x16_translate", "x17_transliterate"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
