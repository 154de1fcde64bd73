"""op8: learning covers all lines, and words are cut by one rule."""

from pyspark.sql import functions as F

from speechmill.llm import license_scan


def test_examples_count_every_line(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line x{i}y{k} of its own" for k in range(50)) + ("\n\nto the\nReleased under the MIT license" if i % 2 else "")) for i in range(100)], "doc_id long, text string")
    lines = license_scan.paragraphs(docs)
    count = lambda weight: license_scan.examples(lines, weight).where("family = 'unknown'").agg(F.sum("weight")).first()[0] - 3 * len(license_scan.OTHER)
    # 5,000 lines of their own and 50 of two words; those that name a licence are left out
    assert count(1e9) == 5050
    assert abs(count(100.0) - 100.0) < 1e-6


def test_words_by_one_rule(spark):
    odd = ["a--b -x +.y c.d. e.-f", "--", "", "BSD 3-Clause, v2.0.", "Ünï-cödé №5 x_y", "..a+b+c..", "a.b-c+d e- -f"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    plain = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}.+-]+|[.+-]+(?![\p{L}\p{N}])", " "), " "), lambda w: w != "")
    for r in rows.select(license_scan.words(F.col("t")).alias("a"), plain.alias("b")).collect():
        assert r.a == r.b


def test_words_are_hashed_by_slices(monkeypatch):
    """Slices don't change the hashes, and memory follows the slice, not the batch."""
    import tracemalloc

    import numpy as np

    from speechmill.llm import common

    batch = ["one two  three", "", "x" * 300, "\n", "Four five"] * 20_000
    plain = [common.hashed_words([x]) for x in batch[:5]]
    tracemalloc.start()
    words, sizes = common.hashed_words(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.tolist() == np.concatenate([p[0] for p in plain]).tolist() * 20_000 and sizes.tolist() == [3, 0, 1, 0, 2] * 20_000
    assert peak < 120 << 20
    monkeypatch.setattr(common, "HASHED_BYTES", 1 << 40)
    assert np.array_equal(common.hashed_words(batch)[0], words)
