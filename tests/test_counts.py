"""Counts of n-grams: made once where a query reads them more than once, and by runs of characters."""

import pytest

from speechmill.functions import text as X
from speechmill.operators import lm
from speechmill.plans import QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["j11_m14_laplace", "m18_contextual_bias", "j9_m17_token_bias"])
def test_texts_are_not_counted_again_for_each_join(spark, name):
    read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "documents.parquet" in f]


def test_sentences_lose_blanks_at_their_ends_alone(spark):
    rows = spark.createDataFrame([("a b \u0085",)], "text string")
    assert rows.select(X.sentences(F.col("text")).alias("s")).first().s == ["a b \u0085"]


def test_counts_of_any_order(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "tokens array<string>")
    got = sorted((r.n, r.ctx, r.word, r.cnt) for r in lm.counts(rows, 4).collect())
    assert got == [(1, "", "a", 3), (1, "", "b", 1), (2, "a", "b", 1), (2, "b", "a", 1), (3, "a b", "a", 1)]


def test_words_of_turns_are_cut_once(spark):
    """Words and their list are worked out for a pair, not again for each word: long turns cost little beyond the edit distance."""
    import time

    from speechmill.operators import scoring

    long = " ".join(f"w{i % 700}" for i in range(2500))
    rows = spark.createDataFrame([(long, long + " end")] * 4 + [("a b c", "a c")], "reference string, hypothesis string").repartition(1)
    start = time.monotonic()
    got = scoring.word_error_rate(rows).collect()
    assert sorted((r.edits, r.n_words) for r in got) == [(1, 3)] + [(1, 2500)] * 4 and time.monotonic() - start < 15
    assert got[0].asDict().keys() == {"reference", "hypothesis", "edits", "n_words", "wer"}
