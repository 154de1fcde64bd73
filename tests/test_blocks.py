"""Counts of n-grams travel as compressed blocks, and asked words beside them: results as by a table of all n-grams."""

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from speechmill.operators import blocks as B
from speechmill.operators import lm

SENTENCES = [["a", "b", "a", "b"], ["b", "a"], ["c"], ["a", "b", "c", "ä", "a"], ["क", "b", "a"]] * 3
ASKED = [("a", ""), ("b", "a"), ("a", "b"), ("a", "a b"), ("c", "a b"), ("zz", "a b"), ("a", "zz"), ("a", "b zz"), ("a", "क b"), ("zz", ""), (None, "a b"), ("c", "c"), ("A", "c a b")]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([(x,) for x in SENTENCES], "tokens array<string>")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(ASKED)], "i int, word string, ctx string")


def _brute(order):
    return Counter((n, " ".join(s[i : i + n - 1]), s[i + n - 1]) for s in SENTENCES for n in range(1, order + 1) for i in range(len(s) - n + 1))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_counts_of_several_chunks_and_buckets(monkeypatch, order):
    monkeypatch.setattr(B, "CHUNK", 7)
    monkeypatch.setattr(B, "ROWS", 2)
    batch = pa.RecordBatch.from_pydict({"tokens": pa.array(SENTENCES, pa.list_(pa.string()))})
    made = list(B.blocks_of(order, 3)(iter([batch, batch.slice(0, 0)])))
    rows, got = pa.Table.from_batches(made), Counter()
    for b in range(3):
        own = rows.filter(pc.equal(rows["bucket"], b)).to_batches()
        for out in B.gram_counts(order)(iter(own)) if own else []:
            for r in out.to_pylist():
                assert (r["n"], r["ctx"], r["word"]) not in got
                got[r["n"], r["ctx"], r["word"]] = r["cnt"]
    assert got == _brute(order)


def test_a_shuffle_moves_blocks_not_ngrams(spark):
    rows = spark.range(3000).selectExpr("transform(sequence(1, 20), k -> concat('w', (id * 7 + k * k) % 900)) as tokens").coalesce(2)
    held = lm.blocks(rows)
    assert held.rows.count() <= 2 * 2 * held.buckets < lm.counts(rows).count() / 100


def _logp(df):
    return {r.i: pytest.approx(r.logp) for r in df.collect()}


def test_kneser_ney_without_a_table_of_all_ngrams(corpus, asked):
    known = asked.where("word is not null and size(split(ctx, ' ')) < 3")
    assert _logp(lm.kneser_ney_of(known, corpus)) == _logp(lm.kneser_ney(known, lm.counts(corpus, 3, True)))


@pytest.mark.parametrize("of", [lm.laplace, lm.maximum_likelihood, lm.add_one])
def test_scores_without_a_table_of_all_ngrams(corpus, asked, of):
    assert _logp(of(asked, lm.blocks(corpus, 3, True))) == _logp(of(asked, lm.counts(corpus, 3, True)))


def test_context_totals_by_blocks(corpus):
    rows = lambda df: sorted(map(tuple, df.select("n", "ctx", "total", "kinds").collect()))
    assert rows(lm.context_totals_of(lm.blocks(corpus))) == rows(lm.context_totals(lm.counts(corpus)))
