"""Mixing keeps rows with a null doc_id."""

from speechmill.llm import mixing


def test_mix_keeps_rows_with_null_ids(spark):
    rows = [(None, "a b c", "en", "src1"), (1, "d e f", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(mixing.mix(docs, budget_share=1.0, max_epochs=1).collect(), key=repr) == sorted(docs.collect(), key=repr)
