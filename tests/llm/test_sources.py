"""Operators that go by row locators, on documents from formats other than Parquet, and with more marks than a bitmap has room for."""

import pytest

from pyspark.sql import functions as F

from speechmill.llm import backoff_lm, common, host_rules, jaccard_join, mixing, stream_dedup

TEXTS = ["one two three four five six", "one  two three four five six", "", None, "seven eight nine ten eleven twelve thirteen", "x", "x", "y z"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(params=["json", "csv", "orc", "table"])
def docs(request, spark, plain, tmp_path):
    kind, path = request.param, f"{tmp_path}/docs"
    if kind == "table":
        spark.sql("drop table if exists located_docs")
        plain.write.option("path", path).saveAsTable("located_docs")
        return spark.table("located_docs")
    options = {"header": "true", "nullValue": "none"} if kind == "csv" else {"ignoreNullFields": "false"} if kind == "json" else {}
    plain.write.options(**options).format(kind).save(path)
    return spark.read.schema(plain.schema).options(**options).format(kind).load(path)


OPERATORS = {
    "op3": stream_dedup.deduplicate,
    "op2": jaccard_join.near_duplicates,
    "op4": lambda d: mixing.mix(d, budget_share=0.9, max_epochs=1),
    "op9": lambda d: backoff_lm.score(d, parts=1).select("doc_id", "n_tokens"),
    "op12": host_rules.keep_good,
}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def wanted(plain, spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('plain')}/docs"
    plain.write.parquet(path)
    return {name: _rows(f(spark.read.parquet(path))) for name, f in OPERATORS.items()}


def test_any_source(docs, wanted):
    assert len(wanted["op3"]) == len(TEXTS)
    for name, operator in OPERATORS.items():
        assert _rows(operator(docs)) == wanted[name], name


def test_marks_in_ranges_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BITS_LEAST", 1 << 16)
    monkeypatch.setattr(common, "BITS_MOST", 1 << 16)
    spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(12).write.parquet(f"{tmp_path}/many")
    docs, at = common.located(spark.read.parquet(f"{tmp_path}/many"))
    gone = common.stored(docs.where("doc_id % 2 = 0").select(at.alias("at")), "gone")
    marks = common.Marks(gone, F.col("at"), 20_000)
    assert marks.ranges == 4
    may, stay = marks.split(docs, at, [docs["doc_id"]])
    may, stay = [r.doc_id for r in may.collect()], [r.doc_id for r in stay.collect()]
    assert sorted(may + stay) == list(range(40_000)) and not any(i % 2 == 0 for i in stay) and len(stay) > 12_000
    left = common.without_rows(docs, at, gone)
    assert left.columns == ["doc_id", "text"] and sorted(r.doc_id for r in left.collect()) == list(range(1, 40_000, 2))
