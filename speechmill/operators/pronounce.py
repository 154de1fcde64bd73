"""Pronunciation by dictionaries as tables: each distinct word of a corpus is spoken once, by the best entry it has or else by rule, and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import arpabet_to_ipa, english_to_ipa, hindi_to_ipa, hinglish_tokens, hinted_language, join_ipa, token_kind
from .translate import MAX_BROADCAST_ENTRIES


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """word (lower case), phones: a pronouncing dictionary of lines `WORD  PH1 PH2 ...`, further pronunciations as `WORD(2)`, comments after `;;;` or `#`. A
    word's first pronunciation counts."""
    line = F.trim(F.regexp_replace("value", r"#.*$|^;;;.*$", ""))
    cut = spark.read.text(path).select(F.split(line, r"\s+").alias("cut")).where("size(cut) > 1")
    head = F.lower(F.col("cut")[0])
    nth = F.coalesce(F.expr("try_cast(nullif(regexp_extract(cut[0], '\\\\((\\\\d+)\\\\)$', 1), '') as int)"), F.lit(1))
    rows = cut.select(F.regexp_replace(head, r"\(\d+\)$", "").alias("word"), nth.alias("nth"), F.slice("cut", 2, F.size("cut") - 1).alias("phones"))
    return rows.groupBy("word").agg(F.min_by("phones", F.struct("nth", "phones")).alias("phones"))


def built_in_pronunciations(spark: SparkSession) -> DataFrame:
    """The six words that are there without a dictionary file."""
    return spark.createDataFrame([(w, list(p)) for w, p in T.PRONUNCIATIONS.items()], "word string, phones array<string>")


def dictionary(spark: SparkSession, loanwords: DataFrame | None = None, custom: DataFrame | None = None, pronunciations: DataFrame | None = None) -> DataFrame:
    """word, ipa, lang: one table of all dictionaries. loanwords and custom have (word, ipa); words of custom count in lower case; pronunciations has (word, phones).

    The best entry of a word: a loanword (given ones before the built-in ones), then custom, then an override, then the pronouncing dictionary; of two entries of
    one kind the greater ipa. Loanwords are Hindi, all others English.
    """
    fixed = lambda entries: spark.createDataFrame(list(entries.items()), "word string, ipa string")
    phones = pronunciations if pronunciations is not None else built_in_pronunciations(spark)
    ranked = [
        (phones.select("word", arpabet_to_ipa(F.col("phones")).alias("ipa")), "en"),
        (fixed(T.OVERRIDES), "en"),
        (custom.select(F.lower("word").alias("word"), "ipa") if custom is not None else None, "en"),
        (fixed(T.LOANWORDS), "hi"),
        (loanwords.select("word", "ipa") if loanwords is not None else None, "hi"),
    ]
    every = None
    for k, (entries, lang) in enumerate(ranked):
        if entries is not None:
            one = entries.select("word", "ipa", F.lit(lang).alias("lang"), F.lit(k).alias("priority"))
            every = one if every is None else every.unionByName(one)
    best = every.groupBy("word").agg(F.max(F.struct("priority", "ipa", "lang")).alias("b"))
    return best.select("word", "b.ipa", "b.lang")


def spoken(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """token, ipa, lang (null: no word) of each distinct token of tokens(token). Rules run once for a token, on what no entry has."""
    words = tokens.select("token").distinct().withColumn("kind", token_kind(F.col("token"))).withColumn("low", F.when(F.col("kind") == "latin", F.lower("token")))
    entries = entries.select(F.col("word").alias("entry"), F.col("ipa").alias("entry_ipa"), F.col("lang").alias("entry_lang"))
    known = words.join(entries, F.col("low") == F.col("entry"), "left")
    by_rule = F.when(F.col("kind") == "hi", hindi_to_ipa(F.col("token"))).when(F.col("kind") == "latin", english_to_ipa(F.col("low"))).otherwise(F.col("token"))
    lang = F.when(F.col("kind") == "hi", "hi").when(F.col("kind") == "latin", hinted_language(F.col("token")))
    return known.select("token", F.coalesce("entry_ipa", by_rule).alias("ipa"), F.coalesce("entry_lang", lang).alias("lang"))


def converted(docs: DataFrame, entries: DataFrame, marker: str = "|") -> DataFrame:
    """doc_id, ipa of docs(doc_id, text), whose ids are unique: tokens in order, with the marker where the language of words changes; without tokens an empty text.

    Tokens are rows. The vocabulary is joined to them, by broadcast behind a count and else by a shuffle in which large keys are split.
    """
    rows = docs.select("doc_id", F.posexplode(hinglish_tokens(F.col("text"))).alias("pos", "token"))
    said = spoken(rows, entries).where("ipa <> ''")
    if said.limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES:
        said = F.broadcast(said)
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.last("lang", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.join(said, "token").select("doc_id", "pos", "ipa", (F.col("lang") != before).alias("turns"))
    part = F.when(F.col("turns"), F.array(F.lit(marker), F.col("ipa"))).otherwise(F.array("ipa"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda p: p["part"])  # the tokens of one text
    texts = parts.groupBy("doc_id").agg(join_ipa(F.flatten(ordered)).alias("ipa"))
    return docs.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("ipa", F.lit("")).alias("ipa"))
