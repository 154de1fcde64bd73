"""Dictionary translation with transliteration, and small dictionary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.text import DIGITS_OR_NONE, gujarati_digits, hinglish_tokens, join_tokens, mapping, transliterate
from ..shared import written

#: Dictionaries up to this number of entries go to all tasks.
MAX_BROADCAST_ENTRIES = 200_000


def lexicon(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    """word, target."""
    return spark.createDataFrame(list(entries.items()), "word string, target string")


def overlaid(*dictionaries: DataFrame) -> DataFrame:
    """Dictionaries (word, target) as one; an entry of a later one wins. Words have one entry in each."""
    every = None
    for k, d in enumerate(dictionaries):
        one = d.select("word", "target", F.lit(k).alias("priority"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("word").agg(F.max_by("target", "priority").alias("target"))


LEAST_ENTRIES = 500


def section_lexicon(sections: DataFrame, least: int = LEAST_ENTRIES) -> DataFrame:
    """sections(section, word, target) as one lexicon: of a word's entries that of the last section wins, words with blanks go; an error where fewer than `least` are left."""
    words = sections.where("word not rlike '\\\\s'").groupBy("word").agg(F.max_by("target", "section").alias("target"))
    size = words.agg(F.count("*").alias("n"))  # one row
    checked = F.when(F.col("n") < least, F.raise_error(F.lit(f"a lexicon needs {least} entries")).cast("string")).otherwise(F.col("target"))
    return words.crossJoin(F.broadcast(size)).select("word", checked.alias("target"))


def looked_up(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens(..., token) with target, null where the dictionary lacks it. The dictionary is broadcast behind a count."""
    words = words.withColumnRenamed("word", "lex_word")
    if words.limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES:
        words = F.broadcast(words)
    return tokens.join(words, F.lower("token") == F.col("lex_word"), "left").drop("lex_word")


def translated(text: Column, entries: dict[str, str]) -> Column:
    """Word by word: marks stay, then the lexicon, digits, else transliteration; tokens are joined again."""
    known = mapping(entries)
    word = lambda t: F.when(~t.rlike(r"[\p{L}\p{N}]"), t).otherwise(F.coalesce(known[F.lower(t)], F.when(t.rlike(DIGITS_OR_NONE), gujarati_digits(t)), transliterate(t)))
    return join_tokens(F.transform(hinglish_tokens(text, True), word))


def recogniser_code(lang: Column) -> Column:
    """The recogniser's code of a segment's label; unknown labels are hi."""
    return F.coalesce(mapping(T.RECOGNISER_CODES)[lang], F.lit("hi"))


def class_labels(spark: SparkSession, labels: list[str] | None = None) -> DataFrame:
    """idx, label of the classes of a model; without its own list the list of codes in tables, which is shorter than the classes some models have."""
    return spark.createDataFrame(list(enumerate(labels or T.CLASS_CODES)), "idx int, label string")


def numbered(labels: DataFrame) -> DataFrame:
    """labels(label), all different, with idx: their places in order from 0. Ranges of the order are tasks of their own; a range starts after the sizes of those before it."""
    ranged = written(labels.select("label").repartitionByRange("label").withColumn("range", F.spark_partition_id()), "labels")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("label")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(sizes), "range").select("label", (F.col("before") + F.col("place")).alias("idx"))


def class_index(labels: DataFrame) -> DataFrame:
    """labels(label, idx) to code, idx: the first class of each code; what follows a hyphen doesn't count."""
    code = F.split(F.trim(F.lower("label")), "-")[0]
    return labels.groupBy(code.alias("code")).agg(F.min("idx").alias("idx"))


def required_index(labels: DataFrame, *codes: str) -> DataFrame:
    """class_index of the given codes; an error for one that has no class."""
    rows = F.broadcast(labels.sparkSession.createDataFrame([(c,) for c in codes], "code string")).join(class_index(labels), "code", "left")
    missing = F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("no class for language "), F.col("code"))).cast("long"))
    return rows.select("code", F.coalesce("idx", missing).alias("idx"))


def merged_entries(rows: DataFrame) -> DataFrame:
    """rows(word, target, priority): the entry of the highest priority for each word."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("priority")))).where("nth = 1").drop("nth", "priority")


def translated_texts(transcripts: DataFrame, ipa: DataFrame, words: DataFrame) -> DataFrame:
    """utt_id, translation of transcripts(utt_id, full_text), by words(word, target): marks stay, then the lexicon, digits, else transliteration.

    The stage takes what the text sounds like, as its place in a run has it, and makes no use of it: ipa only has to have the same utterances. Tokens are rows,
    each distinct one is looked up and transliterated once.
    """
    del ipa
    rows = transcripts.select("utt_id", F.posexplode(hinglish_tokens(F.col("full_text"), True)).alias("pos", "token"))
    token = F.col("token")
    known = looked_up(rows.select("token").distinct(), words)
    by_rule = F.coalesce(F.when(token.rlike(DIGITS_OR_NONE), gujarati_digits(token)), transliterate(token))
    said = known.select("token", F.when(~token.rlike(r"[\p{L}\p{N}]"), token).otherwise(F.coalesce("target", by_rule)).alias("said"))
    parts = rows.join(said, "token").groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("parts"))  # the tokens of one text
    texts = parts.select("utt_id", join_tokens(F.transform("parts", lambda p: p["said"])).alias("translation"))
    return transcripts.select("utt_id").join(texts, "utt_id", "left").select("utt_id", F.coalesce("translation", F.lit("")).alias("translation"))
