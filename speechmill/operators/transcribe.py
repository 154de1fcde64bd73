"""From decoded segments to a transcript: silence gate, words with times, order, duplicates, text with switch marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals

SILENT = 0.6


def heard(decoded: DataFrame, most: float = SILENT) -> DataFrame:
    """Without segments that are silence more likely than `most`; one that says nothing about it is speech."""
    return decoded.where(F.coalesce("no_speech_prob", F.lit(0.0)) <= most)


def decoded_words(decoded: DataFrame) -> DataFrame:
    """decoded(utt_id, seg_id, start, end, lang, text, avg_logprob) to words at even times with their confidence; null or blank text has none."""
    return intervals.word_times(decoded.where("trim(coalesce(text, '')) <> ''"), carried={"lang": F.col("lang"), "confidence": F.exp("avg_logprob")})


def transcripts(decoded: DataFrame, utterances: DataFrame, least: float = 0.3) -> DataFrame:
    """utt_id, full_text, n_words, duration of each of utterances(utt_id, duration: of its audio in seconds).

    Short and silent segments are dropped, words stand in order and without doubles; an utterance of which nothing is left has an empty text and no words.
    """
    kept = heard(decoded.where(F.col("end") - F.col("start") >= least))
    words = intervals.deduplicated_words(decoded_words(kept)).groupBy("utt_id").agg(F.count("*").alias("n_words"))
    rows = utterances.select("utt_id", "duration").join(intervals.switch_text(kept), "utt_id", "left").join(words, "utt_id", "left")
    return rows.select("utt_id", F.coalesce("full_text", F.lit("")).alias("full_text"), F.coalesce("n_words", F.lit(0)).alias("n_words"), "duration")
