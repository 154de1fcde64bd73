"""The whole run over lectures: clean, label, transcribe, pronounce, translate, map prosody, detect, score. What neural models say comes as tables.

    python -m speechmill.lecture --lectures DIR --frames DIR --decoded DIR --synthesised DIR --lexicon DIR --output DIR [...]

Inputs (utt_id is a lecture's number, the name of its WAV file): lectures and synthesised, folders of WAV files; frames (utt_id, frame_idx, start, end, hi, en), the
language model's scores; warped_frames, the same of the mapped audio, without which there is no switching accuracy; decoded (utt_id, seg_id, start, end, lang, text, avg_logprob,
no_speech_prob), what the recogniser gave for each segment; warped_decoded, the same of the mapped audio, without which there is no word error rate; lexicon (word, target).
Tables are Parquet. With --resume-from-transcript the transcript is read from --transcript-file (utt_id, full_text), and segments from --lid-file if there is one.

Each stage's output stays in the folder, so a run that was stopped goes on where it was, and one with other settings makes only what depends on them (stages.Run).
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import signal
from .operators import detect, intervals, pitch, prosody, pronounce, scoring, segments, spectral, transcribe, translate
from .shared import new_path
from .ship import ship
from .sources import audio
from .stages import Run, Stage

RATE, HOP = 16_000, 256


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """utt_id, vec_id (the same), x of the WAV files whose names are numbers."""
    rows = audio.read_wav(spark, folder, RATE).select(F.expr("try_cast(name as long)").alias("utt_id"), "x").where("utt_id is not null")
    return rows.select("utt_id", F.col("utt_id").alias("vec_id"), "x")


def clean(run: Run, lectures: str) -> DataFrame:
    rows = spectral.denoised(_signals(run.spark, lectures), run.settings["denoise"])
    return rows.select(F.col("vec_id").alias("utt_id"), signal.rms_normalised(F.col("y")).alias("x"))


def labelled(run: Run, frames: str) -> DataFrame:
    return _labels(run.spark.read.parquet(frames))


def _labels(rows: DataFrame) -> DataFrame:
    hi, en, label = segments.binary_probabilities(F.col("hi"), F.col("en"))
    binary = rows.select("utt_id", "frame_idx", "start", "end", hi.alias("prob_hi"), en.alias("prob_en"), label.alias("lang"))
    voted = segments.gaussian_smoothed(binary).select("utt_id", "frame_idx", F.when(F.col("smooth") >= 0.5, "hi").otherwise("en").alias("lang"))
    return segments.refined(segments.runs(binary.drop("lang").join(segments.median_labels(voted), ["utt_id", "frame_idx"])))


def labelled_before(run: Run, lid: str) -> DataFrame:
    return run.spark.read.parquet(lid).select("utt_id", "seg_id", "start", "end", "lang")


def transcribed(run: Run, clean: DataFrame, segments: DataFrame, decoded: str) -> DataFrame:
    """What the recogniser gave for segments that are still there, one for a lecture without any."""
    signals = clean.select("utt_id", "x")
    own = intervals.or_whole(segments, signals, RATE, run.settings["default_language"]).select("utt_id", "seg_id")
    known = run.spark.read.parquet(decoded).join(own, ["utt_id", "seg_id"], "left_semi")
    return transcribe.transcripts(known, signals.select("utt_id", (F.size("x") / F.lit(float(RATE))).alias("duration")))


def transcribed_before(run: Run, clean: DataFrame, transcript_file: str) -> DataFrame:
    rows = run.spark.read.parquet(transcript_file).select("utt_id", "full_text")
    words = F.size(F.filter(F.split("full_text", r"\s+"), lambda w: w != "")).cast("long")
    return clean.select("utt_id", (F.size("x") / F.lit(float(RATE))).alias("duration")).join(rows, "utt_id").select("utt_id", "full_text", words.alias("n_words"), "duration")


def pronounced(run: Run, transcript: DataFrame) -> DataFrame:
    rows = transcript.select(F.col("utt_id").alias("doc_id"), F.col("full_text").alias("text"))
    return pronounce.converted(rows, pronounce.dictionary(run.spark)).withColumnRenamed("doc_id", "utt_id")


def translated(run: Run, transcript: DataFrame, ipa: DataFrame, lexicon: str) -> DataFrame:
    return translate.translated_texts(transcript, ipa, run.spark.read.parquet(lexicon))


def synthesised(run: Run, synthesised: str) -> DataFrame:
    return _signals(run.spark, synthesised).select("utt_id", "x")


def contours(run: Run, signals: DataFrame) -> DataFrame:
    rows = spectral.contours(signals.select(F.col("utt_id").alias("vec_id"), "x"))
    return rows.withColumnRenamed("vec_id", "utt_id")


def _curves(frames: DataFrame, to: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("frame_idx", "f0", "energy")))  # the frames of one lecture
    return frames.groupBy("utt_id").agg(listed.alias("s")).select(F.col("utt_id").alias("pair_id"), F.col("s.f0").alias(f"f0_{to}"), F.col("s.energy").alias(f"energy_{to}"))


def warped(run: Run, lecture_contours: DataFrame, voice_contours: DataFrame, voice: DataFrame) -> DataFrame:
    """The voice at the lecture's median pitch, with the lecture's energy along the alignment of the two."""
    named = lambda df: df.withColumnRenamed("utt_id", "vec_id")
    moved = pitch.shifted(named(voice.select("utt_id", "x")), pitch.ratios_of(named(lecture_contours), named(voice_contours)))
    pairs = _curves(lecture_contours, "a").join(_curves(voice_contours, "b"), "pair_id").join(moved.select(F.col("vec_id").alias("pair_id"), F.col("y").alias("x")), "pair_id")
    return prosody.mapped_prosody(pairs, HOP).withColumnRenamed("pair_id", "utt_id")


def detected(run: Run, clean: DataFrame, voice: DataFrame, warped: DataFrame) -> DataFrame:
    """label, p of the part kept for validation: lectures are genuine, synthesised and mapped audio is not."""
    rows = None
    for kind, (df, label) in enumerate(((clean, 1), (voice, 0), (warped, 0))):
        one = df.select((F.col("utt_id") * 3 + kind).alias("vec_id"), "x", F.lit(label).alias("label"))
        rows = one if rows is None else rows.unionByName(one)
    pooled = detect.pooled(spectral.features(rows.select("vec_id", "x"), "lfcc")).join(rows.select("vec_id", "label"), "vec_id")
    path = new_path(run.spark, "pooled")  # read many times by the fit
    pooled.write.parquet(path)
    parts = scoring.stratified_split(run.spark.read.parquet(path), "label", "vec_id")
    model, _ = detect.fit(parts.where("part = 'train'"))
    detect.save(model, f"{run.path('detector')}-model")
    return detect.scores(parts.where("part = 'val'"), model).select("vec_id", "label", "p")


def metrics(run: Run, transcript: DataFrame, segments: DataFrame, clean: DataFrame, warped: DataFrame, detector: DataFrame, **more: str) -> DataFrame:
    """One row; what has no input is null."""
    from .operators import align

    spark, have = run.spark, {}
    if "warped_decoded" in more:
        said = transcribe.transcripts(spark.read.parquet(more["warped_decoded"]), clean.select("utt_id", F.lit(0.0).alias("duration")))
        both = transcript.select("utt_id", F.col("full_text").alias("reference")).join(said.select("utt_id", F.col("full_text").alias("hypothesis")), "utt_id")
        have["wer"] = scoring.word_error_rate(both).agg((F.sum("edits") / F.sum("n_words")).alias("wer"))
    cepstra = lambda df: spectral.features(df.select(F.col("utt_id").alias("vec_id"), "x"), "mfcc").select(F.col("vec_id").alias("pair_id"), F.col("frame_idx").alias("k"), F.col("coefficients").alias("v"))
    path = align.tiled_paths(cepstra(clean), cepstra(warped)).groupBy("pair_id").agg(F.first("cost").alias("cost"), F.count("*").alias("n"))
    have["mcd"] = path.agg(F.avg(F.lit(align.MCD_FACTOR) * F.col("cost") / F.col("n")).alias("mcd"))
    judged = detect.evaluated(detector)
    have |= {"eer": judged.select("eer"), "anti_spoof_accuracy": judged.select("accuracy"), "anti_spoof_validation_loss": judged.select("loss")}
    if "warped_frames" in more:
        cells = intervals.compared(segments, _labels(spark.read.parquet(more["warped_frames"]))).where("ref_lang is not null")
        long = F.col("end") - F.col("start")
        have["lid_switching_accuracy"] = cells.agg((F.sum(F.when(F.col("ref_lang").eqNullSafe(F.col("pred_lang")), long).otherwise(0.0)) / F.sum(long)).alias("a"))
    names = ("wer", "mcd", "eer", "lid_switching_accuracy", "anti_spoof_accuracy", "anti_spoof_validation_loss")
    return scoring.metric_bundle(spark, **{name: have.get(name) for name in names})


def lecture_run(spark: SparkSession, output: str, inputs: dict[str, str], settings: dict[str, object] | None = None) -> Run:
    """The stages over these inputs: lectures, decoded or transcript_file, frames or lid, synthesised, lexicon; warped_frames and warped_decoded where there are any."""
    ship(spark)
    run = Run(spark, output, inputs, {"denoise": "spectral", "default_language": "hi", **(settings or {})})
    run.add(Stage("clean", ("lectures",), clean, ("denoise",)))
    run.add(Stage("segments", ("lid",), labelled_before) if "lid" in inputs else Stage("segments", ("frames",), labelled))
    run.add(Stage("transcript", ("clean", "transcript_file"), transcribed_before) if "transcript_file" in inputs else Stage("transcript", ("clean", "segments", "decoded"), transcribed, ("default_language",)))
    run.add(Stage("ipa", ("transcript",), pronounced), Stage("translation", ("transcript", "ipa", "lexicon"), translated), Stage("voice", ("synthesised",), synthesised))
    run.add(Stage("lecture_contours", ("clean",), lambda run, clean: contours(run, clean)), Stage("voice_contours", ("voice",), lambda run, voice: contours(run, voice)))
    run.add(Stage("warped", ("lecture_contours", "voice_contours", "voice"), warped), Stage("detector", ("clean", "voice", "warped"), detected))
    more = tuple(n for n in ("warped_frames", "warped_decoded") if n in inputs)
    return run.add(Stage("metrics", ("transcript", "segments", "clean", "warped", "detector", *more), metrics))


def export(run: Run) -> dict[str, str]:
    """Besides the kept tables: mapped audio as WAV rows, texts as JSON lines, the metrics as JSON; their paths by name."""
    out = {name: f"{run.folder}/export/{name}" for name in ("output_lrl_cloned", "transcript", "ipa", "translation", "metrics")}
    mapped = run.get("warped").select(F.col("utt_id").cast("string").alias("name"), "x")
    audio.to_wav(mapped, RATE).write.mode("overwrite").parquet(out["output_lrl_cloned"])
    for name in ("transcript", "ipa", "translation", "metrics"):
        run.get(name).write.mode("overwrite").json(out[name])
    return out


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="speechmill.lecture", description="Lectures through all stages; what is there already is kept.")
    for name, text in (("lectures", "folder of WAV files"), ("synthesised", "folder of WAV files"), ("lexicon", "table of word, target"), ("output", "folder of the stages")):
        out.add_argument(f"--{name}", required=True, help=text)
    for name in ("frames", "decoded", "warped-frames", "warped-decoded"):
        out.add_argument(f"--{name}", help="table, see the module")
    out.add_argument("--resume-from-transcript", action="store_true", help="read the transcript instead of making it from --decoded")
    out.add_argument("--transcript-file", help="table of utt_id, full_text")
    out.add_argument("--lid-file", help="table of segments, instead of --frames")
    out.add_argument("--denoise", default="spectral", choices=sorted(spectral.STRATEGIES))
    out.add_argument("--default-language", default="hi")
    out.add_argument("--master", help="a Spark master; else the one Spark is configured with")
    return out


def inputs_of(own: argparse.Namespace) -> dict[str, str]:
    if own.resume_from_transcript and not own.transcript_file:
        raise ValueError("--resume-from-transcript needs --transcript-file")
    names = {"lectures": own.lectures, "synthesised": own.synthesised, "lexicon": own.lexicon, "warped_frames": own.warped_frames, "warped_decoded": own.warped_decoded}
    names |= {"transcript_file": own.transcript_file} if own.resume_from_transcript else {"decoded": own.decoded}
    names |= {"lid": own.lid_file} if own.lid_file else {"frames": own.frames}
    if missing := [n for n in ("decoded", "frames") if n in names and not names[n]]:
        raise ValueError(f"missing inputs: {', '.join(missing)}")
    return {name: path for name, path in names.items() if path}


def main(arguments: Sequence[str] | None = None) -> Run:
    own = parser().parse_args(arguments)
    inputs = inputs_of(own)
    builder = SparkSession.builder.appName("speechmill-lecture").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(own.master) if own.master else builder).getOrCreate()
    run = lecture_run(spark, own.output, inputs, {"denoise": own.denoise, "default_language": own.default_language})
    run.all()
    export(run)
    return run


if __name__ == "__main__":
    main()
