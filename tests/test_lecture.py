"""The whole run over made-up lectures: outputs, resumption after a loss at any stage, and what settings touch."""

import os
import shutil

import numpy as np
import pytest

from speechmill import lecture
from speechmill.functions import tables as T
from speechmill.operators import pronounce, translate
from speechmill.sources import audio
from speechmill.stages import Run, Stage


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("lecture")
    rng = np.random.default_rng(2)
    t = np.arange(9000) / 16_000
    tone = lambda f, u: (0.3 * np.sin(2 * np.pi * f * t) * (1 + 0.5 * np.sin(3 * t + u)) + 0.01 * rng.normal(size=len(t))).tolist()
    for name, base in (("lectures", 150), ("synthesised", 220)):
        rows = spark.createDataFrame([(str(u), tone(base + 10 * u, u)) for u in range(4)], "name string, x array<double>")
        audio.export_wav(audio.to_wav(rows, 16_000), f"{home}/{name}").collect()
    frames = [(u, i, i * 0.1, i * 0.1 + 0.5, float((i // 20 + u) % 2), float((i // 20 + u + 1) % 2)) for u in range(4) for i in range(60)]
    spark.createDataFrame(frames, "utt_id long, frame_idx int, start double, end double, hi double, en double").write.parquet(f"{home}/frames")
    decoded = [(u, s, 2.0 * s, 2.0 * s + 2, "hi" if s % 2 else "en", ["hello world", "नमक kya", "the test"][s], -0.1, 0.0) for u in range(3) for s in range(3)]
    spark.createDataFrame(decoded, "utt_id long, seg_id int, start double, end double, lang string, text string, avg_logprob double, no_speech_prob double").write.parquet(f"{home}/decoded")
    translate.lexicon(spark, T.SAMPLE_LEXICON).write.parquet(f"{home}/lexicon")
    names = ("lectures", "synthesised", "frames", "decoded", "lexicon")
    return {n: f"{home}/{n}" for n in names} | {"warped_frames": f"{home}/frames", "warped_decoded": f"{home}/decoded"}


def _rows(run):
    return {name: sorted(map(repr, df.drop("x").collect())) for name, df in run.all().items() if name != "detector"}


@pytest.fixture(scope="module")
def first(spark, inputs, tmp_path_factory):
    run = lecture.lecture_run(spark, f"{tmp_path_factory.mktemp('out')}", inputs)
    return run, _rows(run)


def test_outputs(spark, first):
    run, rows = first
    assert run.made and not run.kept and set(run.made) == set(run.stages)
    texts = {r.utt_id: r for r in run.get("transcript").collect()}
    assert texts[0].full_text == "hello world ‖ नमक kya ‖ the test" and texts[0].duration == pytest.approx(9000 / 16_000)
    assert texts[3].full_text == "" and texts[3].n_words == 0  # nothing was decoded, the lecture is still there
    assert {r.utt_id: r.ipa for r in run.get("ipa").collect()}[0].startswith("hʌloʊ wɝld")
    assert {r.utt_id: r.translation for r in run.get("translation").collect()}[3] == ""
    row = run.get("metrics").first()
    assert row.wer == 0.0 and row.lid_switching_accuracy == 1.0 and row.mcd > 0 and 0 <= row.eer <= 1
    manifest = {r.stage: r for r in run.manifest().collect()}
    assert set(manifest) == set(run.stages) and manifest["transcript"].n_rows == 4 and manifest["ipa"].needs == {"transcript": run.key("transcript")}
    out = lecture.export(run)
    assert spark.read.json(out["transcript"]).count() == 4 and spark.read.parquet(out["output_lrl_cloned"]).count() == 4


@pytest.mark.parametrize("lost", ["transcript", "warped"])
def test_a_lost_stage_is_made_again_and_nothing_else(spark, inputs, first, lost):
    run, rows = first
    shutil.rmtree(run._manifest(lost))  # cut off before its manifest
    with open(os.path.join(run.path(lost), "part-junk.tmp"), "w") as f:
        f.write("half a file")
    again = lecture.lecture_run(spark, run.folder, inputs)
    assert _rows(again) == rows and again.made == [lost]


def test_settings_touch_what_depends_on_them(spark, inputs, first):
    run, _ = first
    other = lecture.lecture_run(spark, run.folder, inputs, {"denoise": "none"})
    assert other.key("clean") != run.key("clean") and other.key("segments") == run.key("segments") and other.key("ipa") != run.key("ipa") and other.key("voice_contours") == run.key("voice_contours")


def test_from_a_transcript(spark, inputs, first, tmp_path):
    _, rows = first
    run = lecture.lecture_run(spark, first[0].folder, inputs)  # files may have been written anew
    run.get("transcript").select("utt_id", "full_text").write.parquet(f"{tmp_path}/text")
    run.get("segments").write.parquet(f"{tmp_path}/lid")
    own = {n: p for n, p in inputs.items() if n not in ("decoded", "frames")} | {"transcript_file": f"{tmp_path}/text", "lid": f"{tmp_path}/lid"}
    again = lecture.lecture_run(spark, f"{tmp_path}/out", own)
    assert [sorted(map(repr, again.get(n).collect())) for n in ("ipa", "segments")] == [rows["ipa"], rows["segments"]]


def test_arguments():
    base = ["--lectures", "a", "--synthesised", "b", "--lexicon", "c", "--output", "d"]
    with pytest.raises(ValueError, match="transcript-file"):
        lecture.inputs_of(lecture.parser().parse_args([*base, "--frames", "f", "--resume-from-transcript"]))
    with pytest.raises(ValueError, match="decoded"):
        lecture.inputs_of(lecture.parser().parse_args([*base, "--frames", "f"]))
    own = lecture.inputs_of(lecture.parser().parse_args([*base, "--lid-file", "l", "--resume-from-transcript", "--transcript-file", "t"]))
    assert own["lid"] == "l" and own["transcript_file"] == "t" and "frames" not in own
    with pytest.raises(ValueError, match="no input"):
        Run(None, "x", {}).add(Stage("a", ("b",), None))


def test_dictionaries(spark, tmp_path):
    with open(f"{tmp_path}/said", "w") as f:
        f.write(";;; words\nTEST(2)  K AH0\nTEST  T EH1 S T # first\nMADE  M EY1 D\n\nbare\n")
    said = pronounce.read_pronunciations(spark, f"{tmp_path}/said")
    assert {r.word: r.phones for r in said.collect()} == {"test": ["T", "EH1", "S", "T"], "made": ["M", "EY1", "D"]}
    own = lambda rows: spark.createDataFrame(rows, "word string, ipa string")
    entries = pronounce.dictionary(spark, own([("kya", "LOAN")]), own([("Google", "CUSTOM"), ("kya", "no"), ("made", "MINE")]), said)
    docs = spark.createDataFrame([(1, "Kya google made test, hello?"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.ipa for r in pronounce.converted(docs, entries).collect()}
    assert got == {1: "LOAN | CUSTOM MINE tɛst, hɛllɒ?", 2: "", 3: ""}  # hello is not in the given dictionary
    plain = {r.doc_id: r.ipa for r in pronounce.converted(docs, pronounce.dictionary(spark)).collect()}
    assert plain[1] == "kjaː | ɡuːɡəl mæd tɛst, hʌloʊ?"
