"""Each query with SQL against DuckDB on the smallest tables, and the fixtures whose values were worked out by hand."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from speechmill.functions import signal as S
from speechmill.functions import text as X
from speechmill.operators import detect, intervals, lm, prosody, scoring, segments, spectral, translate
from speechmill.plans import ORACLE_SQL, QUERIES
from speechmill.sources import audio

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else f"{v:.8g}" if isinstance(v, float) else v


def _rows(df):
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def _segs(spark, rows):
    return spark.createDataFrame([(1, i, float(a), float(b), lang, n) for i, (a, b, lang, n) in enumerate(rows)], "utt_id long, seg_id int, start double, end double, lang string, n_frames long")


def test_refine_by_hand(spark):
    # the middle one is short and goes to the longer left one; then hi-en-hi with 0.3 s of en is one
    rows = [(0, 1, "hi", 10), (1, 1.1, "en", 1), (1.1, 1.5, "hi", 4), (1.5, 1.8, "en", 3), (1.8, 3, "hi", 12), (3, 4, "en", 10)]
    got = [(r.start, r.end, r.lang) for r in segments.refined(_segs(spark, rows)).orderBy("seg_id").collect()]
    assert got == [(0, 3, "hi"), (3, 4, "en")]


def test_flicker_longer_than_twice_stays(spark):
    got = [(r.start, r.end, r.lang) for r in segments.refined(_segs(spark, [(0, 1, "a", 1), (1, 1.5, "b", 1), (1.5, 2, "a", 1)])).orderBy("seg_id").collect()]
    assert got == [(0, 1, "a"), (1, 1.5, "b"), (1.5, 2, "a")]


def test_refine_edges(spark):
    # a short first one goes to the right, a short last one to the left, a lone one stays
    got = [(r.start, r.end, r.lang) for r in segments.refined(_segs(spark, [(0, 0.1, "hi", 1), (0.1, 1, "en", 9), (1, 2, "hi", 10), (2, 2.1, "en", 1)])).orderBy("seg_id").collect()]
    assert got == [(0, 1, "en"), (1, 2.1, "hi")]
    assert [(r.start, r.end) for r in segments.refined(_segs(spark, [(0, 0.1, "hi", 1)])).collect()] == [(0, 0.1)]
    assert segments.refined(_segs(spark, [(0, 1, "hi", 1)]).limit(0)).count() == 0


def test_probabilities_are_held_within_one(spark):
    row = spark.createDataFrame([([-1.0, -2.0, 0.5],)], "x array<double>").select(S.renormalised(X.F.col("x")).alias("p")).first().p
    e = [math.exp(-1), math.exp(-2), 1.0]
    assert row == pytest.approx([v / sum(e) for v in e])


def test_mel_cepstra_have_thirteen_coefficients():
    assert spectral.cepstra(np.random.default_rng(1).normal(size=8000), "mfcc").shape == (51, 13)
    assert spectral.cepstra(np.zeros(10), "mfcc").shape == (0, 13) and spectral.cepstra(np.zeros(10), "lfcc").shape == (1, 20)
    with pytest.raises(ValueError):
        spectral.cepstra(np.zeros(1000), "other")


@pytest.fixture
def grams(spark):
    return lm.counts(lm.sentence_tokens(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")), 3)


def test_contextual_bias_of_an_unseen_trigram(spark, grams):
    logits = spark.createDataFrame([(0, 7, "d", 0.0, ["a", "b"]), (0, 8, "d", 0.0, []), (0, 9, "zz", 0.0, ["a", "b"])], "hyp_id int, token_id int, token string, logit double, ctx array<string>")
    bias = lm.token_bias(logits.select("token_id", "token"), grams)
    got = {r.token_id: r.logit for r in lm.contextual_bias(logits, bias, grams).collect()}
    assert got[7] == pytest.approx(1.5 * math.log(1 / 5)) and got[8] == pytest.approx(1.5 * math.log(2 / 8)) and got[9] == 0


def test_token_bias_takes_the_first_word_as_it_is(spark, grams):
    tokens = spark.createDataFrame([(1, "c,"), (2, "<a>"), (3, " C "), (4, "b x"), (5, "")], "token_id int, token string")
    assert {r.token_id: r.word for r in lm.token_bias(tokens, grams).collect()} == {3: "c", 4: "b"}


def test_label_near_the_last_end(spark):
    times = spark.createDataFrame([(1, t) for t in (100.0005, 100.002)], "utt_id long, t double")
    assert {r.t: r.lang for r in intervals.label_at(times, _segs(spark, [(0, 100, "hi", 1)])).collect()} == {100.0005: "hi", 100.002: None}


def test_snr_without_powers_and_of_silence(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.0), (3, 1.0)], "utt_id long, power double")
    got = {r.utt_id: r.snr_db for r in scoring.snr_estimate(rows).collect()}
    assert got[1] == 0 and got[2] == -math.inf and got[3] == pytest.approx(0, abs=1e-6)


def test_forward_fill_falls_back_to_the_source(spark):
    rows = spark.createDataFrame([(1, 0, None, 2.0), (1, 1, 0.0, 4.0)], "utt_id long, k int, v double, curve double")
    assert [r.filled for r in segments.forward_filled(rows, "v", "k", source="curve").collect()] == [3.0, 3.0]


def test_split_needs_both_labels(spark):
    with pytest.raises(Exception, match="both labels"):
        scoring.stratified_split(spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int"), "label", "doc_id").collect()
    rows = spark.createDataFrame([(i, int(i > 5)) for i in range(7)], "doc_id long, label int")
    got = sorted((r.doc_id, r.part) for r in scoring.stratified_split(rows, "label", "doc_id").collect())
    assert got == [(0, "train"), (1, "train"), (2, "train"), (3, "train"), (4, "val"), (5, "val"), (6, "train"), (6, "val")]


def test_word_times_without_duration(spark):
    rows = spark.createDataFrame([(1, 0, 2.0, 2.0, "a b", 4000)], "utt_id long, seg_id int, start double, end double, text string, n int")
    assert [r.word_end for r in intervals.word_times(rows, frames="n").orderBy("pos").collect()] == [17.0, 32.0]


def test_wav_files_round_trip(spark, tmp_path):
    x = [0.0, 0.5, -0.5, 1.0, -1.5, 0.1]
    rows = spark.createDataFrame([("a", x), ("b", [])], "name string, x array<double>")
    paths = {r.name: r.path for r in audio.export_wav(audio.to_wav(rows, 16_000), str(tmp_path)).collect()}
    assert sorted(os.listdir(tmp_path)) == ["a.wav", "b.wav"] and set(paths) == {"a", "b"}
    import wave

    with wave.open(paths["a"]) as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()) == (16_000, 1, 2, 6)
    back = {r.name: r.x for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert back["a"] == pytest.approx(np.clip(x, -1, 1), abs=1e-4) and back["b"] == []
    with wave.open(str(tmp_path / "c.wav"), "wb") as f:
        f.setparams((2, 3, 8000, 2, "NONE", ""))
        f.writeframes(b"\x00\x00\x40\x00\x00\x00\x00\x00\xc0\x00\x00\xc0")
    c = audio.read_wav(spark, str(tmp_path)).where("name = 'c'").first()
    assert c.rate == 8000 and c.x == pytest.approx([0.25, -0.5])
    for bad in (b"no", b"RIFF\0\0\0\0WAVE"):
        with pytest.raises(ValueError):
            audio.decoded(bad)


def test_slice_that_is_too_short(spark):
    rows = spark.createDataFrame([([0.0] * 16,)], "x array<double>")
    for start, what in ((2.0, "empty"), (0.8, "shorter")):
        with pytest.raises(Exception, match=what):
            rows.select(S.slice_or_error(X.F.col("x"), X.F.lit(start), X.F.lit(0.5), 16)).collect()


def test_lexicon_needs_its_size(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (1, "two words", "z")], "section int, word string, target string")
    with pytest.raises(Exception, match="500 entries"):
        translate.section_lexicon(rows).collect()
    assert [tuple(r) for r in translate.section_lexicon(rows, 1).collect()] == [("a", "y")]


def test_detector_learns_and_reloads(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2) + 0.01 * (i % 5), 1.0], i % 2) for i in range(60)], "vec_id long, pooled array<double>, label int")
    model, history = detect.fit(rows)
    assert history[-1] < history[0]
    again = detect.load(detect.save(model, f"{tmp_path}/model"))
    assert detect.scores(rows, again).collect() == detect.scores(rows, model).collect()
    row = detect.train_and_evaluate(rows, f"{tmp_path}/other").first()
    assert row.accuracy == 1.0 and row.eer == 0.0


def test_prosody_of_a_signal_mapped_onto_itself(spark):
    f0, e = [0.0, 100.0, 120.0, 0.0], [0.1, 0.4, 0.2, 0.1]
    row = prosody.mapped_prosody(spark.createDataFrame([(1, f0, e, f0, e, [0.1] * 8)], "pair_id long, f0_a array<double>, energy_a array<double>, f0_b array<double>, energy_b array<double>, x array<double>"), 2).first()
    assert row.f0 == pytest.approx(f0) and row.energy == pytest.approx(e) and row.x == pytest.approx([0.1] * 8)


def test_denoise_strategies(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [0.1] * 2000)], "vec_id long, x array<double>")
    assert spectral.denoised(rows, "none").first().y == [0.1] * 2000
    monkeypatch.setenv("DENOISE_BACKEND", "other")
    with pytest.raises(ValueError):
        spectral.denoised(rows, "none")


def test_command_line(spark, tmp_path):
    from speechmill import cli

    own = cli.parser().parse_args(["p17_decision", "--input", SF, "--output", "x"])
    assert own.query == "p17_decision" and own.format == "parquet"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["no_such_query", "--input", SF, "--output", "x"])


def test_duplicate_words(spark):
    rows = [(1, 0, 0, "So", 0.0, 1.0), (1, 1, 0, "so", 0.4, 1.4), (1, 1, 1, "so", 0.9, 1.9), (1, 1, 2, "go", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "utt_id long, seg_id int, pos int, word string, word_start double, word_end double")
    assert [r.word for r in intervals.deduplicated_words(df).orderBy("word_start").collect()] == ["So", "so", "go"]


def test_label_at_the_last_end(spark):
    segs = _segs(spark, [(0, 1, "hi", 1), (1, 2, "en", 1)])
    times = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 2.1)], "utt_id long, t double")
    assert {r.t: r.lang for r in intervals.label_at(times, segs).collect()} == {0.0: "hi", 1.0: "en", 2.0: "en", 2.1: None}


@pytest.mark.parametrize("word, ipa", [("night", "naɪt"), ("city", "sɪtj"), ("cake", "kæk"), ("gem", "dʒɛm"), ("", "?")])
def test_english_rules(spark, word, ipa):
    assert spark.createDataFrame([(word,)], "w string").select(X.english_to_ipa(X.F.col("w")).alias("y")).first().y == ipa


@pytest.mark.parametrize("word, ipa", [("नमक", "nəmək"), ("किताब", "kɪt̪aːb"), ("क्या", "kjaː")])
def test_hindi_rules(spark, word, ipa):
    assert spark.createDataFrame([(word,)], "w string").select(X.hindi_to_ipa(X.F.col("w")).alias("y")).first().y == ipa


def test_letter_queries_read_whole_texts(spark, tmp_path):
    texts = ["ka " * 100 + "na", "b" * 300 + "e", "no " * 40, "no. " * 40]
    spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(texts)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {name: {r.turn: r.y for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("x8_hindi_to_ipa", "x11_squash", "x19_ipa_to_gujarati")}
    assert got["x8_hindi_to_ipa"][0] == "kəə " * 100 + "nə"
    assert got["x11_squash"][1] == "baa"
    one = spark.createDataFrame([("no",)], "w string").select(X.ipa_to_gujarati(X.text_to_ipa(X.F.col("w"), " ")).alias("y")).first().y
    # a sign without a letter empties its own token only
    assert one and got["x19_ipa_to_gujarati"][2] == got["x19_ipa_to_gujarati"][3] == one * 40


def test_word_errors_against_dynamic_programming(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(list("abcd"), rng.integers(0, 8))), " ".join(rng.choice(list("abcd"), rng.integers(0, 8)))) for _ in range(40)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = scoring.word_error_rate(spark.createDataFrame(rows, "reference string, hypothesis string")).collect()
    assert all(r.edits == edits(r.reference.split(), r.hypothesis.split()) for r in got)


def test_dtw_against_dynamic_programming(spark):
    from speechmill.operators.align import dtw_cost

    rng = np.random.default_rng(4)
    rows = [(rng.random(n).tolist(), rng.random(m).tolist()) for n, m in ((1, 1), (1, 5), (6, 4), (9, 9))]
    for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", dtw_cost(X.F.col("a"), X.F.col("b")).alias("cost")).collect():
        d = np.full((len(r.a) + 1, len(r.b) + 1), np.inf)
        d[0, 0] = 0
        for i, x in enumerate(r.a):
            for j, y in enumerate(r.b):
                d[i + 1, j + 1] = abs(x - y) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert r.cost == pytest.approx(d[-1, -1])


@pytest.fixture
def long_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, 1, [1.0] * 12 + rng.random(52).tolist()) for i in range(3)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), [np.array(r[2]) for r in rows]


def test_alignment_queries_read_whole_vectors(spark, long_vectors):
    path, x = long_vectors
    for r in QUERIES["m1_dtw_cost"](spark, path).collect():
        a, b = x[r.pair_id], x[r.pair_id + 1]
        d = np.full((65, 65), np.inf)
        d[0, 0] = 0
        for i in range(64):
            for j in range(64):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert r.cost == pytest.approx(d[-1, -1], abs=1e-5) and r.cost > 0
    last = {r.pair_id: (r.i, r.j) for r in QUERIES["m1_dtw_path"](spark, path).orderBy("step").collect()}
    assert last == {0: (63, 63), 1: (63, 63)}
    assert QUERIES["j8_m13_warped_curve"](spark, path).count() == 2 * 64


def test_tones_are_made_of_all_values(spark, long_vectors):
    path, x = long_vectors
    signals = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>")
    for r in spectral.tones(signals).collect():
        t = np.arange(4000) / 16_000
        assert r.x == pytest.approx(sum(v * np.sin(2 * np.pi * 120 * (k + 1) * t) for k, v in enumerate(x[r.vec_id])), abs=1e-9)


def test_pitch_of_a_tone():
    t = np.arange(8000) / 16_000
    f0 = spectral.pitch(np.sin(2 * np.pi * 220 * t))
    assert np.median(f0) == pytest.approx(220, rel=0.01)
    assert not spectral.pitch(np.zeros(8000)).any()


def test_denoise_lowers_noise_and_keeps_length():
    rng = np.random.default_rng(5)
    noise = rng.normal(0, 0.1, 8000)
    out = spectral.denoise(noise)
    assert len(out) == 8000 and out.std() < 0.7 * noise.std()
    assert spectral.denoise(noise, over=0.0, least=1.0)[600:-600] == pytest.approx(noise[600:-600], abs=1e-9)


def test_resample_keeps_a_slow_tone():
    x = np.sin(2 * np.pi * 100 * np.arange(4000) / 16_000)
    y = spectral.resample(x, 16_000, 8_000)
    assert len(y) == 2000 and np.abs(y[100:-100] - np.sin(2 * np.pi * 100 * np.arange(2000) / 8_000)[100:-100]).max() < 0.01
