"""Queries of sources and sinks (on what is read back), transcripts, prosody mapping, lexicons and the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import tables as T
from ..operators import detect, lm, prosody, scoring, spectral, transcribe, translate
from ..shared import new_path
from ..sources import audio, tables
from . import align_sql as A
from .registry import FRAMES, SIGNALS, frames, query, rounded, run_sql, signals, table
from .segment_queries import _WHOLE as PAIRS
from .segment_queries import RAW, _SCORED, _TURNS, raw_runs, scored, turns
from .text_queries import _ROWS, _SENT, _lm

_TENTH = "list_transform(x, lambda v: v / 4)"


def _named(spark, sf_dir) -> DataFrame:
    """name, x: the vectors as quiet signals."""
    return signals(spark, sf_dir).select(F.col("vec_id").cast("string").alias("name"), F.transform("x", lambda v: v / 4).alias("x"))


def _stored_wav(spark, sf_dir, kind: str) -> DataFrame:
    """Written as WAV rows and read again."""
    path = new_path(spark, f"wav-{kind}")
    audio.to_wav(_named(spark, sf_dir), 16_000, kind).write.parquet(path)
    return audio.from_wav(spark.read.parquet(path))


_HELD = "greatest(-1::DOUBLE, least(1::DOUBLE, v / 4))"


# a sample is written as the integer nearest to 32767 times it, and read as that integer over 32768
_PCM16 = f"SELECT CAST(vec_id AS VARCHAR) AS name, 16000 AS rate, CAST(i - 1 AS INTEGER) AS i, round(CAST(round({_HELD} * 32767) AS BIGINT) / 32768.0::DOUBLE, 9) + 0.0::DOUBLE AS v FROM (SELECT vec_id, unnest(range(1, n + 1)) AS i, unnest(x) AS v FROM s)"


def _samples(back: DataFrame) -> DataFrame:
    return back.select("name", "rate", F.posexplode("x").alias("i", "v")).select("name", "rate", "i", rounded("v", 9).alias("v"))


@query("s1_s5_wav_pcm16", f"WITH {SIGNALS} {_PCM16}")
def wav_pcm16(spark, sf_dir):
    return _samples(_stored_wav(spark, sf_dir, "pcm16"))


@query("s1_read_wav", f"WITH {SIGNALS} {_PCM16}")
def read_wav(spark, sf_dir):
    """WAV files in the shared folder, written and read as files."""
    folder = new_path(spark, "wav-files").removeprefix("file://")
    files = audio.export_wav(audio.to_wav(_named(spark, sf_dir), 16_000), folder)
    files.write.parquet(new_path(spark, "wav-manifest"))
    return _samples(audio.read_wav(spark, folder))


@query("s6_wav_float", f"WITH {SIGNALS} SELECT CAST(vec_id AS VARCHAR) AS name, CAST(n AS INTEGER) AS n, round(list_sum(list_transform(x, lambda v: (v / 4)::FLOAT::DOUBLE)), 5) + 0.0::DOUBLE AS total FROM s")
def wav_float(spark, sf_dir):
    return _stored_wav(spark, sf_dir, "float").select("name", F.size("x").alias("n"), rounded(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("s2_mono_as_given", f"WITH {SIGNALS} SELECT CAST(vec_id AS VARCHAR) AS name, 24000 AS rate, CAST(n AS INTEGER) AS n FROM s")
def mono_as_given(spark, sf_dir):
    return audio.as_mono(_named(spark, sf_dir), 24_000).select("name", "rate", F.size("x").alias("n"))


@query("s3_scaled_for_consumer", f"WITH {SIGNALS} SELECT consumer, CAST(vec_id AS VARCHAR) AS name, round(CASE WHEN peak IS NULL OR p = 0 THEN p / 4 ELSE peak END, 6) AS peak FROM s, (VALUES ('lid', 0.9::DOUBLE), ('spoof', 1.0::DOUBLE), ('stt', NULL)) AS c(consumer, peak)")
def scaled_for_consumer(spark, sf_dir):
    out = [audio.for_consumer(_named(spark, sf_dir), c).select(F.lit(c).alias("consumer"), "name", F.round(S.peak(F.col("x")), 6).alias("peak")) for c in ("lid", "spoof", "stt")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s4_slice_or_error", f"WITH {SIGNALS} SELECT vec_id, CAST(i AS INTEGER) AS i, round(y[i + 1], 6) + 0.0::DOUBLE AS v FROM (SELECT vec_id, y, unnest(range(len(y))) AS i FROM (SELECT vec_id, x[CAST(floor(label * 0.25::DOUBLE * 16) AS INTEGER) + 1 : CAST(floor(label * 0.25::DOUBLE * 16) AS INTEGER) + 8] AS y FROM s))")
def slice_or_error(spark, sf_dir):
    cut = S.slice_or_error(F.col("x"), F.col("label") * F.lit(0.25), F.lit(0.5), 16)
    return signals(spark, sf_dir).select("vec_id", F.posexplode(cut).alias("i", "v")).select("vec_id", "i", rounded("v").alias("v"))


@query("s7_text_lines", r"SELECT regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') AS text, count(*) AS n FROM conversations GROUP BY 1")
def text_lines(spark, sf_dir):
    path = tables.write_text(table(spark, sf_dir, "conversations"), new_path(spark, "lines"))
    return tables.read_text(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("s8_json_segments", f"WITH {FRAMES}, {RAW} SELECT utt_id, seg_id, round(start, 6) AS start, round(\"end\", 6) AS \"end\", lang FROM raw")
def json_segments(spark, sf_dir):
    back = tables.read_segments(spark, tables.write_segments(raw_runs(spark, sf_dir), new_path(spark, "segments")))
    return back.select("utt_id", "seg_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "lang")


@query("s9_curves", f"WITH {FRAMES} SELECT utt_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(prob_hi, 6) AS v FROM frames")
def curves(spark, sf_dir):
    rows = frames(spark, sf_dir).groupBy("utt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "prob_hi"))), lambda s: s["prob_hi"]).alias("curve"))  # the frames of one utterance
    back = tables.read_curves(spark, tables.write_curves(rows, new_path(spark, "curves")))
    return back.select("utt_id", F.posexplode("curve").alias("frame_idx", "v")).select("utt_id", "frame_idx", F.round("v", 6).alias("v"))


@query("s11_corpus_file", f"SELECT sentence, count(*) AS n FROM (SELECT unnest({_SENT}) AS sentence FROM (SELECT regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM benchmark)) GROUP BY sentence")
def corpus_file(spark, sf_dir):
    path = tables.write_text(table(spark, sf_dir, "benchmark"), new_path(spark, "corpus"))
    return tables.read_corpus(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


@query("s12_manifest", f"WITH {FRAMES}, {RAW} SELECT 'segments' AS name, (SELECT count(DISTINCT utt_id) FROM raw) AS n_rows UNION ALL SELECT 'lines', (SELECT count(*) FROM benchmark)")
def manifest(spark, sf_dir):
    segments = tables.write_segments(raw_runs(spark, sf_dir), new_path(spark, "segments"))
    lines = tables.write_text(table(spark, sf_dir, "benchmark"), new_path(spark, "lines"))
    return tables.manifest(segments=(spark.read.json(segments), segments), lines=(tables.read_text(spark, lines), lines)).select("name", "n_rows")


@query("s13_segment_json", f"WITH {FRAMES}, {RAW} SELECT utt_id, seg_id, '{{\"id\":' || seg_id || ',\"start\":' || CAST(round(start, 3) AS VARCHAR) || ',\"end\":' || CAST(round(\"end\", 3) AS VARCHAR) || ',\"lang\":\"' || lang || '\"}}' AS json FROM raw")
def segment_json(spark, sf_dir):
    rows = raw_runs(spark, sf_dir)
    return rows.select("utt_id", "seg_id", tables.as_json(F.col("seg_id").alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "lang").alias("json"))


@query("s14_dump", f"WITH {_TURNS} SELECT utt_id, seg_id, printf(E'[Full transcript]\\n%s\\n\\n[Duration] %.2fs\\n\\n[Word-level timestamps]\\n  %6.2fs – %6.2fs  [%s]  ''%s''  (conf=%.3f)', text, \"end\", start, \"end\", lang, text, 0.5::DOUBLE) AS dump FROM turns")
def dump(spark, sf_dir):
    word = F.struct(F.col("text").alias("word"), "start", "end", "lang", F.lit(0.5).alias("confidence"))
    return turns(spark, sf_dir).select("utt_id", "seg_id", tables.dump(F.col("text"), F.col("end"), F.array(word)).alias("dump"))


_CODES = ", ".join(f"'{c}'" for c in T.CLASS_CODES)


@query("p15_class_labels", f"SELECT vec_id, label AS idx, [{_CODES}][label + 1] AS code FROM embeddings")
def class_labels(spark, sf_dir):
    """The code of the class that each vector's label is the index of."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("idx"))
    classes = translate.class_labels(spark).withColumnRenamed("label", "code")
    return rows.join(F.broadcast(classes), "idx", "left").select("vec_id", "idx", "code")


_DECODED = f"decoded AS (SELECT *, ln((seg_id % 7 + 1) / 8.0::DOUBLE) AS avg_logprob, (length(text) % 10) / 10.0::DOUBLE AS no_speech_prob FROM turns)"


def decoded(spark, sf_dir) -> DataFrame:
    """Turns as decoded segments: the mean log probability and the probability of silence are made from place and length."""
    return turns(spark, sf_dir).withColumn("avg_logprob", F.ln((F.col("seg_id") % 7 + 1) / F.lit(8.0))).withColumn("no_speech_prob", (F.length("text") % 10) / F.lit(10.0))


@query("p9_silence_gate", f"WITH {_TURNS}, {_DECODED} SELECT utt_id, seg_id FROM decoded WHERE no_speech_prob <= 0.6::DOUBLE")
def silence_gate(spark, sf_dir):
    return transcribe.heard(decoded(spark, sf_dir)).select("utt_id", "seg_id")


@query("m21_decoded_words", rf"""WITH {_TURNS}, {_DECODED}, cut AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM decoded)
SELECT utt_id, seg_id, CAST(pos AS INTEGER) AS pos, ws[pos + 1] AS word, round(start + pos * (("end" - start) / len(ws)), 6) AS word_start, round(exp(avg_logprob), 6) AS confidence FROM (SELECT *, unnest(range(len(ws))) AS pos FROM cut)""")
def decoded_words(spark, sf_dir):
    return transcribe.decoded_words(decoded(spark, sf_dir)).select("utt_id", "seg_id", "pos", "word", F.round("word_start", 6).alias("word_start"), F.round("confidence", 6).alias("confidence"))


_KEPT_TURNS = f"{_TURNS}, {_DECODED}, k AS (SELECT * FROM decoded WHERE no_speech_prob <= 0.6::DOUBLE AND \"end\" - start >= 0.3::DOUBLE)"


@query(
    "m22_transcripts",
    rf"""WITH {_KEPT_TURNS}, t AS (SELECT *, lag(lang) OVER (PARTITION BY utt_id ORDER BY seg_id) AS before FROM k WHERE trim(text) <> ''), f AS (SELECT utt_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before <> lang THEN ' ‖ ' ELSE ' ' END || trim(text), '' ORDER BY seg_id) AS full_text FROM t GROUP BY utt_id)
SELECT c.utt_id, coalesce(full_text, '') AS full_text, c.duration FROM (SELECT utt_id, max("end") + 1 AS duration FROM turns GROUP BY utt_id) c LEFT JOIN f USING (utt_id)""",
)
def transcripts(spark, sf_dir):
    """Each conversation as the audio of an utterance that goes on for a second after its last turn."""
    audio_of = turns(spark, sf_dir).groupBy("utt_id").agg((F.max("end") + 1).alias("duration"))
    return transcribe.transcripts(decoded(spark, sf_dir), audio_of).select("utt_id", "full_text", "duration")


@query("m16_train_lines", f"WITH s AS (SELECT unnest({_SENT}) AS line FROM benchmark UNION ALL SELECT trim(unnest(string_split(text, chr(10)))) FROM benchmark), t AS (SELECT {_lm('line')} AS tokens FROM s) SELECT word, count(*) AS cnt FROM (SELECT unnest(tokens) AS word FROM t) GROUP BY word")
def train_lines(spark, sf_dir):
    return lm.unigrams(lm.train_lines(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")))


_TRAIN = f"s AS (SELECT unnest({_SENT}) AS line FROM benchmark UNION ALL SELECT trim(unnest(string_split(text, chr(10)))) FROM benchmark), g AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({_lm('line')}) AS word FROM s) GROUP BY word), v AS (SELECT sum(cnt) AS total, count(*) AS kinds FROM g)"


@query(
    "m23_decoder_tables",
    f"WITH {_TRAIN}, e AS (SELECT item_id * 1000 + pos AS token_id, trim(lower(ws[pos + 1])) AS word FROM (SELECT item_id, ws, unnest(range(len(ws))) AS pos FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark))) "
    "SELECT token_id, word, round(1.5::DOUBLE * greatest(ln((cnt + 1) / (total + kinds)), -10), 6) AS bias FROM e JOIN g USING (word) CROSS JOIN v WHERE word <> '' AND word NOT LIKE '<%'",
)
def decoder_tables(spark, sf_dir):
    corpus = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    vocabulary = corpus.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")).select((F.col("doc_id") * 1000 + F.col("pos")).alias("token_id"), "token")
    return lm.decoder_tables(corpus, vocabulary)[1].select("token_id", "word", rounded("bias").alias("bias"))


@query(
    "x24_section_lexicon",
    r"WITH e AS (SELECT lower(w) AS word, lang || ':' || lower(w) AS target, lang AS section FROM (SELECT DISTINCT lang, unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents)) SELECT word, arg_max(target, section) AS target FROM e WHERE NOT regexp_matches(word, '\s') GROUP BY word",
)
def section_lexicon(spark, sf_dir):
    """Words of each language as sections of a lexicon."""
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).distinct()
    return translate.section_lexicon(words.select("section", F.lower("w").alias("word"), F.concat("section", F.lit(":"), F.lower("w")).alias("target")).distinct())


@query("l9_perturbed", f"WITH {SIGNALS}, w AS (SELECT *, least(0.05::DOUBLE, sqrt((e / n) / 100) * 0.999::DOUBLE) AS step FROM s) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(greatest(-1::DOUBLE, least(1::DOUBLE, v - step * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END))), 6) + 0.0::DOUBLE AS v FROM (SELECT vec_id, step, unnest(range(1, n + 1)) AS i, unnest(x) AS v FROM w)")
def perturbed(spark, sf_dir):
    weights = F.transform("x", lambda v, i: F.when(i % 2 == 0, 0.5).otherwise(-0.25))
    return signals(spark, sf_dir).select("vec_id", F.posexplode(S.perturbed(F.col("x"), weights, F.lit(0.05), 20.0)).alias("i", "v")).select("vec_id", "i", rounded("v").alias("v"))


def _prosody(spark, sf_dir) -> DataFrame:
    """Each vector and the next one of its label as pitch (first half) and energy (second half)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    half = lambda c, k: F.transform(F.slice(c, 1 + 32 * k, 32), lambda v: F.abs(v) * (200 if k == 0 else 1))
    after = F.lead("x").over(Window.partitionBy("label").orderBy("vec_id"))
    both = rows.withColumn("y", after).where("y is not null")
    return both.select(F.col("vec_id").alias("pair_id"), half("x", 0).alias("f0_a"), half("x", 1).alias("energy_a"), half("y", 0).alias("f0_b"), half("y", 1).alias("energy_b"), F.transform("y", lambda v: v / 4).alias("x"))


def _half(c: str, k: int) -> str:
    return f"list_transform({c}[{32 * k + 1}:{32 * k + 32}], lambda v: abs(v) * {200 if k == 0 else 1})"


def _standard(values: str) -> str:
    """Mean 0 and deviation 1; a constant gives 0."""
    less = f"list_transform([{values}], lambda w: list_transform([{A.total('w')} / len(w)], lambda m: list_transform(w, lambda v: v - m))[1])[1]"
    return f"list_transform([{less}], lambda w: list_transform([sqrt({A.total('list_transform(w, lambda v: v * v)')} / len(w))], lambda d: list_transform(w, lambda v: CASE WHEN d < 1e-8 THEN 0 ELSE v / d END))[1])[1]"


def _prosody_frames(c: str) -> str:
    pitch = _standard(f"list_transform({_half(c, 0)}, lambda v: CASE WHEN v > 1 THEN ln(v + 1e-6) ELSE 0 END)")
    return f"list_transform(list_zip({pitch}, {_standard(_half(c, 1))}), lambda z: [z[1], z[2]])"


_PROSODY = f"""{PAIRS}, pairs_p AS MATERIALIZED (SELECT pair_id, a AS x, b AS y, {_prosody_frames('a')} AS a, {_prosody_frames('b')} AS b FROM pairs),
{A.paths("sqrt((x[1] - y[1]) * (x[1] - y[1]) + (x[2] - y[2]) * (x[2] - y[2]))", "pairs_p")}"""


@query("m2_prosody_paths", f"WITH {_PROSODY} {A.steps()}")
def prosody_paths(spark, sf_dir):
    return prosody.prosody_paths(_prosody(spark, sf_dir)).select("pair_id", F.posexplode("path").alias("step", "p")).select("pair_id", "step", "p.i", "p.j")


_GAINED = f"""{_PROSODY}, warped AS (SELECT pair_id, p[2] AS j, avg(f0[p[1]]) AS f0, avg(energy[p[1]]) AS energy FROM (SELECT pair_id, {_half('pairs.a', 0)} AS f0, {_half('pairs.a', 1)} AS energy, unnest(path) AS p FROM paths JOIN pairs USING (pair_id)) GROUP BY pair_id, p[2]),
curves AS (SELECT pair_id, list(f0 ORDER BY j) AS f0, list(energy ORDER BY j) AS energy FROM warped GROUP BY pair_id),
gains AS (SELECT pair_id, b, f0, energy, list_transform(energy, lambda e, j: e / greatest(abs(b[32 + j]), 1e-6)) AS g FROM curves JOIN pairs USING (pair_id)),
samples AS (SELECT *, i // 2 AS k, least(i // 2 + 1, 31) AS after FROM (SELECT *, unnest(range(len(b))) AS i FROM gains))"""


@query(
    "m13_mapped_prosody",
    f"WITH {_GAINED} SELECT pair_id, CAST(i AS INTEGER) AS i, round(CASE WHEN f0[k + 1] > 1 THEN f0[k + 1] ELSE 0 END, 6) AS f0, round(energy[k + 1], 6) AS energy, "
    "round(greatest(-1::DOUBLE, least(1::DOUBLE, b[i + 1] / 4 * (g[k + 1] + (g[after + 1] - g[k + 1]) * (i / 2.0::DOUBLE - k)))), 6) + 0.0::DOUBLE AS v FROM samples",
)
def mapped_prosody(spark, sf_dir):
    """Each sample with the pitch and energy of its frame of two samples."""
    rows = prosody.mapped_prosody(_prosody(spark, sf_dir), 2).select("pair_id", "f0", "energy", F.posexplode("x").alias("i", "v"))
    at = lambda c: F.round(F.get(c, F.floor(F.col("i") / 2).cast("int")), 6).alias(c)
    return rows.select("pair_id", "i", at("f0"), at("energy"), rounded("v").alias("v"))


def _labelled(spark, sf_dir) -> DataFrame:
    """vec_id, pooled, label: pooled features of the tones of each vector; the class is whether its label is even."""
    rows = signals(spark, sf_dir)
    pooled = detect.pooled(spectral.features(spectral.tones(rows.select("vec_id", "x")), "mfcc"))
    path = new_path(spark, "pooled")  # read many times by the fit
    pooled.join(rows.select("vec_id", (F.col("label") % 2).alias("label")), "vec_id").write.parquet(path)
    return spark.read.parquet(path)


@query("l6_l7_detector_scores")
def detector_scores(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    model, _ = detect.fit(rows)
    return detect.scores(rows, model).select("vec_id", "label", F.round("p", 6).alias("p"), "decision")


@query("l8_s10_train_and_evaluate")
def train_and_evaluate(spark, sf_dir):
    return detect.train_and_evaluate(_labelled(spark, sf_dir), new_path(spark, "detector"))


@query("j12_frames_with_labels", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v, 6) + 0.0::DOUBLE AS v, CAST((i - 1) % 2 AS INTEGER) AS label FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)")
def frames_with_labels(spark, sf_dir):
    """Two sequences by place: columns of one row, no join."""
    labels = F.transform("x", lambda v, i: i % 2)
    return signals(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(F.col("x").alias("v"), labels.alias("label"))).alias("i", "r")).select("vec_id", "i", rounded("r.v").alias("v"), "r.label")


def _epochs_sql(epochs: int) -> str:
    """Common table expressions of so many epochs over whole batches: w1 .. hold the weights (k, the bias last), p1 .. the probabilities."""
    steps = ["""e AS (SELECT vec_id, label % 2 AS y, CASE WHEN vec_id % 4 = 0 THEN 'val' ELSE 'train' END AS part, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings),
moments AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS s FROM e WHERE part = 'train' GROUP BY k),
z AS MATERIALIZED (SELECT vec_id, y, part, k, (v - m) / s AS v FROM e JOIN moments USING (k) UNION ALL SELECT DISTINCT vec_id, y, part, (SELECT max(k) + 1 FROM e), 1.0::DOUBLE FROM e),
w0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS w FROM z), p0 AS MATERIALIZED (SELECT vec_id, y, part, 0.5::DOUBLE AS p FROM z GROUP BY ALL)"""]
    for n in range(1, epochs + 1):
        steps.append(f"""w{n} AS MATERIALIZED (SELECT k, w - (g + CASE WHEN k = (SELECT max(k) FROM z) THEN 0 ELSE 0.01::DOUBLE * w END) AS w FROM w{n - 1} JOIN (SELECT k, avg((p - p{n - 1}.y) * v) AS g FROM z JOIN p{n - 1} USING (vec_id) WHERE z.part = 'train' GROUP BY k) USING (k)),
p{n} AS MATERIALIZED (SELECT vec_id, y, part, 1 / (1 + exp(-sum(v * w))) AS p FROM z JOIN w{n} USING (k) GROUP BY vec_id, y, part)""")
    return ", ".join(steps)


_LOSS = "-(y * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))"


def _by_epochs(spark, sf_dir) -> tuple[DataFrame, str]:
    """The vectors, standardised, and the folder of three epochs over them; a quarter of them is kept for validation."""
    part = F.when(F.col("vec_id") % 4 == 0, "val").otherwise("train")
    rows = signals(spark, sf_dir).select("vec_id", F.col("x").alias("pooled"), (F.col("label") % 2).alias("label"), part.alias("part"))
    rows, folder = detect.standardised(rows), new_path(spark, "epochs-of")
    detect.fit_epochs(rows, folder, 3)
    return rows, folder


@query("l6_training_history", f"WITH {_epochs_sql(3)}, every AS ({' UNION ALL '.join(f'SELECT {n} AS n, * FROM p{n}' for n in (1, 2, 3))}) SELECT CAST(n - 1 AS INTEGER) AS epoch, round(avg({_LOSS}) FILTER (part = 'train'), 6) AS train_loss, round(avg({_LOSS}) FILTER (part = 'val'), 6) AS val_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) FILTER (part = 'val'), 6) AS val_accuracy FROM every GROUP BY n")
def training_history(spark, sf_dir):
    _, folder = _by_epochs(spark, sf_dir)
    return detect.history(spark, folder, 3).select("epoch", *(F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")))


@query("l7_scores_of_epochs", f"WITH {_epochs_sql(3)} SELECT vec_id, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 'bona_fide' ELSE 'spoof' END AS decision FROM p3")
def scores_of_epochs(spark, sf_dir):
    """All vectors by the model of the last epoch, as it was written."""
    rows, folder = _by_epochs(spark, sf_dir)
    last = detect.epochs_of(spark, folder, 3)[-1]
    scored = rows.select("vec_id", detect.probability(last.weights, last.bias).alias("p"))
    return scored.select("vec_id", F.round("p", 6).alias("p"), scoring.decision(F.col("p")).alias("decision"))


@query("l8_s10_evaluated_epoch", f"WITH {_epochs_sql(3)} SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg({_LOSS}), 6) AS loss, count(*) AS n FROM p3 WHERE part = 'val'")
def evaluated_epoch(spark, sf_dir):
    """The written model of the last epoch on the part kept for validation."""
    rows, folder = _by_epochs(spark, sf_dir)
    last = detect.epochs_of(spark, folder, 3)[-1]
    found = scoring.accuracy_and_loss(rows.where("part = 'val'").select("label", detect.probability(last.weights, last.bias).alias("p")))
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"), "n")
