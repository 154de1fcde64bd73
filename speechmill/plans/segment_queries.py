"""Queries of frames, segments, intervals, words and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import align, decode, intervals, scoring, segments, spectral
from . import align_sql as A
from . import spectral_sql as Z
from .registry import FRAMES, SIGNALS, frames, query, rounded, run_sql, table

def _times(df: DataFrame, *more: str) -> DataFrame:
    return df.select("utt_id", "seg_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "lang", *more)


def _smooth_sql(value: str, half: int, edge: bool) -> str:
    """Each frame with its neighbours, mirrored at the ends, as rows (utt_id, frame_idx, k, v)."""
    period = "(n * 2)" if edge else "greatest(n * 2 - 2, 1)"
    place = f"((frame_idx + k) % {period} + {period}) % {period}"
    back = f"CASE WHEN {place} < n THEN {place} ELSE {period} - {'1 - ' if edge else ''}{place} END"
    back = back if edge else f"CASE WHEN n = 1 THEN 0 ELSE {back} END"
    return f"""sized AS (SELECT utt_id, frame_idx, count(*) OVER (PARTITION BY utt_id) AS n FROM frames),
wide AS (SELECT utt_id, frame_idx, k, {back} AS place FROM sized, (SELECT unnest(range(-{half}, {half} + 1)) AS k)),
near AS (SELECT w.utt_id, w.frame_idx, w.k, f.{value} AS v FROM wide w JOIN frames f ON f.utt_id = w.utt_id AND f.frame_idx = w.place)"""


_W = segments.gaussian_weights(7)


@query(
    "a1_gaussian_smoothing",
    f"WITH {FRAMES}, {_smooth_sql('prob_hi', 3, False)} SELECT utt_id, frame_idx, round(sum(v * [{', '.join(f'{w!r}::DOUBLE' for w in _W)}][k + 4]), 6) AS smooth FROM near GROUP BY utt_id, frame_idx",
)
def gaussian(spark, sf_dir):
    return segments.gaussian_smoothed(frames(spark, sf_dir)).select("utt_id", "frame_idx", F.round("smooth", 6).alias("smooth"))


_MEDIAN = f"{_smooth_sql('lang', 2, True)}, median AS (SELECT utt_id, frame_idx, CASE WHEN count(*) FILTER (v = 'en') > 2 THEN 'en' ELSE 'hi' END AS lang FROM near GROUP BY utt_id, frame_idx)"


@query("a2_median_labels", f"WITH {FRAMES}, {_MEDIAN} SELECT * FROM median")
def median(spark, sf_dir):
    return segments.median_labels(frames(spark, sf_dir))


@query("a3_zscore", f"WITH {FRAMES} SELECT utt_id, frame_idx, round(CASE WHEN stddev_pop(prob_hi) OVER w < 1e-8 THEN 0 ELSE (prob_hi - avg(prob_hi) OVER w) / stddev_pop(prob_hi) OVER w END, 5) + 0.0::DOUBLE AS z FROM frames WINDOW w AS (PARTITION BY utt_id)")
def zscore(spark, sf_dir):
    return segments.zscores(frames(spark, sf_dir), "prob_hi").select("utt_id", "frame_idx", rounded("z", 5).alias("z"))


@query("a4_cmvn", "WITH b AS (SELECT label, vec_id, unnest(range(len(embedding))) AS coef, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, CAST(coef AS INTEGER) AS coef, round((v - avg(v) OVER w) / (CASE WHEN stddev_pop(v) OVER w < 1e-8 THEN 1 ELSE stddev_pop(v) OVER w END), 5) + 0.0::DOUBLE AS z FROM b WINDOW w AS (PARTITION BY label, coef)")
def cmvn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("coef", "v"))
    by = Window.partitionBy("label", "coef")
    std = F.stddev_pop("v").over(by)
    return rows.select("vec_id", "coef", rounded((F.col("v") - F.avg("v").over(by)) / F.when(std < 1e-8, 1.0).otherwise(std), 5).alias("z"))


@query(
    "a5_forward_fill",
    f"WITH {FRAMES}, h AS (SELECT utt_id, frame_idx, prob_hi AS curve, CASE WHEN event = 'error' OR frame_idx < 2 THEN NULL ELSE prob_hi END AS v FROM frames), g AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS f FROM h) SELECT utt_id, frame_idx, round(CASE WHEN max(abs(f)) OVER (PARTITION BY utt_id) < 1e-8 THEN avg(curve) OVER (PARTITION BY utt_id) ELSE f END, 6) AS filled FROM g",
)
def forward_fill(spark, sf_dir):
    holes = frames(spark, sf_dir).select("utt_id", "frame_idx", F.col("prob_hi").alias("curve"), F.when((F.col("event") == "error") | (F.col("frame_idx") < 2), F.lit(None)).otherwise(F.col("prob_hi")).alias("v"))
    return segments.forward_filled(holes, "v", "frame_idx", source="curve").select("utt_id", "frame_idx", F.round("filled", 6).alias("filled"))


def raw_runs(spark, sf_dir) -> DataFrame:
    return segments.runs(frames(spark, sf_dir))


def smooth_runs(spark, sf_dir) -> DataFrame:
    rows = frames(spark, sf_dir)
    return segments.runs(rows.drop("lang").join(segments.median_labels(rows), ["utt_id", "frame_idx"]))


RAW = run_sql("frames", "lang", "raw")
SMOOTH = f"{_MEDIAN}, voted AS (SELECT f.* REPLACE (m.lang AS lang) FROM frames f JOIN median m USING (utt_id, frame_idx)), {run_sql('voted', 'lang', 'smooth')}"
_OUT = 'utt_id, seg_id, round(start, 6) AS start, round("end", 6) AS "end", lang'


@query("g1_run_lengths", f"WITH {FRAMES}, {run_sql('frames', 'event', 'raw')} SELECT {_OUT}, n_frames FROM raw")
def run_lengths(spark, sf_dir):
    return _times(segments.runs(frames(spark, sf_dir), "event"), "n_frames")


@query("g3_merge_equal", f"WITH {FRAMES}, {RAW}, k AS (SELECT * FROM raw WHERE NOT (lang = 'en' AND n_frames = 1)), m AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY utt_id ORDER BY seg_id) - 1 AS INTEGER) AS run FROM (SELECT *, CASE WHEN lag(lang) OVER (PARTITION BY utt_id ORDER BY seg_id) IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS fresh FROM k)) SELECT utt_id, run AS seg_id, round(arg_min(start, seg_id), 6) AS start, round(arg_max(\"end\", seg_id), 6) AS \"end\", any_value(lang) AS lang, CAST(sum(n_frames) AS BIGINT) AS n_frames FROM m GROUP BY utt_id, run")
def merge_equal(spark, sf_dir):
    return _times(segments.merged(raw_runs(spark, sf_dir).where("not (lang = 'en' and n_frames = 1)")), "n_frames")


def _list_fold(step: str, of: str = "s") -> str:
    """A fold over lists of one segment each; `a` is what is done, `x` the next."""
    return f"CASE WHEN len({of}) = 0 THEN [] ELSE list_reduce(list_prepend([], list_transform({of}, lambda v: [v])), lambda a, x: {step}) END"


_SEG = "{{'start': {0}, 'end': {1}, 'lang': {2}, 'mark': {3}, 'i': {4}}}"
_X, _L = "x[1]", "a[len(a)]"
#: Each segment with its place, so that a step can look at those after it.
_PLACED = f"list_transform(s, lambda v, i: {_SEG.format('v.start', 'v.end', 'v.lang', '0', 'i')})"
_JOINED = _list_fold(f"CASE WHEN len(a) > 0 AND {_L}.lang = {_X}.lang THEN a[:len(a) - 1] || [{_SEG.format(f'{_L}.start', f'{_X}.end', f'{_L}.lang', '0', '0')}] ELSE a || x END", "t")
_B = "(CASE WHEN len(a) > 0 AND a[len(a)].mark = 1 THEN a[:len(a) - 1] ELSE a END)"
_START = f"(CASE WHEN len(a) > 0 AND {_L}.mark = 1 THEN {_L}.start ELSE {_X}.start END)"
_AFTER = f"q[{_X}.i + 1]"
_ABSORB = _list_fold(
    f"""CASE WHEN {_X}.end - {_START} >= 0.2::DOUBLE THEN {_B} || [{_SEG.format(_START, f'{_X}.end', f'{_X}.lang', '0', '0')}]
  WHEN len({_B}) > 0 AND ({_X}.i = len(q) OR {_B}[len({_B})].end - {_B}[len({_B})].start >= {_AFTER}.end - {_AFTER}.start) THEN {_B}[:len({_B}) - 1] || [{_SEG.format(f'{_B}[len({_B})].start', f'{_X}.end', f'{_B}[len({_B})].lang', '0', '0')}]
  WHEN {_X}.i < len(q) THEN {_B} || [{_SEG.format(_START, f'{_X}.end', f'{_X}.lang', '1', '0')}] ELSE {_B} || [{_SEG.format(_START, f'{_X}.end', f'{_X}.lang', '0', '0')}] END""",
    "q",
)
_FLICKERS = "q[{0}].lang = q[{0} + 2].lang AND q[{0} + 1].end - q[{0} + 1].start < 0.4::DOUBLE"
_DROP = _list_fold(
    f"""CASE WHEN len(a) > 0 AND {_L}.mark > 0 THEN a[:len(a) - 1] || [{_SEG.format(f'{_L}.start', f'{_L}.end', f'{_L}.lang', f'{_L}.mark - 1', '0')}]
  WHEN {_X}.i + 2 <= len(q) AND {_FLICKERS.format(f'{_X}.i')} THEN a || [{_SEG.format(f'{_X}.start', f'q[{_X}.i + 2].end', f'{_X}.lang', '2', '0')}] ELSE a || x END""",
    "q",
)


def refine_sql(source: str) -> str:
    """Common table expressions that end in `refined`: sweeps by recursion, each a fold."""
    cast = "STRUCT(start DOUBLE, \"end\" DOUBLE, lang VARCHAR, mark INTEGER, i BIGINT)[]"
    return f"""listed AS (SELECT utt_id, list({_SEG.format('start', '"end"', 'lang', '0', '0')} ORDER BY seg_id)::{cast} AS t FROM {source} GROUP BY utt_id),
once AS (SELECT utt_id, ({_JOINED})::{cast} AS s FROM listed),
absorbed AS (SELECT utt_id, 0 AS round, s FROM once UNION ALL SELECT utt_id, round + 1, ({_JOINED})::{cast} FROM (SELECT utt_id, round, ({_ABSORB})::{cast} AS t FROM (SELECT utt_id, round, ({_PLACED})::{cast} AS q FROM absorbed WHERE len(s) > 1 AND len(list_filter(s, lambda v: v.end - v.start < 0.2::DOUBLE)) > 0))),
still AS (SELECT utt_id, arg_max(s, round) AS s FROM absorbed GROUP BY utt_id),
dropped AS (SELECT utt_id, 0 AS round, s FROM still UNION ALL SELECT utt_id, round + 1, ({_JOINED})::{cast} FROM (SELECT utt_id, round, ({_DROP})::{cast} AS t FROM (SELECT utt_id, round, ({_PLACED})::{cast} AS q FROM dropped) WHERE len(list_filter(range(1, len(q) - 1), lambda k: {_FLICKERS.format('k')})) > 0)),
last AS (SELECT utt_id, arg_max(s, round) AS s FROM dropped GROUP BY utt_id),
refined AS (SELECT utt_id, CAST(k - 1 AS INTEGER) AS seg_id, round(s[k].start, 3) AS start, round(s[k].end, 3) AS "end", s[k].lang AS lang FROM (SELECT utt_id, s, unnest(range(1, len(s) + 1)) AS k FROM last))"""


@query("g2_g5_refine", f"WITH RECURSIVE {FRAMES}, {RAW}, {refine_sql('raw')} SELECT * FROM refined")
def refine(spark, sf_dir):
    return segments.refined(raw_runs(spark, sf_dir))


_G6 = _smooth_sql("prob_hi", 3, False).replace("frames", "pair_shares").replace("sized", "g_sized").replace("wide", "g_wide").replace("near", "g_near")
_G6 = f"""pair_shares AS (SELECT utt_id, frame_idx, start, "end", prob_hi / (prob_hi + 0.93::DOUBLE + 1e-12::DOUBLE) AS prob_hi FROM frames),
{_G6}, smoothed AS (SELECT utt_id, frame_idx, sum(v * [{', '.join(f'{w!r}::DOUBLE' for w in _W)}][k + 4]) AS smooth FROM g_near GROUP BY utt_id, frame_idx),
labelled AS (SELECT utt_id, frame_idx, CASE WHEN smooth >= 0.5::DOUBLE THEN 'hi' ELSE 'en' END AS lang FROM smoothed),
{_MEDIAN.replace('frames', 'labelled')}, voted AS (SELECT b.utt_id, b.frame_idx, b.start, b."end", m.lang FROM pair_shares b JOIN median m USING (utt_id, frame_idx)), {run_sql('voted', 'lang', 'predicted')}"""


@query("g6_predict", f"WITH RECURSIVE {FRAMES}, {_G6}, {refine_sql('predicted')} SELECT * FROM refined")
def predict(spark, sf_dir):
    """Frame probabilities to smoothed, refined segments of one language each."""
    rows = frames(spark, sf_dir)
    hi, en, label = segments.binary_probabilities(F.col("prob_hi"), F.lit(0.93))
    binary = rows.select("utt_id", "frame_idx", "start", "end", hi.alias("prob_hi"), en.alias("prob_en"), label.alias("lang"))
    smooth = segments.gaussian_smoothed(binary)
    voted = smooth.select("utt_id", "frame_idx", F.when(F.col("smooth") >= 0.5, "hi").otherwise("en").alias("lang"))
    labels = segments.median_labels(voted)
    return segments.refined(segments.runs(binary.drop("lang").join(labels, ["utt_id", "frame_idx"])))


_CELLS = """bounds AS (SELECT utt_id, start AS b FROM raw UNION SELECT utt_id, "end" FROM raw UNION SELECT utt_id, start FROM smooth UNION SELECT utt_id, "end" FROM smooth),
cells AS (SELECT utt_id, start, "end", (start + "end") / 2 AS t FROM (SELECT utt_id, b AS start, lead(b) OVER (PARTITION BY utt_id ORDER BY b) AS "end" FROM bounds) WHERE "end" > start)"""


def _at(source: str) -> str:
    return f"(SELECT s.lang FROM {source} s WHERE s.utt_id = c.utt_id AND s.start <= c.t AND c.t < s.\"end\" ORDER BY s.seg_id LIMIT 1)"  # a middle of a cell is never at the last end


@query("j6_boundary_cells", f"WITH {FRAMES}, {RAW}, {SMOOTH}, {_CELLS} SELECT utt_id, round(start, 6) AS start, round(\"end\", 6) AS \"end\", round(t, 6) AS t FROM cells")
def cells(spark, sf_dir):
    found = intervals.boundary_cells(raw_runs(spark, sf_dir), smooth_runs(spark, sf_dir))
    return found.select("utt_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "t")))


@query("j5_label_at", f"WITH {FRAMES}, {RAW}, {SMOOTH}, {_CELLS} SELECT c.utt_id, round(c.t, 6) AS t, {_at('smooth')} AS lang FROM cells c")
def label_at(spark, sf_dir):
    a, b = raw_runs(spark, sf_dir), smooth_runs(spark, sf_dir)
    return intervals.label_at(intervals.boundary_cells(a, b).select("utt_id", "t"), b).select("utt_id", F.round("t", 6).alias("t"), "lang")


@query("r13_switching_accuracy", f"WITH {FRAMES}, {RAW}, {SMOOTH}, {_CELLS}, both_labels AS (SELECT c.*, {_at('raw')} AS a, {_at('smooth')} AS b FROM cells c) SELECT utt_id, round(sum(CASE WHEN a IS NOT DISTINCT FROM b THEN \"end\" - start ELSE 0 END) / sum(\"end\" - start), 6) AS accuracy, round(sum(\"end\" - start), 6) AS seconds FROM both_labels WHERE a IS NOT NULL GROUP BY utt_id")
def accuracy(spark, sf_dir):
    found = intervals.switching_accuracy(raw_runs(spark, sf_dir), smooth_runs(spark, sf_dir))
    return found.select("utt_id", F.round("accuracy", 6).alias("accuracy"), F.round("seconds", 6).alias("seconds"))


@query("p8_long_segments", f"WITH {FRAMES}, {RAW} SELECT {_OUT} FROM raw WHERE \"end\" - start >= 0.3::DOUBLE")
def long_segments(spark, sf_dir):
    return _times(raw_runs(spark, sf_dir).where(F.col("end") - F.col("start") >= 0.3))


_AUDIO = "audio AS (SELECT vec_id AS utt_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _audio(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("utt_id"), F.col("embedding").cast("array<double>").alias("x"))


@query("j4_segment_samples", f"WITH {FRAMES}, {RAW}, {_AUDIO} SELECT utt_id, seg_id, CAST(len(y) AS INTEGER) AS n, round(coalesce(list_sum(y), 0), 6) + 0.0::DOUBLE AS total FROM (SELECT utt_id, seg_id, x[CAST(greatest(0, floor((start - 0.1::DOUBLE) * 16)) AS INTEGER) + 1 : CAST(least(len(x), floor((\"end\" + 0.1::DOUBLE) * 16)) AS INTEGER)] AS y FROM raw JOIN audio USING (utt_id) WHERE \"end\" - start >= 0.3::DOUBLE)")
def segment_samples(spark, sf_dir):
    cut = intervals.samples_of(raw_runs(spark, sf_dir), _audio(spark, sf_dir), 16)
    return cut.select("utt_id", "seg_id", F.size("x").alias("n"), rounded(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("p10_default_segment", f"WITH {FRAMES}, {RAW}, {_AUDIO} SELECT {_OUT} FROM raw UNION ALL SELECT utt_id, 0, 0.0::DOUBLE, round(len(x) / 16.0::DOUBLE, 6), 'hi' FROM audio WHERE utt_id NOT IN (SELECT utt_id FROM raw)")
def default_segment(spark, sf_dir):
    return _times(intervals.or_whole(raw_runs(spark, sf_dir), _audio(spark, sf_dir), 16))


@query("r5_utterance_probabilities", f"WITH {FRAMES}, m AS (SELECT utt_id, avg(prob_hi) AS hi, avg(prob_en) AS en FROM frames GROUP BY utt_id) SELECT utt_id, round(hi / (hi + en + 1e-12), 6) AS prob_hi, round(en / (hi + en + 1e-12), 6) AS prob_en, CASE WHEN hi >= en THEN 'hi' ELSE 'en' END AS lang FROM m")
def utterance_probabilities(spark, sf_dir):
    return segments.utterance_probabilities(frames(spark, sf_dir)).select("utt_id", F.round("prob_hi", 6).alias("prob_hi"), F.round("prob_en", 6).alias("prob_en"), "lang")


#: A turn of a conversation is a segment of three seconds; two turns overlap by one.
_TURNS = "turns AS (SELECT conv_id AS utt_id, CAST(turn AS INTEGER) AS seg_id, turn * 2.0::DOUBLE AS start, turn * 2.0::DOUBLE + 3.0::DOUBLE AS \"end\", role AS lang, text FROM conversations)"
_WORDS = r"""cut AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM turns),
words AS (SELECT utt_id, seg_id, CAST(pos AS INTEGER) AS pos, ws[pos + 1] AS word, start + pos * (("end" - start) / len(ws)) AS word_start, start + (pos + 1) * (("end" - start) / len(ws)) AS word_end FROM (SELECT *, unnest(range(len(ws))) AS pos FROM cut))"""


def turns(spark, sf_dir) -> DataFrame:
    start = F.col("turn") * F.lit(2.0)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("utt_id"), F.col("turn").cast("int").alias("seg_id"), start.alias("start"), (start + 3.0).alias("end"), F.col("role").alias("lang"), "text")


@query("g7_word_times", f"WITH {_TURNS}, {_WORDS} SELECT utt_id, seg_id, pos, word, round(word_start, 6) AS word_start, round(word_end, 6) AS word_end FROM words")
def word_times(spark, sf_dir):
    return intervals.word_times(turns(spark, sf_dir)).select("utt_id", "seg_id", "pos", "word", F.round("word_start", 6).alias("word_start"), F.round("word_end", 6).alias("word_end"))


_SAID = "lower({0}.word) = lower({1}.word) AND {1}.e > {1}.b AND (least({0}.e, {1}.e) - greatest({0}.b, {1}.b)) / ({1}.e - {1}.b) > 0.5::DOUBLE"


@query(
    "g8_deduplicated_words",
    f"WITH {_TURNS}, {_WORDS}, listed AS (SELECT utt_id, list({{'word': word, 'b': word_start, 'e': word_end, 'seg_id': seg_id, 'pos': pos}} ORDER BY word_start, seg_id, pos, word_end, word) AS ws FROM words GROUP BY utt_id), "
    f"kept AS (SELECT utt_id, unnest(list_reduce(list_transform(ws, lambda w: [w]), lambda a, x: CASE WHEN {_SAID.format('a[len(a)]', 'x[1]')} THEN a ELSE a || x END)) AS w FROM listed) "
    "SELECT utt_id, w.b AS word_start, w.seg_id AS seg_id, w.pos AS pos, w.e AS word_end, w.word AS word FROM kept",
)
def deduplicated_words(spark, sf_dir):
    return intervals.deduplicated_words(intervals.word_times(turns(spark, sf_dir)))


@query("k5_words_by_start", f"WITH {_TURNS}, {_WORDS} SELECT utt_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY word_start, seg_id, pos) AS INTEGER) AS nth, word FROM words")
def words_by_start(spark, sf_dir):
    order = Window.partitionBy("utt_id").orderBy("word_start", "seg_id", "pos")
    return intervals.word_times(turns(spark, sf_dir)).select("utt_id", F.row_number().over(order).alias("nth"), "word")


@query("a8_switch_text", f"WITH {_TURNS}, k AS (SELECT *, lag(lang) OVER (PARTITION BY utt_id ORDER BY seg_id) AS before FROM turns WHERE trim(text) <> '') SELECT utt_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before <> lang THEN ' ‖ ' ELSE ' ' END || trim(text), '' ORDER BY seg_id) AS full_text FROM k GROUP BY utt_id")
def switch_text(spark, sf_dir):
    return intervals.switch_text(turns(spark, sf_dir))


#: A score for each labelled document, with ties.
_SCORED = "scored AS (SELECT doc_id, quality AS label, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored(spark, sf_dir) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    return both.select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"))


_ROC = "ties AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM scored GROUP BY score), roc AS (SELECT row_number() OVER w AS k, score, sum(n) OVER w AS fp, sum(p) OVER w AS tp FROM ties WINDOW w AS (ORDER BY score DESC)), rates AS (SELECT *, fp / (SELECT sum(n) FROM ties) AS fpr, tp / (SELECT sum(p) FROM ties) AS tpr FROM roc)"


@query("r11_roc", f"WITH {_SCORED}, {_ROC} SELECT k, round(score, 6) AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rates")
def roc(spark, sf_dir):
    return scoring.roc(scored(spark, sf_dir)).select("k", *(F.round(c, 6).alias(c) for c in ("score", "fpr", "tpr")))


@query("r11_equal_error_rate", f"WITH {_SCORED}, {_ROC}, b AS (SELECT *, lead(fp) OVER w - 2 * fp + coalesce(lag(fp) OVER w, 0) AS df, lead(tp) OVER w - 2 * tp + coalesce(lag(tp) OVER w, 0) AS dt FROM rates WINDOW w AS (ORDER BY k)), kept AS (SELECT 0 AS k, NULL AS score, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT k, score, fpr, tpr FROM b WHERE coalesce(NOT (df = 0 AND dt = 0), true)) SELECT round((1 - tpr + fpr) / 2, 6) AS eer, round(score, 6) AS threshold FROM kept ORDER BY abs(1 - tpr - fpr), k LIMIT 1")
def equal_error_rate(spark, sf_dir):
    return scoring.equal_error_rate(scored(spark, sf_dir)).select(F.round("eer", 6).alias("eer"), F.round("threshold", 6).alias("threshold"))


@query("r10_accuracy_and_loss", f"WITH {_SCORED}, c AS (SELECT label, score, greatest(1e-7, least(1 - 1e-7, score)) AS p FROM scored) SELECT round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS loss, count(*) AS n FROM c")
def accuracy_and_loss(spark, sf_dir):
    found = scoring.accuracy_and_loss(scored(spark, sf_dir).withColumnRenamed("score", "p"))
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"), "n")


@query("p17_decision", f"WITH {_SCORED} SELECT doc_id, CASE WHEN score >= 0.5 THEN 'bona_fide' ELSE 'spoof' END AS decision FROM scored")
def decision(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", scoring.decision(F.col("score")).alias("decision"))


@query("r15_stratified_split", f"WITH {_SCORED}, o AS (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS size, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS place FROM scored), c AS (SELECT *, greatest(1, least(round_even(size * 0.75::DOUBLE, 0), size - 1)) AS cut FROM o) SELECT doc_id, label, unnest(CASE WHEN size = 1 THEN ['train', 'val'] WHEN place <= cut THEN ['train'] ELSE ['val'] END) AS part FROM c")
def stratified_split(spark, sf_dir):
    return scoring.stratified_split(scored(spark, sf_dir).select("doc_id", "label"), "label", "doc_id")


@query("u4_bag_union", f"WITH {_SCORED} SELECT doc_id, label FROM scored WHERE label = 0 UNION ALL SELECT doc_id, label FROM scored WHERE score < 0.5")
def bag_union(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.where("label = 0").select("doc_id", "label").unionByName(rows.where("score < 0.5").select("doc_id", "label"))


_COST = "(CASE WHEN h[{j}] = r[i + 1] THEN 0 ELSE 1 END)"
_WER = rf"""{_TURNS}, w AS (SELECT utt_id, seg_id, list_filter(regexp_split_to_array(text, '\s+'), lambda v: v <> '') AS r, lead(list_filter(regexp_split_to_array(text, '\s+'), lambda v: v <> '')) OVER (PARTITION BY utt_id ORDER BY seg_id) AS h FROM turns),
p AS (SELECT * FROM w WHERE h IS NOT NULL), e AS (SELECT utt_id, seg_id, 0 AS i, CAST(range(len(h) + 1) AS BIGINT[]) AS row FROM p UNION ALL
SELECT e.utt_id, e.seg_id, i + 1, list_reduce(list_prepend([CAST(i + 1 AS BIGINT)], list_transform(h, lambda v, j: [CAST(least(row[j + 1] + 1, row[j] + {_COST.format(j='j')}) AS BIGINT)])), lambda acc, x: acc || [least(x[1], acc[len(acc)] + 1)]) FROM e JOIN p ON e.utt_id = p.utt_id AND e.seg_id = p.seg_id WHERE i < len(r)),
wers AS (SELECT e.utt_id, e.seg_id, CAST(row[len(row)] AS INTEGER) AS edits, CAST(len(r) AS INTEGER) AS n_words, CASE WHEN len(r) > 0 THEN round(row[len(row)] / len(r), 6) END AS wer FROM e JOIN p ON e.utt_id = p.utt_id AND e.seg_id = p.seg_id WHERE i = len(r))"""


def _turn_pairs(spark, sf_dir) -> DataFrame:
    """Each turn against the next one."""
    after = F.lead("text").over(Window.partitionBy("utt_id").orderBy("seg_id"))
    return turns(spark, sf_dir).select("utt_id", "seg_id", F.col("text").alias("reference"), after.alias("hypothesis")).where("hypothesis is not null")


@query("m4_word_error_rate", f"WITH RECURSIVE {_WER} SELECT * FROM wers")
def word_error_rate(spark, sf_dir):
    return scoring.word_error_rate(_turn_pairs(spark, sf_dir)).select("utt_id", "seg_id", "edits", "n_words", F.round("wer", 6).alias("wer"))


def pairs(spark, sf_dir) -> DataFrame:
    """pair_id, a, b: each vector against the next one of its label. Only ids go through the window; vectors are joined to them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    after = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    ids = rows.select("vec_id", after.alias("next_id")).where("next_id is not null")
    one = ids.join(rows.select("vec_id", F.col("x").alias("a")), "vec_id")
    return one.join(rows.select(F.col("vec_id").alias("next_id"), F.col("x").alias("b")), "next_id").select(F.col("vec_id").alias("pair_id"), "a", "b")


_WHOLE = "pairs AS (SELECT * FROM (SELECT vec_id AS pair_id, list_transform(embedding, lambda v: v::DOUBLE) AS a, list_transform(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id), lambda v: v::DOUBLE) AS b FROM embeddings) WHERE b IS NOT NULL)"


@query("j7_pairwise_distances", f"WITH {_WHOLE}, l AS (SELECT pair_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS x, b FROM pairs) SELECT pair_id, CAST(i - 1 AS INTEGER) AS i, count(*) AS n, round(min(d), 6) + 0.0::DOUBLE AS nearest, round(max(d), 6) AS farthest, round(sum(d), 5) AS total FROM (SELECT pair_id, i, unnest(list_transform(b, lambda y: abs(x - y))) AS d FROM l) GROUP BY pair_id, i")
def pairwise_distances(spark, sf_dir):
    """All distances of each pair, summed up for each place of its first signal."""
    rows = align.pairwise_distances(pairs(spark, sf_dir)).groupBy("pair_id", "i")
    return rows.agg(F.count("*").alias("n"), rounded(F.min("d")).alias("nearest"), F.round(F.max("d"), 6).alias("farthest"), F.round(F.sum("d"), 5).alias("total"))


@query(
    "m1_dtw_cost",
    # one row of costs after the other; in a row, each cell adds to the best of its left, upper and diagonal neighbours
    f"WITH RECURSIVE {_WHOLE}, r AS (SELECT pair_id, 1 AS i, list_transform(b, lambda y, j: list_sum(list_transform(b[:j], lambda z: abs(a[1] - z)))) AS costs FROM pairs UNION ALL "
    "SELECT r.pair_id, i + 1, list_reduce(list_prepend([]::DOUBLE[], list_transform(b, lambda y, j: [abs(a[i + 1] - y), CASE WHEN j > 1 THEN least(costs[j], costs[j - 1]) ELSE costs[j] END])), lambda acc, x: acc || [x[1] + CASE WHEN len(acc) = 0 THEN x[2] ELSE least(x[2], acc[len(acc)]) END]) "
    "FROM r JOIN pairs p ON r.pair_id = p.pair_id WHERE i < len(a)) SELECT pair_id, round(costs[len(costs)], 6) + 0.0::DOUBLE AS cost FROM r JOIN pairs USING (pair_id) WHERE i = len(a)",
)
def dtw_cost(spark, sf_dir):
    frames_of = lambda c: F.transform(c, lambda v: F.array(v)).alias(c)
    return align.dtw_paths(pairs(spark, sf_dir).select("pair_id", frames_of("a"), frames_of("b"))).select("pair_id", rounded("cost").alias("cost"))


def _paths(spark, sf_dir) -> DataFrame:
    two = lambda c: F.transform(c, lambda v: F.array(v, v * v))
    return align.dtw_paths(pairs(spark, sf_dir).select("pair_id", two("a").alias("a"), two("b").alias("b")))


_SQUARES = A.paths("sqrt((x - y) * (x - y) + (x * x - y * y) * (x * x - y * y))")


@query("m1_dtw_path", f"WITH {_WHOLE}, {_SQUARES} {A.steps()}")
def dtw_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("pair_id", F.posexplode("path").alias("step", "p")).select("pair_id", "step", "p.i", "p.j")


_BY_LABEL = "frames_of AS (SELECT label, list([embedding[1]::DOUBLE, embedding[2]::DOUBLE] ORDER BY vec_id) AS f FROM embeddings GROUP BY label), long_pairs AS (SELECT p.label AS pair_id, p.f AS a, q.f AS b FROM frames_of p JOIN frames_of q ON q.label = p.label + 1)"


@query("m1_tiled_path", f"WITH {_BY_LABEL}, {A.paths('sqrt((x[1] - y[1]) * (x[1] - y[1]) + (x[2] - y[2]) * (x[2] - y[2]))', 'long_pairs')} SELECT pair_id, CAST(p[1] - 1 AS INTEGER) AS i, CAST(p[2] - 1 AS INTEGER) AS j FROM (SELECT pair_id, unnest(path) AS p FROM paths)")
def tiled_path(spark, sf_dir):
    """All vectors of a label, in order, as the frames of one signal against those of the next label; frames are rows, the matrix goes by tiles."""
    v = F.array(*(F.get("embedding", i).cast("double") for i in (0, 1)))
    rows = table(spark, sf_dir, "embeddings").select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("k"), v.alias("v"))
    left = rows.join(rows.select((F.col("label") - 1).alias("label")).distinct(), "label", "left_semi").withColumnRenamed("label", "pair_id")
    right = rows.withColumn("label", F.col("label") - 1).join(rows.select("label").distinct(), "label", "left_semi").withColumnRenamed("label", "pair_id")
    return align.tiled_paths(left, right).select("pair_id", "i", "j")


_MEL = f"""mel AS MATERIALIZED (SELECT vec_id, list(c ORDER BY k) AS c FROM (SELECT vec_id, k, list(v ORDER BY c) AS c FROM cepstra GROUP BY vec_id, k) GROUP BY vec_id),
mel_pairs AS (SELECT n.vec_id AS pair_id, p.c AS a, q.c AS b FROM (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings) n JOIN mel p ON p.vec_id = n.vec_id JOIN mel q ON q.vec_id = n.other)"""


@query(
    "m3_mel_cepstral_distortion",
    f"WITH {SIGNALS}, {Z.cepstra('mfcc')}, {_MEL}, {A.paths('list_distance(x, y)', 'mel_pairs')} SELECT pair_id, round({align.MCD_FACTOR!r}::DOUBLE * list_sum(list_transform(path, lambda st: list_distance(a[st[1]], b[st[2]]))) / len(path), 5) AS mcd FROM paths",
)
def distortion(spark, sf_dir):
    """Mel cepstra of the tones of each vector against those of the next one of its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    frames = spectral.features(spectral.tones(rows), "mfcc").groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "coefficients"))), lambda r: r["coefficients"]).alias("c"))  # the frames of one signal
    after = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    both = table(spark, sf_dir, "embeddings").select("vec_id", after.alias("other")).where("other is not null")
    both = both.join(frames.withColumnRenamed("c", "a"), "vec_id").join(frames.select(F.col("vec_id").alias("other"), F.col("c").alias("b")), "other")
    return align.mel_cepstral_distortion(align.dtw_paths(both.select(F.col("vec_id").alias("pair_id"), "a", "b"))).select("pair_id", F.round("mcd", 5).alias("mcd"))


_BUNDLE = ("wer", "mcd", "eer", "lid_switching_accuracy", "anti_spoof_accuracy", "anti_spoof_validation_loss", "snr_db", "epsilon")
_EIGHTHS = "list_transform(range(0, len({0}), 8), lambda k8: {0}[k8 + 1:k8 + 8])"
_FAR = "sqrt(list_sum(list_transform(range(1, 9), lambda ax: (x[ax] - y[ax]) * (x[ax] - y[ax]))))"
_CEPSTRA = f"""cepstra AS (SELECT pair_id, {_EIGHTHS.format('a')} AS a, {_EIGHTHS.format('b')} AS b FROM pairs), {A.paths(_FAR, "cepstra", "aligned")},
stepped AS (SELECT pair_id, len(path) AS n, list_sum(list_transform(path, lambda st: sqrt(list_sum(list_transform(range(1, 9), lambda ax: pow(a[st[1]][ax] - b[st[2]][ax], 2)))))) AS cost FROM aligned),
distorted AS (SELECT pair_id, {align.MCD_FACTOR!r}::DOUBLE * cost / n AS mcd FROM stepped)"""


def cepstral_pairs(spark, sf_dir) -> DataFrame:
    """pair_id, a, b: each vector, and the next one of its label, as eight frames of eight cepstral coefficients."""
    eighths = lambda c: F.transform(F.sequence(F.lit(1), F.size(c), F.lit(8)), lambda at: F.slice(c, at, 8))
    return pairs(spark, sf_dir).select("pair_id", eighths("a").alias("a"), eighths("b").alias("b"))


@query("m3_distortion_of_cepstra", f"WITH {_WHOLE}, {_CEPSTRA} SELECT pair_id, round(mcd, 6) AS mcd FROM distorted")
def distortion_of_cepstra(spark, sf_dir):
    return align.mel_cepstral_distortion(align.dtw_paths(cepstral_pairs(spark, sf_dir))).select("pair_id", F.round("mcd", 6).alias("mcd"))


@query(
    "r14_metric_bundle",
    f"WITH RECURSIVE {FRAMES}, {RAW}, {SMOOTH}, {_CELLS}, {_SCORED}, {_ROC}, {_WER}, {_WHOLE}, {_CEPSTRA}, both_labels AS (SELECT c.*, {_at('raw')} AS a, {_at('smooth')} AS b FROM cells c), bend AS (SELECT *, lead(fp) OVER w - 2 * fp + coalesce(lag(fp) OVER w, 0) AS df, lead(tp) OVER w - 2 * tp + coalesce(lag(tp) OVER w, 0) AS dt FROM rates WINDOW w AS (ORDER BY k)), kept AS (SELECT 0 AS k, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT k, fpr, tpr FROM bend WHERE coalesce(NOT (df = 0 AND dt = 0), true)), "
    "judged AS (SELECT avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss FROM (SELECT label, score, greatest(1e-7, least(1 - 1e-7, score)) AS p FROM scored)), "
    "ratios AS (SELECT 10 * log10(quantile_cont(prob_hi, 0.95) / (quantile_cont(prob_hi, 0.05) + 1e-12::DOUBLE)) AS snr FROM frames GROUP BY utt_id), power AS (SELECT list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) / len(embedding) AS p FROM embeddings) "
    "SELECT (SELECT round(sum(edits) / sum(n_words), 6) FROM wers) AS wer, (SELECT round(avg(mcd), 6) FROM distorted) AS mcd, (SELECT round((1 - tpr + fpr) / 2, 6) FROM kept ORDER BY abs(1 - tpr - fpr), k LIMIT 1) AS eer, "
    "(SELECT round(sum(CASE WHEN a IS NOT DISTINCT FROM b THEN \"end\" - start ELSE 0 END) / sum(\"end\" - start), 6) FROM both_labels WHERE a IS NOT NULL) AS lid_switching_accuracy, (SELECT round(accuracy, 6) FROM judged) AS anti_spoof_accuracy, (SELECT round(loss, 6) FROM judged) AS anti_spoof_validation_loss, "
    "(SELECT round(avg(snr), 6) FROM ratios) AS snr_db, (SELECT round(min(least(0.05::DOUBLE, sqrt(p / 100) * 0.999::DOUBLE)), 6) FROM power) AS epsilon",
)
def metric_bundle(spark, sf_dir):
    """All metrics in one row: words of turns against the next ones, cepstra of vectors, scores of documents, labels of frames, and what noise each vector bears.
    Signal to noise is estimated by utterance and averaged, so no estimate is one task's."""
    cells = intervals.compared(raw_runs(spark, sf_dir), smooth_runs(spark, sf_dir)).where("ref_lang is not null")
    long = F.col("end") - F.col("start")
    same = F.when(F.col("ref_lang").eqNullSafe(F.col("pred_lang")), long).otherwise(0.0)
    edits = scoring.word_error_rate(_turn_pairs(spark, sf_dir))
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    judged = scoring.accuracy_and_loss(scored(spark, sf_dir).withColumnRenamed("score", "p"))
    have = {
        "wer": edits.agg(F.sum("edits") / F.sum("n_words")),
        "mcd": align.mel_cepstral_distortion(align.dtw_paths(cepstral_pairs(spark, sf_dir))).agg(F.avg("mcd")),
        "eer": scoring.equal_error_rate(scored(spark, sf_dir)).select("eer"),
        "lid_switching_accuracy": cells.agg(F.sum(same) / F.sum(long)),
        "anti_spoof_accuracy": judged.select("accuracy"),
        "anti_spoof_validation_loss": judged.select("loss"),
        "snr_db": scoring.snr_estimate(frames(spark, sf_dir).select("utt_id", F.col("prob_hi").alias("power"))).agg(F.avg("snr_db")),
        "epsilon": rows.agg(F.min(signal.epsilon_for_snr(F.col("x"), 0.05, 20.0))),
    }
    bundle = scoring.metric_bundle(spark, **{name: have[name] for name in _BUNDLE})
    return bundle.select(*(F.round(name, 6).alias(name) for name in _BUNDLE))


@query("j8_m13_warped_curve", f"WITH {_WHOLE}, {_SQUARES} SELECT pair_id, CAST(p[2] - 1 AS INTEGER) AS j, round(avg(a[p[1]]), 6) + 0.0::DOUBLE AS v FROM (SELECT pair_id, a, unnest(path) AS p FROM paths) GROUP BY pair_id, p[2]")
def warped_curve(spark, sf_dir):
    curve = pairs(spark, sf_dir).select("pair_id", F.posexplode("a").alias("i", "v"))
    n = pairs(spark, sf_dir).select("pair_id", F.size("b").alias("n"))
    return align.warped_curve(_paths(spark, sf_dir), curve, n).select("pair_id", "j", rounded("v").alias("v"))


#: Scores of tokens: events of a user are hypotheses, kinds of events tokens.
_CAND = "cand AS (SELECT user_id AS utt_id, event_id % 7 AS hyp_id, event_id AS token_id, ln(value / 1000) AS logprob FROM events)"


def candidates(spark, sf_dir) -> DataFrame:
    # the logarithm of 0 is null in Spark, but a token of probability 0 must pull its hypothesis down, not leave its sum
    logprob = F.when(F.col("value") == 0, -float("inf")).otherwise(F.ln(F.col("value") / 1000))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("utt_id"), (F.col("event_id") % 7).alias("hyp_id"), F.col("event_id").alias("token_id"), logprob.alias("logprob"))


@query("k2_top_tokens", f"WITH {_CAND} SELECT utt_id, hyp_id, token_id FROM cand QUALIFY row_number() OVER (PARTITION BY utt_id, hyp_id ORDER BY logprob DESC, token_id) <= 3")
def top_tokens(spark, sf_dir):
    return decode.top_tokens(candidates(spark, sf_dir), 3).select("utt_id", "hyp_id", "token_id")


@query("k3_best_hypotheses", f"WITH {_CAND} SELECT utt_id, hyp_id, token_id, CAST(row_number() OVER (PARTITION BY utt_id ORDER BY logprob DESC, hyp_id, token_id) AS INTEGER) AS nth FROM cand QUALIFY nth <= 5")
def best_hypotheses(spark, sf_dir):
    return decode.best_hypotheses(candidates(spark, sf_dir).withColumnRenamed("logprob", "total"), 5).select("utt_id", "hyp_id", "token_id", "nth")


@query("k4_best_per_token", f"WITH {_CAND}, h AS (SELECT utt_id, hyp_id, sum(logprob) AS total, count(*) AS n_tokens FROM cand GROUP BY utt_id, hyp_id) SELECT utt_id, hyp_id, round(total, 6) AS total, n_tokens FROM h QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY total / n_tokens DESC, hyp_id) = 1")
def best_per_token(spark, sf_dir):
    sums = candidates(spark, sf_dir).groupBy("utt_id", "hyp_id").agg(F.sum("logprob").alias("total"), F.count("*").alias("n_tokens"))
    return decode.best_per_token(sums).select("utt_id", "hyp_id", F.round("total", 6).alias("total"), "n_tokens")


_BEAM = """pairs AS (SELECT utt_id, CAST(prev AS INTEGER) AS prev, CAST(prev + 1 + token_id // 9 % (9 - prev) AS INTEGER) AS token, max(logprob) AS logit FROM (SELECT *, token_id % 9 AS prev FROM cand) GROUP BY ALL),
scores AS (SELECT *, CASE WHEN token % 3 > 0 AND token < 9 THEN -(1 + (prev + token) % 5) / 4::DOUBLE END AS lm, CASE WHEN token % 3 > 0 AND token < 9 THEN -(2 + token % 4) / 5::DOUBLE END AS lm_own, 'W' || token AS word FROM pairs),
need AS (SELECT DISTINCT utt_id, 'w' || token_id % 9 AS word FROM cand WHERE token_id % 4 = 1)"""
_MOVES = """z AS (SELECT *, logit + CASE WHEN lm IS NULL THEN 0 ELSE 1.5::DOUBLE * greatest(lm, -10) END AS z FROM scores),
ranked AS (SELECT utt_id, prev, token, z - ln(sum(exp(z)) OVER w) AS logp, CASE WHEN lm_own IS NULL THEN 0 ELSE 1.5::DOUBLE * greatest(lm_own, -10) END AS lm, CASE WHEN lm IS NOT NULL THEN lower(word) END AS word FROM z WINDOW w AS (PARTITION BY utt_id, prev)),
moves AS (SELECT *, CAST(row_number() OVER (PARTITION BY utt_id, prev ORDER BY logp DESC, token) AS INTEGER) AS rank FROM ranked QUALIFY rank <= 3
  UNION ALL SELECT utt_id, prev, 9, 0, 0, NULL, 1 FROM (SELECT DISTINCT utt_id, token AS prev FROM scores WHERE token <> 9 UNION SELECT utt_id, 0 FROM scores) r WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.utt_id = r.utt_id AND s.prev = r.prev)),
lists AS (SELECT utt_id, list(word) AS missing, count(*) AS n_need FROM need GROUP BY utt_id),
search AS (SELECT DISTINCT m.utt_id, 0 AS step, 0 AS parent, 0 AS rank, 0 AS place, 0 AS token, 0::DOUBLE AS logp, 0::DOUBLE AS lm, coalesce(missing, []) AS missing, coalesce(n_need, 0) AS n_need, 0::DOUBLE AS combined, false AS ended, []::INTEGER[] AS tokens FROM moves m LEFT JOIN lists USING (utt_id)
  UNION ALL SELECT * FROM (SELECT utt_id, step, parent, rank, CAST(row_number() OVER (PARTITION BY utt_id, ended ORDER BY combined DESC, parent, rank) - 1 AS INTEGER) AS place, token, logp, lm, missing, n_need, combined, ended, tokens
    FROM (SELECT *, logp + lm - CASE WHEN n_need > 0 THEN 0.05::DOUBLE * len(missing) / n_need ELSE 0 END AS combined, token = 9 AS ended
      FROM (SELECT s.utt_id, s.step + 1 AS step, s.place AS parent, m.rank, m.token, s.logp + m.logp AS logp, s.lm + m.lm AS lm, list_filter(s.missing, lambda w: w IS DISTINCT FROM m.word) AS missing, s.n_need, CASE WHEN m.token = 9 THEN s.tokens ELSE list_append(s.tokens, m.token) END AS tokens
        FROM search s JOIN moves m ON s.utt_id = m.utt_id AND s.token = m.prev WHERE NOT s.ended AND s.step < 444))) WHERE ended OR place < 3)"""


@query(
    "m20_beam_search",
    f"WITH RECURSIVE {_CAND}, {_BEAM}, {_MOVES} SELECT utt_id, array_to_string(tokens, ' ') AS tokens, round(logp / greatest(len(tokens), 1), 6) AS mean_logp, round(combined, 6) AS combined, ended FROM search WHERE ended OR step = 444 QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY combined / (4 + step) DESC, step, parent, rank) = 1",
)
def beam_search(spark, sf_dir):
    """Events of a user as a scorer over ten tokens, each of which leads to later ones only; two of three tokens are words of a language model."""
    rows = candidates(spark, sf_dir).withColumn("prev", (F.col("token_id") % 9).cast("int"))
    token = (F.col("prev") + 1 + F.floor(F.col("token_id") / 9) % (9 - F.col("prev"))).cast("int")
    pairs = rows.groupBy("utt_id", "prev", token.alias("token")).agg(F.max("logprob").alias("logit"))
    known = (F.col("token") % 3 > 0) & (F.col("token") < 9)
    model = {"lm": F.when(known, -(1 + (F.col("prev") + F.col("token")) % 5) / 4), "lm_own": F.when(known, -(2 + F.col("token") % 4) / 5), "word": F.concat(F.lit("W"), "token")}
    need = rows.where("token_id % 4 = 1").select("utt_id", F.concat(F.lit("w"), (F.col("token_id") % 9).cast("string")).alias("word"))
    found = decode.beam_search(pairs.withColumns(model), need, 9)
    return found.select("utt_id", F.array_join("tokens", " ").alias("tokens"), rounded("mean_logp").alias("mean_logp"), rounded("combined").alias("combined"), "ended")


_NEED = r"""t AS (SELECT conv_id AS utt_id, turn, role, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM conversations)"""


@query("j10_u3_missing_words", f"WITH {_NEED}, need AS (SELECT DISTINCT utt_id, unnest(ws) AS word FROM t WHERE role = 'user'), said AS (SELECT DISTINCT utt_id, unnest(ws) AS word FROM t WHERE role = 'assistant') SELECT * FROM need EXCEPT SELECT * FROM said")
def missing_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("utt_id"), "role", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word"))
    return decode.missing_words(rows.where("role = 'user'"), rows.where("role = 'assistant'"))


@query("m19_coverage_penalty", f"WITH {_NEED}, o AS (SELECT utt_id, turn, ws, lead(ws) OVER (PARTITION BY utt_id ORDER BY turn) AS said FROM t) SELECT utt_id, turn, round(CASE WHEN len(list_distinct(ws)) > 0 THEN 0.05::DOUBLE * len(list_filter(list_distinct(ws), lambda w: NOT list_contains(said, w))) / len(list_distinct(ws)) ELSE 0 END, 6) AS penalty FROM o WHERE said IS NOT NULL")
def coverage_penalty(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("utt_id"), "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"))
    rows = rows.withColumn("said", F.lead("ws").over(Window.partitionBy("utt_id").orderBy("turn"))).where("said is not null")
    return rows.select("utt_id", "turn", F.round(decode.coverage_penalty(F.col("said"), F.col("ws")), 6).alias("penalty"))
