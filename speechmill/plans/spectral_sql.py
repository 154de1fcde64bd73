"""DuckDB's SQL of transforms as sparse and dense matrix products: basis, window and filter tables joined to frames, and dot products of lists.

The Spark side computes the same with fast transforms in Arrow batches; here every value is a sum over the basis it is defined by.
"""

from __future__ import annotations

PI = "3.141592653589793::DOUBLE"

#: Common table expressions that end in tone(vec_id, y): 4,000 samples, made of the values of s(vec_id, x) as strengths of tones 120, 240, ... Hz at 16 kHz.
TONES = f"""waves AS (SELECT t, list(sin(2 * {PI} * 120 * k * t / 16000) ORDER BY k) AS w FROM range(4000) a(t), (SELECT unnest(range(1, max(n) + 1)) AS k FROM s) GROUP BY t),
tone AS MATERIALIZED (SELECT vec_id, list(list_dot_product(x, w[:n]) ORDER BY t) AS y FROM s, waves GROUP BY vec_id)"""


def _window(size: int, n_fft: int) -> str:
    """A Hann window of the size in the middle of a frame, at place i from 0."""
    before = (n_fft - size) // 2
    return f"(CASE WHEN i >= {before} AND i < {before + size} THEN 0.5 - 0.5 * cos(2 * {PI} * (i - {before}) / {size}) ELSE 0 END)"


def spectrum(size: int, hop: int, n_fft: int = 512) -> str:
    """Common table expressions that end in bins(vec_id, k, f, re, im): frames centred at multiples of the hop over mirrored ends, times the window and each wave of the transform."""
    half = n_fft // 2
    mirrored = f"list_reverse(y[2:{half + 1}]) || y || list_reverse(y[len(y) - {half}:len(y) - 1])"
    return f"""basis AS MATERIALIZED (SELECT f, list({_window(size, n_fft)} * cos(2 * {PI} * ((f * i) % {n_fft}) / {n_fft}) ORDER BY i) AS c, list(-{_window(size, n_fft)} * sin(2 * {PI} * ((f * i) % {n_fft}) / {n_fft}) ORDER BY i) AS s FROM range({half + 1}) a(f), range({n_fft}) b(i) GROUP BY f),
framed AS MATERIALIZED (SELECT vec_id, k, p[k * {hop} + 1:k * {hop} + {n_fft}] AS x FROM (SELECT vec_id, p, unnest(range((len(p) - {n_fft}) // {hop} + 1)) AS k FROM (SELECT vec_id, {mirrored} AS p FROM tone))),
bins AS MATERIALIZED (SELECT vec_id, k, f, list_dot_product(x, c) AS re, list_dot_product(x, s) AS im FROM framed, basis)"""


def _mel(hz: str) -> str:
    return f"(2595 * log10(1 + {hz} / 700.0::DOUBLE))"


def _edge(kind: str, i: str) -> str:
    """The i-th of 42 edges of bands between 0 and 8,000 Hz."""
    return f"(700 * (pow(10.0::DOUBLE, ({_mel('8000')} * ({i}) / 41) / 2595) - 1))" if kind == "mfcc" else f"(8000.0::DOUBLE * ({i}) / 41)"


def _bands(kind: str) -> str:
    if kind == "cqcc":
        at = "(least(32.7::DOUBLE * pow(2.0::DOUBLE, b / 12.0::DOUBLE), 8000) / 31.25::DOUBLE)"
        level = "list(ln(greatest(re * re + im * im, 1e-10)) ORDER BY f)"
        return f"levels AS (SELECT vec_id, k, {level} AS l FROM bins GROUP BY vec_id, k), bands AS (SELECT vec_id, k, list(l[i + 1] + t * (l[i + 2] - l[i + 1]) ORDER BY b) AS x FROM (SELECT vec_id, k, l, b, CAST(floor({at}) AS BIGINT) AS i, {at} - floor({at}) AS t FROM levels, range(84) r(b)) GROUP BY vec_id, k)"
    rise, fall = f"(f * 31.25::DOUBLE - {_edge(kind, 'b')}) / ({_edge(kind, 'b + 1')} - {_edge(kind, 'b')})", f"({_edge(kind, 'b + 2')} - f * 31.25::DOUBLE) / ({_edge(kind, 'b + 2')} - {_edge(kind, 'b + 1')})"
    return f"""filters AS MATERIALIZED (SELECT b, list(greatest(0, least({rise}, {fall})) ORDER BY f) AS w FROM range(40) a(b), range(257) c(f) GROUP BY b),
levels AS (SELECT vec_id, k, list(re * re + im * im ORDER BY f) AS l FROM bins GROUP BY vec_id, k), bands AS (SELECT vec_id, k, list(ln(list_dot_product(l, w) + 1e-6) ORDER BY b) AS x FROM levels, filters GROUP BY vec_id, k)"""


def cepstra(kind: str) -> str:
    """Common table expressions that end in cepstra(vec_id, k, c, v): mfcc has coefficients 1 to 13, the others 0 to 19, each with mean 0 and deviation 1 over the frames of a signal."""
    n, first, keep = (84, 0, 20) if kind == "cqcc" else (40, 1, 14) if kind == "mfcc" else (40, 0, 20)
    scale = f"sqrt(CASE WHEN c = 0 THEN 1.0::DOUBLE / {n} ELSE 2.0::DOUBLE / {n} END)"
    raw = f"""{TONES}, {spectrum(400, 160)}, {_bands(kind)},
cosines AS (SELECT c, list({scale} * cos({PI} * c * (2 * i + 1) / {2 * n}) ORDER BY i) AS w FROM range({first}, {keep}) a(c), range({n}) b(i) GROUP BY c),
plain AS MATERIALIZED (SELECT vec_id, k, c - {first} AS c, list_dot_product(x, w) AS v FROM bands, cosines)"""
    if kind == "mfcc":
        return f"{raw}, cepstra AS (SELECT * FROM plain)"
    return f"{raw}, cepstra AS (SELECT vec_id, k, c, (v - avg(v) OVER w) / (CASE WHEN stddev_pop(v) OVER w < 1e-8 THEN 1 ELSE stddev_pop(v) OVER w END) AS v FROM plain WINDOW w AS (PARTITION BY vec_id, c))"


#: Common table expressions that end in samples(vec_id, i, v): tone at half its rate, by a windowed sinc of 65 taps.
HALVED = f"""{TONES}, taps AS (SELECT list((CASE WHEN g = 0 THEN 0.5 ELSE sin({PI} * g / 2) / ({PI} * g) END) * (0.5 + 0.5 * cos({PI} * g / 32)) ORDER BY g) AS w FROM range(-32, 33) a(g)),
cut AS MATERIALIZED (SELECT vec_id, unnest(range(2000)) AS i, unnest(list_transform(range(2000), lambda i: p[2 * i + 1:2 * i + 65])) AS x FROM (SELECT vec_id, list_transform(range(32), lambda z: 0.0::DOUBLE) || y || list_transform(range(32), lambda z: 0.0::DOUBLE) AS p FROM tone)),
samples AS (SELECT vec_id, i, list_dot_product(x, w) AS v FROM cut, taps)"""

#: Common table expressions that end in samples(vec_id, i, v): tone less twice the mean power of its first ten frames in each bin, with the phases as they were.
SUBTRACTED = f"""{TONES}, {spectrum(512, 128)},
floors AS (SELECT vec_id, f, avg(re * re + im * im) AS noise FROM bins WHERE k < 10 GROUP BY vec_id, f),
scaled AS (SELECT vec_id, k, f, re * g AS re, im * g AS im FROM (SELECT vec_id, k, f, re, im, coalesce(sqrt(greatest(re * re + im * im - 2 * noise, 0.002::DOUBLE * (re * re + im * im)) / nullif(re * re + im * im, 0)), 0) * (CASE WHEN f IN (0, 256) THEN 1 ELSE 2 END) / 512 AS g FROM bins JOIN floors USING (vec_id, f))),
lists AS MATERIALIZED (SELECT vec_id, k, list(re ORDER BY f) AS re, list(im ORDER BY f) AS im FROM scaled GROUP BY vec_id, k),
back AS MATERIALIZED (SELECT i, any_value({_window(512, 512)}) AS w, list(cos(2 * {PI} * ((f * i) % 512) / 512) ORDER BY f) AS c, list(sin(2 * {PI} * ((f * i) % 512) / 512) ORDER BY f) AS s FROM range(512) a(i), range(257) b(f) GROUP BY i),
laid AS (SELECT vec_id, k * 128 + i - 256 AS i, sum(w * (list_dot_product(re, c) - list_dot_product(im, s))) AS v, sum(w * w) AS norm FROM lists, back GROUP BY vec_id, k * 128 + i - 256),
samples AS (SELECT vec_id, i, v / (CASE WHEN norm > 1e-10 THEN norm ELSE 1 END) AS v FROM laid WHERE i >= 0 AND i < 4000)"""

#: Common table expressions that end in pitch(vec_id, k, f0, energy): frames of 2,048 samples every 256; the first lag of 32 to 319 whose difference, over the mean of those up to
#: it, is under 0.15 and then falls no further, placed by a parabola; 0 without one and in silence.
PITCH = f"""{TONES}, framed AS MATERIALIZED (SELECT vec_id, k, p[k * 256 + 1:k * 256 + 2048] AS x FROM (SELECT vec_id, p, unnest(range((len(p) - 2048) // 256 + 1)) AS k FROM (SELECT vec_id, list_reverse(y[2:1025]) || y || list_reverse(y[len(y) - 1024:len(y) - 1]) AS p FROM tone))),
gaps AS MATERIALIZED (SELECT vec_id, k, list_dot_product(x, x) AS power, list_transform(range(321), lambda g: list_dot_product(x[1:1024], x[1:1024]) + list_dot_product(x[g + 1:g + 1024], x[g + 1:g + 1024]) - 2 * list_dot_product(x[1:1024], x[g + 1:g + 1024])) AS d FROM framed),
sums AS (SELECT vec_id, k, power, g, d[g + 1] AS d, sum(d[g + 1]) OVER (PARTITION BY vec_id, k ORDER BY g) AS total FROM (SELECT *, unnest(range(321)) AS g FROM gaps)),
scaled AS MATERIALIZED (SELECT vec_id, k, any_value(power) AS power, list(d * g / greatest(total, 1e-12) ORDER BY g) AS d FROM sums GROUP BY vec_id, k),
under AS (SELECT *, list_filter(range(32, 320), lambda g: d[g + 1] < 0.15::DOUBLE)[1] AS low FROM scaled),
dips AS (SELECT *, list_filter(range(low, 320), lambda g: g = 319 OR NOT d[g + 2] < d[g + 1])[1] AS lag FROM under),
pitch AS (SELECT vec_id, k, CASE WHEN lag IS NULL OR power <= 1e-8 THEN 0 ELSE 16000 / (lag + CASE WHEN abs(d[lag] - 2 * d[lag + 1] + d[lag + 2]) > 1e-12 THEN 0.5 * (d[lag] - d[lag + 2]) / (d[lag] - 2 * d[lag + 1] + d[lag + 2]) ELSE 0 END) END AS f0 FROM dips),
louds AS (SELECT vec_id, k, sqrt(list_dot_product(x, x) / 1024) AS energy FROM (SELECT vec_id, k, p[k * 256 + 1:k * 256 + 1024] AS x FROM (SELECT vec_id, p, unnest(range((len(p) - 1024) // 256 + 1)) AS k FROM (SELECT vec_id, list_reverse(y[2:513]) || y || list_reverse(y[len(y) - 512:len(y) - 1]) AS p FROM tone))))"""
