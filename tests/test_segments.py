"""Refinement of segments against the rule written out plainly, on random segments, and on one utterance of many."""

import random
import time

import pytest

from pyspark.sql import functions as F

from speechmill.operators import segments

LEAST = 0.2
SCHEMA = "utt_id long, seg_id int, start double, end double, lang string"


def _joined(parts):
    out = []
    for start, end, lang in parts:
        if out and out[-1][2] == lang:
            out[-1][1] = end
        else:
            out.append([start, end, lang])
    return out


def _absorbed(parts):
    """A sweep, and whether it moved anything."""
    waiting, kept, several = [list(p) for p in parts], [], len(parts) > 1
    moved = False
    for k, part in enumerate(waiting):
        after = waiting[k + 1] if k + 1 < len(waiting) else None
        if not several or part[1] - part[0] >= LEAST:
            kept.append(part)
            continue
        moved = True
        if kept and (after is None or kept[-1][1] - kept[-1][0] >= after[1] - after[0]):
            kept[-1][1] = part[1]
        elif after is not None:
            after[0] = part[0]
        else:
            kept.append(part)
    return _joined(kept), moved


def _without_flicker(parts):
    kept, k = [], 0
    while k < len(parts):
        three = parts[k : k + 3]
        takes = len(three) == 3 and three[0][2] == three[2][2] and three[1][1] - three[1][0] < 2 * LEAST
        kept.append([three[0][0], three[2][1], three[0][2]] if takes else three[0])
        k += 3 if takes else 1
    return _joined(kept), len(kept) < len(parts)


def plainly(parts):
    for sweep in (_absorbed, _without_flicker):
        moved = True
        while moved:
            parts, moved = sweep(parts)
    return [(round(a, 3), round(b, 3), lang) for a, b, lang in parts]


def made(rng, u):
    """Segments whose neighbours differ; every fifth utterance has gaps, half have three labels."""
    out, t = [], rng.choice([0.0, 0.3])
    widths = rng.choice([[0.1, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.9, 1.3], [0.1, 0.3, 0.3, 0.3, 0.5], [0.2005, 0.25, 0.3333, 0.6]])
    for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 60])):
        width, lang = rng.choice(widths), rng.choice([x for x in ("ab" if u % 2 else "abc") if not out or x != out[-1][2]])
        out.append((t, t + width, lang))
        t += width + (rng.choice([0, 0, 0.05]) if u % 5 == 0 else 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_is_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    all_of = {u: made(rng, u) for u in range(800)}
    rows = spark.createDataFrame([(u, i, *p) for u, parts in all_of.items() for i, p in enumerate(parts)], SCHEMA)
    got = {}
    for r in segments.refined(rows).orderBy("utt_id", "seg_id").collect():
        assert r.seg_id == len(got.setdefault(r.utt_id, []))
        got[r.utt_id].append((r.start, r.end, r.lang))
    assert got == {u: plainly(parts) for u, parts in all_of.items()}


def test_times_round_as_their_binary_value_does(spark):
    rng = random.Random(3)
    x = [rng.uniform(0, 4000) for _ in range(3000)] + [k / 2000 for k in range(-100, 3000)]
    rows = spark.createDataFrame([(v,) for v in x], "x double").withColumn("y", segments.to_places(F.col("x"))).collect()
    assert all(r.y == round(r.x, 3) for r in rows)


def test_one_utterance_of_many_segments(spark):
    """100,000 segments of one utterance: windows over rows, so seconds; a fold over one array took two minutes for 1,000."""
    n = 100_000
    rows = spark.range(n).selectExpr("1L as utt_id", "cast(id as int) as seg_id", "cast(id * 0.3 as double) as start", "cast((id + 1) * 0.3 as double) as end", "if(id % 2 = 0, 'hi', 'en') as lang")
    began = time.time()
    assert segments.refined(rows).count() == -(-n // 3)
    assert time.time() - began < 90
