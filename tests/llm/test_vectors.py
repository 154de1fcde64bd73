"""op11 and op13 against plain Python: ties, repeated rows, nulls, non-finite components, unequal lengths, empty tables, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from speechmill.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, q string, x string, cell int, group_key int, n string, ids string, pos int"


def vectors(n, seed, size=16, ids=None):
    """Clusters, with copies (ties), a hot cluster of a third of the rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, size))
    rows = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else rng.integers(7)]
        v = (c + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.5])).astype(np.float32).tolist()
        rows.append((ids[i] if ids else i, v, int(rng.integers(4))))
    rows += [(n, None, 1), (n + 1, [float("nan")] * size, 1), (n + 2, [float("inf")] + [0.0] * (size - 1), 2), (n + 3, [None] + [0.5] * (size - 1), 2)]
    rows += [(n + 4, [0.25] * (size - 3), 3), (n + 5, [], 0), (n + 6, [0.5] * size, None), (None, [0.5] * size, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", "x", 1, 2, "n", "ids", 5) for r in rows], SCHEMA).repartition(3)


def kept_rows(rows, scale):
    return [(i, [math.floor(scale * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]


def mined(rows, least=50, most=95):
    """The rule of op11 over kept rows of (id, q, label), all pairs."""
    rows = [(i, q, (label + 1) % 10 if i % 7 == 0 else label) for i, q, label in kept_rows(rows, 256) if i is not None and label is not None]
    out = []
    for a, q, label in {(i, tuple(q), label) for i, q, label in rows if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, lab) for i, v, lab in rows)
        for s, p, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            fits = [r for r in scored if r[2] != label and least * -s <= 100 * -r[0] <= most * -s]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op11_brute_force(spark, seed):
    rows = vectors(400, seed)
    rows += [rows[50], rows[50], rows[51], (100, rows[7][1], 2)]  # an anchor and a row repeated, an id with two vectors
    got = hard_negatives.of_embeddings(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_op11_in_many_shards_and_settled_often(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 16 * 3)
    monkeypatch.setattr(hard_negatives, "HELD", 4)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 70)
    rows = vectors(500, 4)
    assert sorted(map(tuple, hard_negatives.of_embeddings(frame(spark, rows)).collect())) == mined(rows)


def test_op11_walk_prunes_whole_groups():
    """Far clusters: most pairs of leaves are never scored, and what is found is what a full search finds."""
    rng = np.random.default_rng(5)
    x = (np.repeat(np.eye(16) * 4000, 400, axis=0) + rng.integers(-20, 20, (6400, 16))).astype(np.float64)
    labels, ids = np.arange(6400) % 3, np.arange(6400)
    at = np.arange(0, 6400, 50)
    tree = hard_negatives.grown(x[at], labels[at])
    a = at[tree.order]
    walk = hard_negatives.Walk(hard_negatives.Wanted(ids[a], labels[a], x[a], tree, np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf), 5, True))
    for part in range(0, 6400, 1600):
        walk.take(ids[part : part + 1600], labels[part : part + 1600], x[part : part + 1600])
    assert walk.scored < 0.25 * len(a) * 6400
    request, score, ident = walk.found[0]
    for k in range(len(a)):
        s = x @ x[a[k]]
        best = sorted((-s[i], i) for i in ids if labels[i] == labels[a[k]] and i != a[k])[:5]
        assert [(-v, i) for v, i in zip(score[request == k], ident[request == k])] == best


def test_op11_edges(spark):
    none = frame(spark, vectors(3, 1)).where("false")
    assert hard_negatives.of_embeddings(none).count() == 0
    alone = [(50, [1.0, 0.0], 3), (1, [0.5, 0.0], 4)]  # no positive
    assert hard_negatives.of_embeddings(frame(spark, alone)).count() == 0
    zero = [(50, [0.0], 3), (1, [0.0], 3), (2, [0.0], 4), (3, [-1.0], 4)]
    assert sorted(map(tuple, hard_negatives.of_embeddings(frame(spark, zero)).collect())) == mined(zero) == [(50, 1, 1, 2, 0, 0), (50, 1, 2, 3, 0, 0)]
    with pytest.raises(ValueError, match="2\\^53"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1 << 27])], "vec_id long, label long, q array<long>"), F.lit(True))


def coded(rows):
    """The rule of op13 with a full search in each round."""
    rows = kept_rows(rows, 4096)
    size = max(1, -(-max(len(q) for _, q, _ in rows) // 8))
    rows = [(i, q + [0] * (8 * size - len(q)), label) for i, q, label in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))[:16]
    part = lambda q, p: q[p * size : (p + 1) * size]
    books = [[part(q, p) for _, q, _ in first] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = {}
            for _, q, _ in rows:
                own.setdefault(near(part(q, p), books[p])[1], []).append(part(q, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    found = [(i, [near(part(q, p), books[p]) for p in range(8)], label) for i, q, label in rows]
    errors = {}
    for _, f, label in found:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], sha) for i, f, label in found]


@pytest.mark.parametrize("n, size", [(300, 16), (40, 19), (5, 8)])
def test_op13_brute_force(spark, n, size):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    rows = vectors(n, n, size, ids)
    rows += [rows[2], rows[2], (ids[0], rows[3][1], 1)]
    got = vector_codes.compressed(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(coded(rows), key=repr)


def test_op13_search_is_a_full_search():
    rng = np.random.default_rng(8)
    for spread in (2, 5, 100):  # small spreads give ties
        x, book = rng.integers(-spread, spread, (500, 4)), rng.integers(-spread, spread, (16, 4))
        d = ((x[:, None] - book) ** 2).sum(2)
        best, least = vector_codes.nearest(x, rng.integers(0, 16, 500), book)
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_op13_edges(spark):
    none = frame(spark, vectors(3, 1)).where("false")
    got = vector_codes.compressed(none)
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compressed(frame(spark, [(1, [1e9] * 8, 1)])).collect()
