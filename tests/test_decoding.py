"""Beam search and Kneser-Ney against plain Python."""

import math
import random
from collections import defaultdict

import duckdb
import pytest

from speechmill.operators import decode, lm
from speechmill.plans import ORACLE_SQL, QUERIES

END, BEAM, ALPHA, BETA, FLOOR, PROMPT = 9, 3, 1.5, 0.05, -10.0, 4


def plain_search(scores, need, most):
    """scores: {prev: {token: (logit, lm, lm_own, word)}}. Hypotheses as (combined, logp, lm, missing, tokens), in the order they are made."""
    need = {w.lower() for w in need}
    live, pool = [(0.0, 0.0, 0.0, need, [0])], []
    for _ in range(most):
        made = []
        for _, logp, own, missing, tokens in live:
            after = scores.get(tokens[-1], {END: (0.0, None, None, None)})
            z = {t: s + (ALPHA * max(m, FLOOR) if m is not None else 0) for t, (s, m, _, _) in after.items()}
            norm = math.log(sum(map(math.exp, z.values())))
            for t in sorted(z, key=lambda t: (-z[t], t))[:BEAM]:
                _, m, m_own, word = after[t]
                left = missing - {word.lower()} if m is not None else missing
                a, b = logp + z[t] - norm, own + (ALPHA * max(m_own, FLOOR) if m_own is not None else 0)
                made.append((a + b - (BETA * len(left) / len(need) if need else 0), a, b, left, [*tokens, t]))
        pool += [h for h in made if h[4][-1] == END]
        live = sorted((h for h in made if h[4][-1] != END), key=lambda h: -h[0])[:BEAM]
        if not live:
            break
    best = max(pool + live, key=lambda h: h[0] / (len(h[4]) - 1 + PROMPT))
    tokens = [t for t in best[4][1:] if t != END]
    return tokens, best[1] / max(1, len(tokens)), best[0], best[4][-1] == END


@pytest.mark.parametrize("most", [3, 8])
def test_beam_search(spark, most):
    rng = random.Random(most)
    rows, needs, want = [], [], {}
    for u in range(60):
        scores = defaultdict(dict)
        for _ in range(rng.choice([3, 12, 40])):
            p, t = rng.randrange(9), rng.choice([*range(1, 10), END])
            known = t % 3 and t != END
            scores[p][t] = (rng.uniform(-4, 1), rng.choice([-0.5, -2.0, -30.0]) if known else None, -rng.random() if known else None, f"W{t}")
        scores[0].setdefault(1, (0.0, None, None, "W1"))
        need = rng.sample(["w1", "w2", "W4", "w5", "w8"], rng.randrange(4))
        rows += [(u, p, t, *v) for p, xs in scores.items() for t, v in xs.items()]
        needs += [(u, w) for w in need]
        want[u] = plain_search(scores, need, most)
    scores = spark.createDataFrame(rows, "utt_id long, prev int, token int, logit double, lm double, lm_own double, word string")
    got = decode.beam_search(scores, spark.createDataFrame(needs, "utt_id long, word string"), END, most=most).collect()
    assert len(got) == 60
    for r in got:
        tokens, mean, combined, ended = want[r.utt_id]
        assert (r.tokens, r.ended) == (tokens, ended) and r.mean_logp == pytest.approx(mean) and r.combined == pytest.approx(combined)


def test_an_end_outside_the_beam_counts(spark):
    """The end is the fourth best of all that follow two hypotheses, but goes to the pool."""
    rows = [(1, 0, 1, 0.0), (1, 0, 2, 0.0), (1, 1, 3, 3.0), (1, 1, 4, 2.9), (1, 1, 9, -4.0), (1, 2, 5, 3.0), (1, 2, 6, 2.9)]
    scores = spark.createDataFrame([(*r, None, None, "x") for r in rows], "utt_id long, prev int, token int, logit double, lm double, lm_own double, word string")
    none = spark.createDataFrame([], "utt_id long, word string")
    assert decode.beam_search(scores, none, END, most=2).first().ended is False
    after = decode.beam_search(scores, none, END, most=3).first()
    assert after.tokens in ([1, 3], [2, 5]) and after.ended


def plain_kneser_ney(sentences, order, discount=0.1):
    grams = [defaultdict(int) for _ in range(order + 1)]
    for s in sentences:
        s = ["<s>"] * (order - 1) + s + ["</s>"] * (order - 1)
        for n in range(1, order + 1):
            for i in range(len(s) - n + 1):
                grams[n][tuple(s[i : i + n])] += 1

    def p(word, ctx):
        n = len(ctx) + 1
        if n == 1:
            return sum(g[1] == word for g in grams[2]) / len(grams[2])
        kinds = sum(g[:-1] == ctx for g in grams[n])
        lower = p(word, ctx[1:])
        if not kinds:
            return lower
        if n == order:
            own, total = grams[n].get((*ctx, word), 0), sum(c for g, c in grams[n].items() if g[:-1] == ctx)
        else:
            own, total = sum(g[1:] == (*ctx, word) for g in grams[n + 1]), sum(g[1:-1] == ctx for g in grams[n + 1])
        return max(own - discount, 0) / total + discount * kinds / total * lower

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney(spark, order):
    rng = random.Random(order)
    sentences = [rng.choices("abcde", k=rng.randint(1, 7)) for _ in range(30)]
    rows = spark.createDataFrame([(i, 0, s) for i, s in enumerate(sentences)], "doc_id long, pos int, tokens array<string>")
    grams = lm.counts(rows, order, padded=True)
    p = plain_kneser_ney(sentences, order)
    asked = [(i, rng.choice("ABCDEz"), [rng.choice("abcdez") for _ in range(rng.randrange(order + 1))]) for i in range(80)]
    table = spark.createDataFrame([(i, w, " ".join(c)) for i, w, c in asked], "i int, word string, ctx string")
    got = {r.i: r.logp for r in lm.kneser_ney(table, grams, order).collect()}
    for i, w, c in asked:
        assert got[i] == pytest.approx(math.log(max(p(w.lower(), tuple(c[-order + 1 :])), 1e-12)))
    assert len(got) == 80


def test_probabilities_of_all_words_sum_to_one(spark):
    rows = spark.createDataFrame([(0, 0, list("abcab")), (1, 0, list("bca"))], "doc_id long, pos int, tokens array<string>")
    grams = lm.counts(rows, 3, padded=True)
    asked = spark.createDataFrame([(w, c) for c in ("a b", "b", "q r", "") for w in ("a", "b", "c", "<s>", "</s>")], "word string, ctx string")
    sums = defaultdict(float)
    for r in lm.kneser_ney(asked, grams).collect():
        sums[r.ctx] += math.exp(r.logp)
    assert all(v == pytest.approx(1.0) for v in sums.values())


@pytest.mark.parametrize("name", ["k4_best_per_token", "m20_beam_search"])
def test_a_token_of_probability_zero_pulls_its_hypothesis_down(spark, tmp_path, name):
    # values of 0 as the whole of a pair of neighbours, and within a hypothesis
    rows = [(e, "2024-01-01", u, "click", 0.0 if (e * 7 + u) % 3 == 0 else 1.0 + e % 50, "") for u in range(40) for e in range(u, 700, 41)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same = lambda a, b: a == b or (a != a and b != b)
    ours = QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({ORACLE_SQL[name]}) ORDER BY utt_id").fetchall()
    got = [tuple(r) for r in ours.orderBy("utt_id").collect()]
    assert len(got) == len(theirs) == 40 and all(same(a, b) for x, y in zip(got, theirs) for a, b in zip(x, y))
