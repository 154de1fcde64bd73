"""op1: the Markov ratio against plain dictionaries, very long and repeated urls, an empty table."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from speechmill.llm import url_filter


def plain_model(urls, order):
    """Witten-Bell from order down to 0 over the bytes of urls, each ended by a byte 0: log-probability of each url."""
    follow = defaultdict(Counter)
    for u in (u + b"\0" for u in urls):
        for i in range(len(u)):
            for k in range(min(order, i) + 1):
                follow[u[i - k : i]][u[i]] += 1

    def p(ctx, c):
        lower = p(ctx[1:], c) if ctx else 1 / 256
        own = follow.get(ctx)
        if not own:
            return lower
        total, kinds = sum(own.values()), len(own)
        return (own[c] + kinds * lower) / (total + kinds)

    return lambda u: sum(math.log(p((u + b"\0")[max(0, i - order) : i], (u + b"\0")[i])) for i in range(len(u) + 1))


def test_ratio_against_dictionaries():
    rng = np.random.default_rng(1)
    made = lambda letters: [bytes(rng.choice(list(letters), rng.integers(1, 12)).tolist()) for _ in range(60)]
    good, bad = made(b"abcd./"), made(b"abxy-/")
    ratio = url_filter.Ratio(url_filter.Markov(good, 3), url_filter.Markov(bad, 3), 0.0)
    a, b = plain_model(good, 3), plain_model(bad, 3)
    asked = [*made(b"abcdxy./-z"), b"a" * 3000]
    got = ratio.scores(asked)
    assert got == pytest.approx([(a(u) - b(u)) / (len(u) + 1) for u in asked], abs=1e-4)


@pytest.fixture
def pages(spark):
    hosts = ["https://A.net/x", "http://example.net/en/y", "http://example.com/de/z", "http://x.org/fr/a", "https://shop.example/a?b", "no url", None, ""]
    rows = [(i, f"{h}{i}" if h else h, "<p>", "h", "v") for i, h in enumerate(hosts * 12)]
    long = "http://long.example/" + "seg/" * 50_000
    return spark.createDataFrame([*rows, (900, long, "", "", ""), (900, long, "", "", "")], "page_id long, url string, html string, host string, verdict string")


def test_long_and_repeated_urls(pages):
    got = url_filter.judge(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "ratio"]
    rows = got.collect()
    twice = [r for r in rows if r.page_id == 900]
    assert len(rows) == 98 and len(twice) == 2 and twice[0] == twice[1] and len(twice[0].path) == 200_001 and twice[0].ratio is not None
    assert {r.verdict for r in rows if r.rule == "net/"} == {"block"} and {r.verdict for r in rows if r.rule == "example.net/en/"} == {"allow"}


def test_empty_table(pages):
    assert url_filter.judge(pages.where("false")).count() == 0


def test_learns_from_all_urls(spark):
    """More urls a side than the 20,000 that were once sampled: ratios and threshold against plain dictionaries over all of them."""
    rows = [(i, f"http://e.example.net/en/{i * 7919 % 99991:x}") for i in range(21_000)] + [(50_000 + i, f"http://b{i % 7}.net/{i:o}") for i in range(300)]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    parts = url_filter.with_parts(urls).selectExpr("concat(host, path) as u", "rule like '%/en/' as good").distinct()
    sides = [(r.u.encode(), r.good, r.held) for r in parts.withColumn("held", url_filter.held_out(parts["u"])).collect()]
    a, b = (plain_model([u for u, good, held in sides if good == side and not held], 2) for side in (True, False))
    plain = lambda u: (a(u) - b(u)) / (len(u) + 1)
    model = url_filter.train(urls, order=2)
    asked = [b"e.example.net/en/1", b"b3.net/77", b"x.org/", "ü.example/中".encode()]
    assert model.scores(asked) == pytest.approx([plain(u) for u in asked], abs=1e-6)
    good, bad = (np.array([plain(u) for u, g, held in sides if g == side and held]) for side in (True, False))
    errors = lambda cut: (good <= cut).mean() + (bad > cut).mean()
    assert errors(model.threshold + 1e-6) == pytest.approx(min(errors(c) for c in np.unique(np.r_[-np.inf, good[:300], bad])), abs=1e-3)
    assert model.counts.count() > 0 and sum(r.accepted for r in model.counts.where("gram >= shiftleft(1L, 48)").collect()) == sum(len(u) + 1 for u, g, held in sides if g and not held)
