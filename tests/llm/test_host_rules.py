"""op12 against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from speechmill.llm import common, host_rules

SCHEMA = "doc_id long, text string, lang string, source string, host string, n long, group_key int, at string, short string"


def made():
    rng = random.Random(3)
    words = ["wörter", "zwei", "a", "of#", "Of#", "langes", "naïve", "x|y", "<b>", "ét", "東京"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \n\t ", "a b c a b c", "A b c a b c", "x " * 60, "l1 l1 l1\nl1 l1 l1\n\n \nl1 l1 l1\r\nend", "w" * 5000, " ".join(f"u{i}" for i in range(9000))]
    for _ in range(60):
        n = rng.choice([3, 49, 50, 51, 90])
        w = rng.choices(words, k=n)
        texts.append("".join(x + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for x in w))
        texts.append("\n".join([" ".join(w[:12])] * 8 + [" ".join(w)]))
    rows = [(i, t, "en", rng.choice(["good", "bad", "one", None]), "h", 1, 2, "a", "s") for i, t in enumerate(texts)]
    rows = [(*r[:3], "bad", *r[4:]) if r[1] and len(r[1].split()) < 20 else r for r in rows]  # a host whose documents are short
    return [*rows, rows[20], rows[20], (None, " ".join(f"word{i}" for i in range(60)), "en", "good", "h", 1, 2, "a", "s"), (999, rows[31][1], "en", "single", "h", 1, 2, "a", "s")]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)


def failures(n, chars, symbols, lines, again, repeat):
    return {"short": n < 50, "repetitive": 100 * repeat > 50 * n, "word_length": chars < 3 * n or chars > 10 * n, "symbols": 10 * symbols > n, "repeated_lines": 100 * again > 30 * lines}


def judged(rows):
    found = [(r[0], r[3], counts(r[1])) for r in rows]
    rates = {}
    for rule in host_rules.RULES:
        own = {}
        for _, host, c in found:
            if host is not None:
                n, k = own.get(host, (0, 0))
                own[host] = n + 1, k + failures(*c)[rule]
        total, bad = sum(n for n, _ in own.values()), sum(k for _, k in own.values())
        mean, m = bad / total, len(own)
        chance = mean * (1 - mean)
        room = total - sum(n * n for n, _ in own.values()) / total - (m - 1)
        rho = min(1.0, (sum(n * (k / n - mean) ** 2 for n, k in own.values()) / chance - (m - 1)) / room) if chance and room else 0
        for host, (n, k) in own.items():
            weight = 1 / rho - 1 if rho > 1e-9 else None
            rates.setdefault(host, []).append(mean if weight is None else (k + weight * mean) / (n + weight))
    out = []
    for i, host, c in found:
        base = failures(*c)["short"] or failures(*c)["repetitive"]
        rate = round(max(rates[host]), 6) if host is not None else None
        out.append((i, *c[:3], *c[4:], base, not base and (rate is None or rate <= 0.5), host, rate))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(4)


def test_op12_brute_force(docs):
    got = host_rules.judge(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host"]
    rows = {"got": [], "want": []}
    for r in got.collect():
        rows["got"].append((*(r[c] for c in names), None if r.host_rate is None else pytest.approx(r.host_rate, abs=2e-6)))
    rows["want"] = judged(made())
    key = lambda r: repr(r[:9])
    assert sorted(rows["want"], key=key) == sorted(rows["got"], key=key)
    kept = {r[8] for r in rows["want"] if r[7]}
    assert kept == {"good", "one", None} | ({"single"} & kept) and any(r[8] == "bad" and not r[6] and not r[7] for r in rows["want"])  # a good document goes with its host


def test_op12_keeps_columns_and_rows_without_id(docs):
    left = host_rules.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r[7] for r in judged(made()))
    assert left.where("doc_id is null").count() == 1


def test_op12_empty_table(docs):
    none = docs.where("false")
    assert host_rules.judge(none).count() == 0 and host_rules.keep_good(none).count() == 0


def test_few_documents_stay_near_the_mean(spark):
    """A host of one failing document gets a lower rate than one of a hundred."""
    hosts = [("large", 1)] * 100 + [("tiny", 1)] + [(f"h{k}", int(i < 10)) for k in range(20) for i in range(100)]
    rows = spark.createDataFrame(hosts, "host string, bad int").select("host", *((F.col("bad") == 1).alias(r) for r in host_rules.RULES))
    rate = {r.host: r.rate for r in host_rules.host_rates(rows).where("rule = 'short'").collect()}
    assert rate["large"] > 0.9 and 0.1 < rate["tiny"] < rate["large"] and abs(rate["h0"] - 0.1) < 0.02


def test_group_values_by_broadcast_and_by_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), (None, 30), ("b", 15), ("c", 5)) for i in range(n)], "k string, group_key int")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.with_group_values(rows, groups, "k", "n", 100)
    assert got.columns == ["k", "group_key", "n"] and Counter((r.k, r.n) for r in got.collect()) == {("a", 50): 50, (None, 30): 30, ("b", 15): 15, ("c", 5): 5}
