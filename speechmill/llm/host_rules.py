"""Quality rules by host: failures of documents, shrunk rates of hosts, verdicts joined back to documents.

1. Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated 3-word windows) and from them RULES, each
   failed or not, by integer comparisons.
2. Failures are summed by host and rule. Each rule has a beta prior over hosts, fitted to the hosts' own rates by moments (the variance
   between hosts beyond what the binomial gives, in the weighted form of Kleinman): with overdispersion rho the prior weighs
   1 / rho - 1 documents, so a host of few documents keeps near the mean of all and one of many near its own rate. Without
   overdispersion every host has the mean.
3. A host is rejected where the shrunk rate of any rule is above LIMIT. Documents go if they fail a base rule (too short, too
   repetitive) or if their host is rejected.

A host is any column; the query takes `source`, the domain that documents come from. Hosts are not bounded in number: their verdicts
come back by a merge join, those of hosts with a large share of the documents by broadcast (common.with_group_values).

Defined results: null text has no words, so it fails; an empty one likewise; a null host is no host, its documents have only the base rules
and count in no rate (host_rate null); repeated rows count and come back each; null ids stay; other columns are not read; an
empty table gives an empty table. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, located, map_batches, mix, stored, texts, with_group_values, without_rows

#: Of a shrunk failure rate; above it a host's documents all go.
LIMIT = 0.5
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Name and failure of each rule; the first two are the base rules.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
}


def repeated_words(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those of them in 3-word windows that the text has twice or more."""
    hashes, sizes = hashed_words(batch, fold=False)
    if len(hashes) < 3:
        return sizes, np.zeros(len(batch), np.int64)
    owner = np.repeat(np.arange(len(batch), dtype=np.uint64), sizes)
    with np.errstate(over="ignore"):
        window = mix(mix(mix(hashes[:-2]) + hashes[1:-1]) + hashes[2:])
        window = mix(window + owner[:-2] * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(owner[:-2] == owner[2:])  # windows within one text
    _, place, count = np.unique(window[at], return_inverse=True, return_counts=True)
    at = at[count[place] > 1]
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[at + k] = True
    return sizes, np.bincount(owner[inside].astype(np.int64), minlength=len(batch))


def text_counts(batch: list[str]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n_words, n_repeat = repeated_words(batch)
    raw = [t.encode("utf-8", "surrogatepass") for t in batch]
    data = np.frombuffer(b"".join(raw), np.uint8)
    stops = np.cumsum([0, *(len(x) for x in raw)])
    sums = lambda which: np.diff(np.r_[0, np.cumsum(which, dtype=np.int64)][stops])
    chars = ((data & 0xC0) != 0x80) & (data != 32) & ((data < 9) | (data > 13))
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in batch]
    n_lines = np.array([len(x) for x in lines], np.int64)
    distinct = np.array([len(set(x)) for x in lines], np.int64)
    return dict(zip(COUNTS, (n_words, sums(chars), sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))), n_lines, n_lines - distinct, n_repeat), strict=True))


def counted(docs: DataFrame, host: Column, key: Column, kind: str = "long") -> DataFrame:
    """doc_id (key, of that type), host, COUNTS and a boolean for each rule (true: failed), a row for each row of docs."""

    def make():
        return lambda b: {"doc_id": b.column(0), "host": b.column(1), **text_counts(texts(b))}

    rows = docs.select(key.cast(kind).alias("doc_id"), host.cast("string").alias("host"), docs["text"])
    found = map_batches(rows, make, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.select("*", *(F.expr(failed).alias(name) for name, failed in RULES.items()))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, rule, n, failures, rate (shrunk) of each host and rule."""
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    pairs = stored(hosts.unpivot(["host", "n"], list(RULES), "rule", "failures"), "hosts")
    n, k = F.col("n"), F.col("failures")
    prior = pairs.groupBy("rule").agg(
        F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.sum(n.cast("double") * n).alias("squares"), F.sum(k.cast("double") * k / n).alias("own")
    )
    mean = F.col("failed") / F.col("docs")
    # between: sum of n * (rate - mean)^2; by chance it is (hosts - 1) * mean * (1 - mean)
    between = F.col("own") - F.col("docs") * mean * mean
    room = F.col("docs") - F.col("squares") / F.col("docs") - (F.col("hosts") - 1)
    rho = F.try_divide(F.try_divide(between, mean * (1 - mean)) - (F.col("hosts") - 1), room)
    prior = prior.select("rule", mean.alias("mean"), F.least(rho, F.lit(1.0)).alias("rho"))
    weight = 1 / F.col("rho") - 1
    rate = F.when(F.col("rho") > 1e-9, (k + weight * F.col("mean")) / (n + weight)).otherwise(F.col("mean"))
    return pairs.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failures", rate.alias("rate"))


def verdicts(rows: DataFrame) -> DataFrame:
    """host, n, host_rate (the highest of its rules' shrunk rates, to 6 places) and the rule that has it, a row for each host."""
    rate = F.round("rate", 6)
    return host_rates(rows).groupBy("host").agg(F.max("n").alias("n"), F.max(rate).alias("host_rate"), F.max_by("rule", F.struct(rate, "rule")).alias("host_rule"))


def _judged(rows: DataFrame, limit: float) -> DataFrame:
    rows = stored(rows, "rules")
    known = stored(verdicts(rows), "verdicts")
    none = rows.where("host is null").withColumns({"host_rate": F.lit(None).cast("double"), "host_rule": F.lit(None).cast("string")})
    found = with_group_values(rows.where("host is not null"), known, "host", "n", rows.count()).drop("n").unionByName(none)
    base = F.col("short") | F.col("repetitive")
    bad = F.coalesce(F.col("host_rate") > limit, F.lit(False))
    return found.select("doc_id", *(c for c in COUNTS if c != "n_lines"), base.alias("base_failed"), (~base & ~bad).alias("kept"), "host", "host_rate", "host_rule")


def judge(docs: DataFrame, host: Column | None = None, limit: float = LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, kept, host, host_rate, host_rule: a row for each row of docs. host: docs' source by default."""
    return _judged(counted(docs, docs["source"] if host is None else host, docs["doc_id"]), limit)


def keep_good(docs: DataFrame, host: Column | None = None, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs whatever their names. Rows go by their locator, so ids may repeat or be null."""
    docs, at = located(docs)
    rows = counted(docs, docs["source"] if host is None else host, at, "struct<file: string, row: bigint>")
    return without_rows(docs, at, _judged(rows, limit).where(~F.col("kept")).select(F.col("doc_id").alias("at")))


def oracle() -> str:
    """judge() of documents in DuckDB's SQL."""
    blank, word = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    fails = ", ".join(f"({failed}) AS {name}" for name, failed in RULES.items())
    pairs = " UNION ALL ".join(f"SELECT host, '{r}' AS rule, count(*) AS n, count(*) FILTER ({r}) AS k FROM f WHERE host IS NOT NULL GROUP BY host" for r in RULES)
    return f"""WITH w AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents),
tri AS (SELECT row, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM tri) WHERE c > 1),
again AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(3) d(k) GROUP BY row),
c AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN again USING (row)),
f AS (SELECT *, {fails} FROM c),
p AS ({pairs}),
m AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(k)::DOUBLE / sum(n) AS mean, sum(n::DOUBLE * n) AS squares, sum(k::DOUBLE * k / n) AS own FROM p GROUP BY rule),
r AS (SELECT rule, mean, least(((own - docs * mean * mean) / nullif(mean * (1 - mean), 0) - (hosts - 1)) / nullif(docs - squares / docs - (hosts - 1), 0), 1.0::DOUBLE) AS rho FROM m),
s AS (SELECT host, rule, round(CASE WHEN rho > 1e-9 THEN (k + (1 / rho - 1) * mean) / (n + (1 / rho - 1)) ELSE mean END, 6) AS rate FROM p JOIN r USING (rule)),
v AS (SELECT host, max(rate) AS host_rate, arg_max(rule, (rate, rule)) AS host_rule FROM s GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND coalesce(host_rate <= {LIMIT}, true) AS kept, host, host_rate, host_rule
FROM f LEFT JOIN v USING (host)"""
