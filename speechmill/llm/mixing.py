"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions alone.

A tree domain - language - source has a weight at each node. The token budget goes down from the root: children share their
parent's budget by weight, none gets more than its subtree can give (its tokens times MAX_EPOCHS), and what a child can't
take goes to its siblings by weight; only what the whole subtree can't take leaves it for the parent's siblings. This is a
water level per set of siblings, found by one window over them.

Each leaf then takes whole epochs while its budget lasts and the first tokens of one more. The order within an epoch is
that of md5(seed:epoch:doc_id), so a leaf's selection with a larger budget contains that with a smaller one. Running sums
are taken in two steps, over hash buckets of a leaf and within a bucket, so that no task holds a leaf that has a third of all rows.

Defined results: null text has no tokens; documents without tokens are never selected; null lang or source is the name '' (and its domain
'other'); repeated rows count and are ordered one by one; names without a weight have DEFAULT_WEIGHT; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, located, stored

DOMAIN_NAMES = ("web", "books", "news", "forums")
DOMAIN_WEIGHTS = {"web": 0.3, "books": 0.3, "news": 0.2, "forums": 0.2}
LANG_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
SOURCE_WEIGHTS: dict[str, float] = {}
DEFAULT_WEIGHT = 1.0
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.6, 2, 17
#: Hash digits that make a leaf's buckets: 16 ** 3 of them.
DIGITS = 3
#: Leaves up to this number go to all tasks; more are joined by a shuffle.
MAX_BROADCAST_LEAVES = 50_000
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Sources srcN by fives: 0-4 web, 5-9 books, 10-14 news, 15-19 forums; else other."""
    n = F.regexp_extract(source, "^src([0-9]{1,4})$", 1)
    k = (F.when(n != "", n).cast("int") / 5).cast("int")
    out = F.lit("other")
    for i, name in enumerate(DOMAIN_NAMES):
        out = F.when(k == i, name).otherwise(out)
    return out


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for key, w in weights.items():
        out = F.when(name == key, F.lit(float(w))).otherwise(out)
    return out


def _named(docs: DataFrame) -> list[Column]:
    """doc_id, domain, lang, source, n_tokens."""
    lang, source = (F.coalesce(docs[c], F.lit("")) for c in ("lang", "source"))
    words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    return [docs["doc_id"].cast("long").alias("doc_id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), words.alias("n_tokens")]


def counted(docs: DataFrame) -> DataFrame:
    return docs.select(*_named(docs))


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(*parent, name, cap, weight, budget of the parent) with their own `share`, by water level."""
    key = F.col("cap") / F.col("weight")
    order = Window.partitionBy(*parent).orderBy(key, name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = nodes.where("weight > 0").withColumn("level", (F.col("budget") - before) / rest)
    # the level rises while nodes are filled and falls from there: its highest value is the right one
    level = level.withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    return level.withColumn("share", F.greatest(F.lit(0.0), F.least("cap", F.col("level") * F.col("weight")))).drop("level", "budget", "weight")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """leaves(domain, lang, source, tokens) with budget long: tokens to take from each."""
    cap = (F.col("tokens") * max_epochs).cast("double")
    caps = leaves.where("tokens > 0").withColumn("cap", cap)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(budget_share) + 1e-6).cast("double").alias("budget"))
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col("domain"), weights[0])).crossJoin(F.broadcast(total)).withColumn("root", F.lit(0))
    top = shared_out(top, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(F.col("lang"), weights[1])).join(top, "domain")
    mid = shared_out(mid, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = caps.withColumn("weight", weight_of(F.col("source"), weights[2])).join(mid, ["domain", "lang"])
    return shared_out(low, ["domain", "lang"], "source").select(*LEAF, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def _place(seed: int) -> Column:
    """Where a document stands in its leaf's part epoch `full`."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _budgets(rows: DataFrame, budget_share: float, max_epochs: int, weights: tuple[dict, dict, dict]) -> tuple[DataFrame, bool]:
    """Each leaf's budget as whole epochs (`full`) and what is left of it (`rest`); and whether there are few enough leaves to send to all tasks."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    budgets = stored(leaf_budgets(leaves, budget_share, max_epochs, weights), "budgets")
    full = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    budgets, few = budgets.select(*LEAF, full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest")), budgets.count() <= MAX_BROADCAST_LEAVES
    return (F.broadcast(budgets) if few else budgets), few


def _part_epoch(own: DataFrame, seed: int, ties: list[str]) -> DataFrame:
    """The rows whose start in their leaf's part epoch lies before its rest, with `place` and `start`."""
    part = own.where("rest > 0").withColumn("place", _place(seed))
    part = part.withColumn("bucket", F.substring("place", 1, DIGITS))
    sums = part.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("s"))
    ordered = Window.partitionBy(*LEAF).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("s").over(ordered) - F.col("s")).drop("s")
    within = Window.partitionBy(*LEAF, "bucket").orderBy("place", "doc_id", "n_tokens", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = part.join(sums, [*LEAF, "bucket"]).where("before < rest")
    return near.withColumn("start", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).where("start < rest")


def select(
    docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, taken: a row per document and epoch that gives tokens; taken < n_tokens for the last one of a leaf."""
    rows = stored(counted(docs), "counted")
    budgets, _ = _budgets(rows, budget_share, max_epochs, weights)
    own = rows.where("n_tokens > 0").join(budgets, LEAF)
    whole = own.where("full > 0").select("doc_id", *LEAF, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    near = _part_epoch(own, seed, [])
    near = near.select("doc_id", *LEAF, F.col("full").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("start")).alias("taken"))
    return whole.unionByName(near)


def mix(
    docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
) -> DataFrame:
    """The rows of docs that select() takes, one for each epoch, columns as they are; the last document of a leaf stays whole.

    A leaf's part epoch is a prefix of an order, so the last row of it decides on all others: one such row for each leaf goes to
    all tasks, and no text is shuffled. The order ends in the row's locator: rows that repeat a doc_id and rows with null ids are taken
    one by one. Null or blank texts have no tokens and are never taken; an empty table stays empty; columns of any name are kept.
    """
    docs, at = located(docs)
    rows = stored(docs.select(*_named(docs), at.alias("at")), "counted")
    budgets, few = _budgets(rows, budget_share, max_epochs, weights)
    order = F.struct("place", "doc_id", "n_tokens", "at")
    near = _part_epoch(rows.where("n_tokens > 0").join(budgets, LEAF), seed, ["at"])
    last = near.groupBy(*LEAF).agg(F.max(order).alias("last"))
    leaves = stored(budgets.join(last, LEAF, "left"), "leaves")
    own = fresh(docs, "own")
    inner = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(own), *_named(docs), at.alias("at")).where("n_tokens > 0")
    taken = inner.join(F.broadcast(leaves) if few else leaves, LEAF).withColumn("place", _place(seed))
    copies = F.col("full") + F.when(order <= F.col("last"), 1).otherwise(0)
    taken = taken.withColumn("copies", copies).where("copies > 0").select(own, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(own)[c].alias(c) for c in docs.columns))


def oracle(budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same selection in DuckDB's SQL over the view documents."""
    case = lambda name, weights: f"CASE {' '.join(f"WHEN {name} = '{k}' THEN {float(w)!r}" for k, w in weights.items())} ELSE {DEFAULT_WEIGHT!r} END" if weights else repr(DEFAULT_WEIGHT)
    domains = " ".join(f"WHEN k = {i} THEN '{name}'" for i, name in enumerate(DOMAIN_NAMES))

    def level(name: str, source: str, parent: str, key: str, keep: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY cap / weight, {key}"
        return f"""
{name}_level AS (SELECT *, (budget - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({source}) WHERE weight > 0),
{name} AS (SELECT {keep}, greatest(0.0, least(cap, max(level) OVER (PARTITION BY {parent}) * weight)) AS share FROM {name}_level)"""

    top = level("dom", f"SELECT domain, sum(cap) AS cap, {case('domain', DOMAIN_WEIGHTS)} AS weight, any_value(budget) AS budget, 0 AS root FROM caps, total GROUP BY domain", "root", "domain", "domain")
    mid = level("lng", f"SELECT caps.domain, caps.lang, sum(cap) AS cap, {case('caps.lang', LANG_WEIGHTS)} AS weight, any_value(share) AS budget FROM caps JOIN dom USING (domain) GROUP BY caps.domain, caps.lang", "domain", "lang", "domain, lang")
    low = level("src", f"SELECT caps.domain, caps.lang, caps.source, caps.tokens, cap, {case('caps.source', SOURCE_WEIGHTS)} AS weight, share AS budget FROM caps JOIN lng USING (domain, lang)", "domain, lang", "source", "domain, lang, source, tokens")
    return rf"""
WITH named AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  try_cast(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,4}})$', 1) AS INTEGER) // 5 AS k FROM documents),
counted AS (SELECT doc_id, CASE {domains} ELSE 'other' END AS domain, lang, source, n_tokens FROM named),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted GROUP BY ALL),
caps AS (SELECT *, CAST(tokens * {max_epochs} AS DOUBLE) AS cap FROM leaves WHERE tokens > 0),
total AS (SELECT CAST(floor(sum(tokens) * {budget_share!r}::DOUBLE + 1e-6) AS DOUBLE) AS budget FROM leaves),{top},{mid},{low},
own AS (SELECT c.*, tokens, CAST(floor(share + 1e-6) AS BIGINT) AS budget FROM counted c JOIN src USING (domain, lang, source) WHERE n_tokens > 0),
split AS (SELECT *, CAST(budget // tokens AS INTEGER) AS whole, budget % tokens AS rest FROM own),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM split WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole)) AS INTEGER) AS epoch, n_tokens, n_tokens AS taken FROM split WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens, CAST(least(n_tokens, rest - start) AS BIGINT) AS taken FROM run WHERE start < rest
"""
