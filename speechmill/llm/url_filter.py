"""URL filter: rules first, then the ratio of two character language models.

Rules are strings host/path-prefix. A rule fits its host and all subdomains if the url's path starts with the
rule's path; the longest one that fits decides. Other urls go to the method: two smoothed variable-order Markov
models over the characters of host and path, one of accepted and one of rejected urls (those that the rules decide),
give a log-likelihood difference divided by the length; at or under a calibrated threshold the url is blocked.

Models: order ORDER down to 0, interpolated by the number of distinct followers of a context (Witten-Bell); a
context that a model hasn't seen gives way to the next shorter one. They are learnt from all distinct urls that the rules decide. Of each
side a fifth (by a hash) is kept for calibration: the threshold is the one with the least sum of the two error rates there, and the smallest
such, so ties favour keeping; a side without urls there counts as one without errors.

Relations. A gram is a character with up to ORDER bytes before it in its url. The map step counts the grams of a slice, a shuffle by gram sums them
up: one table for both sides. The probabilities of the grams that are asked for come level by level, from characters alone up to whole grams: a level
joins the one below by the gram without its first byte, so no key has more than 256 rows. A url's score is the sum of its grams' values, joined by
gram. Grams that have HOT_SHARE of all occurrences or more, no more of them than its inverse, are added up in the map step from a broadcast table. Values
are whole numbers of 1 / UNIT, so sums do not depend on their order. Nothing that grows with the urls goes to the driver or to every task.

Defined results: null, or no '://': host and path are empty, no rule, and the verdict is allow (there is nothing to score); where one side has fewer than
LEAST_URLS distinct urls each url that no rule decides is allowed; repeated rows are judged one by one; urls of any length are scored whole, in slices of a batch cut by rows and
bytes; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, located, map_batches, stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
LEAST_URLS = 5
#: Values of grams are whole numbers of 1 / UNIT.
UNIT = 1 << 24
#: A gram in one integer: its bytes, the last one lowest, and above them how many they are.
SIZE_BIT = 48
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    got = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return F.translate(got(1), UPPER, LOWER), got(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        fits.append(F.when(((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}"), rule))
    return F.coalesce(*fits, F.lit(None).cast("string"))


class Markov:
    """One model over a list of urls in memory, for tests: counts of characters after contexts of up to 5 bytes; a context and its follower are packed in one integer."""

    def __init__(self, urls: list[bytes], order: int = ORDER):
        self.order, self.levels = order, []
        packed, here, _ = _packed(urls, order)
        for k in range(order + 1):
            full = packed[k][here[k]]
            keys, counts = np.unique(full, return_counts=True)
            contexts, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts
            self.levels.append((keys, counts.astype(np.float64), contexts, totals.astype(np.float64), kinds.astype(np.float64)))

    def log_probs(self, packed: list[np.ndarray], here: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(packed[0]), 1 / 256)
        for k, (keys, counts, contexts, totals, kinds) in enumerate(self.levels):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(contexts, packed[k] >> np.uint64(8)), len(contexts) - 1)
            seen = here[k] & (contexts[at] == packed[k] >> np.uint64(8))
            own = np.minimum(np.searchsorted(keys, packed[k]), len(keys) - 1)
            n = np.where(keys[own] == packed[k], counts[own], 0.0)
            p = np.where(seen, (n + kinds[at] * p) / (totals[at] + kinds[at]), p)
        return np.log(p)


def _packed(urls: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order: context and character of each position in one integer, and whether the context lies within the url. A byte 0 ends each url."""
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    chars = np.frombuffer(b"\0".join(urls) + b"\0" if urls else b"", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(urls)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    packed, here, value = [], [], chars.copy()
    for k in range(order + 1):
        if k:
            value = value + np.where(place >= k, np.r_[np.zeros(min(k, len(chars)), np.uint64), chars[: max(0, len(chars) - k)]] << np.uint64(8 * k), np.uint64(0))
        packed.append(value)
        here.append(place >= k)
    return packed, here, owner


@dataclass
class Ratio:
    """Two models in memory, for tests; Model has them as tables."""

    accepted: Markov
    rejected: Markov
    threshold: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """(log P accepted - log P rejected) / length: higher is better."""
        packed, here, owner = _packed(urls, self.accepted.order)
        gap = self.accepted.log_probs(packed, here) - self.rejected.log_probs(packed, here)
        return np.bincount(owner, weights=gap, minlength=len(urls)) / np.bincount(owner, minlength=len(urls)) if len(urls) else gap


def grams_of(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all urls in order, and the url of each. A byte 0 ends each url."""
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    chars = np.frombuffer(b"\0".join(urls) + b"\0" if urls else b"", np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(urls)), sizes)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    gram = chars | np.minimum(place, order) + 1 << SIZE_BIT
    for k in range(1, order + 1):
        gram[k:] |= np.where(place[k:] >= k, chars[:-k] << 8 * k, 0)
    return gram, owner


def with_parts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", *more: Column) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), *more)
    return cut.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def _encoded(batch, name: str = "url") -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def gram_counts(rows: DataFrame, columns: list[str], order: int) -> DataFrame:
    """gram and the columns: how many times each gram is in urls for which the column (0 or 1) is 1. Sums are taken for each slice first."""

    def make():
        def step(b):
            gram, owner = grams_of(_encoded(b), order)
            found, at = np.unique(gram, return_inverse=True)
            weight = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns}
            return {"gram": found, **{c: np.bincount(at, weights=w[owner], minlength=len(found)).astype(np.int64) for c, w in weight.items()}}

        return step

    return map_batches(rows.select("url", *columns), make, "gram long, " + ", ".join(f"{c} long" for c in columns)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in columns))


def gram_values(counts: DataFrame, asked: DataFrame, order: int) -> list[DataFrame]:
    """gram, seen, value of the grams in asked(gram, seen), in a table for each size: log P accepted - log P rejected, times UNIT. counts: gram, accepted, rejected."""
    zero = F.lit(0).cast("long")
    every = stored(counts.select("gram", "accepted", "rejected", zero.alias("seen")).unionByName(asked.select("gram", zero.alias("accepted"), zero.alias("rejected"), "seen")), "url-grams")
    size, tables = F.shiftright("gram", SIZE_BIT), []
    for k in range(order + 1):
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        level = every.where(size > k).groupBy(key.alias("key")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("asked"), F.sum(F.when(size == k + 1, F.col("seen")).otherwise(0)).alias("seen")
        )
        context = Window.partitionBy(F.shiftright("key", 8))
        sides = [(c, F.sum(c).over(context), F.sum((F.col(c) > 0).cast("long")).over(context)) for c in ("accepted", "rejected")]
        level = level.select("key", "asked", "seen", *(x for c, total, kinds in sides for x in (F.col(c), total.alias(f"{c}_total"), kinds.alias(f"{c}_kinds")))).where("asked > 0")
        if k:
            below = tables[-1].select(F.col("key").alias("shorter"), F.col("accepted").alias("accepted_p"), F.col("rejected").alias("rejected_p"))
            level = level.join(below, F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("shorter"))
        else:
            level = level.withColumns({"accepted_p": F.lit(1 / 256), "rejected_p": F.lit(1 / 256)})
        p = {c: F.when(F.col(f"{c}_kinds") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")) for c in ("accepted", "rejected")}
        tables.append(stored(level.select("key", "seen", *(x.alias(c) for c, x in p.items())), f"url-level{k}"))
    discard(every)
    value = F.round((F.ln("accepted") - F.ln("rejected")) * UNIT).cast("long")
    return [t.where("seen > 0").select(F.col("key").bitwiseOR(F.lit(k + 1 << SIZE_BIT)).alias("gram"), "seen", value.alias("value")) for k, t in enumerate(tables)]


def url_sums(rows: DataFrame, order: int, hot: Broadcast) -> DataFrame:
    """file, row, n, total: a row for each url with its length and what hot grams add."""

    def make():
        known, value = hot.value

        def step(b):
            gram, owner = grams_of(_encoded(b), order)
            at, held = _hot_places(gram, known)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, owner[held], value[at[held]])
            return {"file": b.column(0), "row": b.column(1), "n": np.bincount(owner, minlength=b.num_rows), "total": total}

        return step

    return map_batches(rows, make, "file long, row long, n long, total long")


def url_grams(rows: DataFrame, order: int, hot: Broadcast) -> DataFrame:
    """file, row, gram: the grams of each url, but the hot ones, a row for each place."""

    def make():
        known, _ = hot.value

        def step(b):
            gram, owner = grams_of(_encoded(b), order)
            left = ~_hot_places(gram, known)[1]
            file, row = (b.column(i).to_numpy(zero_copy_only=False)[owner[left]] for i in (0, 1))
            return {"file": file, "row": row, "gram": gram[left]}

        return step

    return map_batches(rows, make, "file long, row long, gram long")


def _hot_places(gram: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram its place in the sorted table of hot ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return at, known[at] == gram


@dataclass
class Model:
    """Counts of the grams of both sides' urls (gram, accepted, rejected), and the calibrated threshold."""

    counts: DataFrame
    order: int
    threshold: float = float("-inf")

    def ratios(self, rows: DataFrame) -> DataFrame:
        """file, row, ratio of rows(file, row, url): (log P accepted - log P rejected) / length, higher is better."""
        asked = gram_counts(rows.withColumn("seen", F.lit(1)), ["seen"], self.order)
        values = stored(reduce(DataFrame.unionByName, gram_values(self.counts, asked, self.order)), "url-values")
        is_hot = F.col("seen") >= max(1.0, (values.agg(F.sum("seen")).first()[0] or 0) * HOT_SHARE)
        hot = values.where(is_hot).select("gram", "value").toPandas().sort_values("gram")  # at most 1 / HOT_SHARE rows
        sent = rows.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot["value"].to_numpy(np.int64)))
        rest = url_grams(rows, self.order, sent).join(values.where(~is_hot).select("gram", "value").hint("merge"), "gram")
        sums = url_sums(rows, self.order, sent).unionByName(rest.select("file", "row", F.lit(0).cast("long").alias("n"), F.col("value").alias("total")))
        return sums.groupBy("file", "row").agg((F.sum("total") / F.lit(float(UNIT)) / F.sum("n")).alias("ratio"))

    def scores(self, urls: list[bytes]) -> list[float]:
        """The ratios of a few urls."""
        rows = [(0, k, u.decode("utf-8", "surrogatepass")) for k, u in enumerate(urls)]
        asked = self.counts.sparkSession.createDataFrame(rows, "file long, row long, url string")
        return [r.ratio for r in self.ratios(asked).orderBy("row").collect()]


def best_cut(ratios: DataFrame) -> float:
    """The threshold for rows(ratio, good): good urls at or under it are lost, bad ones over it get through."""
    groups = ratios.groupBy("ratio").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    ranged = stored(groups.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "url-cuts")
    # a row for each partition
    parts = ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()
    good, bad = (list(accumulate((r[c] for r in parts), initial=0)) for c in ("good", "bad"))
    before = ratios.sparkSession.createDataFrame([(r.part, g, b) for r, g, b in zip(parts, good, bad, strict=False)], "part int, good_before long, bad_before long")
    so_far = Window.partitionBy("part").orderBy("ratio")
    lost = F.sum("good").over(so_far) + F.col("good_before")
    through = F.lit(bad[-1]) - F.sum("bad").over(so_far) - F.col("bad_before")
    errors = (lost * F.lit(max(1, bad[-1])) + through * F.lit(max(1, good[-1]))).alias("errors")
    best = ranged.join(F.broadcast(before), "part").select(errors, "ratio").agg(F.min(F.struct("errors", "ratio")).alias("x")).first().x
    return best.ratio if best is not None and best.errors < bad[-1] * max(1, good[-1]) else float("-inf")


def held_out(url: Column) -> Column:
    """Whether a url is kept for calibration."""
    return F.pmod(F.xxhash64(url), F.lit(5)) == 4


def train(pages: DataFrame, rules=RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> Model | None:
    """Learn from all distinct urls that the rules decide; None where a side has too few of them."""
    allowed = F.col("rule").isin([r for r, v in rules if v == "allow"])
    parts = with_parts(pages, rules, id_col, url_col).where(F.col("rule").isNotNull())
    urls = stored(parts.select(F.concat("host", "path").alias("url"), allowed.alias("good")).distinct().withColumn("held", held_out(F.col("url"))), "url-sides")
    sizes = {r.good: r.n for r in urls.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(True, 0), sizes.get(False, 0)) < LEAST_URLS:
        return None
    sides = urls.where("not held").select("url", F.col("good").cast("int").alias("accepted"), (~F.col("good")).cast("int").alias("rejected"))
    model = Model(stored(gram_counts(sides, ["accepted", "rejected"], order), "url-counts"), order)
    kept, at = located(urls)
    kept = kept.select(F.xxhash64(at["file"]).alias("file"), at["row"].alias("row"), "url", "good").where(kept["held"])
    model.threshold = best_cut(model.ratios(kept.select("file", "row", "url")).join(kept.select("file", "row", "good"), ["file", "row"]))
    return model


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where nothing is scored)."""
    kinds = reduce(lambda x, r: x.when(F.col("rule") == r[0], r[1]), rules, F)
    pages, at = located(pages)
    model = train(pages, rules, order, id_col, url_col)
    if model is None:
        parts = with_parts(pages, rules, id_col, url_col)
        return parts.select("*", F.coalesce(kinds, F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    parts = with_parts(pages, rules, id_col, url_col, F.xxhash64(at["file"]).alias("file"), at["row"].alias("row"))
    rows = parts.select("file", "row", F.concat("host", "path").alias("url")).where("url <> ''")
    judged = parts.join(model.ratios(rows), ["file", "row"], "left")
    low = F.coalesce(F.col("ratio") <= F.lit(model.threshold), F.lit(False))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(kinds, F.when(low, "block").otherwise("allow")).alias("verdict"), "ratio")
