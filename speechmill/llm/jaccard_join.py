"""N-gram Jaccard join by a token-group matrix, exact.

Two texts link when 100 * |A and B| >= PERCENT * |A or B| of their sets of word shingles. Steps:

1. Texts with the same set are one class; everything below runs over classes.
2. A global order of tokens, rare ones first: tokens that are frequent in some batch get counts, the others count as
   rare and stand in hash order. A class of n tokens enters the matrix with the first n - ceil(0.8 n) + k(n) of them,
   k(n) = 1 + n / MORE: two linked sets share at least the smaller k of the two in these parts. (If x and y share m >= 0.8 |x|
   tokens, the last m - k of these lie at or beyond the end of what is |x| - m + k long.) Classes and pairs that share fewer
   go. The order only decides how much work there is, never what is found.
   Sizes tell more: m shared tokens of a pair leave m - max(left out) in these parts, and a class that has fewer in common
   with all classes of each range of sizes goes.
3. Partition into groups: in each of ROUNDS rounds a class is compared with the most frequent leader of its tokens (a token's
   leader is the class with the smallest hash under it); those that link hang on it. Connected classes are cut into groups of about GROUP members, which belong to one component by
   what was already verified. Large families of near copies so become a few groups after a linear number of comparisons.
4. The matrix holds (token, group). Groups of different components that share a token are candidates. One pair of
   representatives is verified first (twice), which joins most of what belongs together and settles pairs of single classes.
5. For what remains, each group stores the union of its tokens; a query class of the smaller group opens the other group only
   if its overlap with that union reaches what a link needs. Members of opened groups are verified by their sets.

Nothing is capped: all candidate pairs of different components end verified or bounded out. Classes are named by a
64-bit hash of the set, tokens by a 64-bit hash of the shingle (at n distinct texts, n^2 / 2^65 chances of a clash).

Defined results: null text, or no words: empty set, linked with nothing, its own component; fewer words than WORDS: the
whole sequence is the one shingle; repeated rows are copies; a null doc_id never names a component that has other ids;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import located, map_batches, shingle_sets, stored, texts, without_rows
from .graph import components

WORDS, PERCENT = 5, 80
#: A token more for each so many of a set.
MORE = 20
#: Rounds of leaders, and the logarithm of a range of sizes.
ROUNDS, RANGE = 4, 0.03
#: Members of a group at most about this many.
GROUP = 64
#: Frequent in a batch: in so many different sets; the table of counts that all tasks get has a fixed size.
FREQUENT_IN_BATCH, FREQUENT_LEAST, FREQUENT_MAX = 3, 16, 1 << 17


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    import xxhash

    digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def profile(docs: DataFrame, at: Column, words: int) -> DataFrame:
    """kind 0: a row per document (doc_id, at, n, key, key2); kind 1: a token (key) frequent in a batch, with its count (n)."""

    def make():
        def step(b):
            sets = shingle_sets(texts(b), words)
            key, key2 = _keys(sets)
            _, first = np.unique(key, return_index=True)
            tokens, counts = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
            often = counts >= FREQUENT_IN_BATCH
            tokens, counts = _signed(tokens[often]), counts[often]
            k, zeros = len(tokens), np.zeros(len(tokens), np.int64)
            return {
                "kind": np.r_[np.zeros(len(sets), np.int32), np.ones(k, np.int32)],
                "doc_id": pa.concat_arrays([b.column(0), pa.nulls(k, pa.int64())]),
                "at": pa.concat_arrays([b.column(1), pa.nulls(k, b.column(1).type)]),
                "n": np.r_[np.array([len(s) for s in sets], np.int64), counts],
                "key": np.r_[key, tokens],
                "key2": np.r_[key2, zeros],
            }

        return step

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), at.alias("at"), docs["text"])
    return map_batches(rows, make, "kind int, doc_id long, at struct<file: string, row: bigint>, n long, key long, key2 long")


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """token, cid, n, often: the tokens by which a class enters the matrix; a class once in each batch."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT_MAX entries at most

    def make():
        known, counts = sent.value

        def step(b):
            sets = [s for s in shingle_sets(texts(b), words) if len(s)]
            if not sets:
                return {"tokens": [], "often": [], "cid": [], "n": []}
            key, _ = _keys(sets)
            _, first = np.unique(key, return_index=True)
            tokens, often = [], []
            for i in first:
                s = sets[i]
                size = min(len(s), len(s) - -(-percent * len(s) // 100) + 1 + len(s) // MORE)
                weight = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, counts[at], 0)
                # sets are sorted by hash, and the sort is stable: by count, then hash
                chosen = np.argsort(weight, kind="stable")[:size]
                tokens.append(_signed(s[chosen]))
                often.append(weight[chosen] > 0)
            return {"tokens": tokens, "often": often, "cid": key[first], "n": [len(sets[i]) for i in first]}

        return step

    made = map_batches(docs.select("text"), make, "tokens array<long>, often array<boolean>, cid long, n long")
    return made.select("cid", "n", F.explode(F.arrays_zip("tokens", "often")).alias("t")).select(F.col("t.tokens").alias("token"), F.col("t.often").alias("often"), "cid", "n")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, s: the sets of the documents whose ids are wanted."""

    def make():
        def step(b):
            sets = [s for s in shingle_sets(texts(b), words) if len(s)]
            if not sets:
                return {"cid": [], "s": []}
            return {"cid": _keys(sets)[0], "s": [_signed(s) for s in sets]}

        return step

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    # ids that are null match each other here, unlike in an ordinary join
    return map_batches(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["rep"]), "left_semi").select("text"), make, "cid long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those that link."""
    left = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb")))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where((100 + percent) * shared >= percent * (F.size("sa") + F.size("sb"))).select("a", "b").distinct()


def _relabel(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes(cid, n, comp) with the components that links (a, b between comps) join."""
    labels = components(links)
    return stored(classes.join(labels, classes["comp"] == labels["node"], "left").select("cid", "n", F.coalesce("label", "comp").alias("comp")), "classes")


def _least(n):
    """k(n): tokens that a class of n has in common with any other it links with, if that one is no smaller."""
    return F.floor(n / MORE) + 1


def _left_out(n, percent: int):
    """Tokens of a class of n that don't enter the matrix."""
    return F.greatest(F.lit(0), F.ceil(percent * n / 100) - 1 - F.floor(n / MORE))


def _most_left_out(low, high, percent: int):
    """The most that a class of a size from low to high leaves out: it falls by one where k(n) rises, so the last size before that counts too (percent is 5 at least)."""
    before = F.floor(high / MORE) * MORE - 1
    return F.greatest(_left_out(high, percent), F.when(before >= low, _left_out(before, percent)).otherwise(0))


def _needed(low_a, high_a, low_b, high_b, percent: int):
    """Tokens of the matrix that two linked classes of such sizes share: of m in common, those beyond the nearer end are at most what one of them left out."""
    both = F.ceil(percent * (low_a + low_b) / (100 + percent)) - F.greatest(_most_left_out(low_a, high_a, percent), _most_left_out(low_b, high_b, percent))
    return F.greatest(both, _least(F.least(low_a, low_b)))


def _linkable(posts: DataFrame, percent: int) -> DataFrame:
    """The rows of posts(token, cid, n) whose class shares enough tokens with classes of some range of sizes to link with one of them."""
    size = F.floor(F.ln("n") / RANGE).cast("int").alias("size")
    held = posts.groupBy("token", size).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("cid").alias("x"), F.max("cid").alias("y"))
    near = posts.join(held, "token").where((F.col("x") != F.col("cid")) | (F.col("y") != F.col("cid")))
    near = near.where((100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low")))
    near = near.groupBy("cid", "n", "size").agg(F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
    n = F.col("n")
    good = near.where(F.col("k") >= _needed(n, n, F.col("low"), F.col("high"), percent)).select("cid").distinct()
    return posts.join(good, "cid", "left_semi")


def _led(posts: DataFrame, seed: int, percent: int) -> DataFrame:
    """(a, b): each class with that leader of its tokens with which it has most in common, if that is enough. A token's leader depends on the seed."""
    order = F.struct(F.xxhash64("cid", F.lit(seed)).alias("h"), F.col("cid").alias("lead"), F.col("n").alias("n_lead"))
    leads = posts.groupBy("token").agg(F.min(order).alias("l")).select("token", "l.lead", "l.n_lead")
    best = posts.join(leads, "token").where("cid <> lead").groupBy("cid", "lead").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("n_lead").alias("m"))
    n, m = F.col("n"), F.col("m")
    best = best.where(F.col("k") >= _needed(n, n, m, m, percent)).groupBy("cid").agg(F.max(F.struct("k", "lead")).alias("best"))
    return best.select(F.col("cid").alias("a"), F.col("best.lead").alias("b"))


def _candidates(posts: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The groups (cid, n, comp, sub), and the pairs of groups of different components that share a token."""
    sizes = classes.groupBy("comp").agg(F.count("*").alias("size"))
    members = stored(classes.join(sizes, "comp").select("cid", "n", "comp", F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / GROUP)).alias("sub")), "groups")
    held = posts.select("token", "cid").join(members, "cid")
    mixed = held.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    matrix = held.join(mixed, "token").groupBy("token", "comp", "sub").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = stored(matrix, "matrix")
    side = lambda p: matrix.select("token", *(F.col(c).alias(f"{c}_{p}") for c in ("comp", "sub", "low", "high")))
    fits = (F.col("comp_a") < F.col("comp_b")) & (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    pairs = side("a").join(side("b"), "token").where(fits).groupBy("comp_a", "sub_a", "comp_b", "sub_b").agg(F.count("*").alias("k"), *(f(f"{c}_{p}").alias(f"{c}_{p}") for c, f in (("low", F.min), ("high", F.max)) for p in ("a", "b")))
    sizes = [F.col(c) for c in ("low_a", "high_a", "low_b", "high_b")]
    pairs = pairs.where(F.col("k") >= _needed(*sizes, percent)).drop("k", "low_a", "low_b", "high_a", "high_b")
    return members, stored(pairs, "pairs")


def _apart(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The pairs of groups whose components are still apart; before and after: (cid, comp)."""
    moved = before.select("cid", F.col("comp").alias("old")).join(after.select("cid", "comp"), "cid").groupBy("old").agg(F.min("comp").alias("new"))
    for p in ("a", "b"):
        pairs = pairs.join(moved.select(F.col("old").alias(f"comp_{p}"), F.col("new").alias(f"new_{p}")), f"comp_{p}")
    return pairs.where("new_a <> new_b").drop("new_a", "new_b")


def link_classes(docs: DataFrame, classes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(cid, comp) of each class that shares a token of the matrix with another one. classes: (cid, rep)."""
    posts = prefixes(docs, frequent, words, percent)
    # tokens that aren't known as frequent have few rows; the frequent ones are aggregated before the shuffle
    rare = posts.where("not often")
    from pyspark.sql import Window

    by = Window.partitionBy("token")
    rare = rare.select("token", "cid", "n", F.min("cid").over(by).alias("x"), F.max("cid").over(by).alias("y")).where("x < y").drop("x", "y")
    often = posts.where("often").select("token", "cid", "n").distinct()
    several = often.groupBy("token").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x < y").select("token")
    posts = stored(rare.unionByName(often.join(several, "token", "left_semi")).distinct(), "posts")
    # a class needs k tokens in common with one of at least percent of its size
    nodes = posts.groupBy("cid").agg(F.first("n").alias("n"), F.count("*").alias("shared")).where(F.col("shared") >= _least(F.floor(F.col("n") * percent / 100))).drop("shared")
    posts = stored(posts.join(nodes.select("cid"), "cid", "left_semi").select("token", "cid", "n"), "posts")
    posts = stored(_linkable(posts, percent), "posts")
    # groups by leader: in each round one comparison at most for each class
    best = stored(reduce(DataFrame.unionByName, [_led(posts, seed, percent) for seed in range(ROUNDS)]).distinct(), "leaders")
    nodes = posts.groupBy("cid").agg(F.first("n").alias("n"))
    sets = stored(sets_of(docs, nodes.join(classes, "cid").select("rep").distinct(), words), "sets")

    links = verified(best, sets, percent)
    now = _relabel(nodes.select("cid", "n", F.col("cid").alias("comp")), links)

    members, pairs = _candidates(posts, now, percent)
    for pick in (F.min, F.max):
        heads = members.groupBy("comp", "sub").agg(pick("cid").alias("head"))
        tried = pairs
        for p, c in (("a", "a"), ("b", "b")):
            tried = tried.join(heads.select(F.col("comp").alias(f"comp_{p}"), F.col("sub").alias(f"sub_{p}"), F.col("head").alias(c)), [f"comp_{p}", f"sub_{p}"])
        found = verified(tried, sets, percent)
        ends = now.select("cid", "comp")
        found = found.join(ends.withColumnsRenamed({"cid": "a", "comp": "ca"}), "a").join(ends.withColumnsRenamed({"cid": "b", "comp": "cb"}), "b")
        later = _relabel(now, found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        pairs = stored(_apart(pairs, members, later), "apart")
        now = later
        if pairs.isEmpty():
            return now.select("cid", "comp")

    # what remains with more than one member on a side: bound, then open
    sizes = members.groupBy("comp", "sub").agg(F.count("*").alias("size"))
    for p in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("comp").alias(f"comp_{p}"), F.col("sub").alias(f"sub_{p}"), F.col("size").alias(f"size_{p}")), [f"comp_{p}", f"sub_{p}"])
    pairs = pairs.where("size_a > 1 or size_b > 1")
    a, b = (F.struct(F.col(f"comp_{p}").alias("comp"), F.col(f"sub_{p}").alias("sub")) for p in ("a", "b"))
    smaller = F.col("size_a") <= F.col("size_b")
    asked = pairs.select(F.when(smaller, a).otherwise(b).alias("q"), F.when(smaller, b).otherwise(a).alias("g")).select("q.*", F.col("g.comp").alias("g_comp"), F.col("g.sub").alias("g_sub"))
    queries = asked.join(members, ["comp", "sub"]).select("cid", "n", "g_comp", "g_sub")
    opened = queries.select("g_comp", "g_sub").distinct().withColumnsRenamed({"g_comp": "comp", "g_sub": "sub"})
    # at most about GROUP sets in a union
    unions = members.join(opened, ["comp", "sub"]).join(sets, "cid").groupBy("comp", "sub").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("u"))
    unions = unions.withColumnsRenamed({"comp": "g_comp", "sub": "g_sub"})
    bounded = queries.join(sets, "cid").join(unions, ["g_comp", "g_sub"]).where(100 * F.size(F.array_intersect("s", "u")).cast("long") >= percent * F.col("n")).select("cid", "n", "g_comp", "g_sub")
    inside = members.withColumnsRenamed({"cid": "b", "n": "n_b", "comp": "g_comp", "sub": "g_sub"})
    pairs = bounded.join(inside, ["g_comp", "g_sub"]).where((100 * F.col("n") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n"))).select(F.col("cid").alias("a"), "b")
    found = verified(pairs, sets, percent)
    ends = now.select("cid", "comp")
    found = found.join(ends.withColumnsRenamed({"cid": "a", "comp": "ca"}), "a").join(ends.withColumnsRenamed({"cid": "b", "comp": "cb"}), "b")
    return _relabel(now, found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select("cid", "comp")


def _grouped(docs: DataFrame, at: Column, words: int, percent: int) -> DataFrame:
    """doc_id, at, n, group (of texts that links connect; null for those that link with nothing), name (its smallest doc_id): a row for each row of docs."""
    seen = stored(profile(docs, at, words), "profile")
    rows = seen.where("kind = 0").select("doc_id", "at", "n", "key", "key2")
    top = seen.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "key").limit(FREQUENT_MAX).toPandas()
    tokens, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    classes = stored(rows.where("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    comps = link_classes(docs, classes.select(F.col("key").alias("cid"), "rep"), (tokens[order], counts[order]), words, percent)
    joined = classes.join(comps, classes["key"] == comps["cid"], "left")
    names = joined.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("name"))
    # classes of one row that link with nothing need no entry
    known = joined.where("copies > 1 or comp is not null").select("key", "key2", "rep", "comp").join(names, "comp", "left")
    known = known.select("key", "key2", F.coalesce("name", "rep").alias("name"), F.when(F.col("comp").isNotNull(), F.struct(F.lit(0).cast("long").alias("more"), F.col("comp").alias("key"))).otherwise(F.struct(F.col("key2").alias("more"), "key")).alias("group"))
    return rows.join(known, ["key", "key2"], "left")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included."""
    found = _grouped(*located(docs), words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("name", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked texts: that with the smallest doc_id, null ids last, then the first by its locator.

    Rows go by their locator: rows that repeat a doc_id are judged one by one, and rows with null ids like others. Texts without
    words (null ones too) link with nothing and all stay; an empty table stays empty; columns of any name are kept.
    """
    docs, at = located(docs)
    found = stored(_grouped(docs, at, words, percent).where("group is not null").select("at", "group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at").alias("rank")), "grouped")
    first = found.groupBy("group").agg(F.min("rank").alias("first"))
    return without_rows(docs, at, found.join(first, "group").where(F.col("at") != F.col("first.at")).select("at"))
