"""N-gram language models as count tables: ngrams(n, ctx, word, cnt), or as blocks of counts where no whole table is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import lm_tokens, sentences
from ..shared import written
from ..ship import ship
from . import blocks as B

START, END = "<s>", "</s>"


def sentence_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, tokens: a row for each sentence with words."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    return rows.select("doc_id", "pos", lm_tokens(F.col("sentence")).alias("tokens")).where(F.size("tokens") > 0)


@dataclass(frozen=True)
class Blocks:
    """Counts of all n-grams up to an order as compressed rows (blocks.py), not yet summed."""

    rows: DataFrame
    order: int
    buckets: int


#: Buckets at least; a bucket is summed in the memory of one task.
BUCKETS = 32


def blocks(rows: DataFrame, order: int = 3, padded: bool = False) -> Blocks:
    """The n-grams of rows(tokens), for orders from 2; padded: with order - 1 marks at either end. As many buckets as the session has shuffle partitions."""
    spark = ship(rows.sparkSession)
    tokens = F.col("tokens")
    if padded:
        pad = lambda m: F.array(*[F.lit(m)] * (order - 1))
        tokens = F.concat(pad(START), tokens, pad(END))
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Blocks(rows.select(tokens.alias("tokens")).where("tokens is not null").mapInArrow(B.blocks_of(order, buckets), B.SCHEMA), order, buckets)


def counts(rows: DataFrame, order: int = 3, padded: bool = False) -> DataFrame:
    """Counts of all 1..order-grams of rows(tokens): n, ctx (its words joined by blanks, as tokens have none), word, cnt; padded: with order - 1 marks at either end.

    One pass over the text: each place with the order - 1 words after it is counted within a task, and these counts go to the buckets of their first two words as
    compressed blocks. What they begin with are the shorter n-grams, so these are summed in the same bucket.
    """
    if order < 2:
        return unigrams(rows).select(F.lit(1).alias("n"), F.lit("").alias("ctx"), "word", "cnt")
    return blocks(rows, order, padded).rows.groupBy("bucket").applyInArrow(B.gram_counts(order), "n int, ctx string, word string, cnt long")


def _with(asked: DataFrame, *more: str) -> StructType:
    out = StructType([f for f in asked.schema.fields if f.name != B.ASKED])
    for name in more:
        out = out.add(name, "long")
    return out


def _dealt(asked: DataFrame, places: tuple[int, ...], buckets: int) -> DataFrame:
    """Rows, or packed rows where that is all there is, packed and dealt by their words at some places."""
    return asked.mapInArrow(B.dealt_rows(places, buckets, asked.columns == ["data"]), B.ROWS_SCHEMA)


def _beside(asked: DataFrame, blocks: DataFrame, step, schema: str = B.ROWS_SCHEMA) -> DataFrame:
    return asked.groupBy("bucket").cogroup(blocks.groupBy("bucket")).applyInArrow(step, schema)


def one_pass(asked: DataFrame, grams: Blocks, around: bool = False) -> DataFrame:
    """asked(..., lm_words array) once through the blocks of a corpus, bucket by bucket, written: rows of kinds of blocks.py. Neither side is a row for each n-gram or word on
    the way, and no table of all n-grams is made."""
    return written(_beside(_dealt(asked, B.FIRST, grams.buckets), grams.rows, B.passed(grams.order, grams.buckets, around), B.PASS_SCHEMA), "counted")


def _unpacked(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.select("data").mapInArrow(B.unpacked(schema.names), schema)


def context_totals_of(grams: Blocks) -> DataFrame:
    """n, ctx, total, kinds. A context of two words and more is in one bucket; sums of the others are few and are added up."""
    found = written(grams.rows.groupBy("bucket").applyInArrow(B.context_sums(grams.order), "n int, ctx string, total long, kinds long"), "totals", compression="zstd")
    short = found.where("n <= 2").groupBy("n", "ctx").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))
    return found.where("n > 2").unionByName(short)


def train_lines(corpus: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, tokens of a corpus in which every sentence counts, and every line once more."""
    once = sentence_tokens(corpus, text)
    lines = corpus.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    again = lines.select("doc_id", F.col("pos"), lm_tokens(F.trim("line")).alias("tokens")).where(F.size("tokens") > 0)
    return once.unionByName(again)


#: What a decoder is made with.
DECODER = {"order": 3, "smoothing": "laplace", "alpha": 1.5, "beta": 0.05, "beam": 3}


def decoder_tables(corpus: DataFrame | None, vocabulary: DataFrame, settings: dict = DECODER) -> tuple[DataFrame, DataFrame] | None:
    """The count table and the bias of each token for constrained decoding; None (plain decoding) without a corpus or with an unknown smoothing."""
    if corpus is None or settings["smoothing"] != "laplace":
        return None
    grams = counts(train_lines(corpus), settings["order"])
    return grams, token_bias(vocabulary, grams, settings["alpha"])


def context_totals(grams: DataFrame) -> DataFrame:
    return grams.groupBy("n", "ctx").agg(F.sum("cnt").alias("total"), F.count("*").alias("kinds"))


def unigrams(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def top_words(rows: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; ties in order of first occurrence (doc_id, pos, place)."""
    words = rows.select("doc_id", "pos", F.posexplode("tokens").alias("place", "word"))
    seen = words.groupBy("word").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos", "place")).alias("first"))
    return seen.orderBy(F.desc("cnt"), "first").limit(k).select("word", "cnt")


def queries_of(rows: DataFrame, order: int) -> DataFrame:
    """Each word of rows(doc_id, pos, tokens) with its context, shorter at the start of a sentence."""
    placed = rows.select("doc_id", "pos", "tokens", F.posexplode("tokens").alias("place", "word"))
    size = F.least(F.col("place"), F.lit(order - 1))
    return placed.select("doc_id", "pos", "place", "word", F.array_join(F.slice("tokens", F.col("place") - size + 1, size), " ").alias("ctx"))


def _counted_blocks(asked: DataFrame, grams: Blocks) -> DataFrame:
    """_counted by blocks. Words without a context, and the totals of contexts of one word, come from the table of words; the rest is looked up bucket by bucket."""
    words = F.when(F.col("ctx") == "", F.array(F.lower("word"))).otherwise(F.concat(F.split("ctx", " "), F.array(F.lower("word"))))
    found, names = one_pass(asked.withColumn(B.ASKED, words), grams), asked.columns
    table = found.where(F.col("kind") == B.WORDS).select("bucket", "kind", "n", "words", "ids").mapInArrow(B.words_of_blocks(["cnt", "followed"]), "word string, cnt long, followed long")
    table = written(table, "words", compression="zstd")
    empty = table.agg(F.sum("cnt").alias("all_words"), F.count("*").alias("kinds"))  # one row
    own = table.select(F.col("word").alias("lm_key"), F.col("cnt").alias("lm_cnt"), "followed")
    short, more = (_unpacked(found.where(F.col("kind") == k), _with(asked, "cnt", "total")) for k in (B.SHORT, B.LONG))
    lone = F.col("ctx") == ""
    key = F.when(lone, F.lower("word")).otherwise(F.col("ctx"))
    short = short.join(own, key == F.col("lm_key"), "left").select(*names, F.when(lone, F.col("lm_cnt")).otherwise(F.col("cnt")).alias("cnt"), F.when(~lone & (F.col("followed") > 0), F.col("followed")).alias("total"))
    return short.unionByName(more).crossJoin(F.broadcast(empty)).withColumn("total", F.when(lone, F.col("all_words")).otherwise(F.col("total")))


def _counted(asked: DataFrame, grams: DataFrame | Blocks) -> DataFrame:
    """asked(..., word, ctx) with cnt and total (null where unseen). Words without a context, a large share of all, take their total from one row."""
    if isinstance(grams, Blocks):
        return _counted_blocks(asked, grams)
    own = grams.select(F.col("ctx").alias("g_ctx"), F.col("word").alias("g_word"), "cnt")
    totals = grams.where("ctx <> ''").groupBy("ctx").agg(F.sum("cnt").alias("total")).withColumnRenamed("ctx", "t_ctx")
    empty = grams.where("ctx = ''").agg(F.sum("cnt").alias("all_words"), F.count("*").alias("kinds"))  # one row
    known = asked.join(own, (asked["ctx"] == own["g_ctx"]) & (F.lower(asked["word"]) == own["g_word"]), "left").drop("g_ctx", "g_word")
    lone = known.where("ctx = ''").withColumn("total", F.lit(None).cast("long"))
    after = known.where("ctx <> '' or ctx is null").join(totals, F.col("ctx") == F.col("t_ctx"), "left").drop("t_ctx")
    return lone.unionByName(after).crossJoin(F.broadcast(empty)).withColumn("total", F.when(F.col("ctx") == "", F.col("all_words")).otherwise(F.col("total")))


def laplace(asked: DataFrame, grams: DataFrame | Blocks) -> DataFrame:
    """asked(..., word, ctx) with logp = ln((count + 1) / (context total + kinds of words)); unseen counts are 0."""
    p = (F.coalesce("cnt", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("kinds"))
    return _counted(asked, grams).select(*asked.columns, F.ln(p).alias("logp"))


def maximum_likelihood(asked: DataFrame, grams: DataFrame | Blocks, floor: float = 1e-12) -> DataFrame:
    """logp = ln(count / context total) by counts of padded sentences, at least ln(floor)."""
    p = F.coalesce(F.col("cnt") / F.col("total"), F.lit(0.0))
    return _counted(asked, grams).select(*asked.columns, F.ln(F.greatest(p, F.lit(floor))).alias("logp"))


def add_one(asked: DataFrame, grams: DataFrame | Blocks) -> DataFrame:
    """logp by counts of padded sentences: (count + 1) / (context total + size of the vocabulary, in which the marks and one unknown word count)."""
    p = (F.coalesce("cnt", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.col("kinds") + 1)
    return _counted(asked, grams).select(*asked.columns, F.ln(p).alias("logp"))


def _without_first(ctx: str) -> Column:
    return F.when(F.instr(ctx, " ") > 0, F.substring(ctx, F.instr(ctx, " ") + 1, F.lit(1 << 30))).otherwise("")


def kneser_ney_tables(grams: DataFrame, order: int = 3, discount: float = 0.1) -> list[tuple[DataFrame, DataFrame | None]]:
    """Interpolated Kneser-Ney of counts of padded sentences, one entry for each size of n-gram from 1 to order: what is left of each seen n-gram
    (ctx, word, alpha), and what each seen context hands down (ctx, gamma); the first entry has the share of each word (word, alpha) alone.

    The highest order counts occurrences, the lower ones count in how many different contexts an n-gram stands.
    """
    follows = grams.where("n = 2").groupBy("word").agg(F.count("*").alias("c"))
    pairs = grams.where("n = 2").agg(F.count("*").alias("pairs"))  # one row
    tables: list[tuple[DataFrame, DataFrame | None]] = [(follows.crossJoin(F.broadcast(pairs)).select("word", (F.col("c") / F.col("pairs")).alias("alpha")), None)]
    for k in range(2, order + 1):
        own = grams.where(F.col("n") == k)
        longer = grams.where(F.col("n") == k + 1).groupBy(_without_first("ctx").alias("ctx"), "word").agg(F.count("*").alias("c"))
        counted = own.select("ctx", "word", F.col("cnt").alias("c")) if k == order else longer
        held = counted.groupBy("ctx").agg(F.sum("c").alias("total")).join(own.groupBy("ctx").agg(F.count("*").alias("kinds")), "ctx")
        left = counted.join(held.select("ctx", "total"), "ctx").select("ctx", "word", (F.greatest(F.col("c") - F.lit(discount), F.lit(0.0)) / F.col("total")).alias("alpha"))
        tables.append((left, held.select("ctx", (F.lit(discount) * F.col("kinds") / F.col("total")).alias("gamma"))))
    return tables


def kneser_ney(asked: DataFrame, grams: DataFrame, order: int = 3, discount: float = 0.1, floor: float = 1e-12) -> DataFrame:
    """asked(..., word, ctx) with logp, at least ln(floor), by interpolated Kneser-Ney of the last order - 1 words of ctx.

    From the share of the word alone upwards: p = alpha(ctx, word) + gamma(ctx) * p of the shorter context; a context that was never seen, or for which there
    are too few words, hands p on as it is. Unknown words have no share. Rows without a long enough context get a key of their own, so they don't meet in one task.
    """
    lowest, *higher = kneser_ney_tables(grams, order, discount)
    words = F.filter(F.split("ctx", " "), lambda w: w != "")
    rows = asked.select(*asked.columns, F.lower(F.trim("word")).alias("kn_word"), words.alias("kn_words"))
    share = lowest[0].withColumnRenamed("word", "kn_known")
    rows = rows.join(share, rows["kn_word"] == share["kn_known"], "left").select(*rows.columns, F.coalesce("alpha", F.lit(0.0)).alias("kn_p"))
    for k, (left, held) in enumerate(higher, 2):
        tail = F.when(F.size("kn_words") >= k - 1, F.array_join(F.slice("kn_words", -(k - 1), k - 1), " "))
        rows = rows.withColumn("kn_ctx", F.coalesce(tail, F.concat(F.lit("\0"), F.xxhash64(*asked.columns).cast("string"))))
        held = held.withColumnRenamed("ctx", "kn_held")
        left = left.select(F.col("ctx").alias("kn_left"), F.col("word").alias("kn_known"), "alpha")
        rows = rows.join(held, rows["kn_ctx"] == held["kn_held"], "left").drop("kn_held")
        rows = rows.join(left, (rows["kn_ctx"] == left["kn_left"]) & (rows["kn_word"] == left["kn_known"]), "left")
        p = F.when(F.col("gamma").isNull(), F.col("kn_p")).otherwise(F.coalesce("alpha", F.lit(0.0)) + F.col("gamma") * F.col("kn_p"))
        rows = rows.select(*asked.columns, "kn_word", "kn_words", p.alias("kn_p"))
    return rows.select(*asked.columns, F.ln(F.greatest("kn_p", F.lit(floor))).alias("logp"))


def kneser_ney_of(asked: DataFrame, rows: DataFrame, discount: float = 0.1, floor: float = 1e-12) -> DataFrame:
    """kneser_ney of order 3 by the padded sentences of rows(tokens): the columns of asked but word and ctx, with logp. Counts and asked words travel packed, as in one_pass.

    The pass answers for three words; what it says of pairs and words is dealt by these, and asked rows go to it by their last word, the one before it, and both. Each
    step's result is written, so that the shuffles of one are gone before the next.
    """
    names = [c for c in asked.columns if c not in ("word", "ctx")]
    context = F.filter(F.split("ctx", " "), lambda w: w != "")
    words = F.concat(F.slice(context, F.greatest(F.lit(1), F.size(context) - 1), 2), F.array(F.lower(F.trim("word"))))
    own, grams = asked.select(*names, F.coalesce(words, F.array(F.lower(F.trim("word")))).alias(B.ASKED)), blocks(rows, 3, True)
    found = one_pass(own, grams, True)
    pairs = found.where(F.col("kind") == B.COUNT).agg(F.sum("n").alias("pairs"))  # one row
    of = lambda kind: found.where(F.col("kind") == kind).select("bucket", "kind", "n", "words", "ids")
    said = found.where(F.col("kind").isin(B.SHORT, B.LONG)).select("data")
    said = written(_beside(_dealt(said, B.LAST, grams.buckets), of(B.STATS), B.with_words(-1, {"kn_before": 0})).select("data"), "kn-words")
    said = written(_beside(_dealt(said, B.BEFORE_LAST, grams.buckets), of(B.STATS), B.with_words(-2, {"kn_kinds": 1, "kn_total": 2})).select("data"), "kn-contexts")
    said = _beside(_dealt(said, B.LAST_PAIR, grams.buckets), of(B.PAIRS), B.with_pairs("kn_cnt"))
    rows = _unpacked(said, _with(own, "cnt", "total", "kinds", "kn_before", "kn_kinds", "kn_total", "kn_cnt")).crossJoin(F.broadcast(pairs))
    p = F.coalesce(F.col("kn_before") / F.col("pairs"), F.lit(0.0))
    for cnt, total, kinds in (("kn_cnt", "kn_total", "kn_kinds"), ("cnt", "total", "kinds")):
        alpha = F.greatest(F.coalesce(cnt, F.lit(0)) - F.lit(discount), F.lit(0.0)) / F.col(total)
        p = F.when(F.col(total).isNull(), p).otherwise(alpha + F.lit(discount) * F.col(kinds) / F.col(total) * p)
    return rows.select(*names, F.ln(F.greatest(p, F.lit(floor))).alias("logp"))


def perplexity(scored: DataFrame) -> DataFrame:
    """exp of the mean negative logp; infinite without words."""
    mean = F.avg("logp")
    return scored.agg(F.coalesce(F.exp(-mean), F.lit(float("inf"))).alias("perplexity"), F.count("logp").alias("n_words"))


def token_bias(vocabulary: DataFrame, grams: DataFrame, alpha: float = 1.5, floor: float = -10.0) -> DataFrame:
    """vocabulary(token_id, token) with bias = alpha * max(logp of its first word, floor), for tokens whose first word the model has seen; none for tokens that begin with '<'."""
    token = F.trim(F.regexp_replace(F.lower("token"), r"\s+", " "))
    asked = vocabulary.select("token_id", F.element_at(F.split(token, " "), 1).alias("word"), F.lit("").alias("ctx"), token.alias("t")).where("word <> '' and t not like '<%'").drop("t")
    grams = grams.where("n = 1")
    known = asked.join(grams.select("word"), "word", "left_semi")
    return laplace(known, grams).select("token_id", "word", (F.greatest("logp", F.lit(floor)) * F.lit(alpha)).alias("bias")).where("bias <> 0")


def contextual_bias(logits: DataFrame, bias: DataFrame, grams: DataFrame | Blocks, alpha: float = 1.5, floor: float = -10.0, words: DataFrame | None = None) -> DataFrame:
    """logits(hyp_id, token_id, token, logit, ctx array of the last words) plus the bias of the token. Where there are words before it and the
    token is one word of the model, it is that word's score after the last two of them instead, seen there or not. words: the counts of words, where grams are blocks."""
    word = F.trim(F.lower("token"))
    base = logits.join(bias.select("token_id", "bias"), "token_id", "left")
    asked = base.where(F.col("bias").isNotNull() & (F.size("ctx") > 0)).select("hyp_id", "token_id", word.alias("word"), F.array_join(F.slice("ctx", F.greatest(F.lit(1), F.size("ctx") - 1), 2), " ").alias("ctx"))
    asked = asked.join((grams if words is None else words).where("n = 1").select("word"), "word", "left_semi")
    near = laplace(asked, grams).select("hyp_id", "token_id", (F.greatest("logp", F.lit(floor)) * F.lit(alpha)).alias("near"))
    out = base.join(near, ["hyp_id", "token_id"], "left")
    return out.select("hyp_id", "token_id", (F.col("logit") + F.coalesce("near", "bias", F.lit(0.0))).alias("logit"))
