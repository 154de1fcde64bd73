"""Stupid-backoff language-model scores, computed relationally.

    S(w | context) = count(context w) / count(context)           if the n-gram is kept
                   = ALPHA * S(w | shorter context)               otherwise
    S(w) = count(w) / all words, at least FLOOR

Kept are n-grams of order 2 and more that occur MIN_COUNT times or more in the whole corpus, so a text isn't certain of what
it alone says. Counts cover all documents.

Relations. Rows are arrays, as a row for each n-gram costs more than the counting.
1. Texts are read and cut once. A part is about PART_BYTES of them: its documents, its distinct word hashes, and its words as indexes of these.
2. Exploded n-grams: the map step lists the distinct n-grams of a part with their counts, sorted by hash, a row for each bucket of hashes. A shuffle by
   bucket brings the rows of all parts together; their sums are the count tables, and the join gives each row the counts of its n-grams in the
   whole corpus. There are so many buckets that each has about GROUP n-grams. PARTS ranges of buckets are taken one after another, and the shuffle files of one
   are deleted before the next; so are as many ranges of parts in the next step.
3. Counts go back to their parts by a join on the part; there each word takes the counts of the n-grams that end at it, and the sums are taken for each document.

Parts are stored with their numbers, so nothing rests on two scans that give the same batches. An n-gram comes once a part at most, so no frequent one makes a
bucket large.

Defined results: null text is empty; without words: n_tokens 0, log_score 0, mean null; repeated rows are scored one by one and both
count; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, hashed_words, map_batches, mix, stored, texts

ORDER, ALPHA, MIN_COUNT, FLOOR = 3, 0.4, 2, 1e-12
#: Text of a part, whose n-grams are counted together before the shuffle.
PART_BYTES = 4 << 20
#: N-grams of all parts that meet in a bucket, counted before those of a part are made distinct.
GROUP = 4 << 20
#: Ranges of buckets, and of parts, taken one after another. Each shuffles its own rows alone, so disk for shuffles is 1 / PARTS of one for all.
PARTS = 4
#: Parts of a row group, so that a reader holds few at once.
ROW_GROUP = {"compression": "zstd", "parquet.block.row.count.limit": "2"}


def ngram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k up to order the hash of the k-gram that ends at each word (0 where the document has no such), and the place of each word in its document."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, last = [], None
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            if k == 1:
                last = mix(words + np.uint64(1))
            else:
                # the (k-1)-gram one word back, then this word
                last = np.where(place >= k - 1, mix(_back(last) * np.uint64(31) + words + np.uint64(k)), np.uint64(0))
            out.append(last)
    return out, place


def _back(x: np.ndarray) -> np.ndarray:
    """What stands one word back."""
    return np.concatenate([np.zeros(min(1, len(x)), x.dtype), x[:-1]])


def _lists(values: np.ndarray, sizes) -> pa.Array:
    """Consecutive pieces of an array as lists."""
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    item = pa.from_numpy_dtype(values.dtype)
    return pa.ListArray.from_arrays(offsets, pa.array(values), type=pa.list_(pa.field("element", item)))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The values of all lists of a column, one after another."""
    out = pc.list_flatten(column)
    return (out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out).to_numpy(zero_copy_only=False)


def encoded(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """part, n_words, doc_id, size (of each document), words (distinct hashes), codes (the words of all documents, as indexes of these): a row for each part."""

    def make():
        count = iter(range(1 << 31))
        task = TaskContext.get().partitionId()

        def step(b):
            words, sizes = hashed_words(texts(b))
            known, codes = np.unique(words, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(0)]), type=pa.list_(pa.field("element", pa.int64())))
            return {
                "part": [task << 31 | next(count)], "n_words": [len(words)], "doc_id": ids, "size": _lists(sizes.astype(np.int32), [len(sizes)]),
                "words": _lists(known.view(np.int64), [len(known)]), "codes": _lists(codes.astype(np.int32), [len(codes)]),
            }

        return step

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return map_batches(rows, make, "part long, n_words long, doc_id array<long>, size array<int>, words array<long>, codes array<int>", part_bytes)


def part_grams(words, codes, size, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """ngram_hashes() of a part's columns, and how many words each of its documents has."""
    sizes = _flat(size).astype(np.int64)
    return *ngram_hashes(_flat(words).view(np.uint64)[_flat(codes)], sizes, order), sizes


def _first_top(bucket: int, buckets: int) -> np.uint64:
    """The least upper half of a hash that falls into a bucket; buckets are equal intervals of hashes in their order."""
    return np.uint64(-(-(bucket << 32) // buckets))


def exploded(parts: DataFrame, order: int, first: int, stop: int, buckets: int) -> DataFrame:
    """part, bucket, h, n: the distinct n-grams of each part in order of their hashes, a row for each of the buckets from first to before stop."""

    def make():
        low, high = _first_top(first, buckets), _first_top(stop, buckets)

        def step(b):
            out = []
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                grams, place, _ = part_grams(row.column(1), row.column(2), row.column(3), order)
                own = []
                for k, g in enumerate(grams):
                    top = g >> np.uint64(32)
                    own.append(g[(top >= low) & (top < high) & (place >= k)])
                h = np.sort(np.concatenate(own))
                at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                n, h = np.diff(np.r_[at, len(h)]), h[at]
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else at
                sizes = np.diff(np.r_[starts, len(h)])
                out.append((np.full(len(starts), row.column(0)[0].as_py()), bucket[starts], h.view(np.int64), n.astype(np.int32), sizes))
            part, bucket, h, n, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
            return {"part": part, "bucket": bucket, "h": _lists(h, sizes), "n": _lists(n, sizes)}

        return step

    return map_batches(parts.select("part", "words", "codes", "size"), make, "part long, bucket long, h array<long>, n array<int>", PART_BYTES)


def _counts(rows: pa.Table) -> pa.Table:
    """part, bucket, c: of a bucket's rows with the counts of their n-grams in all of them."""
    h, n, sizes = _flat(rows["h"]), _flat(rows["n"]), pc.list_value_length(rows["h"]).to_numpy()
    known, at = np.unique(h, return_inverse=True)
    total = np.bincount(at, weights=n, minlength=len(known)).astype(np.int64)
    return pa.table({"part": rows["part"], "bucket": rows["bucket"], "c": _lists(total[at], sizes)})


def _scores(n_words: int, order: int, alpha: float, min_count: int):
    """The step that scores the documents of a part by the counts of its n-grams."""

    def step(part: pa.Table, counts: pa.Table) -> pa.Table:
        grams, place, sizes = part_grams(part["words"], part["codes"], part["size"], order)
        c = _flat(counts.sort_by("bucket")["c"])
        known, at = np.unique(np.concatenate([g[place >= k] for k, g in enumerate(grams)]), return_inverse=True)
        if len(known) != len(c):
            raise ValueError("counts don't fit the part")
        at, begin, s, shorter = c[at], 0, np.zeros(len(place)), None
        for k in range(order):
            room = place >= k
            own = np.zeros(len(place), np.int64)
            own[room] = at[begin : (begin := begin + int(room.sum()))]
            if k == 0:
                s = np.log(np.maximum(own / max(1, n_words), FLOOR))
            else:
                kept = room & (own >= min_count)
                s[room] += np.log(alpha)
                s[kept] = np.log(own[kept] / _back(shorter)[kept])
            shorter = own
        owner = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(owner, weights=s, minlength=len(sizes)).astype(float)  # whole numbers where there are no words
        out = pa.table({"doc_id": pc.list_flatten(part["doc_id"]), "n_tokens": sizes, "log_score": total})
        grams = known = at = c = s = own = shorter = None
        give_back()
        return out

    return step


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, parts: int = PARTS, part_bytes: int = PART_BYTES, group: int = GROUP) -> DataFrame:
    """doc_id, n_tokens, log_score (sum over words of log S), mean_log_score, perplexity."""
    rows = stored(encoded(docs, part_bytes), "words", **ROW_GROUP)
    n_words = rows.agg(F.sum("n_words")).first()[0] or 0
    own = -(-order * n_words // (group * parts)) or 1
    found = []
    for k in range(parts):
        grams = exploded(rows, order, k * own, (k + 1) * own, parts * own)
        found.append(stored(grams.groupBy("bucket").applyInArrow(_counts, "part long, bucket long, c array<long>"), "counts", compression="zstd"))
    counts = reduce(DataFrame.unionByName, found)
    step = _scores(n_words, order, alpha, min_count)
    # ranges of parts too: one shuffles its own parts and their counts alone
    own_parts = lambda x, k: x.where(F.pmod(F.xxhash64("part"), F.lit(parts)) == k).groupBy("part")
    joined = [own_parts(rows, k).cogroup(own_parts(counts, k)).applyInArrow(step, "doc_id long, n_tokens long, log_score double") for k in range(parts)]
    scored = reduce(DataFrame.unionByName, [stored(x, "scores") for x in joined])
    discard(rows, *found)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_score", mean.alias("mean_log_score"), F.exp(-mean).alias("perplexity"))


def oracle(alpha: float = ALPHA, min_count: int = MIN_COUNT) -> str:
    """The scores of order 3 in DuckDB's SQL over the view documents, to 4 places."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT rid, w[i] AS g1, w[i - 1] || ' ' || w[i] AS g2, w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] AS g3, CASE WHEN i > 1 THEN w[i - 1] END AS p1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS p2, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT g1 AS k, count(*) AS c FROM g GROUP BY g1), c2 AS (SELECT g2 AS k, count(*) AS c FROM g WHERE i > 1 GROUP BY g2), c3 AS (SELECT g3 AS k, count(*) AS c FROM g WHERE i > 2 GROUP BY g3), n AS (SELECT sum(c) AS n FROM c1),
s AS (SELECT g.rid, CASE WHEN i > 2 AND c3.c >= {min_count} THEN ln(c3.c / q2.c) ELSE CASE WHEN i > 2 THEN ln({alpha!r}) ELSE 0 END
  + CASE WHEN i > 1 AND c2.c >= {min_count} THEN ln(c2.c / q1.c) ELSE CASE WHEN i > 1 THEN ln({alpha!r}) ELSE 0 END + ln(greatest(c1.c / n.n, {FLOOR!r})) END END AS s
  FROM g CROSS JOIN n JOIN c1 ON c1.k = g1 LEFT JOIN c2 ON i > 1 AND c2.k = g2 LEFT JOIN c3 ON i > 2 AND c3.k = g3 LEFT JOIN c1 q1 ON q1.k = p1 LEFT JOIN c2 q2 ON q2.k = p2),
t AS (SELECT rid, sum(s) AS s FROM s GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0), 4) + 0.0::DOUBLE AS log_score, round(s / len(w), 4) AS mean_log_score FROM d LEFT JOIN t USING (rid)"""
