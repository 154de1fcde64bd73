"""Product-quantised vector codes by exact k-means in integers, with Exponion search.

Vectors become integers floor(SCALE * x) and are cut into PARTS equal parts; each part position has a codebook of ENTRIES entries. The rows are
packed once into blocks (a row of arrays for vectors of BLOCK components: ids, labels, components of 16 or 32 bits, codes), which every round reads and writes once, so a
round moves no single vectors and needs no shuffle: a block carries the sums and counts of its parts by entry as narrow columns of their own,
and the new codebooks come from aggregating these alone (at most PARTS * ENTRIES rows of components reach the driver).

Exponion search: a part starts at its entry of the round before, at squared distance d. Any entry nearer, or as near, lies within twice that
radius of the start entry: its squared distance to it is at most 4 * d. So the start entry's neighbours, sorted by distance, are scanned only up
to there. Distances are integers, ties go to the lower index, and the bound is compared exactly: the result is that of a full search.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; components beyond LARGEST after scaling are an error
(their distances don't fit 64 bits); shorter vectors are filled up with zeros to the longest one, and all to a multiple of PARTS; the first
entries are those of the ENTRIES smallest vec_ids (null ids last, ties by components; fewer rows give fewer entries); repeated rows count each; null
labels are one label; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, stored, with_group_values

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of a block, so that it has 0.5 to 1 MB.
BLOCK = 1 << 18
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, scale: int, *more: Column) -> DataFrame:
    """vec_id, label, q (array<long>: floor(scale * x) of each component), more; rows without a whole finite vector are dropped."""
    x = vectors["embedding"]
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    rows = vectors.where(sound)
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label"), F.transform(rows["embedding"], lambda v: F.floor(v.cast("double") * scale)).alias("q"), *more)


def matrix(column: pa.ListArray, width: int, largest: int = LARGEST) -> np.ndarray:
    """Rows of the lists, filled up with zeros to width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) and max(int(values.max()), -int(values.min())) > largest:
        raise ValueError(f"a component is beyond {largest} after scaling")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of book nearest to each row of x (ties to the lower index) and its squared distance, searched from the entries in start."""
    between = ((book[:, None] - book[None]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    radius = np.take_along_axis(between, order, 1)
    best = start.astype(np.int64)
    least = ((x - book[best]) ** 2).sum(1)
    bound, own = 4 * least, best.copy()
    at = np.arange(len(x))
    for k in range(len(book)):
        at = at[radius[own[at], k] <= bound[at]]  # lists are sorted, so who is out stays out
        if not len(at):
            break
        entry = order[own[at], k]
        d = ((x[at] - book[entry]) ** 2).sum(1)
        closer = (d < least[at]) | ((d == least[at]) & (entry < best[at]))
        least[at[closer]], best[at[closer]] = d[closer], entry[closer]
    return best, least


BLOCK_SCHEMA = "ids array<bigint>, labels array<bigint>, x binary, codes binary, sums array<bigint>, counts array<bigint>, errors array<bigint>"


def packed(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Blocks of rows as they come, components as numbers of that kind; all codes are 0."""
    n = max(1, BLOCK // width)

    def make():
        def step(b):
            x = matrix(b.column(2), width)
            cut = range(0, len(x), n)
            lists = lambda c: [c.slice(i, n).to_pylist() for i in cut]
            return {
                "ids": lists(b.column(0)), "labels": lists(b.column(1)), "x": [x[i : i + n].astype(kind).tobytes() for i in cut],
                "codes": [bytes(len(x[i : i + n]) * PARTS) for i in cut], "sums": [[]] * len(cut), "counts": [[]] * len(cut), "errors": [[]] * len(cut),
            }

        return step

    return map_batches(rows, make, BLOCK_SCHEMA, part_bytes=1 << 30)


def assigned(blocks: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """blocks with the codes by these codebooks (PARTS x entries x components), searched from the codes they have, and what a new round needs."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)  # as large as ENTRIES vectors

    def make():
        known = sent.value
        parts, entries, size = known.shape

        def block(x: bytes, codes: bytes):
            x = np.frombuffer(x, kind).astype(np.int64).reshape(-1, parts, size)
            start, codes = np.frombuffer(codes, np.uint8).reshape(-1, parts), np.empty((len(x), parts), np.uint8)
            sums, counts, errors = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                best, least = nearest(x[:, p], start[:, p], known[p])
                np.add.at(sums[p], best, x[:, p])
                counts[p] += np.bincount(best, minlength=entries)
                codes[:, p], errors = best, errors + least
            return codes.tobytes(), sums.ravel(), counts.ravel(), errors

        def step(b):
            made = [block(x, c) for x, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            codes, sums, counts, errors = zip(*made, strict=True)
            return {"ids": b.column(0), "labels": b.column(1), "x": b.column(2), "codes": codes, "sums": sums, "counts": counts, "errors": errors}

        return step

    return map_batches(blocks, make, BLOCK_SCHEMA)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floor(sum / count) of each entry's parts; entries without parts stay. Reads the narrow columns alone."""
    parts, entries, size = books.shape
    total = np.zeros(parts * entries * (size + 1), object)
    for r in blocks.select(F.posexplode(F.concat("sums", "counts"))).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect():
        total[r.pos] = int(r.s)
    sums, counts = total[: books.size].reshape(books.shape), total[books.size :].reshape(parts, entries, 1)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books).astype(np.int64)


def encode(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row that is kept, and the final codebooks (PARTS x entries x components)."""
    rows = whole_numbers(vectors, SCALE)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((PARTS, 0, 0), np.int64)
    longest, most = rows.agg(F.max(F.size("q")), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    size, kind = max(1, -(-longest // PARTS)), "<i2" if (most or 0) < 1 << 15 else "<i4"
    heads = matrix(pa.array([r.q for r in first], pa.list_(pa.int64())), size * PARTS)
    books = np.ascontiguousarray(heads.reshape(len(first), PARTS, size).transpose(1, 0, 2))
    blocks = stored(packed(rows, size * PARTS, kind), "blocks")
    for k in range(ROUNDS + 1):
        before, blocks = blocks, stored(assigned(blocks, books, kind), "blocks")
        discard(before)
        if k < ROUNDS:
            books = moved(blocks, books)
    place = F.sequence(F.lit(0), F.size("ids") - 1)
    codes = F.transform(place, lambda i: F.lower(F.hex(F.substring("codes", i * PARTS + 1, F.lit(PARTS)))))
    out = blocks.select(F.explode(F.arrays_zip("ids", "labels", codes.alias("code"), "errors")).alias("e"))
    return out.select(F.col("e.ids").alias("vec_id"), F.col("e.labels").alias("label"), F.col("e.code").alias("code"), F.col("e.errors").alias("error")), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that is kept."""
    rows, books = encode(vectors)
    rows = stored(rows, "codes")
    labels = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    found = with_group_values(rows, labels, "label", "n", rows.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """compressed() of embeddings in DuckDB's SQL, with a full search in each round."""
    size = f"(SELECT CAST(greatest(1, ceil(max(len(q)) / {PARTS}.0)) AS BIGINT) FROM v)"
    steps = [rf"""v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT row, p, list_transform(range(p * {size} + 1, (p + 1) * {size} + 1), lambda i: coalesce(q[i], 0)) AS x FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM w JOIN (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM v) USING (row) WHERE e < {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, p, min((d, e)) AS best FROM (SELECT row, w.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM w JOIN b{k} ON w.p = b{k}.p) GROUP BY row, p)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m
  FROM (SELECT w.p, best[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM w JOIN a{k} USING (row, p)) GROUP BY p, e, i) GROUP BY p, e) n USING (p, e))""")
    return f"""WITH {", ".join(steps)},
r AS (SELECT row, string_agg(lower(printf('%02x', CAST(best[2] AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (row), h"""
