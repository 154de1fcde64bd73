"""Helpers shared by the operators: work tables, whole-text map steps, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import RELEASE, new_path

#: The six characters that separate words in every contract of this folder.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """The name, with lines after it until df has no such column (in any case of letters)."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors. Shuffle files are deleted once their
    query has ended; the session's setting for that is turned on and stays on, so that queries that run side by side don't turn it off for each other."""
    spark = df.sparkSession
    path = new_path(spark, name)
    spark.conf.set(RELEASE, "true")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _from_parquet(docs: DataFrame) -> bool:
    """Whether docs are a Parquet relation as read, whose rows know their file and place. Rows of other formats, databases and views don't."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and the locator of each row: struct(file, row), the Parquet file it stands in and its place there.

    A table read from Parquet has these of its own. Any other one (JSON, CSV, ORC, JDBC, a catalog's table, a view, a query) is first written to the
    shared folder, as its rows have no lasting place.
    """
    if not _from_parquet(docs):
        docs = stored(docs, "content", compression="zstd")
    meta = docs.metadataColumn("_metadata")
    return docs, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


#: Bits of a bitmap of locators, and the most of them: 2 MB to 32 MB for each task, whatever there is to mark. What needs more bits is cut into ranges
#: of files, each with a bitmap of its own; there are so many ranges at most, enough for 4e9 marked rows at 4 bits each.
BITS_LEAST, BITS_MOST, RANGES_MOST = 1 << 24, 1 << 28, 64


class Marks:
    """A set of row locators as bitmaps of bounded size: rows that they don't mark are surely not in the set, so they need no join."""

    def __init__(self, rows: DataFrame, at: Column, count: int):
        self.rows, self.at, self.bits = rows, at, BITS_LEAST
        while self.bits < min(BITS_MOST, 16 * count):
            self.bits *= 2
        self.ranges = max(1, min(RANGES_MOST, 16 * count // BITS_MOST))

    def _place(self, at: Column) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(at), F.lit(self.bits)) + 1
        return F.bitmap_bucket_number(place), F.bitmap_bit_position(place).cast("int")

    def split(self, docs: DataFrame, at: Column, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
        """The rows that may be in the set, and those that surely aren't; both with these columns. A range reads its own files only."""
        if self.ranges == 1:
            return self._split(docs, self.rows, at, columns)
        own = lambda x, k: F.pmod(F.xxhash64(x["file"]), F.lit(self.ranges)) == k
        parts = [self._split(docs.where(own(at, k)), self.rows.where(own(self.at, k)), at, columns) for k in range(self.ranges)]
        return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])

    def _split(self, docs: DataFrame, marked_rows: DataFrame, at: Column, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
        bucket, bit = self._place(self.at)
        bitmap = marked_rows.groupBy(bucket.alias("mark_bucket")).agg(F.bitmap_construct_agg(bit).alias("mark_bits"))
        bucket, bit = self._place(at)
        mark, bits = fresh(docs, "mark"), fresh(docs, "mark_bits")
        held = bitmap.withColumnRenamed("mark_bits", bits)
        rows = docs.select(*columns, F.struct(bucket.alias("bucket"), bit.alias("bit")).alias(mark))
        rows = rows.join(F.broadcast(held), rows[mark]["bucket"] == held["mark_bucket"], "left").drop(held["mark_bucket"])
        marked = F.coalesce(F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast({mark}.bit div 8 as int) + 1, 1)), 16, 10) as int), {mark}.bit % 8) & 1 = 1"), F.lit(False))
        return rows.where(marked).drop(mark, bits), rows.where(~marked).drop(mark, bits)


def without_rows(docs: DataFrame, at: Column, gone: DataFrame) -> DataFrame:
    """docs (as located() gives them) without the rows whose locator is in gone(at). Rows that surely stay are not shuffled."""
    gone = stored(gone, "gone")
    own = fresh(docs, "at")
    may, stay = Marks(gone, F.col("at"), gone.count()).split(docs, at, [*(docs[c] for c in docs.columns), at.alias(own)])
    left = may.join(gone.hint("merge"), may[own] == gone["at"], "left_anti")
    return stay.select(*docs.columns).unionByName(left.select(*docs.columns))


#: A group with more than this share of all rows is a hot one: there can't be more than its inverse of them, so a narrow list of them goes to all tasks.
HOT_SHARE = 1e-5


def with_group_values(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of groups(key, size, ...), a row for each key of rows; nulls are a key like others.

    Groups above HOT_SHARE of total come by broadcast (at most 1 / HOT_SHARE rows), so their rows stay where they are; the others by a merge join,
    in which no key then has many rows. rows and groups are read twice: they should be stored.
    """
    own = fresh(rows, "group_key")
    groups, hot = groups.withColumnRenamed(key, own), F.col(size) > int(total * HOT_SHARE)
    many, few = F.broadcast(groups.where(hot)), groups.where(~hot)
    on = lambda g: rows[key].eqNullSafe(g[own])
    rest = rows.join(many.select(own), on(many), "left_anti")
    return rows.join(many, on(many)).drop(own).unionByName(rest.join(few.hint("merge"), rest[key].eqNullSafe(few[own])).drop(own))


#: Rows that a map step holds as Python objects at once, and bytes of them.
ROWS, BYTES = 512, 2 << 20


def pieces_of(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows and about so many bytes; a larger row stands alone."""
    ends = np.cumsum(np.full(batch.num_rows, 16, np.int64) + _row_bytes(batch))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binaries of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


_kept: dict[object, object] = {}
_asked: set[object] = set()


def kept(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task under a key; made where it isn't there."""
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Free memory that a worker's allocator holds goes back to the system: workers outlive their tasks, beside whatever runs next."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def alone(make: Callable[[], object]):
    """make(); of what the worker keeps, only what make() asked for stays, so operators that share workers don't add up their memory."""
    _asked.clear()
    made = make()
    for key in set(_kept) - _asked:
        del _kept[key]
    give_back()
    return made


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], schema: str, part_bytes: int | None = None) -> DataFrame:
    """mapInArrow: make() runs once in a task, what it returns turns each slice of a batch (of ROWS rows, or of part_bytes) into columns of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = alone(make)
        for batch in batches:
            for part in pieces_of(batch, batch.num_rows, part_bytes) if part_bytes else pieces_of(batch):
                if part.num_rows:
                    out = step(part)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((out[f.name], f) for f in fields)], schema=fields)
                    out = None
            batch = part = None
            give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit hash (splitmix64): spreads the bits of a sum."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_table(fold: bool) -> np.ndarray:
    """A 64-bit value of each byte, A-Z as a-z if fold; 0 for the six blanks."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse
_TABLES = {fold: _bytes_table(fold) for fold in (True, False)}
#: Powers that a worker keeps; a longer text makes its own.
POWERS_KEPT = 1 << 22
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    if n > POWERS_KEPT:
        out = []
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
        return out
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                x = np.full(max(n, 1 << 16), base, np.uint64)
                x[0] = 1
                _powers[k] = np.multiply.accumulate(x)
    return _powers


#: Text of a slice that is hashed at once.
HASHED_BYTES = 1 << 20


def hashed_words(batch: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts in order, and how many each text has. A-Z count as a-z if fold.

    A word's hash is a polynomial over its bytes, taken from running sums over slices of the batch: nothing is done word by word, and what is held beside the
    hashes (about 40 bytes for each byte of text) doesn't grow with the batch but for a longer text.
    """
    parts, own, size = [], [], 0
    for x in batch:
        own.append(x.encode("utf-8", "surrogatepass"))
        size += len(own[-1]) + 1
        if size >= HASHED_BYTES:
            parts.append(_hashed(own, fold))
            own, size = [], 0
    if own or not parts:
        parts.append(_hashed(own, fold))
    return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _hashed(raw: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """hashed_words() of one slice."""
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    value = _TABLES[fold][data]
    inside = value != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    power, inverse = _powers_to(len(data))
    with np.errstate(over="ignore"):
        value *= power[: len(data)]
        sums = np.cumsum(value, dtype=np.uint64)
        hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([1] + [len(x) + 1 for x in raw])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(batch: list[str], n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-word shingles; the whole sequence where it has fewer words; empty without words."""
    hashes, sizes = hashed_words(batch)
    stops = np.cumsum(sizes)
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
        total = mix(total)
    out = []
    for stop, size in zip(stops.tolist(), sizes.tolist(), strict=True):
        if size >= n:
            own = np.sort(total[stop - size : stop - n + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif size:
            value = np.full(1, size, np.uint64)
            with np.errstate(over="ignore"):
                for h in hashes[stop - size : stop]:
                    value = mix(value + h)
            out.append(value)
        else:
            out.append(hashes[:0])
    return out


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    return shingle_sets([text], n)[0]
