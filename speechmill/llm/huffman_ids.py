"""Token-id output: canonical length-limited Huffman coding with independent blocks.

Layout of the output, a Parquet folder in the shared folder with two tables:
  codebook  one row per id in use: id, bits. Codes follow from the lengths (canonical: by length, then id).
  frames    one row per frame: shard, frame, doc_ids, doc_tokens (ids of each document), n_tokens,
            points (bit offset of each block of BLOCK ids), payload (the bits, most significant first).
A frame holds whole documents up to FRAME ids (at least one document). Blocks decode independently of each other;
the decoder runs through all blocks of a frame at once, one table lookup for each id place. Shards are ranges of doc_id
in ascending order, frames ascend within a shard.

The counts behind the codes cover all documents. What the driver gets is bounded: one count per vocabulary id, and one
token sum per shard.

Special tokens that stand in a text get their ids, as the library does when it is loaded as it is.

Defined results: null text is empty; an empty text has only the end id; rows with equal doc_id stand side by side, ordered by
their ids; null doc_id sorts first; other columns are not read; empty input gives empty tables.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_batches, new_path, stored

BLOCK = 256
FRAME = 1 << 18
MAX_BITS = 20
SHARD_BYTES = 64 << 20
KEPT_CHUNKS = 1_000_000
#: Text whose chunks are looked up together.
PART_BYTES = 8 << 20
#: Words of these letters are one piece in themselves, and composed already.
#: ASCII marks after them, but for the apostrophe, are pieces of their own.
WORD = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
PROBES = ("Word", "a", "Stra\u00dfe", "\u00c9t\u00e9", "Na\u00efve", "\u00d8RE", "\u00ffz", "Isn", "thTHth", "x" * 60, "word.", "a%%%", "\u00e9t\u00e9**!", "x-", "b]`")


class Words:
    """A tokenizer that never joins ids across blanks, with a bounded dict from blank-free chunk to ids.

    Right only for tokenizers that drop white space before they look for words; the tests hold it against
    encoding whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: two bytes an id where the vocabulary allows
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[bytes, bytes] = {}
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        # a tokenizer with another alphabet or other steps before its model takes the long way
        self.direct = True
        probes = [x.encode() for x in PROBES]
        plain = self._library(probes)
        self.direct = self.encode(pa.array(PROBES)) == [plain[c] for c in probes]
        self.known.clear()

    @staticmethod
    def of(path: str) -> Words:
        return kept((Words, path), lambda: Words(path))

    def _library(self, new: list[bytes]) -> dict[bytes, bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        stops = (np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * np.dtype(self.kind).itemsize).tolist()
        return {c: flat[a:b] for c, a, b in zip(new, [0, *stops], stops)}

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Lower-cased words of WORD: straight to the library's model, in its alphabet of bytes, where ASCII letters stand for themselves."""
        tokenize, letters, code = self.tokenizer.model.tokenize, self.letters, self.code
        spelt = [c.decode() if c.isascii() else c.decode("latin-1").translate(letters) for c in new]
        return {c: array(code, [t.id for t in tokenize(x)]).tobytes() for c, x in zip(new, spelt, strict=True)}

    def _looked_up(self, values: pa.Array, learn: Callable[[list[bytes]], dict[bytes, bytes]]) -> pa.Array:
        """Ids of each value, null of a null. The first KEPT_CHUNKS values a worker meets stay known, others for one call."""
        cut, known = values.dictionary_encode(), self.known
        keys = cut.dictionary.cast(pa.large_binary()).to_pylist()
        new = [k for k in keys if k not in known]
        own = learn(new) if new else {}
        known |= own
        ids = pa.array([known[k] for k in keys], pa.large_binary()).take(cut.indices)
        if len(known) > KEPT_CHUNKS:
            for k in own:
                del known[k]
        return ids

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text, packed as `kind`.

        Distinct chunks are cut into a word and the marks after it, and the word is lower-cased: both leave the ids as they are and
        make more chunks alike. All this is done on Arrow arrays; only distinct words, marks and other chunks become Python objects.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
        cut = lists.flatten().dictionary_encode()
        other, ids = cut.dictionary, None
        if self.direct:
            parts = pc.extract_regex(other, WORD)
            word, marks = pc.utf8_lower(pc.struct_field(parts, "word")), pc.struct_field(parts, "marks")
            ids = pc.binary_join_element_wise(self._looked_up(word, self._words), self._looked_up(marks, self._library), pa.scalar(b"", pa.large_binary()))
            other = pc.if_else(pc.is_null(parts), other, pa.scalar(None, pa.large_string()))
        rest = self._looked_up(other, self._library)
        ids = (rest if ids is None else pc.coalesce(ids, rest)).take(cut.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        at = lists.offsets.to_numpy()
        at = stops[at - at[0]].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[x:y]) for x, y in zip(at, at[1:], strict=False)]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed as the tokenizer's kind, end id last)."""
    kind = np.dtype(Words.of(tokenizer_path).kind)
    end = np.array([end_id], kind).tobytes()

    def make():
        words = Words.of(tokenizer_path)

        def step(b):
            ids = [x + end for x in words.encode(b.column(1))]
            return {"doc_id": b.column(0), "n_tokens": [len(x) // kind.itemsize for x in ids], "ids": ids}

        return step

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, n_tokens long, ids binary", part_bytes=PART_BYTES)


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """id, n: each task counts its ids in an array before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                c = np.bincount(np.frombuffer(x, kind))
                if len(c) > len(total):
                    total = np.pad(total, (0, len(c) - len(total)))
                total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits, by package-merge. One symbol alone gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    # each level: symbols and the packages of the level below, merged by weight; a package is a pair of neighbours
    levels = [(weights, np.arange(n))]
    for _ in range(max_bits - 1):
        below = levels[-1][0]
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        kind = np.concatenate([np.arange(n), np.full(len(pairs), -1)])
        at = np.argsort(merged, kind="stable")
        levels.append((merged[at], kind[at]))
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for _, kind in reversed(levels):
        chosen = kind[:take]
        symbols = chosen[chosen >= 0]
        bits[symbols] += 1
        take = 2 * int((chosen < 0).sum())
    out = np.zeros(n, np.int64)
    out[order] = bits
    return out


class Codebook:
    """Canonical codes and the decoding table, from ids and code lengths alone."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids)[order].astype(np.int64), np.asarray(bits)[order].astype(np.int64)
        self.width = int(self.bits.max()) if len(ids) else 1
        step = np.int64(1) << (self.width - self.bits)
        first = np.cumsum(step) - step  # codes aligned to the left, in canonical order
        self.codes = first >> (self.width - self.bits)
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.code_of, self.bits_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.bits_of[self.ids] = self.codes.astype(np.uint64), self.bits
        self.table_id = np.zeros(1 << self.width, np.uint32)
        self.table_bits = np.ones(1 << self.width, np.uint8)
        filled = int(step.sum()) if len(ids) else 0
        self.table_id[:filled] = np.repeat(self.ids, step)
        self.table_bits[:filled] = np.repeat(self.bits, step)

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the bits."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        room = np.zeros(total // 8 + 9, np.uint8)
        # a code lies in at most 8 bytes from the byte it starts in: width <= 56
        shifted = self.code_of[ids] << (np.uint64(64) - bits.astype(np.uint64) - (starts & 7).astype(np.uint64))
        bytes_ = shifted.astype(">u8").view(np.uint8).reshape(-1, 8)
        at = starts >> 3
        for k in range((self.width + 14) // 8):
            room += np.bincount(at + k, weights=bytes_[:, k], minlength=len(room))[: len(room)].astype(np.uint8)
        return starts[::block].astype(np.int64), room[: (total + 7) // 8].tobytes()

    def decode(self, points: np.ndarray, payload: bytes, n: int, block: int = BLOCK) -> np.ndarray:
        """All blocks side by side: at each of the places of a block one lookup for every block."""
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint64)
        # the 32 bits that start at each byte
        word = (data[:-7] << np.uint64(24)) | (data[1:-6] << np.uint64(16)) | (data[2:-5] << np.uint64(8)) | data[3:-4]
        at = np.asarray(points, np.int64).copy()
        out = np.zeros((len(at), block), np.uint32)
        mask = np.uint64((1 << self.width) - 1)
        for k in range(block):
            live = at if k == 0 or n % block == 0 or k < n % block else at[:-1]
            if not len(live):
                break
            seen = (word[np.minimum(live >> 3, len(word) - 1)] >> (np.uint64(32 - self.width) - (live & 7).astype(np.uint64))) & mask
            out[: len(live), k] = self.table_id[seen]
            live += self.table_bits[seen]
        return out.reshape(-1)[:n]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shards: int | None = None) -> str:
    """Write the layout above under path; gives the path."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer_path, end_id), "ids", compression="zstd")
    # at most one row per id of the vocabulary
    kind = Words.of(tokenizer_path).kind
    counts = id_counts(tokens, kind).orderBy("id").toPandas()
    bits = code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(counts["id"], bits, strict=True)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    made = (counts["id"].to_numpy(np.int64), bits)
    # enough shards that a task sorts about SHARD_BYTES
    size = int(counts["n"].sum()) * np.dtype(kind).itemsize
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, frame, width = Codebook(*made), 0, np.dtype(kind).itemsize
        doc_ids: list = []
        parts: list[bytes] = []
        size, before, shard = 0, 0, 0

        def flush():
            nonlocal doc_ids, parts, size, frame, before
            ids = np.frombuffer(b"".join(parts), kind)
            points, payload = book.encode(ids)
            row = [[shard], [frame], [before], [doc_ids], [[len(x) // width for x in parts]], [len(ids)], [points.tolist()], [payload]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["shard", "frame", "before", "doc_ids", "doc_tokens", "n_tokens", "points", "payload"])
            doc_ids, parts, size, frame, before = [], [], 0, frame + 1, before + len(ids)
            return out

        for b in batches:
            for s, d, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                shard = s
                if parts and size + len(x) // width > FRAME:
                    yield flush()
                doc_ids.append(d)
                parts.append(x)
                size += len(x) // width
        if parts:
            yield flush()

    (
        tokens.select("doc_id", "ids").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
        .mapInArrow(frames, "shard int, frame long, before long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, points array<long>, payload binary")
        .write.option("compression", "uncompressed").parquet(f"{path}/frames")
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, decoded from the files."""
    rows = spark.read.parquet(f"{path}/codebook").toPandas()
    made = (rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))
    frames = spark.read.parquet(f"{path}/frames")
    sums = {r[0]: r[1] for r in frames.groupBy("shard").agg(F.sum("n_tokens")).collect()}  # a row per shard
    base, total = {}, 0
    for s in sorted(sums):
        base[s], total = total, total + sums[s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = None
        for b in batches:
            for row in b.to_pylist():
                book = book or Codebook(*made)
                ids = book.decode(np.array(row["points"]), row["payload"], row["n_tokens"]).astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                whole = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["shard"]] + row["before"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([whole[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return frames.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what is read back from the files written."""
    spark = docs.sparkSession
    back = read(spark, write(docs, tokenizer_path, end_id, new_path(spark, "huffman")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

