"""N-grams in compressed blocks: a shuffle moves a row for each bucket and stretch of text, not one for each n-gram. Numpy inside tasks; Spark deals the blocks out by bucket.

A block lists distinct sequences of words, as indexes into its own words, with whole numbers for each. Sequences of two words and more are dealt by their first
two words, so that all longer ones that begin alike are in one bucket and no single frequent word fills one; words alone are dealt by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many words of text are counted together before they become blocks.
CHUNK = 1_500_000
#: Rows of a batch that goes back to Spark.
ROWS = 100_000
SCHEMA = "bucket int, kind int, n long, words binary, ids binary"
BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])
WORDS, GRAMS = 0, 1


def give_back() -> None:
    """Free memory that a worker's allocators hold goes back to the system: workers outlive their tasks, beside whatever runs next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays by the places of their bytes, which compress better than whole numbers."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(n), at + n * wide


def encoded(known: pa.Array, ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Sequences (ids: a column for each place, 0 where there is no word, else 1 + the index in known) and their values."""
    place = np.zeros(len(known) + 1, np.uint32)
    for x in ids:
        place[x] = 1
    place[0] = 0
    used = np.flatnonzero(place)
    place[used] = np.arange(1, len(used) + 1)
    words = known.take(pa.array(used - 1))
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    text = words.buffers()[2]
    text = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]] if text else np.zeros(0, np.uint8)
    return _squeezed(np.diff(offsets).astype("<u4"), text), _squeezed(*(place[x].astype("<u4") for x in ids), *(x.astype("<i8") for x in values))


def decoded(n: int, words: bytes, ids: bytes, width: int) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    raw = _raw(ids)
    at, out, values = 0, [], []
    for _ in range(width):
        x, at = _planes(raw, at, n, "<u4")
        out.append(x.astype(np.int32))
    while at < len(raw):
        x, at = _planes(raw, at, n, "<i8")
        values.append(x)
    n_words = int(max(int(x.max(initial=0)) for x in out))
    raw = _raw(words)
    sizes, at = _planes(raw, 0, n_words, "<u4")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(n_words, pa.py_buffer(offsets), pa.py_buffer(raw[at:])), out, values


def hashes(known: pa.Array) -> np.ndarray:
    """crc32 of each word; 0 in front for no word."""
    return np.fromiter((0, *map(zlib.crc32, known.cast(pa.binary()).to_pylist())), np.int64, len(known) + 1)


def dealt(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of sequences by the hashes of two of their words."""
    return (first * 31 + second) % buckets


class Trie:
    """Distinct sequences by levels: parent (index in the level before) and word of each node, in order; count is the sum of what stands below. Word 0: nothing follows."""

    def __init__(self, ids: list[np.ndarray], counts: np.ndarray, width: int):
        self.width, self.parents, self.words = width, [], []
        at = np.zeros(len(counts), np.int64)
        for x in ids:
            at *= width
            at += x
            codes, at = np.unique(at, return_inverse=True)
            self.parents.append((codes // width).astype(np.int32))
            self.words.append((codes % width).astype(np.int32))
        self.counts = [np.bincount(at, weights=counts, minlength=len(codes)).astype(np.int64)]
        for k in range(len(ids) - 1, 0, -1):
            self.counts.insert(0, self.below(k, self.counts[0]))

    def below(self, k: int, values: np.ndarray) -> np.ndarray:
        """Values of the nodes of level k, summed by their parents."""
        return np.bincount(self.parents[k], weights=values, minlength=len(self.words[k - 1])).astype(np.int64)

    def after(self, k: int) -> np.ndarray:
        """How often the nodes of level k - 1 are followed by a word."""
        return self.below(k, self.counts[k] * (self.words[k] > 0))

    def kinds(self, k: int) -> np.ndarray:
        """By how many different words they are followed."""
        return self.below(k, self.words[k] > 0)

    def found(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """For each level the node of each of the given sequences; -1 where there is none."""
        out, at = [], np.zeros(len(ids[0]), np.int64)
        for parents, words, x in zip(self.parents, self.words, ids, strict=False):
            codes, code = parents.astype(np.int64) * self.width + words, at * self.width + x
            place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            good = (at >= 0) & (x > 0) & (codes[place] == code if len(codes) else False)
            at = np.where(good, place, -1)
            out.append(at)
        return out

    def columns(self) -> list[np.ndarray]:
        """The words of the deepest nodes."""
        out, at = [], np.arange(len(self.words[-1]))
        for k in range(len(self.words) - 1, -1, -1):
            out.insert(0, self.words[k][at])
            at = self.parents[k][at]
        return out


def merged(rows: pa.Table, kind: int, width: int) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The blocks of one kind with all their words together: words, ids and values, not yet summed."""
    parts = [decoded(r["n"], r["words"], r["ids"], width) for r in rows.filter(pc.equal(rows["kind"], kind)).to_pylist()]
    if not parts:
        return pa.array([], pa.string()), [np.zeros(0, np.int32)] * width, []
    every = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    place, begin, ids = every.indices.to_numpy() + 1, 0, []
    for own, x, _ in parts:
        here = np.concatenate([np.zeros(1, np.int32), place[begin : begin + len(own)]])
        ids.append([here[c] for c in x])
        begin += len(own)
    join = lambda columns: [np.concatenate(c) for c in zip(*columns, strict=True)]
    return every.dictionary, join(ids), join(p[2] for p in parts)


def word_blocks(known: pa.Array, ids: np.ndarray, values: list[np.ndarray], crc: np.ndarray, buckets: int) -> Iterator[dict]:
    """Words (ids of known, from 1) with their values, a block for each bucket."""
    bucket = crc[ids] % buckets
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = np.sort(by[cuts[b] : cuts[b + 1]])
        words, data = encoded(known, [ids[own]], [v[own] for v in values])
        yield {"bucket": int(b), "kind": WORDS, "n": len(own), "words": words, "ids": data}


def gram_blocks(known: pa.Array, trie: Trie, crc: np.ndarray, buckets: int) -> Iterator[dict]:
    columns, counts = trie.columns(), trie.counts[-1]
    bucket = dealt(crc[columns[0]], crc[columns[1]], buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = by[cuts[b] : cuts[b + 1]]
        words, data = encoded(known, [c[own] for c in columns], [counts[own]])
        yield {"bucket": int(b), "kind": GRAMS, "n": len(own), "words": words, "ids": data}


def chunk_blocks(tokens: list[pa.Array], order: int, buckets: int) -> Iterator[dict]:
    """The blocks of some lists of words."""
    flat = pa.concat_arrays([x.flatten() for x in tokens]).dictionary_encode()
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in tokens]).astype(np.int64)
    n = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
    by = np.argsort(-n, kind="stable")  # frequent words get small indexes
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(1, len(by) + 1)
    known, ids = flat.dictionary.take(pa.array(by)), rank[flat.indices.to_numpy()]
    crc, width = hashes(known), len(known) + 1
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def after(k: int) -> np.ndarray:
        """The word k places on in the same list; 0 where there is none."""
        out = np.zeros_like(ids)
        n = max(0, len(ids) - k)
        out[:n] = np.where(owner[:n] == owner[len(ids) - n :], ids[len(ids) - n :], 0)
        return out

    inner = after(1) > 0
    yield from word_blocks(known, np.arange(1, width), [n[by], np.bincount(ids[inner], minlength=width)[1:]], crc, buckets)
    columns = [after(k)[inner] for k in range(order)]
    del flat, owner, ids, inner
    if len(columns[0]):
        yield from gram_blocks(known, Trie(columns, np.ones(len(columns[0]), np.int8), width), crc, buckets)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """A few blocks at a time."""
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if sum(len(x["words"]) + len(x["ids"]) for x in held[-64:]) > 4 << 20 or len(held) == 64:
            yield pa.RecordBatch.from_pylist(held, BLOCK)
            held = []
    yield pa.RecordBatch.from_pylist(held, BLOCK)


def blocks_of(order: int, buckets: int):
    """For mapInArrow over rows(tokens)."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            tokens = b.column(0)
            at = 0
            while at < len(tokens):
                # as many lists as fit; one list alone may be longer
                sizes = np.cumsum(tokens.slice(at).value_lengths().to_numpy())
                take = max(1, int(np.searchsorted(sizes, CHUNK - n, "right"))) if not n else int(np.searchsorted(sizes, CHUNK - n, "right"))
                held.append(tokens.slice(at, take))
                n, at = n + (int(sizes[take - 1]) if take else 0), at + take
                if at < len(tokens):
                    yield from _batches(chunk_blocks(held, order, buckets))
                    held, n = [], 0
        if n:
            yield from _batches(chunk_blocks(held, order, buckets))
        held = b = tokens = None
        give_back()

    return run


def in_pieces(schema: pa.Schema, n: int, columns) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each; columns(places) makes those of some places."""
    for at in range(0, n, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns(np.arange(at, min(n, at + ROWS))), schema, strict=True)], schema=schema)


GRAM_ROWS = pa.schema([("n", pa.int32()), ("ctx", pa.string()), ("word", pa.string()), ("cnt", pa.int64())])
TOTAL_ROWS = pa.schema([("n", pa.int32()), ("ctx", pa.string()), ("total", pa.int64()), ("kinds", pa.int64())])


def _texts(known: pa.Array, trie: Trie) -> list[pa.Array]:
    """The words of the nodes of each level but the last, joined by blanks; those that nothing follows have no text."""
    every = pa.concat_arrays([pa.array([None], pa.string()), known])
    out = [every.take(pa.array(trie.words[0]))]
    for k in range(1, len(trie.words) - 1):
        out.append(pc.binary_join_element_wise(out[-1].take(pa.array(trie.parents[k])), every.take(pa.array(trie.words[k])), " "))
    return out


def word_sums(rows: pa.Table, n_values: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The words of a bucket and their summed values."""
    known, (ids,), values = merged(rows, WORDS, 1)
    values = values or [np.zeros(0)] * n_values
    return known, [np.bincount(ids, weights=v, minlength=len(known) + 1)[1:].astype(np.int64) for v in values]


def trie_of(rows: pa.Table, order: int) -> tuple[pa.Array, Trie]:
    known, ids, values = merged(rows, GRAMS, order)
    return known, Trie(ids, values[0] if values else np.zeros(0), len(known) + 1)


def gram_counts(order: int):
    """For applyInArrow: n, ctx, word, cnt of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        known, (cnt, _) = word_sums(rows, 2)
        yield from in_pieces(GRAM_ROWS, len(known), lambda at: [np.full(len(at), 1, np.int32), pa.array([""] * len(at), pa.string()), known.take(pa.array(at)), cnt[at]])
        known, trie = trie_of(rows, order)
        texts = _texts(known, trie)
        for k in range(1, order):
            nodes, parents, words, counts, ctx = np.flatnonzero(trie.words[k]), trie.parents[k], trie.words[k], trie.counts[k], texts[k - 1]
            row = lambda at: [np.full(len(at), k + 1, np.int32), ctx.take(pa.array(parents[at])), known.take(pa.array(words[at] - 1)), counts[at]]  # noqa: B023, E731
            yield from in_pieces(GRAM_ROWS, len(nodes), lambda at: row(nodes[at]))  # noqa: B023
        give_back()

    return run


def context_sums(order: int):
    """For applyInArrow: n, ctx, total, kinds of a bucket; those of n up to 2 are sums of this bucket alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        known, (cnt, _) = word_sums(rows, 2)
        yield from in_pieces(TOTAL_ROWS, min(1, len(cnt)), lambda at: [[1], [""], [int(cnt.sum())], [len(cnt)]])
        known, trie = trie_of(rows, order)
        texts = _texts(known, trie)
        for k in range(1, order):
            total, kinds, ctx = trie.after(k), trie.kinds(k), texts[k - 1]
            nodes = np.flatnonzero(kinds)
            row = lambda at: [np.full(len(at), k + 1, np.int32), ctx.take(pa.array(at)), total[at], kinds[at]]  # noqa: B023, E731
            yield from in_pieces(TOTAL_ROWS, len(nodes), lambda at: row(nodes[at]))  # noqa: B023
        give_back()

    return run


ROWS_SCHEMA, PASS_SCHEMA = "bucket int, data binary", SCHEMA + ", data binary"
ROW, PASS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())]), BLOCK.append(pa.field("data", pa.binary()))
#: Kinds of rows of a pass besides WORDS: pairs with how many words go before them, words with what stands around them, a number of pairs, and asked rows with less than
#: or as many words as the order.
PAIRS, STATS, COUNT, SHORT, LONG = 2, 3, 4, 5, 6
#: The column of asked rows with their words, and the places of those by which they are dealt.
ASKED = "lm_words"
FIRST, LAST_PAIR, LAST, BEFORE_LAST = (0, 1), (-2, -1), (-1,), (-2,)


def _bytes_of(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _ids_at(words: pa.Array, known: pa.Array, places: tuple[int, ...]) -> list[np.ndarray]:
    """The words of each list at some places (from its end, where negative) as 1 + the index in known; 0 for others and where there is no such place."""
    flat = pc.fill_null(pc.index_in(words.flatten(), value_set=known, skip_nulls=True), -1).to_numpy(zero_copy_only=False) + 1
    sizes = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins, flat = np.cumsum(sizes) - sizes, np.append(flat, 0)
    at = [np.where(sizes >= (k + 1 if k >= 0 else -k), begins + (k if k >= 0 else sizes + k), len(flat) - 1) for k in places]
    return [flat[x].astype(np.int64) for x in at]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _dealt_rows(rows: pa.Table, places: tuple[int, ...], buckets: int) -> Iterator[dict]:
    words = _whole(rows[ASKED])
    known = words.flatten().unique().drop_null()
    crc, ids = hashes(known), _ids_at(words, known, places)
    own = dealt(crc[ids[0]], crc[ids[1]], buckets) if len(ids) > 1 else crc[ids[0]] % buckets
    bucket = np.where(np.all([x > 0 for x in ids], axis=0), own, np.arange(len(own)) % buckets)  # those without such words go to any
    by = np.argsort(bucket, kind="stable")
    cuts, rows = np.searchsorted(bucket[by], np.arange(buckets + 1)), rows.take(pa.array(by))
    for b in np.flatnonzero(np.diff(cuts)):
        yield {"bucket": int(b), "data": _bytes_of(rows.slice(cuts[b], cuts[b + 1] - cuts[b]))}


def dealt_rows(places: tuple[int, ...], buckets: int, packed: bool):
    """For mapInArrow: rows, as they are or packed in a column data, as packed rows by the bucket of their words at some places."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for t in map(_rows_of, b.column(0).to_pylist()) if packed else [pa.Table.from_batches([b])]:
                held.append(t)
                n += t.num_rows
                if n >= CHUNK // 3:
                    yield from (pa.RecordBatch.from_pylist([r], ROW) for r in _dealt_rows(pa.concat_tables(held), places, buckets))
                    held, n = [], 0
        if n:
            yield from (pa.RecordBatch.from_pylist([r], ROW) for r in _dealt_rows(pa.concat_tables(held), places, buckets))
        held = None
        give_back()

    return run


def unpacked(names: list[str]):
    """For mapInArrow: packed rows as rows again."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield from _rows_of(data).select(names).to_batches(max_chunksize=ROWS)

    return run


def words_of_blocks(names: list[str]):
    """For mapInArrow over blocks of words that are summed: word and its values."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                known, _, values = decoded(r["n"], r["words"], r["ids"], 1)
                yield pa.RecordBatch.from_arrays([known, *map(pa.array, values)], names=["word", *names])

    return run


def _picked(levels: list[np.ndarray], each: list[np.ndarray | None], at: np.ndarray) -> pa.Array:
    """each[k] at the nodes of level k where at is k; null for no node, other levels and 0."""
    out = np.zeros(len(at), np.int64)
    for k, (node, values) in enumerate(zip(levels, each, strict=False)):
        own = (at == k) & (node >= 0)
        if values is not None and own.any():
            out[own] = values[node[own]]
    return pa.array(out, pa.int64(), mask=out == 0)


def _around(known: pa.Array, trie: Trie, buckets: int) -> Iterator[dict]:
    """Of a bucket of sequences of three words: STATS of words (different words before and after it, different pairs of a word before it and one after it), PAIRS of a
    second and third word with how many different words go before them, and the number of different pairs."""
    width, crc = len(known) + 1, hashes(known)
    sums = lambda ids, weights=None: np.bincount(ids, weights=weights, minlength=width)[1:].astype(np.int64)
    values = [sums(trie.words[1]), sums(trie.words[0][trie.parents[1]]), sums(trie.words[1], trie.kinds(2))]
    yield {"kind": COUNT, "n": len(trie.words[1])}
    yield from ({**r, "kind": STATS} for r in word_blocks(known, np.arange(1, width), values, crc, buckets))
    after = np.flatnonzero(trie.words[2])
    if len(after):
        pairs = Trie([trie.words[1][trie.parents[2][after]], trie.words[2][after]], np.ones(len(after), np.int8), width)
        yield from ({**r, "kind": PAIRS} for r in gram_blocks(known, pairs, crc, buckets))


def passed(order: int, buckets: int, around: bool):
    """For a cogroup of packed asked rows and blocks: asked rows with cnt of their words and total and kinds of all but the last of these, from two words on (null where
    unseen); blocks of words, summed; and what stands around words and pairs, if asked for."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        known, values = word_sums(rows, 2)
        words, ids = encoded(known, [np.arange(1, len(known) + 1)], values)
        out = [{"kind": WORDS, "n": len(known), "words": words, "ids": ids}] if len(known) else []
        known, trie = trie_of(rows, order)
        if around and len(known):
            out += _around(known, trie, buckets)
        after, kinds = ([None, *(f(k) for k in range(2, order))] for f in (trie.after, trie.kinds))
        for t in map(_rows_of, asked["data"].to_pylist()):
            sequence = _whole(t[ASKED])
            size = pc.fill_null(sequence.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            levels = trie.found(_ids_at(sequence, known, tuple(range(order))))
            # with an unknown last word the words before it still count: level size - 2 has them
            t = t.append_column("cnt", _picked(levels, [None, *trie.counts[1:]], size - 1)).append_column("total", _picked(levels, after, size - 2)).append_column("kinds", _picked(levels, kinds, size - 2))
            for kind, own in ((SHORT, size < 3), (LONG, size >= 3)):
                if own.any():
                    out.append({"kind": kind, "n": int(own.sum()), "data": _bytes_of(t.filter(pa.array(own)))})
        give_back()
        return pa.Table.from_batches([pa.RecordBatch.from_pylist([r], PASS) for r in out], PASS)

    return run


def with_words(place: int, names: dict[str, int]):
    """For a cogroup of packed asked rows and STATS: the rows with values (by their places in STATS) of the word at a place from the end; null for 0."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        known, ids, values = merged(rows, STATS, 1)
        sums = [np.bincount(ids[0], weights=v, minlength=len(known) + 1).astype(np.int64) for v in values] or [np.zeros(1, np.int64)] * 3
        out = []
        for t in map(_rows_of, asked["data"].to_pylist()):
            (at,) = _ids_at(_whole(t[ASKED]), known, (place,))
            for name, k in names.items():
                t = t.append_column(name, pa.array(x := sums[k][at], pa.int64(), mask=x == 0))
            out.append(_bytes_of(t))
        give_back()
        return pa.table([pa.array([None] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=ROW)

    return run


def with_pairs(name: str):
    """For a cogroup of packed asked rows and PAIRS: the rows with the value of their last two words."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        known, ids, values = merged(rows, PAIRS, 2)
        trie, out = Trie(ids, values[0] if values else np.zeros(0), len(known) + 1), []
        for t in map(_rows_of, asked["data"].to_pylist()):
            levels = trie.found(_ids_at(_whole(t[ASKED]), known, LAST_PAIR))
            out.append(_bytes_of(t.append_column(name, _picked(levels, [None, trie.counts[1]], np.ones(t.num_rows, np.int8)))))
        give_back()
        return pa.table([pa.array([None] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=ROW)

    return run
