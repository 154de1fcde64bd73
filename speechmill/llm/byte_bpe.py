"""Byte-level BPE encoding and decoding by replaying merges over the words of a corpus.

Method: the documents of a task are taken in parts of about PART_BYTES of text, and each part is one corpus: its distinct
pieces are laid out as one row of symbols. An inverted index leads from each merge (the token a pair makes) to the positions
where the pair stands. A heap gives the merges by rank; each is applied to all its positions at once (by array operations where there are
many) and only the pairs with the two neighbours change. The ids of a part's pieces are then looked up for its documents, and nothing is kept from part to part: the
work for a GB and the memory of a task are the same however large the input is.

One corpus of the whole input would need either all distinct pieces in every task or a row per piece occurrence in a join; the
first has no bound and the second shuffles several times the input. The ids are the same, as a merge never reaches beyond its piece.

Defined results: null text is empty text; an empty text has no ids; repeated rows are encoded one by one; columns other than the id and the text are not read; a null id stays null; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, map_batches, texts

#: Text of one corpus, about; a longer document stands alone.
PART_BYTES = 8 << 20
#: Merges that are due at so many places or more are applied to all of them by array operations.
MANY = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Ranks(dict):
    """Token bytes to rank, with the ways back and the pairs that make each token; made once in a worker."""

    def __init__(self, path_or_ranks: str | dict[bytes, int]):
        super().__init__(path_or_ranks if isinstance(path_or_ranks, dict) else read_ranks(path_or_ranks))
        self.spell = {r: token for token, r in self.items()}
        self.step = max(self.spell) + 3
        self.pairs = {}
        for token, r in self.items():
            for k in range(1, len(token)):
                a, b = self.get(token[:k]), self.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.step + b] = r
        self.byte_rank = np.array([self.get(bytes([k]), -1) for k in range(256)], np.int64)
        first = [int(r) for r in self.byte_rank]
        #: What two bytes make, at 256 times the one and the other; -1 for nothing.
        self.byte_pairs = np.array([self.pairs.get(a * self.step + b, -1) if a >= 0 and b >= 0 else -1 for a in first for b in first], np.int32)
        spelt = [self.spell.get(r, b"") for r in range(max(self.spell) + 1)]
        self.spelt, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.spelt[places_of(self.spelt_at, self.spelt_size, ids)].tobytes()


def places_of(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the given segments, one segment after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after the other (unsigned 32-bit integers), and how many each piece has.

    All pieces stand in one row of symbols with a gap after each. `places` is the inverted index: merge to positions of its
    pair. Ties between equal pairs go to the left one. A piece in which a merge makes a pair of lower rank waits with its
    other positions until that pair is done; so each piece sees its merges in just the order it would see alone.
    """
    if not pieces:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    step, pair = ranks.step, ranks.pairs.get
    gap, gone = step - 2, step - 1
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1  # places of the gaps
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    row = ranks.byte_rank.astype(np.int32)[raw]
    row[ends] = gap
    # arrays of small integers: lists would hold an object for each
    symbols = array("i", row.tobytes())
    right = array("i", np.arange(1, len(row) + 1, dtype=np.int32).tobytes())
    left = array("i", np.arange(-1, len(row) - 1, dtype=np.int32).tobytes())

    # merges of two single bytes, by rank and position
    made = np.append(ranks.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]], np.int32(-1))
    made[ends] = made[ends[ends > 0] - 1] = -1
    del row, raw
    at = np.flatnonzero(made >= 0)
    at = at[np.argsort(made[at], kind="stable")]
    merges, first = np.unique(made[at], return_index=True)
    # the index of the start is a slice of `at` until its merge is due; `places` has what is added meanwhile
    start = dict(zip(merges.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(at)]), strict=True))
    places: dict[int, list[int]] = {r: [] for r in start}
    heap = merges.tolist()
    # the merge of the pair that begins at each position, -1 for none: tells which entries of the index still hold
    due = array("i", made.tobytes())
    del made

    def wait(merge: int, i: int) -> None:
        found = places.get(merge)
        if found is None:
            heapq.heappush(heap, merge)
            places[merge] = [i]
        else:
            found.append(i)

    symbols_of, right_of, left_of, due_of = (np.frombuffer(x, np.int32) for x in (symbols, right, left, due))  # views of the same memory

    def made_by(keys: np.ndarray) -> np.ndarray:
        different, back = np.unique(keys, return_inverse=True)
        return np.fromiter((pair(k, -1) for k in different.tolist()), np.int64, len(different))[back]

    def all_at_once(r: int, here: np.ndarray) -> bool:
        """The merge at all its places, from left to right in effect; False, and nothing done, where places overlap or a pair of lower rank comes up on the way."""
        here = here[due_of[here] == r]
        j = right_of[here]
        after = right_of[j].astype(np.int64)
        if np.intersect1d(j, here, assume_unique=True).size:
            return False
        before = left_of[here]
        joined = np.isin(before, j)  # the place before is merged too: by then it is r
        old = np.where(joined, r, symbols_of[before])
        on_left = np.where(before >= 0, made_by(old.astype(np.int64) * step + r), -1)
        on_right = made_by(r * step + symbols_of[after].astype(np.int64))
        if ((on_right >= 0) & (on_right < r)).any() or ((on_left >= 0) & (on_left < r)).any():
            return False
        symbols_of[here], symbols_of[j], due_of[j] = r, gone, -1
        right_of[here] = after
        left_of[after] = here
        due_of[here] = on_right = made_by(r * step + symbols_of[after].astype(np.int64))
        alone = (before >= 0) & ~joined
        due_of[before[alone]] = on_left[alone]
        merge, where = np.r_[on_right, on_left[alone]], np.r_[here, before[alone]]
        merge, where = merge[merge >= 0], where[merge >= 0]
        by = np.argsort(merge, kind="stable")
        merge, where = merge[by], where[by]
        for own in np.split(np.arange(len(merge)), np.flatnonzero(np.diff(merge)) + 1) if len(merge) else []:
            s, found = int(merge[own[0]]), where[own].tolist()
            if s in places:
                places[s] += found
            else:
                heapq.heappush(heap, s)
                places[s] = found
        return True

    while heap:
        r = heapq.heappop(heap)
        here = places.pop(r)
        if r in start:
            a, b = start.pop(r)
            if b - a + len(here) >= MANY:
                if all_at_once(r, np.unique(np.r_[at[a:b], np.array(here, np.int64)])):
                    continue
            here += at[a:b].tolist()
        elif len(here) >= MANY and all_at_once(r, np.unique(np.array(here, np.int64))):
            continue
        here.sort()
        waiting, later, r_step = set(), [], r * step
        for i in here:
            if due[i] != r:
                continue  # one of the two has been merged meanwhile
            if waiting and bisect.bisect_left(ends, i) in waiting:
                later.append(i)
                continue
            j = right[i]
            after, before = right[j], left[i]
            symbols[i], symbols[j], due[j] = r, gone, -1
            right[i] = after
            left[after] = i
            due[i] = s = pair(r_step + symbols[after], -1)
            if s >= 0:
                wait(s, i)
                if s < r:
                    waiting.add(bisect.bisect_left(ends, i))
            if before >= 0:
                due[before] = s = pair(symbols[before] * step + r, -1)
                if s >= 0:
                    wait(s, before)
                    if s < r:
                        waiting.add(bisect.bisect_left(ends, i))
        for i in later:
            wait(r, i)

    row = np.frombuffer(symbols, np.int32)
    return row[row < gap].astype("<u4"), np.add.reduceat((row < gap).astype(np.int64), np.r_[0, ends[:-1] + 1])


class Encoder:
    """Texts to ids by replay.

    A chunk is what lies between two places where a space stands before a non-blank: the pattern always cuts there
    (a space followed by a non-blank begins a piece), so the pieces of the chunks are the pieces of the text.
    """

    CUT = re.compile(r"(?= \S)")
    ODD = re.compile(r" (?:\s|$)")

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        self.pieces = regex.compile(pattern).findall

    @staticmethod
    def of(path: str, pattern: str) -> Encoder:
        return kept((Encoder, path, pattern), lambda: Encoder(path, pattern))

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.ODD.search(text):
            return [x for x in self.CUT.split(text) if x]
        first, *rest = text.split(" ")
        out = [f" {x}" for x in rest]
        if first:
            out.insert(0, first)
        return out

    def learn(self, chunks: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has. A piece that is a whole chunk is the same string, kept once."""
        pieces: dict[str, int] = {}
        of_chunk, n_pieces = array("i"), array("i")
        for c in chunks:
            cut = self.pieces(c)
            if len(cut) == 1 and len(cut[0]) == len(c):
                cut[0] = c
            n_pieces.append(len(cut))
            for p in cut:
                of_chunk.append(pieces.setdefault(p, len(pieces)))
        ids, sizes = replay([p.encode("utf-8", "surrogatepass") for p in pieces], self.ranks)
        which = np.frombuffer(of_chunk, np.int32) if of_chunk else np.zeros(0, np.int32)
        ends = np.cumsum(np.frombuffer(n_pieces, np.int32)) if n_pieces else np.zeros(0, np.int64)
        upto = np.r_[0, np.cumsum(sizes[which])][np.r_[0, ends]]
        return ids[places_of(np.cumsum(sizes) - sizes, sizes, which)], np.diff(upto)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the texts are one corpus."""
        known: dict[str, int] = {}
        places = [array("i", [known.setdefault(c, len(known)) for c in self.chunks(x)]) for x in batch]
        ids, sizes = self.learn(known)
        starts = np.cumsum(sizes) - sizes
        return [ids[places_of(starts, sizes, np.frombuffer(x, np.int32))].tobytes() if x else b"" for x in places]

    def decode(self, ids: bytes) -> bytes:
        return self.ranks.bytes_of(np.frombuffer(ids, "<u4")) if ids else b""


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids binary (little-endian unsigned 32-bit). One narrow step: no shuffle."""

    def make():
        encoder = Encoder.of(ranks_path, pattern)
        return lambda b: {"id": b.column(0), "ids": encoder.encode(texts(b, "text"))}

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), make, "id long, ids binary", part_bytes=PART_BYTES).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids, decoded binary: the bytes the ids stand for."""

    def make():
        encoder = Encoder.of(ranks_path, pattern)
        return lambda b: {"id": b.column(0), "ids": b.column(1), "decoded": [encoder.decode(x) for x in b.column(1).to_pylist()]}

    return map_batches(encoded.select(encoded[id_col].alias("id"), "ids"), make, "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode() and then decode(), in one step over each batch."""

    def make():
        encoder = Encoder.of(ranks_path, pattern)

        def step(b):
            ids = encoder.encode(texts(b))
            return {
                "doc_id": b.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids],
            }

        return step

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", part_bytes=PART_BYTES)
