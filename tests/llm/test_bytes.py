"""op6, op7, op10 against plain versions that use the libraries whole-text."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from speechmill.llm import audio_features as A
from speechmill.llm import byte_bpe as B
from speechmill.llm import huffman_ids as H

TEXTS = [
    "", None, " ", "  ", "a", "Hello, world!  Two  spaces\n\n new\tline ", "naïve café — “quotes” don't 123 4567", " x　y   z", "日本語 テキスト हिन्दी",
    "a  b   c\n d \n  e", "x" * 3000, "word " * 2000, "İSTANBUL ΟΔΟΣ é ́", "<|endoftext|> <|startoftext|>", "a<|endoftext|>b word<|startoftext|> x <|ENDOFTEXT|>", "\x1c\x1d a\x85b\x0b c", "Hello, world!  Two  spaces\n\n new\tline ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 5 % 19, t, "en", "ids-clash", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_tokens int, id int")


def whole():
    return [(i * 5 % 19, t or "") for i, t in enumerate(TEXTS)] + [(None, "no id here")]


def test_byte_bpe_equals_library(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, len(x := enc.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in whole() if d is not None)
    got = sorted(tuple(r) for r in B.digests(docs, path, P.PATTERN).collect() if r.doc_id is not None)
    assert got == want
    back = B.decode(B.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(t for _, t in whole())


def _replayed(pieces, ranks):
    ids, sizes = B.replay(pieces, B.Ranks(ranks))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("many", [1, 5, 1 << 30])
def test_replay_order_with_lower_ranks_made_late(monkeypatch, many):
    monkeypatch.setattr(B, "MANY", many)
    # "bc" merges first and makes "abc", whose rank is lower than that of the next "bc"
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"abcbc": 5}

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(1)
    pieces = [bytes(rng.choice(list(b"abc"), rng.integers(1, 30)).tolist()) for _ in range(300)]
    assert _replayed(pieces, ranks) == [plain(p) for p in pieces]


@pytest.mark.parametrize("many", [1, 5, 1 << 30])
def test_replay_of_random_ranks(monkeypatch, many):
    """Merges at many places go by array operations, others one by one: tables in which pairs of lower rank come up late, and runs of one letter."""
    monkeypatch.setattr(B, "MANY", many)
    rng = np.random.default_rng(many)
    for _ in range(30):
        made = list({bytes(rng.choice(list(b"abc"), rng.integers(2, 6)).tolist()) for _ in range(rng.integers(3, 25))})
        ranks = {bytes([k]): k for k in range(256)} | {t: 256 + k for k, t in enumerate(made)}
        pieces = list({bytes(rng.choice(list(b"abc"), rng.integers(1, 14)).tolist()) for _ in range(120)})

        def plain(piece, ranks=ranks):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            return [ranks[p] for p in parts]

        assert _replayed(pieces, ranks) == [plain(p) for p in pieces]


def test_parts_of_any_size_give_the_same_ids():
    e = B.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [t or "" for t in TEXTS]
    assert e.encode(texts) == [e.encode([t])[0] for t in texts]
    assert [e.decode(x).decode() for x in e.encode(texts)] == texts


def test_byte_bpe_real_rows(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(path), special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: enc.encode_ordinary(r.text or "") for r in docs.collect()}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in B.encode(docs, path, P.PATTERN).collect()}
    assert got == want


def test_huffman_files_hold_the_ids(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(d, np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in whole()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for d, ids in rows:
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = sorted((tuple(r) for r in H.digests(docs, path, 2).collect()), key=lambda r: r[1])
    assert got == want


def test_huffman_real_rows(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in H.digests(docs, path, 2).collect()) == want


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_codebook_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(max=40000)
    known, counts = np.unique(ids, return_counts=True)
    bits = H.code_lengths(counts, 16)
    assert bits.max() <= 16 and (0.5**bits).sum() <= 1
    book = H.Codebook(known, bits)
    points, payload = book.encode(ids)
    assert (book.decode(points, payload, n) == ids).all()


def test_code_lengths_are_optimal_without_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    depth = [0] * len(counts)
    heapq.heapify(heap)
    k = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] += 1
        heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
        k += 1
    assert (H.code_lengths(counts, 20) * counts).sum() == (np.array(depth) * counts).sum()
    assert H.code_lengths(counts, 4).max() <= 4


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert H.digests(none, P.path("word_bpe_49k.json"), 2).count() == 0
    assert B.digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert A.digests(none).count() == 0


def test_audio_contract(spark, docs):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32): r for r in A.digests(docs).collect()}
    for d, t in whole():
        raw = t.encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[(d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))]
        assert r.media_bytes == len(pay) + 44 and r.media_sha256 == hashlib.sha256(A.to_wav(pay)).hexdigest()
    assert len({r.feature for r in got.values() if r.n_bytes == len(TEXTS[5].encode())}) == 1


def test_audio_kernels():
    x = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y = A.resample(x, up, down)
        t = np.arange(len(y)) * down / up
        assert np.abs(y - np.sin(t * 2 * np.pi * 440 / 16000))[200:-200].max() < 0.02
    high = A.resample(np.sin(np.arange(16000) * 2 * np.pi * 7000 / 16000), 1, 2)
    assert np.abs(high)[200:-200].max() < 0.02  # over the new half rate: gone
    assert A.hysteresis(np.array([0, -5, -9, -5, 0, -9, -5, -5, -9.0]), -3, -6) == [(0, 2), (3, 5)]
    tone = ((np.r_[np.zeros(8000), np.sin(np.arange(8000) * 0.5), np.zeros(8000)] * 100) + 128).astype(np.uint8).tobytes()
    tensors, spans, speech = A.features(A.to_wav(tone))
    assert tensors.shape[1:] == A.TENSOR and len(spans) == len(tensors) and len(speech) == 1
    assert abs(speech[0][0] - 0.5) < 0.05 and abs(speech[0][1] - 1.0) < 0.05
    assert A.from_wav(A.to_wav(b"abc")) == (b"abc", 16000)


def test_tensor_rows(spark, docs):
    rows = A.tensor_rows(A.media_column(docs)).toArrow()
    made = A.as_tensors(rows["tensor"])
    assert made.to_numpy_ndarray().shape == (rows.num_rows, *A.TENSOR)
    assert A.segment_rows(A.media_column(docs)).count() >= 1
