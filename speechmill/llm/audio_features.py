"""Media columns: audio features of 8-bit samples.

Steps: a WAV column (8-bit unsigned mono, lossless for any byte string) is written as a Parquet table and read back;
each recording is resampled by a polyphase filter (up/down), cut into overlapped frames, turned into log-mel
filterbank rows, and segmented by frame energy with two thresholds (hysteresis). The log-mel rows are stored as
tensors of fixed shape TENSOR = (frames, bands) with the time span of each; the last one is padded with the floor.

Memory: one recording at a time, its samples as floats and all its log-mel rows; spectra are made block by block.

Defined results: null text is an empty text, whose payload is one unit of padding; other columns are not read; repeated rows give repeated rows; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, stored, texts

UNIT, PAD = 576, 255
RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
N_FFT, WINDOW, HOP, BANDS = 256, 200, 80, 40
TENSOR = (64, BANDS)
FLOOR = np.float32(np.log(1e-10))
#: Of the loudest smoothed frame: a segment must reach HIGH_DB and lasts while it stays over LOW_DB.
HIGH_DB, LOW_DB, SMOOTH = -4.0, -5.5, 5
BLOCK = 4096


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of UNIT; the unpadded size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + bytes([PAD]) * (size - len(raw)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, format 1, one channel, 8 bits."""
    pad = len(samples) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.lru_cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Hann-windowed sinc split into its `up` phases, (up, 2 * taps + 1) by input sample."""
    wide = max(up, down)
    half = taps * wide
    t = np.arange(-half, half + 1)
    h = np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1]
    h *= up / h.sum()
    rows = []
    for phase in range(up):
        own = h[phase::up]
        rows.append(own)
    width = max(map(len, rows))
    return np.array([np.pad(x, (0, width - len(x))) for x in rows], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: output n takes phase (n * down) mod up of the filter over the input around n * down / up."""
    if up == down or not len(x):
        return x.astype(np.float32)
    phases = low_pass(up, down, taps)
    half = taps * max(up, down)
    count = -(-len(x) * up // down)
    n = np.arange(count, dtype=np.int64) * down
    # h[k] meets x[(n + half - k) / up]; k = phase + up * m
    out = np.empty(count, np.float32)
    width = phases.shape[1]
    padded = np.pad(x.astype(np.float32), (width, width))
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for phase in range(up):
        mine = np.flatnonzero((n + half) % up == phase)
        first = (n[mine] + half) // up  # the newest input sample that the phase sees
        flipped = np.ascontiguousarray(phases[phase][::-1])
        for at in range(0, len(mine), 1 << 16):
            rows = first[at : at + (1 << 16)] - (width - 1) + width
            rows = np.clip(rows, 0, len(windows) - 1)
            step = rows[1] - rows[0] if len(rows) > 1 else 1
            block = windows[rows[0] : rows[-1] + 1 : step] if len(rows) and rows[-1] == rows[0] + step * (len(rows) - 1) and step > 0 else windows[rows]
            out[mine[at : at + (1 << 16)]] = block @ flipped
    return out


@functools.lru_cache
def mel_filters(n_fft: int, bands: int, rate: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (n_fft / 2 + 1, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def frame_count(size: int) -> int:
    return max(1, 1 + (size - WINDOW) // HOP) if size else 0


def log_mel(y: np.ndarray, rate: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of log-mel rows and of frame energies in dB; the frames overlap by WINDOW - HOP samples."""
    y = np.pad(y, (0, max(0, WINDOW - len(y))))
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    window, filters = np.hanning(WINDOW).astype(np.float32), mel_filters(N_FFT, BANDS, rate)
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * window, N_FFT)).astype(np.float32) ** 2
        yield np.log(np.maximum(power @ filters, 1e-10)).astype(np.float32), 10 * np.log10(np.maximum((part * part).mean(1), 1e-10))


def hysteresis(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Runs of frames at or above `low` that hold a frame at or above `high`, as half-open frame spans."""
    if not len(energy):
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, energy >= low, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    loud = np.r_[0, np.cumsum(energy >= high)]
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if loud[b] > loud[a]]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, *TENSOR), their time spans, and the spans of speech-like energy, in seconds."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x -= x.mean() if len(x) else 0
    y = resample(x)
    rate = rate * UP // DOWN
    rows, energies = zip(*log_mel(y, rate), strict=True)
    mel, energy = np.concatenate(rows), np.concatenate(energies)
    smooth = np.convolve(np.pad(energy, SMOOTH // 2, mode="edge"), np.full(SMOOTH, 1 / SMOOTH), "valid")
    count = -(-len(mel) // TENSOR[0])
    tensors = np.concatenate([mel, np.full((count * TENSOR[0] - len(mel), BANDS), FLOOR, np.float32)]).reshape(count, *TENSOR)
    time = lambda k: k * HOP / rate
    spans = [(time(k * TENSOR[0]), time(min(len(mel), (k + 1) * TENSOR[0]) - 1) + WINDOW / rate) for k in range(count)]
    peak = smooth.max()
    return tensors, spans, [(time(a), time(b - 1) + WINDOW / rate) for a, b in hysteresis(smooth - peak)]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the WAV of each whole text."""

    def make():
        def step(b):
            made = [payload(x) for x in texts(b)]
            return {"doc_id": b.column(0), "n_bytes": [n for _, n in made], "media": [to_wav(p) for p, _ in made]}

        return step

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, n_bytes long, media binary")


def tensor_rows(media: DataFrame) -> DataFrame:
    """A row per tensor: doc_id, part, start_s, end_s, tensor (TENSOR flattened, row-major). as_tensors() gives it its Arrow type."""

    def run(batches):
        for b in batches:
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tensors, spans, _ = features(m)
                n = len(tensors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([s for s, _ in spans]), pa.array([e for _, e in spans]),
                     pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (TENSOR[0] * TENSOR[1]), pa.array(tensors.ravel()))],
                    ["doc_id", "part", "start_s", "end_s", "tensor"],
                )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, part int, start_s double, end_s double, tensor array<float>")


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The tensor column of tensor_rows() as Arrow's fixed-shape tensor type."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = TENSOR[0] * TENSOR[1]
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), TENSOR), pa.FixedSizeListArray.from_arrays(flat.flatten(), size))


def segment_rows(media: DataFrame) -> DataFrame:
    """A row per energy segment: doc_id, segment, start_s, end_s."""

    def run(batches):
        for b in batches:
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = features(m)[2]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32()), pa.array([s for s, _ in spans], pa.float64()), pa.array([e for _, e in spans], pa.float64())], ["doc_id", "segment", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, segment int, start_s double, end_s double")


def summary(media: bytes) -> str:
    """Counts, spans and a digest of the tensors in hundredths, as text: equal media, equal text."""
    tensors, spans, speech = features(media)
    digest = hashlib.sha256(np.round(tensors * 100).astype("<i4").tobytes()).hexdigest()[:16]
    voiced = sum(e - s for s, e in speech)
    return f"tensors={len(tensors)}x{TENSOR[0]}x{TENSOR[1]};end={spans[-1][1]:.4f};segments={len(speech)};voiced={voiced:.4f};mean={tensors.mean(dtype=np.float64):.3f};logmel={digest}"


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, all taken from the media as read back."""
    back = stored(media_column(docs), "media", compression="zstd")

    def make():
        def step(b):
            media = b.column(2).to_pylist()
            data = [from_wav(m)[0] for m in media]
            return {
                "doc_id": b.column(0), "n_bytes": b.column(1), "payload_bytes": [len(x) for x in data], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in data],
                "tail_crc32": [zlib.crc32(x[-32:]) for x in data], "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": [summary(m) for m in media],
            }

        return step

    return map_batches(back.select("doc_id", "n_bytes", "media"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
