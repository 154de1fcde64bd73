"""WAV files as rows (name, rate, x array<double>), and back.

Files are read by Spark's binaryFile source, so any path that Spark reads will do. They are written as rows of a Parquet
table (name, content) by Spark's own writer; `export_wav` puts such rows into a folder that executors see as local files.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators.spectral import resample

#: Peak that each consumer of a signal wants: language identification, detection and speaker embedding; the others take it as it is.
PEAKS = {"lid": 0.9, "spoof": 1.0, "speaker": 1.0, "stt": None, "prosody": None, "metrics": None}
ROWS = "name string, rate int, x array<double>"


def encoded(x: np.ndarray, rate: int, kind: str) -> bytes:
    """One channel as WAV: kind pcm16 (held within 1, rounded) or float (32 bits, as it is)."""
    if kind == "pcm16":
        held = np.clip(np.nan_to_num(x), -1, 1) * 32767
        body, form, bits = (np.sign(held) * np.floor(np.abs(held) + 0.5)).astype("<i2").tobytes(), 1, 16
    elif kind == "float":
        body, form, bits = np.asarray(x, "<f4").tobytes(), 3, 32
    else:
        raise ValueError(f"unknown kind {kind!r}: pcm16 or float")
    width = bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, form, 1, rate, rate * width, width, bits)
    data = struct.pack("<4sI", b"data", len(body)) + body
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (the mean of all channels) and rate of PCM of 8, 16, 24 or 32 bits, or floats."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    form, at = None, 12
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        if name == b"data":
            break
        at += 8 + size + size % 2
    else:
        raise ValueError("a WAVE file without samples")
    if form is None:
        raise ValueError("a WAVE file without a format")
    kind, channels, rate, _, _, bits = form
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
    elif kind in (1, 0xFFFE) and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif kind in (1, 0xFFFE) and bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 0] << 8) | (raw[:, 1] << 16) | (raw[:, 2] << 24)) >> 8) / float(1 << 23)
    elif kind in (1, 0xFFFE) and bits in (16, 32):
        x = np.frombuffer(body, f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))
    else:
        raise ValueError(f"samples of form {kind} with {bits} bits")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def to_wav(signals: DataFrame, rate: int, kind: str = "pcm16") -> DataFrame:
    """signals(name, x) to name, content."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [encoded(np.asarray(x if x is not None else [], float), rate, kind) for x in pdf["x"]]})

    return signals.select("name", "x").mapInPandas(run, "name string, content binary")


def from_wav(files: DataFrame, rate: int | None = None) -> DataFrame:
    """files(name, content) to name, rate, x; with a rate all are brought to it."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                x, own = decoded(bytes(content))
                out.append((name, rate or own, (x if rate in (None, own) else resample(x, own, rate)).tolist()))
            yield pd.DataFrame(out, columns=["name", "rate", "x"])

    return files.select("name", "content").mapInPandas(run, ROWS)


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """All .wav files under a path; the name is the file's without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return from_wav(files.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name"), "content"), rate)


def as_mono(signals: DataFrame, rate: int) -> DataFrame:
    """Signals that are arrays already: their rate is taken as given, whatever it was."""
    return signals.select("name", F.lit(rate).alias("rate"), "x")


def for_consumer(signals: DataFrame, consumer: str) -> DataFrame:
    """Samples scaled to the peak that one of PEAKS wants."""
    peak = PEAKS[consumer]
    return signals if peak is None else signals.withColumn("x", signal.peak_normalised(F.col("x"), peak))


def export_wav(wav: DataFrame, folder: str) -> DataFrame:
    """Writes to_wav() rows into files of a folder that all executors mount; gives the manifest name, path, n_bytes. A task that runs again writes the same files."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, f"{name}.wav")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                out.append((name, path, len(content)))
            yield pd.DataFrame(out, columns=["name", "path", "n_bytes"])

    return wav.mapInPandas(run, "name string, path string, n_bytes long")
