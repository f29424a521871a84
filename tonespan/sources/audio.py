"""Audio files as rows. WAV is decoded here; other formats by a decoder that is passed in."""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tonespan.sources import matroska

RATE = 16_000
#: Samples in one row batch on the way back to Spark.
_BATCH = 1 << 18


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(samples x channels in [-1, 1], rate) of PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    raw = raw[: len(raw) // (channels * width) * channels * width].reshape(-1, width)
    if width == 1:
        x = (raw[:, 0].astype(float) - 128) / 128
    else:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        x = wide.view("<i4").ravel() / 2.0**31
    return x.reshape(-1, channels), rate


def decode_known(content: bytes, stream: int = 0) -> tuple[np.ndarray, int]:
    """The sound of one audio stream of a file, by what its header says: PCM in WAV (which
    has one stream) or in Matroska."""
    if content[:4] == matroska.EBML.to_bytes(4, "big"):
        return matroska.decode(content, stream)
    if stream:
        raise ValueError(f"no audio stream {stream}")
    return decode_wav(content)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation onto another rate."""
    if rate == to or not len(x):
        return x
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def read(spark: SparkSession, path: str, seconds: float | None = None, rate: int = RATE, decoder: Callable[[bytes], tuple[np.ndarray, int]] | None = None, stream: int = 0) -> DataFrame:
    """(path, i, x, error): mono samples of the files at ``path``, channels averaged; a file
    that cannot be decoded is one row with the error. Files are read by executors, one at a
    time; ``seconds``: only so much of each; ``stream``: which audio stream, unless a
    ``decoder`` of one's own decides that."""
    decoder = decoder or functools.partial(decode_known, stream=stream)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    x, own = decoder(bytes(content))
                except Exception as e:  # noqa: BLE001  any decoder's failure is the file's
                    yield pd.DataFrame({"path": [name], "i": [None], "x": [None], "error": [str(e) or type(e).__name__]})
                    continue
                mono = x.mean(axis=1)
                mono = resample(mono if seconds is None else mono[: int(seconds * own)], own, rate).astype(np.float32)
                for a in range(0, len(mono), _BATCH):
                    part = mono[a : a + _BATCH]
                    yield pd.DataFrame({"path": name, "i": np.arange(a, a + len(part)), "x": part, "error": None})

    return files.mapInPandas(run, "path string, i long, x float, error string")


def model(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A segmentation, voiceprint or measuring model over Arrow batches of ``rows``. None is
    bundled: ``run`` is loaded once for each worker and gets one batch at a time."""
    if run is None:
        raise ValueError("no model is bundled; pass one as run")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(run, parts)

    return rows.mapInPandas(batches, schema)
