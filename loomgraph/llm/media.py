"""Operator 8: media columns.

A document's bytes are stored as the samples of an 8-bit mono WAV file by the wave module, and
everything else is computed from the samples read back out of the stored bytes: a short-time
Fourier transform, the peaks of its spectrogram, and pairs of nearby peaks as fingerprints
(anchor frequency, second frequency, time between them), stored as an array coded by anchor time.

Defined results: null or empty text is 64 zero bytes, whose silence has no peaks and an empty
fingerprint array; equal texts give equal values; rows are independent, so repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import chunks, table, texts_of

PAD = 64
SAMPLE_RATE = 8000
#: Frame length of the transform; frames do not overlap.
FRAME = 256
#: Frames transformed at once.
FRAMES_AT_ONCE = 4096
#: Bands of the spectrum; each gives its loudest bin as a possible peak.
BANDS = ((1, 8), (8, 16), (16, 32), (32, 64), (64, 129))
#: A bin is a peak if it is this many times louder than its frame's mean.
LOUDNESS = 3.0
#: An anchor peak pairs with the peaks of this many following frames.
PAIR_FRAMES = 2

MEDIA_SCHEMA = (
    "doc_id long, media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, n_frames long, fingerprints array<bigint>"
)


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Times and frequency bins of the peaks, ordered by time, and the number of frames."""
    signal = np.frombuffer(samples, np.uint8)
    n_frames = -(-len(signal) // FRAME)
    hann = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for first in range(0, n_frames, FRAMES_AT_ONCE):
        part = signal[first * FRAME : (first + FRAMES_AT_ONCE) * FRAME].astype(np.float32) - 128.0
        frames = np.pad(part, (0, -len(part) % FRAME)).reshape(-1, FRAME)
        frames = (frames - frames.mean(axis=1, keepdims=True)) * hann
        power = np.abs(np.fft.rfft(frames, axis=1))
        floor = LOUDNESS * power.mean(axis=1) + 1e-3
        for low, high in BANDS:
            loudest = power[:, low:high].argmax(axis=1)
            t = np.flatnonzero(power[np.arange(len(power)), low + loudest] > floor)
            times.append(first + t)
            bins.append(low + loudest[t])
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order].astype(np.int64), f[order].astype(np.int64), n_frames


def pair_fingerprints(times: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """time << 32 | anchor bin << 20 | second bin << 8 | frames between, by anchor time."""
    found = []
    for step in range(1, len(BANDS) * (PAIR_FRAMES + 1)):
        if step >= len(times):
            break
        between = times[step:] - times[:-step]
        ok = (between > 0) & (between <= PAIR_FRAMES)
        found.append((times[:-step] << 32 | bins[:-step] << 20 | bins[step:] << 8 | between)[ok])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Per row of ``docs``: the stored WAV, checks of the payload read back, and its fingerprints."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            columns: list[list] = [[] for _ in range(9)]
            for text in texts_of(batch.column("text")):
                media = encode_wav(text + bytes(-len(text) % PAD if text else PAD))
                payload = decode_wav(media)
                times, bins, n_frames = spectral_peaks(payload)
                row = (
                    media if keep_media else None,
                    len(text),
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-PAD:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    n_frames,
                    pair_fingerprints(times, bins),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, MEDIA_SCHEMA)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature`` is the number of peak pairs and the digest of the time-coded array."""
    media = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    packed = F.concat_ws(",", F.transform("fingerprints", lambda x: F.hex(x)))
    feature = F.concat_ws(":", F.size("fingerprints").cast("string"), F.sha2(packed, 256))
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
