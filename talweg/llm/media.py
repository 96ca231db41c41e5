"""Media columns: text as 8-bit WAV, short-time Fourier transforms and time-coded fingerprints of spectral peaks.

A payload is the text as UTF-8, zero-padded to a positive multiple of 64 bytes; it is stored as the 8-bit mono
samples of a WAV file, read back by the wave module, and analysed in frames of 256 samples (Hann window, half
overlapping), less its mean and zero-padded by half a frame at the start and at the end, and to whole frames, so that
every sample stands in the middle of some frame. A recording of at most 320 samples would have too few frames: it is
zero-padded by 192 samples on both sides, in steps of 32. In each of four bands of the spectrum the strongest bin of
a frame is a peak, if it stands out from the mean of the frame; each peak is paired with the peaks of the next three
frames in its own band and with those of its own frame in the bands above. A fingerprint is (time in frames, first
bin, second bin, distance in frames) in one integer, kept as an array in order of time.

Null and empty texts are 64 zero bytes, whose spectrum has no peak, so their array is empty; so is that of a text of
one repeated byte that fills its payload. Equal texts have equal values; repeated rows are encoded each for itself;
an empty table gives no rows; other columns are ignored. Long recordings are analysed in blocks of frames, so memory is
bounded by the text itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import arrow_map, id_and_text, table

RATE, FRAME, HOP, NEXT, BLOCK = 8000, 256, 128, 3, 2048
SHORT, SHORT_HOP, SHORT_PAD = 320, 32, 192
BANDS = ((1, 9), (9, 25), (25, 57), (57, 129))
_HANN = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each band (columns) and frame (rows), 0 where none stands out."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if not np.ptp(x):
        return np.zeros((0, len(BANDS)), np.int64)
    pad, hop = (SHORT_PAD, SHORT_HOP) if len(x) <= SHORT else (HOP, HOP)
    x = np.pad(x - x.mean(), (pad, pad + -len(x) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    out = np.zeros((len(frames), len(BANDS)), np.int64)
    for at in range(0, len(frames), BLOCK):
        block = frames[at : at + BLOCK]
        spectrum = np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _HANN, axis=1))
        floor = 1.5 * spectrum.mean(axis=1)
        for k, (a, b) in enumerate(BANDS):
            best = spectrum[:, a:b].argmax(axis=1)
            out[at : at + BLOCK, k] = np.where(np.take_along_axis(spectrum[:, a:b], best[:, None], 1)[:, 0] > floor, best + a, 0)
    return out


def fingerprints(samples: bytes) -> np.ndarray:
    """Pairs of peaks: time << 24 | first bin << 13 | second bin << 2 | distance (0 in one frame, to NEXT), sorted."""
    p = peaks(samples)
    found = [np.empty(0, np.int64)]
    for d in range(1, NEXT + 1):
        for k in range(len(BANDS)):
            a, b = p[:-d, k], p[d:, k]
            at = np.flatnonzero((a > 0) & (b > 0))
            found.append(at << 24 | a[at] << 13 | b[at] << 2 | d)
    for j, k in combinations(range(len(BANDS)), 2):
        a, b = p[:, j], p[:, k]
        at = np.flatnonzero((a > 0) & (b > 0))
        found.append(at << 24 | a[at] << 13 | b[at] << 2)
    return np.sort(np.concatenate(found))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the WAV file)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow_map(id_and_text(docs), each, "doc_id long, n_bytes long, media binary")


def analyse_media(media: DataFrame) -> DataFrame:
    """What the stored recordings hold, read back: digests of samples and file, and the fingerprints."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for stored in batch.column(2).to_pylist():
            x = samples_of(stored)
            prints = fingerprints(x)
            for c, v in zip(cols, (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), prints, f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()[:32]}"), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints", "feature"])

    return arrow_map(media, each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>, feature string")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a recording, stored, read back and fingerprinted; `feature` is the digest of `fingerprints`."""
    return analyse_media(encode_media(table(spark, sf_dir, "documents")))
