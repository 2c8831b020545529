"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak fingerprints.

A fingerprint is an array of (time, code): ``time`` is the frame of an anchor peak, ``code`` packs
the anchor's and a later peak's frequency bins and their distance in frames.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored

RATE, WINDOW, HOP = 8000, 512, 256
#: One peak at most per band of bins and frame; a peak is the largest of a frame and its neighbours.
BANDS = ((1, 16), (16, 40), (40, 96), (96, 257))
#: A peak is paired with peaks of so many following frames.
FAN_FRAMES = 3
#: Frames transformed at once, so long media need bounded memory.
CHUNK = 2048
UNIT = 64
#: Rows whose media a worker holds at once.
_ROWS = 256
_HANN = np.hanning(WINDOW).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM holding ``payload`` byte for byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[np.ndarray, bytes]:
    """Samples in [-1, 1) (channels averaged) and the raw frames of a WAV of 8, 16, 24 or 32 bits.

    ValueError if the bytes are none.
    """
    try:
        with wave.open(io.BytesIO(media), "rb") as w:
            width, channels, raw = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"not a WAV: {e}") from e
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (wide.view("<i4").ravel() / 2.0**31).astype(np.float32)
    else:
        x = (np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)).astype(np.float32)
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x, raw


def stft(x: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes (frames, WINDOW // 2 + 1), ``CHUNK`` frames at a time; the end is padded with 0."""
    n = max(1, -(-max(len(x) - WINDOW, 0) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    for at in range(0, n, CHUNK):
        yield np.abs(np.fft.rfft(frames[at : at + CHUNK] * _HANN, axis=1))


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of spectral peaks: in each band, the frame's largest bin if no neighbouring frame
    is larger in that band."""
    best, which = [], []
    for mag in stft(x):
        best.append(np.stack([mag[:, a:b].max(axis=1) for a, b in BANDS], axis=1))
        which.append(np.stack([mag[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1))
    top, bins = np.concatenate(best), np.concatenate(which)
    edge = np.full((1, top.shape[1]), -1.0, top.dtype)
    is_peak = (top > 1e-3) & (top >= np.concatenate([edge, top[:-1]])) & (top > np.concatenate([top[1:], edge]))
    frame, band = np.nonzero(is_peak)
    return frame, bins[frame, band]


def pair_codes(frame: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each peak paired with the peaks of the following ``FAN_FRAMES`` frames."""
    times, codes = [], []
    for ahead in range(1, (FAN_FRAMES + 1) * len(BANDS)):
        a, b = slice(0, max(len(frame) - ahead, 0)), slice(ahead, None)
        gap = frame[b] - frame[a]
        near = (gap >= 1) & (gap <= FAN_FRAMES)
        times.append(frame[a][near])
        codes.append((bins[a][near] << 13) | (bins[b][near] << 4) | gap[near])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


_OUT = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("n_peaks", pa.int64()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]
_DDL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_peaks long, times array<int>, codes array<int>"


def media_row(media: bytes | None, n_bytes: int | None = None) -> tuple:
    """All columns of one WAV; nothing but nulls for a null value or bytes that are no WAV."""
    try:
        if media is None:
            raise ValueError
        x, raw = from_wav(media)
    except ValueError:
        return (None,) * len(_OUT)
    frame, bins = peaks(x)
    t, c = pair_codes(frame, bins)
    n_frames = max(1, -(-max(len(x) - WINDOW, 0) // HOP) + 1)
    return (len(raw) if n_bytes is None else n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), n_frames, len(frame), t, c)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: its text as UTF-8, padded, as the bytes of a WAV.

    A null text counts as empty; the payload is padded with bytes 0 to a positive multiple of 64.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [(n, to_wav(p)) for n, p in map(payload_of, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "n_bytes", "media"])

    out = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def wav_fingerprints(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str | None = None) -> DataFrame:
    """(id, media columns) for a column of WAV bytes; ``size_col``: bytes of the payload before padding.

    A null value, or bytes that are no WAV, give null results. Equal media give equal values; an id may be
    null or repeated; silence has no peaks.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [media_row(m, n) for m, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_OUT)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *[k for k, _ in _OUT]])

    size = col(size_col).cast("long") if size_col else F.lit(None).cast("long")
    out = media.select(col(id_col).alias("id"), col(media_col).alias("media"), size.alias("n")).mapInArrow(run, f"id {kind}, {_DDL}")
    return out.withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media columns) of every row: its text is kept as a WAV in a shared table and read from there."""
    return wav_fingerprints(stored(to_media(docs, id_col, text_col), "media"), id_col, size_col="n_bytes")


def op3_peak_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = fingerprints(docs)
    digest = F.md5(F.concat_ws(",", F.transform(F.arrays_zip("times", "codes"), lambda x: F.concat_ws(":", x.times, x.codes))))
    feature = F.concat_ws("/", F.col("n_frames"), F.col("n_peaks"), F.size("codes"), digest)
    return rows.withColumn("feature", feature).drop("times", "codes")
