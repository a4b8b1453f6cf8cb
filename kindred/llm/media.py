"""Media columns: payloads as WAV bytes, short-time spectra, spectral-peak pair fingerprints.

A payload is stored as an 8-bit mono WAV written and read by the wave module, so the samples
are the payload's bytes. Frames of FRAME samples, HOP apart, go through a Hann window and an
FFT; in each of BANDS bands of a frame the strongest bin is a peak if it exceeds the frame's
mean. Each peak is paired with the peaks of the same band in the next FAN frames. A pair is
one integer: (bin, later bin, distance in frames), stored with the time of its first frame.

Frames overlap, the first begins LEAD samples before the payload and the last ends FRAME - LEAD
after it (silence is added): a payload of PAD bytes has two frames, and every byte has a weight
of 0.4 or more in one of them. Times count FRAME samples: the time of a frame is the block of
FRAME samples in which it begins, 0 before the payload.

Defined results: null text is empty; payloads are padded with bytes 0 to a positive multiple
of PAD; equal payloads give equal columns; silent payloads have empty arrays; payloads of a few
bytes may share their peaks.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow_rows import map_batches

PAD = 64
RATE = 8000
FRAME = 256
HOP = 64
#: Samples from the beginning of the first frame to the payload.
LEAD = 200
#: First bins of the bands; the last entry is the end.
BANDS = (1, 9, 25, 57, 129)
FAN = 2
#: Frames transformed at once; bounds the memory of very long payloads.
BLOCK = 4096


def to_wav(payload: bytes) -> bytes:
    """Payload bytes as the 8-bit samples of a mono WAV."""
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV that to_wav wrote."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


_window = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (in FRAME samples) and codes of the peak pairs, ordered by frame, band, distance."""
    x = np.frombuffer(samples, np.uint8)
    n = 1 + -(-len(x) // HOP)
    peaks = np.zeros((n, len(BANDS) - 1), np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        start, end = lo * HOP - LEAD, (hi - 1) * HOP + FRAME - LEAD
        part = x[max(0, start) : end].astype(np.float32) - 128
        part = np.pad(part, (max(0, -start), end - max(0, start) - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _window, axis=1)).round(1)
        mean = power[:, 1:].mean(axis=1)
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            top = power[:, a:b].argmax(axis=1)
            strong = power[np.arange(hi - lo), a + top] > mean
            peaks[lo:hi, k] = np.where(strong, a + top, 0)
    times, codes, order = [], [], []
    for d in range(1, FAN + 1):
        if n > d:
            first, later = peaks[:-d], peaks[d:]
            t, k = np.nonzero((first > 0) & (later > 0))
            times.append(np.maximum(t * HOP - LEAD, 0) // FRAME)
            codes.append((first[t, k] << 16) | (later[t, k] << 4) | d)
            order.append((t * len(BANDS) + k) * (FAN + 1) + d)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    o = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[o].astype(np.int32), np.concatenate(codes)[o].astype(np.int32)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes of the text in UTF-8 and `media binary`, the WAV of its padded payload."""

    def build(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in b.column(1).to_pylist()]
        media = [to_wav(r + bytes(-len(r) % PAD if r else PAD)) for r in raw]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, F.col(text_col).cast("string")), build, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds to id_col, n_bytes and media what the stored samples hold.

    payload binary (read back), times array<int> and codes array<int> (equally long).
    """

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        payload = [from_wav(m) for m in b.column(2).to_pylist()]
        pairs = [fingerprint(p) for p in payload]
        lists = []
        for k in (0, 1):
            ends = np.concatenate([[0], np.cumsum([len(p[k]) for p in pairs])]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[k] for p in pairs]), pa.int32())))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(payload, pa.binary()), *lists], names=[*b.schema.names, "payload", "times", "codes"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, "n_bytes", "media"), read, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")
