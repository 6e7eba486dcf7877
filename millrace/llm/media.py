"""Media columns: 8-bit WAV by the wave module, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts, utf8

UNIT = 576
PAD = b"\xff"
RATE = 8000
#: Bins of each band. Samples in a frame and between frame starts, frames transformed at once, partners of a peak, and how far ahead they may lie.
BANDS = ((1, 17), (17, 65), (65, 129), (129, 257))
FRAME, HOP, BLOCK, FAN_OUT, REACH = 512, 288, 4096, 3, 63
#: Samples of silence after a payload of whole units, so that its last sample is in the last frame.
TAIL, SILENCE = 224, 128


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames and bins where a band's strongest bin is a maximum in time, by frame then band; the number of frames."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, power = [], []
    for i in range(0, len(frames), BLOCK):
        f = np.fft.rfft((frames[i : i + BLOCK].astype(np.float32) - 128) * window)
        p = f.real**2 + f.imag**2
        k = np.stack([p[:, a:b].argmax(1) + a for a, b in BANDS])
        best.append(k)
        power.append(p[np.arange(k.shape[1]), k])
    best, power = np.concatenate(best, 1), np.concatenate(power, 1)
    edge = np.full((len(BANDS), 1), -1.0)
    around = np.concatenate((edge, power, edge), 1)
    at, band = np.nonzero(((power >= around[:, :-2]) & (power > around[:, 2:])).T)
    return at, best[band, at], len(frames)


def pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Times and codes (anchor bin, partner bin, frames between: 9, 9 and 6 bits), by time then partner; the number of frames."""
    at, bins, n = peaks(samples)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((bins[:-k][near] << 15) | (bins[k:][near] << 6) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(times, kind="stable")
    return times[order].astype(np.int32), codes[order].astype(np.int32), n


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the whole text as UTF-8, padded with 255 to a positive multiple of 576, as a WAV file."""

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            yield {"doc_id": b.column(0), "n_bytes": [len(x) for x in raw], "media": [to_wav(x + PAD * (-len(x) % UNIT if x else UNIT)) for x in raw]}

    return map_batches(texts(docs), run, "doc_id long, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Read each WAV back: the payload's and the file's digests, and the fingerprint as time-coded arrays (times, codes)."""

    def run(batches):
        for b in batches:
            out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "times", "codes")}
            for m in b.column("media").to_pylist():
                payload = from_wav(m)
                times, codes, n = pairs(np.frombuffer(payload + bytes([SILENCE]) * TAIL, np.uint8))
                for name, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), n, times, codes)):
                    out[name].append(v)
            yield out | {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")}

    return map_batches(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, times array<int>, codes array<int>")


def media_features(docs: DataFrame) -> DataFrame:
    """Encode, read back, fingerprint.

    A null or empty text is 576 bytes of 255; a null doc_id is carried; repeated rows give repeated rows; very long
    texts are transformed in blocks; of equal peaks (ties) the first bin counts; an empty table gives no rows; other columns are ignored.
    """
    return fingerprint(encode(docs))


def media_digest(docs: DataFrame) -> DataFrame:
    feature = F.concat_ws(":", F.lit("stft-pairs"), F.col("n_frames").cast("string"), F.size("codes").cast("string"), F.lower(F.hex(F.xxhash64("times", "codes"))))
    return media_features(docs).withColumn("feature", feature).drop("times", "codes")
