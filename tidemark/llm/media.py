"""Operator 9: media columns - audio stored losslessly, with features.

A text's UTF-8 bytes, padded with bytes 255 to a multiple of 576, are the 8-bit
samples of a mono WAV file.  The stored file is read back and its samples are
halved in rate by a polyphase low-pass filter, cut into overlapping frames and
turned into log-mel energies, which are averaged over time to one tensor of
fixed shape ``SHAPE``; frame energies give active spans by a threshold with
hysteresis (a span opens above the upper and closes under the lower one).

Every file is worked on by itself, in its task, so equal texts get equal
values.  Defined results: a null or empty text is 576 bytes 255; repeated rows
each give their result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

UNIT, TAIL = 576, 32
RATE, DOWN, TAPS = 16_000, 2, 32
FRAME, HOP = 256, 128
SHAPE = (16, 20)
OPEN, CLOSE = 0.5, -0.5


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


def low_pass(taps: int, up: int, down: int) -> np.ndarray:
    at = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(at / max(up, down)) * np.hanning(taps + 2)[1:-1]
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """x at up/down times its rate: output n is one phase of the filter over the
    samples around n * down / up, so no zero or dropped sample is computed."""
    h = low_pass(taps * up, up, down)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for phase in range(up):
        at = np.arange(phase, n, up)
        out[at] = view[at * down // up] @ h[(at[0] * down) % up :: up][::-1] if len(at) else 0
    return out


def mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, (bins, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def spans_of(energy: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """[first, last) frames of runs that open above upper and close under lower."""
    mark = np.where(energy > upper, 1, np.where(energy < lower, -1, 0))
    known = np.flatnonzero(mark)
    if not len(known):
        return []
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False)
    turn = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in turn.reshape(-1, 2)]


class Features:
    """Log-mel tensor and active spans of 8-bit samples."""

    def __init__(self, rate: int = RATE, shape: tuple[int, int] = SHAPE):
        self.rate, self.shape = rate // DOWN, shape
        self.window, self.bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate // DOWN, FRAME, shape[1])

    def __call__(self, payload: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        x = resample(x, 1, DOWN)
        if len(x) < FRAME:
            x = np.pad(x, (0, FRAME - len(x)))
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        mels, energy = [], []
        for a in range(0, len(frames), 4096):  # bounded memory for very long texts
            power = np.abs(np.fft.rfft(frames[a : a + 4096] * self.window, axis=1)) ** 2
            mels.append(np.log10(power @ self.bank + 1e-6))
            energy.append(np.log10(power.sum(axis=1) + 1e-6))
        mel, loud = np.concatenate(mels), np.concatenate(energy)
        edges = np.linspace(0, len(mel), self.shape[0] + 1).astype(int)
        sums = np.concatenate([np.zeros((1, self.shape[1])), np.cumsum(mel, axis=0)])
        first = np.minimum(edges[:-1], len(mel) - 1)
        last = np.maximum(edges[1:], first + 1)
        tensor = ((sums[last] - sums[first]) / (last - first)[:, None]).astype(np.float32)
        z = (loud - loud.mean()) / (loud.std() + 1e-6)
        second = HOP / self.rate
        return tensor, [(a * second, b * second) for a, b in spans_of(z, OPEN, CLOSE)]


def tensor_array(rows: list[list[float]], shape: tuple[int, int] = SHAPE) -> pa.Array:
    """Stored features as an Arrow fixed-shape tensor array."""
    flat = pa.array(np.asarray(rows, np.float32).reshape(-1), pa.float32())
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), pa.FixedSizeListArray.from_arrays(flat, shape[0] * shape[1]))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensor array<float>, spans array<struct<start:double,stop:double>>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: sizes and digests of payload and stored form, the
    ``SHAPE`` tensor (row-major) and the spans in seconds; with ``keep_media``
    the file itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            for start in range(0, len(batch), 256):
                out = []
                part = batch.iloc[start : start + 256]
                for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                    n, payload = payload_of(text)
                    media = store(payload)
                    back, _ = load(media)
                    tensor, spans = features(back)
                    row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), tensor.reshape(-1), [{"start": a, "stop": b} for a, b in spans])
                    out.append((*row, media) if keep_media else row)
                names = [c.split()[0] for c in SCHEMA.split(", ")] + ["media"] * keep_media
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA + ", media binary" * keep_media)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns; ``feature`` names the tensor by its values in tenths,
    the number of spans and their total time in milliseconds."""
    found = media_columns(table(spark, sf_dir, "documents"))
    tenths = F.array_join(F.transform("tensor", lambda x: F.round(x * 10).cast("int").cast("string")), ",")
    active = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s.stop - s.start)
    feature = F.concat(F.lit(f"mel{SHAPE[0]}x{SHAPE[1]}:"), F.md5(tenths), F.lit(";spans="), F.size("spans").cast("string"), F.lit(";active_ms="), F.round(active * 1000).cast("long").cast("string"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
