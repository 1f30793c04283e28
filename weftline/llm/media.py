"""Audio features of bytes kept as 8-bit PCM WAV.

Payload: the text's UTF-8 bytes, zero-padded to a positive multiple of 64. It is
stored losslessly as mono 8-bit PCM in a WAV file; all features come from the
samples read back from that file:

- polyphase resampling from RATE by UP/DOWN with a windowed-sinc filter of TAPS
  taps a phase, zero beyond the ends;
- overlapped Hann windows of WINDOW samples every HOP, their power spectra in
  MELS triangular mel bands, in log;
- hysteresis segmentation of the frame energies: a segment starts where the
  energy rises over the upper threshold and lasts until it falls below the
  lower one (both between the text's own 10 and 90 % quantiles).

Log-mels are cut into chunks of FRAMES x MELS (the last one padded with
zeros), so each is a fixed-shape tensor: the tasks put them into Arrow's type of
that name and take the query's digest from there. ``tensor_rows`` is the table to
store, a row a chunk, and ``read_tensors`` gives what is read back the type again
without a copy. Each chunk and segment carries its time span in ms.
Long texts are processed in blocks of CHUNK frames with bounded memory; each
text is computed by itself, so equal texts give equal values.

Defined results: null and empty texts are 64 zero bytes. Repeated rows, and rows
without doc_id, are rows of their own; other columns don't matter; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import table

RATE = 16_000
UP, DOWN, TAPS = 5, 8, 32
WINDOW, HOP, MELS, FRAMES = 256, 128, 40, 96
CHUNK = 4096
_ROWS_OUT = 64


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -len(raw) // 64 * -64), b"\0"), len(raw)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def filter_bank() -> np.ndarray:
    """(UP, TAPS) coefficients: row p belongs to output samples k with k * DOWN = p (mod UP)."""
    half, cut = TAPS // 2, min(1.0 / UP, 1.0 / DOWN) * UP
    out = np.zeros((UP, TAPS))
    for p in range(UP):
        t = np.arange(TAPS) - half + 1 - p / UP
        out[p] = cut * np.sinc(cut * t) * (0.54 + 0.46 * np.cos(np.pi * t / half)) * (np.abs(t) <= half)
        out[p] /= out[p].sum()
    return out.astype(np.float32)


def mel_bank() -> np.ndarray:
    """(WINDOW // 2 + 1, MELS) triangles, evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, WINDOW // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    bank = np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)
    empty = bank.sum(0) == 0  #: narrow low bands get their nearest bin
    bank[np.abs(f - mid).argmin(0)[empty], np.flatnonzero(empty)] = 1
    return bank.astype(np.float32)


_FILTER, _MEL = filter_bank(), mel_bank()
_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples first .. first + count of the resampled signal."""
    k = np.arange(first, first + count) * DOWN
    base, phase = k // UP, k % UP
    lo = int(base[0]) - TAPS // 2 + 1
    hi = int(base[-1]) + TAPS // 2 + 1
    part = samples[max(lo, 0) : hi]
    part = np.pad(part, (max(-lo, 0), hi - max(lo, 0) - len(part)))
    rows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(count, np.float32)
    for p in range(UP):
        at = np.flatnonzero(phase == p) if UP > 1 else slice(None)
        out[at] = rows[(base - base[0])[at]] @ _FILTER[p] if UP > 1 else rows[::DOWN] @ _FILTER[p]
    return out


def log_mel(data: bytes) -> np.ndarray:
    """(frames, MELS) float32; the frames overlap by WINDOW - HOP, the last ones are zero-padded."""
    samples = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    length = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-(length - WINDOW) // HOP) + 1)
    out = np.empty((frames, MELS), np.float32)
    for lo in range(0, frames, CHUNK):
        n = min(CHUNK, frames - lo)
        need = (n - 1) * HOP + WINDOW
        have = min(need, length - lo * HOP)
        y = np.zeros(need, np.float32)
        y[:have] = resample(samples, lo * HOP, have)
        rows = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * _HANN
        spectrum = np.fft.rfft(rows)
        power = spectrum.real**2 + spectrum.imag**2
        out[lo : lo + n] = np.log(power.astype(np.float32) @ _MEL + np.float32(1e-6))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) frames of the segments, by two thresholds."""
    low, high = np.quantile(energy, [0.1, 0.9])
    up, down = low + 0.6 * (high - low), low + 0.4 * (high - low)
    known = np.where(energy > up, 1, np.where(energy < down, -1, 0))
    last = np.maximum.accumulate(np.where(known != 0, np.arange(len(known)), -1))
    on = np.where(last >= 0, known[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def span_ms(first: int, end: int) -> tuple[int, int]:
    """Milliseconds that frames first .. end - 1 cover, rounded down."""
    rate = RATE * UP // DOWN
    return first * HOP * 1000 // rate, ((end - 1) * HOP + WINDOW) * 1000 // rate


def features(wav: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Payload read back, (chunks, FRAMES, MELS) tensor, spans of chunks and of segments in ms."""
    data = from_wav(wav)
    mel = log_mel(data)
    n = len(mel)
    chunks = -(-n // FRAMES)
    tensor = np.zeros((chunks * FRAMES, MELS), np.float32)
    tensor[:n] = mel
    spans = [span_ms(c * FRAMES, min(n, (c + 1) * FRAMES)) for c in range(chunks)]
    return data, tensor.reshape(chunks, FRAMES, MELS), spans, [span_ms(a, b) for a, b in segments(mel.mean(1))]


def _spans(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{a}-{b}" for a, b in spans)


def _extract(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(lo, _ROWS_OUT)
                rows = []
                for t in part.column(1):
                    sent, n = payload(t.as_py())
                    wav = to_wav(sent)
                    data, tensor, spans, parts = features(wav)
                    sha = hashlib.sha256(as_tensors(tensor).storage.flatten().to_numpy()).hexdigest()
                    text = f"{tensor.shape[0]}x{FRAMES}x{MELS}:{sha}:{len(parts)}:{hashlib.sha256(f'{_spans(spans)};{_spans(parts)}'.encode()).hexdigest()}"
                    rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), text))
                    if full:
                        rows[-1] += (wav, list(tensor.reshape(len(tensor), -1)), [{"start": a, "end": b} for a, b in spans], [{"start": a, "end": b} for a, b in parts])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                kinds += [pa.binary(), pa.list_(pa.list_(pa.float32())), span, span] * full
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [f"c{i}" for i in range(len(kinds) + 1)])

    return run


def audio_features(docs: DataFrame, text_col: str = "text", full: bool = True) -> DataFrame:
    """doc_id, the digest columns and, with ``full``, the WAV file (media), the
    chunks' tensors (each FRAMES * MELS floats) and both kinds of spans."""
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if full:
        span = "array<struct<start:long,end:long>>"
        names += f", media binary, tensors array<array<float>>, chunk_spans {span}, segments {span}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_extract(full), names)


def as_tensors(tensor: np.ndarray) -> pa.FixedShapeTensorArray:
    """(chunks, FRAMES, MELS) floats as Arrow tensors of FRAMES x MELS."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensor, np.float32))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, tensor, spans, _ = features(to_wav(payload(t.as_py())[0]))
            flat = as_tensors(tensor).storage.flatten()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1) * FRAMES * MELS, pa.int32()), flat)
            columns = [pa.array([i] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32())]
            yield pa.record_batch([*columns, *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)), lists], ["doc_id", "chunk", "start", "end", "tensor"])


def tensor_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, chunk, its span in ms, and its tensor (FRAMES * MELS floats, by rows) of each chunk."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_chunks, "doc_id long, chunk int, start long, end long, tensor array<float>")


def read_tensors(rows: pa.Table) -> pa.Table:
    """An Arrow table of stored ``tensor_rows`` with ``tensor`` in the fixed-shape tensor type."""
    flat = rows["tensor"].combine_chunks().flatten()
    storage = pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS)
    tensors = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS]), storage)
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", tensors)


def op3_audio(spark, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents"), full=False)
