"""Fingerprints and texture features of grey images, from arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.functions.deploy import ship

# The low-pass filter of four vanishing moments (Daubechies 1992, table 6.1).
DB4 = np.array([0.2303778133088964, 0.7148465705529154, 0.6308807679298587, -0.0279837694168599, -0.1870348117190931, 0.0308413818355607, 0.0328830116668852, -0.0105974017850690])


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance (ITU-R BT.601) of rows of one, three (blue, green, red) or four bytes a pixel."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels == 1 else x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299


def _shares(size: int, to: int) -> np.ndarray:
    """to x size: how much of each old cell a new one takes, rows summing to 1."""
    edge = np.linspace(0, size, to + 1)
    low, high = np.maximum(edge[:-1, None], np.arange(size)[None, :]), np.minimum(edge[1:, None], np.arange(1, size + 1)[None, :])
    out = np.maximum(0, high - low)
    return out / out.sum(1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas."""
    return _shares(x.shape[0], height) @ x @ _shares(x.shape[1], width).T


def cosine_transform(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix (Ahmed, Natarajan and Rao 1974)."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def dct_hash(x: np.ndarray, side: int = 32) -> int:
    """A signed 64-bit number: which of the 8 x 8 lowest frequencies of the image at side x side are above their median."""
    t = cosine_transform(side)
    low = np.round((t @ resized(x, side, side) @ t.T)[:8, :8].reshape(-1), 6)  # what is equal but for rounding is equal
    bits = low > np.median(low)
    value = sum(1 << k for k in np.flatnonzero(bits).tolist())
    return value - (1 << 64) if value >= 1 << 63 else value


def wavelet_step(x: np.ndarray, low: np.ndarray = DB4) -> tuple[np.ndarray, np.ndarray]:
    """(approximation, detail) along the last axis of even length, with periodic ends (Mallat 1989)."""
    high = low[::-1] * (-1) ** np.arange(len(low))
    at = (2 * np.arange(x.shape[-1] // 2)[:, None] + np.arange(len(low))[None, :]) % x.shape[-1]
    return x[..., at] @ low, x[..., at] @ high


def wavelet_features(x: np.ndarray, side: int = 128, levels: int = 3) -> np.ndarray:
    """Mean absolute value and standard deviation of the last approximation and of each level's details across, down and diagonal, coarsest first."""
    x = resized(x, side, side) / 255
    details = []
    for _ in range(levels):
        a, d = wavelet_step(x)
        (aa, ad), (da, dd) = (tuple(y.swapaxes(0, 1) for y in wavelet_step(z.swapaxes(0, 1))) for z in (a, d))
        details.append((da, ad, dd))
        x = aa
    each = [x, *(y for level in reversed(details) for y in level)]
    return np.array([f(y) for y in each for f in (lambda y: np.abs(y).mean(), np.std)])


def image_features(images: DataFrame, key: str) -> DataFrame:
    """(key, hash, wavelet) of rows (key, height, width, channels, data) as ``sources.files.decoded_images`` gives them.

    Rows that couldn't be decoded (null data or a height below 1) have nulls. Worked out where the
    image is read, nothing is shuffled.
    """
    ship(images.sparkSession)
    kind = dict(images.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            hashes, features = [], []
            for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                fine = data is not None and h is not None and h > 0 and len(data) == h * w * c
                x = grey(data, h, w, c) if fine else None
                hashes.append(dct_hash(x) if fine else None)
                features.append(wavelet_features(x).tolist() if fine else None)
            yield pa.RecordBatch.from_arrays([keys, pa.array(hashes, pa.int64()), pa.array(features, pa.list_(pa.float64()))], ["key", "hash", "wavelet"])

    found = images.select(key, "height", "width", "channels", "data").mapInArrow(run, f"key {kind}, hash long, wavelet array<double>")
    return found.withColumnRenamed("key", key)
