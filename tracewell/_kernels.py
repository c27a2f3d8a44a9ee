"""Vectorised helpers that run inside Spark tasks: spectrums, partial sums, resampling, seeded noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_normals(key: int, n: int) -> np.ndarray:
    """``n`` standard normal numbers that depend on ``key`` alone."""
    with np.errstate(over="ignore"):
        words = splitmix(np.arange(2 * n, dtype=np.uint64) + splitmix(np.array([key & (2**64 - 1)], np.uint64)))
    u = (words >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54
    return np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * np.pi * u[n:])


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the bins from 0 up to half the sample rate, which itself is left out."""
    return np.abs(np.fft.rfft(samples))[: len(samples) // 2]


def band_rms(magnitudes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Root mean square of each band; a band is summed by itself, so a weak one loses nothing beside a strong one."""
    ends = np.stack([lo, hi], axis=1).ravel()
    sums = np.add.reduceat(np.append(magnitudes**2, 0.0), ends)[::2]
    return np.sqrt(np.where(hi > lo, sums, 0.0) / np.maximum(hi - lo, 1))


def unit(vector: np.ndarray) -> np.ndarray:
    return vector / (np.linalg.norm(vector) + 1e-12)


def memberships(x: np.ndarray, centers: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy memberships of the rows of ``x`` and their squared distances to the centres."""
    squared = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    d = np.maximum(np.sqrt(squared), 1e-12)
    ratio = (d[:, :, None] / d[:, None, :]) ** (2.0 / (m - 1.0))
    return 1.0 / (ratio.sum(axis=2) + 1e-12), squared


def stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, from the list's flat values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def grouped_vectors(batch: pa.RecordBatch, group: str, *vectors: str) -> Iterator[tuple]:
    """Each group of a batch with the matrices of its vectors; groups may differ in their number of places."""
    names = batch[group].dictionary_encode()
    codes = names.indices.to_numpy()
    for k, name in enumerate(names.dictionary.to_pylist()):
        own = None if len(names.dictionary) == 1 else pa.array(np.flatnonzero(codes == k))
        yield name, *(stacked(batch[v] if own is None else batch[v].take(own)) for v in vectors)


def full_places(groups: pd.Series, vectors: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each group with the places of its rows whose vector isn't null."""
    full = np.flatnonzero([v is not None for v in vectors])
    codes, names = pd.factorize(groups.to_numpy()[full])
    for k, name in enumerate(names):
        yield name, full[codes == k]


def placed(rows: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Puts row vectors into an array of objects."""
    for p, row in zip(places, rows, strict=True):
        out[p] = row


def mahalanobis(x: np.ndarray, center: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - center
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0.0))
