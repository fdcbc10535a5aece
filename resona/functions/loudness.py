"""Psychoacoustic scales on rows of band energies (`array<double>`), all in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from resona.functions import vectors

# fixed values: upper edges of the 24 critical bands (Hz)
BARK = [
    100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720,
    2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500,
]

# fixed values: loudness levels (phon) of the curves below
PHON = [3, 20, 40, 60, 80, 100]

# fixed values: frequencies (Hz) and, per level, the sound pressure (dB) that sounds equally loud
LOUDNESS_HZ = [
    31.62, 50, 70.7, 100, 141.4, 200, 316.2, 500, 707.1, 1000, 1414, 1682, 2000, 2515, 3162,
    3976, 5000, 7071, 10000, 11890, 14140, 15500,
]
EQUAL_LOUDNESS = [
    [55, 40, 32, 24, 19, 14, 10, 6, 4, 3, 2, 2, 0, -2, -5, -4, 0, 5, 10, 14, 25, 35],
    [66, 52, 43, 37, 32, 27, 23, 21, 20, 20, 20, 20, 19, 16, 13, 13, 18, 22, 25, 30, 40, 50],
    [76, 64, 57, 51, 47, 43, 41, 41, 40, 40, 40, 39.5, 38, 35, 33, 33, 35, 41, 46, 50, 60, 70],
    [89, 79, 74, 70, 66, 63, 61, 60, 60, 60, 60, 59, 56, 53, 52, 53, 56, 61, 65, 70, 80, 90],
    [103, 96, 92, 88, 85, 83, 81, 80, 80, 80, 80, 79, 76, 72, 70, 70, 75, 79, 83, 87, 95, 105],
    [118, 110, 107, 105, 103, 102, 101, 100, 100, 100, 100, 99, 97, 94, 90, 90, 95, 100, 103, 105, 108, 115],
]


def band_loudness(bands: int = len(BARK)) -> np.ndarray:
    """(bands, levels): pressure per band edge and level, between the curve's frequencies."""
    curves = [np.interp(BARK, LOUDNESS_HZ, curve) for curve in EQUAL_LOUDNESS]
    return np.array(curves).T[:bands]


def spreading(bands: int = len(BARK)) -> np.ndarray:
    """Masking of band j in band i."""
    # fixed values: the spreading function of critical bands
    apart = np.arange(bands)[:, None] - np.arange(bands)[None, :] + 0.474
    return 10 ** ((15.81 + 7.5 * apart - 17.5 * np.sqrt(1 + apart**2)) / 10)


def bark_bands(power: Column, samplerate: float, window: int, bands: int = len(BARK)) -> Column:
    """Spectrum bins (window/2 + 1 of them up to half the rate) summed per critical band."""
    axis = np.linspace(0, samplerate / 2, window // 2 + 1)
    edges = [0, *BARK]
    sums = []
    for low, high in zip(edges[:bands], edges[1:]):
        inside = np.flatnonzero((axis >= low) & (axis < high))
        part = F.slice(power, int(inside[0]) + 1, len(inside)) if len(inside) else None
        sums.append(vectors.total(part) if part is not None else F.lit(0.0))
    return F.array(*sums)


def bark_band_of(frequency: Column) -> Column:
    """Number of the critical band 0..23 of a frequency; null beyond the last edge."""
    below = sum(((frequency >= edge).cast("int") for edge in BARK), F.lit(0))
    return F.when((frequency >= 0) & (frequency < BARK[-1]), below)


def mask(bands: Column, count: int = len(BARK)) -> Column:
    """Energy spread into the neighbouring bands."""
    matrix = vectors.matrix_literal(spreading(count).tolist())
    return vectors.bound(bands, lambda b: F.transform(matrix, lambda row: vectors.dot(row, b)))


def decibel(bands: Column) -> Column:
    return F.transform(bands, lambda v: 10 * F.log10(F.greatest(v, F.lit(1.0))))


def phon(bands: Column, count: int = len(BARK)) -> Column:
    """Decibels to phon: linear between the curves, 3 below the lowest, on and on above the last.

    Written as the sum of the way through each gap between two curves.
    """
    curves = band_loudness(count)
    gaps = len(PHON) - 1
    starts_and_slopes = np.concatenate([curves[:, :-1], np.diff(PHON) / np.diff(curves, axis=1)], axis=1)
    table = vectors.matrix_literal(starts_and_slopes.tolist())

    def one(db: Column, row: Column) -> Column:
        out = F.lit(float(PHON[0]))
        for gap, rise in enumerate(np.diff(PHON)):
            way = F.greatest((db - F.get(row, F.lit(gap))) * F.get(row, F.lit(gaps + gap)), F.lit(0.0))
            out = out + (F.least(way, F.lit(float(rise))) if gap < gaps - 1 else way)
        return out

    return F.zip_with(bands, table, one)


def sone(bands: Column) -> Column:
    # fixed values: loudness doubles every 10 phon from 40 on, below it is a power
    return F.transform(
        bands,
        lambda v: F.when(v >= 40, F.pow(F.lit(2.0), (v - 40) / 10)).otherwise(F.pow(v / 40, F.lit(2.642))),
    )


def fluctuation_weight(bin_number: Column, segment_size: int, samplerate: float) -> Column:
    """Weight of a modulation bin (1, 2, ...), highest at 4 Hz."""
    hertz = bin_number * F.lit(samplerate / segment_size)
    return 1 / (hertz / 4 + 4 / hertz)


def mel_filters(samplerate: float, window: int, bands: int = 80, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(bands, window/2 + 1) triangular filters of equal area, evenly spaced in mel.

    The scale is linear below 1000 Hz and logarithmic above (27 steps per factor 6.4).
    """
    # fixed values: the mel scale with a linear and a logarithmic part
    linear, log_start, log_step = 200.0 / 3, 1000.0, np.log(6.4) / 27.0

    def to_mel(f):
        f = np.asarray(f, dtype=float)
        return np.where(f < log_start, f / linear, log_start / linear + np.log(np.maximum(f, 1e-9) / log_start) / log_step)

    def to_hertz(m):
        m = np.asarray(m, dtype=float)
        knee = log_start / linear
        return np.where(m < knee, m * linear, log_start * np.exp(log_step * (m - knee)))

    edges = to_hertz(np.linspace(to_mel(low), to_mel(high or samplerate / 2), bands + 2))
    axis = np.linspace(0, samplerate / 2, window // 2 + 1)
    rising = (axis[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - axis[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]
