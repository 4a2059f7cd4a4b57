"""Perceptual features of gray frames. Frames are arrays of doubles in 0..255, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix."""
    k, i = np.mgrid[0:n, 0:n]
    out = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] = np.sqrt(1 / n)
    return out


def phash_of(gray: np.ndarray) -> int:
    """64 bits of the low 8 x 8 frequencies of a square frame: 1 above their median, first bit highest, as a signed number."""
    d = dct_matrix(len(gray))
    low = (d @ gray.astype(np.float64) @ d.T)[:8, :8].reshape(-1)
    bits = low > np.median(low)
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def sharpness_of(gray: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian; 0 for frames under 3 pixels either way."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.float32)
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(edges.var())


def brightness_of(gray: np.ndarray) -> tuple[float, float]:
    """Mean and 99th percentile of a frame, both in 0..1."""
    g = gray.astype(np.float32) / 255
    return float(g.mean()), float(np.percentile(g, 99))


FEATURES = StructType([StructField("phash", LongType())] + [StructField(c, DoubleType()) for c in ("sharpness", "brightness", "dark_p99")])


@F.pandas_udf(FEATURES)
def frame_features(frames: pd.Series, widths: pd.Series) -> pd.DataFrame:
    """All features of a frame, rounded half to even as thresholds expect; phash only of 32 x 32 frames."""
    rows = []
    for frame, width in zip(frames, widths, strict=True):
        if frame is None or not width:
            rows.append((None, None, None, None))
            continue
        gray = np.asarray(frame, float).reshape(-1, int(width))
        mean, p99 = brightness_of(gray)
        rows.append((phash_of(gray) if gray.shape == (32, 32) else None, round(sharpness_of(gray), 3), round(mean, 4), round(p99, 4)))
    return pd.DataFrame(rows, columns=["phash", "sharpness", "brightness", "dark_p99"])


def median_bits(values: Column) -> Column:
    """64 values as 64 bits, 1 above the median (the mean of the middle two), first bit highest; on the JVM."""
    ordered = F.sort_array(F.transform(values, lambda x: x.cast("double")))
    middle = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("bits"), middle.alias("middle")), lambda a, x: F.struct(F.shiftleft(a["bits"], 1).bitwiseOR(F.when(x.cast("double") > a["middle"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("bits"), a["middle"].alias("middle")))["bits"]


def low_frequencies(values: Column, width: int) -> Column:
    """The low 8 x 8 frequencies of a square frame on the JVM: a product with the DCT's rows from the left and from the right."""
    rows = dct_matrix(width)[:8].tolist()
    places = F.sequence(F.lit(0), F.lit(width - 1))

    def product(weights: Column, own: Column) -> Column:
        return F.aggregate(F.zip_with(weights, own, lambda w, v: w * v), F.lit(0.0), lambda total, x: total + x)

    matrix = F.lit(rows).cast("array<array<double>>")
    halfway = F.transform(matrix, lambda d: F.transform(places, lambda j: product(d, F.transform(places, lambda i: F.get(values, i * width + j).cast("double")))))
    return F.flatten(F.transform(halfway, lambda half: F.transform(matrix, lambda d: product(d, half))))


def dct_bits(values: Column, width: int) -> Column:
    """`phash_of` a frame, on the JVM."""
    return median_bits(low_frequencies(values, width))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def laplacian_variance(values: Column, width: int) -> Column:
    """Sharpness of a square frame of `width` columns on the JVM, in doubles."""
    inner = [r * width + c for r in range(1, width - 1) for c in range(1, width - 1)]

    def at(k: int) -> Column:
        return F.get(values, F.lit(k)).cast("double")

    edges = F.array(*[at(k - width) + at(k + width) + at(k - 1) + at(k + 1) - 4 * at(k) for k in inner])
    mean = F.aggregate(edges, F.lit(0.0), lambda a, x: a + x) / len(inner)
    return F.aggregate(edges, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(inner)
