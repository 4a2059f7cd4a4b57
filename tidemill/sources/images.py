"""Pixel features of image files, decoded on the JVM by Spark's image source (JPEG, PNG, GIF, BMP)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemill.functions.pixels import brightness_of, phash_of, sharpness_of
from tidemill.session import shared_files

LONG_SIDE = 256
FEATURES = StructType([StructField("phash", LongType()), *[StructField(c, DoubleType()) for c in ("sharpness", "brightness", "dark_p99")], StructField("decode_error", StringType())])


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-averaged to another size; enlarging repeats pixels."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        cells = np.arange(old)
        overlap = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
        return np.clip(overlap, 0, None) * new / old

    return weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of BGR(A) or gray bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return pixels[:, :, 0] if channels == 1 else np.floor((pixels[:, :, 2] * 299 + pixels[:, :, 1] * 587 + pixels[:, :, 0] * 114) / 1000)


def oriented(gray: np.ndarray, orientation: int | None) -> np.ndarray:
    """A frame as EXIF orientation 1 to 8 shows it."""
    turned = {2: lambda g: g[:, ::-1], 3: lambda g: g[::-1, ::-1], 4: lambda g: g[::-1], 5: lambda g: g.T, 6: lambda g: np.rot90(g, -1), 7: lambda g: np.rot90(g, 2).T, 8: np.rot90}
    return turned.get(orientation, lambda g: g)(gray)


@F.pandas_udf(FEATURES)
def pixel_features(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, orientation: pd.Series) -> pd.DataFrame:
    """Features of frames as their EXIF orientation shows them."""
    rows = []
    for raw, h, w, c, turn in zip(data, height, width, channels, orientation, strict=True):
        if raw is None or h <= 0 or w <= 0:
            rows.append((None, None, None, None, "cannot decode image"))
            continue
        gray = gray_of(raw, h, w, c)
        if max(h, w) > LONG_SIDE:
            scale = LONG_SIDE / max(h, w)
            gray = resized(gray, max(1, round(h * scale)), max(1, round(w * scale)))
        gray = oriented(gray, None if pd.isna(turn) else int(turn))
        mean, p99 = brightness_of(gray)
        rows.append((phash_of(resized(gray, 32, 32)), round(sharpness_of(gray), 3), round(mean, 4), round(p99, 4), None))
    return pd.DataFrame(rows, columns=FEATURES.names).astype({"phash": "Int64"})


#: Longest side from which an embedded preview stands for its photo.
LEAST_PREVIEW = 96


def write_previews(photos: DataFrame, folder: str) -> None:
    """Writes the embedded JPEG of each of `photos` (id, path, preview_offset, preview_length) to `folder`/<id mod 1024>/<id>.jpg, from executors."""

    def written(rows: Iterator) -> None:
        files, base = shared_files(folder)
        for row in rows:
            try:
                with open(row["path"], "rb") as f:
                    f.seek(row["preview_offset"])
                    data = f.read(row["preview_length"] or 0)
            except OSError:  # gone since it was listed
                continue
            own = f"{base}/{row['id'] % 1024}"
            files.create_dir(own, recursive=True)
            with files.open_output_stream(f"{own}/{row['id']}.jpg") as out:
                out.write(data)

    shared_files(folder)[0].create_dir(shared_files(folder)[1], recursive=True)
    photos.select("id", "path", "preview_offset", "preview_length").foreachPartition(written)


def preview_features(photos: DataFrame, folder: str) -> DataFrame:
    """id, phash, sharpness, brightness, dark_p99 of photos by their embedded previews (`write_previews`), turned by their orientation; small ones have none."""
    path = F.concat(F.lit(shared_files(folder)[1] + "/"), F.col("id") % 1024, F.lit("/"), F.col("id"), F.lit(".jpg"))
    turned = photos.filter(F.col("orientation").isNotNull() & (F.col("orientation") != 1)).select(path.alias("path"), "orientation")
    found = image_features(photos.sparkSession, [folder], turned, least_side=LEAST_PREVIEW)
    return found.filter("phash IS NOT NULL").select(F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long").alias("id"), "phash", "sharpness", "brightness", "dark_p99")


def image_features(spark: SparkSession, paths: list[str], orientations: DataFrame | None = None, *, least_side: int = 0) -> DataFrame:
    """path, phash, sharpness, brightness, dark_p99, decode_error of the images under `paths`, turned as `orientations` (path, orientation) say."""
    # paths are taken as patterns, so what means something in one is escaped
    images = spark.read.format("image").option("recursiveFileLookup", True).load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    # origins are encoded as in a URL, where a plus is a plus
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    own = images.select("image.*", F.regexp_replace(origin, "^file:(//)?", "").alias("path"))
    own = own.filter(F.greatest("height", "width") >= least_side) if least_side else own
    turned = own.withColumn("orientation", F.lit(None).cast("int")) if orientations is None else own.join(F.broadcast(orientations), "path", "left")
    return turned.withColumn("f", pixel_features("data", "height", "width", "nChannels", "orientation")).select("path", "f.*")
