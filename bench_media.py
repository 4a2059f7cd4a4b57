"""The media run of the benchmark: N camera JPEGs of one body and different EXIF data, scanned, scanned again and classified."""

from __future__ import annotations

import os
import struct
import tempfile
import time

from pyspark.sql import SparkSession

from tidemill.plans import workspace as W


def jpeg_body(spark: SparkSession, width: int = 64, height: int = 48) -> bytes:
    """A small JPEG, encoded by the JVM."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, (x * 4 << 16) | (y * 5 << 8) | (x * y % 256))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def exif(k: int) -> bytes:
    """An APP1 segment with make, model and a capture time of its own."""
    taken = time.strftime("%Y:%m:%d %H:%M:%S", time.gmtime(1_262_304_000 + k * 7919 % 315_360_000)).encode() + b"\0"
    texts, at = [(0x10F, b"Camera\0\0"), (0x110, b"Model 1\0"), (0x9003, taken)], 8 + 2 + 12 * 2 + 12 + 4
    ifd, data = [], b""
    for tag, text in texts[:2]:
        ifd.append(struct.pack("<HHII", tag, 2, len(text), at + len(data)))
        data += text
    sub = at + len(data)
    ifd.append(struct.pack("<HHII", 0x8769, 4, 1, sub))
    inner = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(taken), sub + 18) + struct.pack("<I", 0) + taken
    body = b"Exif\0\0II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(ifd) + struct.pack("<I", 0) + data + inner
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def run(spark: SparkSession, files: int = 50_000) -> dict[str, float]:
    """Seconds of the first scan, a scan without changes, and the classification of all categories."""
    body, took = jpeg_body(spark), {}
    with tempfile.TemporaryDirectory(prefix="tidemill-bench-") as base:
        for k in range(files):
            folder = os.path.join(base, "src", str(2010 + k % 12), f"{1 + k % 144 // 12:02d}")
            if k < 144:
                os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"IMG_{k:06d}.JPG"), "wb") as f:
                f.write(body[:2] + exif(k) + body[2:])
        ws = W.open_workspace(spark, os.path.join(base, "src"), os.path.join(base, "review"), os.path.join(base, "delete"))
        for name, step in (("media_scan", W.run_scan), ("media_rescan", W.run_scan), ("media_classify", W.run_classify)):
            began = time.time()
            out = step(ws)
            took[f"{name}_{files // 1000}k"] = round(time.time() - began, 3)
            if name == "media_scan" and out["new"] != files:
                raise RuntimeError(f"{out} instead of {files} new files")
        ws.close()
    return took
