"""Pixels of image files as arrays: 8-bit files by the image source, score maps in .npy by the binary source."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "path string, h int, w int, gray array<double>"


def to_gray(a: np.ndarray, bgr: bool = False) -> np.ndarray:
    """Luminance of the first three channels; two channels are an error."""
    a = np.asarray(a, float)
    if a.ndim == 2:
        return a
    if a.ndim != 3 or a.shape[2] == 2:
        raise ValueError(f"Expected a 2D image or an image with 1, 3 or more channels, got shape {a.shape}.")
    if a.shape[2] == 1:
        return a[..., 0]
    c = a[..., 2::-1] if bgr else a[..., :3]
    return c @ np.array([0.2126, 0.7152, 0.0722])


def read_gray(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, h, w, gray): one row per readable image."""

    def run(frames):
        for f in frames:
            rows = []
            for o, h, w, n, d in zip(f["origin"], f["height"], f["width"], f["nChannels"], f["data"]):
                a = np.frombuffer(bytes(d), np.uint8).reshape(h, w, n)
                rows.append((o, h, w, to_gray(a, bgr=True).ravel()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "gray"])

    out = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*").mapInPandas(run, PIXELS)
    return out.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def read_arrays(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, h, w, gray) of .npy files."""

    def run(frames):
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"]):
                a = to_gray(np.load(io.BytesIO(bytes(content)), allow_pickle=False))
                rows.append((p, *a.shape, a.ravel()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "gray"])

    out = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(paths).select("path", "content").mapInPandas(run, PIXELS)
    return out.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def as_mask(gray: str = "gray"):
    """A mask is on where it isn't zero."""
    return F.transform(gray, lambda x: x != 0)
