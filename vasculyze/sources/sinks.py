"""Sinks: tables, sorted JSON, masks as PNG and score maps as .npy."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Parquet or CSV with a header; CSV comes as one file."""
    out = df.coalesce(1).write.option("header", True) if format == "csv" else df.write
    out.mode("overwrite").format(format).save(path)
    return path


def to_json(value, indent: int | None = None) -> str:
    def plain(v):
        if isinstance(v, np.generic):
            return v.item()
        return v.tolist() if isinstance(v, np.ndarray) else str(v)

    return json.dumps(value, sort_keys=True, indent=indent, default=plain)


def write_json(value, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json(value, 2) + "\n")
    return path


def read_json(path: str) -> dict:
    """A metrics file, or {} where it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
    except (OSError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def png(mask: np.ndarray) -> bytes:
    """A binary mask as an 8-bit gray PNG of 0 and 255."""
    h, w = mask.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = mask.astype(np.uint8) * 255
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def safe_stem(text: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in text).strip("_") or "image"


def write_masks(df: DataFrame, folder: str) -> DataFrame:
    """Writes a PNG (and a .npy of the score, where there is one) per row of (image_id, method, h, w, mask, score) to a folder that
    all executors share; a retried task writes the same files again. Returns (image_id, method, pred_mask_path, score_path)."""

    def run(frames):
        os.makedirs(f"{folder}/masks", exist_ok=True)
        os.makedirs(f"{folder}/scores", exist_ok=True)
        for f in frames:
            out = []
            for i, method, h, w, mask, score in zip(f["image_id"], f["method"], f["h"], f["w"], f["mask"], f["score"]):
                name = safe_stem(f"{i}_{method}")
                pred, scored = f"{folder}/masks/{name}.png", f"{folder}/scores/{name}.npy" if score is not None else None
                with open(pred, "wb") as file:
                    file.write(png(np.asarray(mask, bool).reshape(h, w)))
                if scored:
                    np.save(scored, np.asarray(score, np.float32).reshape(h, w))
                out.append((str(i), method, pred, scored))
            yield pd.DataFrame(out, columns=["image_id", "method", "pred_mask_path", "score_path"])

    rows = df.where("mask is not null").select(F.col("image_id").cast("string"), "method", "h", "w", "mask", "score")
    return rows.mapInPandas(run, "image_id string, method string, pred_mask_path string, score_path string")
