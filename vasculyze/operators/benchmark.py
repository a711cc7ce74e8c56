"""Segmenters and score maps against manual masks: one row per image and method, with a failure's text instead of a failure."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import to_json
from .kernels import fundus_vector, masks
from .segment import SEGMENTERS, postprocess

METRICS = ("dice", "iou", "precision", "recall", "specificity")
FEATURE_NAMES = tuple(fundus_vector(np.zeros((8, 8), bool)))
_PAIRED = [f"{kind}_{n}" for n in FEATURE_NAMES for kind in ("manual", "predicted", "abs_error", "rel_error")]
_COLUMNS = ["method", "runtime_seconds", "params_json", "diagnostics_json", "error", *METRICS, *_PAIRED]
_SCHEMA = "method string, runtime_seconds double, params_json string, diagnostics_json string, error string, " + ", ".join(f"{c} double" for c in (*METRICS, *_PAIRED)) + ", mask array<boolean>, score array<double>"


def overlap(true: np.ndarray, got: np.ndarray, fov: np.ndarray | None = None) -> dict[str, float]:
    """Overlap inside the field of view; an empty denominator gives 1."""
    t, g = np.asarray(true, bool), np.asarray(got, bool)
    if t.shape != g.shape:
        raise ValueError(f"Mask shapes differ: {t.shape} and {g.shape}.")
    if fov is not None:
        t, g = t[np.asarray(fov, bool)], g[np.asarray(fov, bool)]
    tp, fp, fn, tn = int((t & g).sum()), int((~t & g).sum()), int((t & ~g).sum()), int((~t & ~g).sum())
    part = lambda a, b: a / b if b else 1.0
    return {"dice": part(2 * tp, 2 * tp + fp + fn), "iou": part(tp, tp + fp + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "specificity": part(tn, tn + fp)}


def feature_errors(manual: dict[str, float], predicted: dict[str, float]) -> dict[str, float]:
    a, b, out = manual, predicted, {}
    for n in FEATURE_NAMES:
        gap = abs(b[n] - a[n])
        out |= {f"manual_{n}": a[n], f"predicted_{n}": b[n], f"abs_error_{n}": gap, f"rel_error_{n}": gap / abs(a[n]) if a[n] else (0.0 if b[n] == 0 else float("inf"))}
    return out


def _planes(row: dict):
    shape = (row["h"], row["w"])
    plane = lambda c, kind: None if row.get(c) is None else np.asarray(row[c], kind).reshape(shape)
    return plane("gray", float), plane("mask", bool), plane("fov", bool)


def _run(images: DataFrame, tries: list[dict], attempt, keep_planes: bool, extra: tuple[str, ...] = (), continue_on_error: bool = True) -> DataFrame:
    """Each image with each try. An image is read once; `tries` is a short list of methods and parameters."""
    ids = [f"`{c}` {t}" for c, t in images.dtypes if c not in ("gray", "mask", "fov", "score", "h", "w")]
    names = [c for c in images.columns if c not in ("gray", "mask", "fov", "score", "h", "w")]
    more = {"requested_method": "string", "candidate_index": "int", "candidate_params_json": "string"}

    def work(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                manual = None  # the manual mask's features, once for all tries
                for t in tries:
                    base = dict.fromkeys(columns) | {c: row[c] for c in names} | {c: t[c] for c in extra}
                    began = time.perf_counter()
                    try:
                        gray, true, fov = _planes(row)
                        method, mask, score, params, facts = attempt(row, t, gray, fov)
                        took = time.perf_counter() - began
                        manual = manual or fundus_vector(true, fov)
                        new = {"method": method, "runtime_seconds": took, "params_json": to_json(params), "diagnostics_json": to_json(facts), **overlap(true, mask, fov), **feature_errors(manual, fundus_vector(mask, fov))}
                        if keep_planes:
                            new |= {"mask": mask.ravel(), "score": None if score is None else np.asarray(score, float).ravel()}
                    except Exception as e:
                        if not continue_on_error:
                            raise
                        new = {"method": t["method"], "runtime_seconds": time.perf_counter() - began, "params_json": to_json(t["params"]), "error": str(e)}
                    out.append(base | new)
            yield pd.DataFrame(out, columns=columns, dtype=object)

    columns = [*names, *extra, *_COLUMNS, "mask", "score"]
    schema = ", ".join([*ids, *(f"{c} {more[c]}" for c in extra), _SCHEMA])
    out = images.mapInPandas(work, schema)
    return out if keep_planes else out.drop("mask", "score")


def _segment(row, t, gray, fov):
    r = SEGMENTERS[t["method"]](gray, fov, **t["params"])
    return r.method, r.mask, r.score, r.params, r.diagnostics


def _scored(row, t, gray, fov):
    if row.get("score") is None:
        raise ValueError("prediction path is missing.")
    mask = postprocess(np.asarray(row["score"], float).reshape(row["h"], row["w"]), fov_mask=fov, **t["params"])
    return t["method"], mask, None, t["params"], {"vessel_pixels": int(mask.sum())}


def _check(methods) -> list[str]:
    unknown = [m for m in methods if m not in SEGMENTERS]
    if unknown:
        raise ValueError(f"Unknown segmentation methods: {', '.join(unknown)}. Known: {', '.join(SEGMENTERS)}.")
    return list(methods)


def params_of(method: str, given: Mapping[str, Mapping] | None) -> dict:
    """Parameters by the method's alias, overridden by those of its function's name."""
    return dict((given or {}).get(method, {})) | dict((given or {}).get(SEGMENTERS[method].__name__, {}))


def benchmark(images: DataFrame, methods: Sequence[str] = ("frangi", "diffusion_threshold", "random_walker", "geodesic_voting"), params: Mapping[str, Mapping] | None = None, keep_planes: bool = False, continue_on_error: bool = True) -> DataFrame:
    """(image_id, h, w, gray, mask[, fov], ...) with each method. keep_planes adds the predicted mask and score for a sink."""
    return _run(images, [{"method": m, "params": params_of(m, params)} for m in _check(methods)], _segment, keep_planes, (), continue_on_error)


def benchmark_predictions(images: DataFrame, method: str) -> DataFrame:
    """Given masks (column score, on where above 0) against manual ones; a null score is a row with an error."""
    return _run(images.withColumn("score", F.transform("score", lambda x: (x > 0).cast("double"))), [{"method": method, "params": {"min_size": 0}}], _scored, False)


def evaluate_scores(images: DataFrame, method: str, params: Mapping | None = None, keep_planes: bool = False) -> DataFrame:
    return _run(images, [{"method": method, "params": dict(params or {})}], _scored, keep_planes)


def expand_grid(grid) -> list[dict]:
    """A mapping is the product of its values in key order; a sequence is taken as it is."""
    if not isinstance(grid, Mapping):
        return [dict(g) for g in grid]
    many = lambda v: list(v) if isinstance(v, Sequence) and not isinstance(v, (str, bytes)) else [v]
    return [dict(zip(grid, v)) for v in product(*[many(x) for x in grid.values()])]


_TUNED = ("requested_method", "candidate_index", "candidate_params_json")


def _candidates(method: str, grid) -> list[dict]:
    out = [{"method": method, "params": p, "requested_method": method, "candidate_index": i, "candidate_params_json": to_json(p)} for i, p in enumerate(expand_grid(grid))]
    if not out:
        raise ValueError("param_grid must contain at least one candidate.")
    return out


def tune_scores(images: DataFrame, method: str, grid) -> DataFrame:
    return _run(images, _candidates(method, grid), _scored, False, _TUNED)


def tune_segmenters(images: DataFrame, grids: Mapping[str, object]) -> DataFrame:
    return _run(images, [c for m in _check(grids) for c in _candidates(m, grids[m])], _segment, False, _TUNED)


def summarize(tuning: DataFrame, score: str = "dice", higher_is_better: bool = True) -> DataFrame:
    """A row per candidate with means over its successes; per requested method the best is selected: score, then density error, time, index."""
    absent = [c for c in ("requested_method", "method", "candidate_index", "candidate_params_json", "error", score) if c not in tuning.columns]
    if absent:
        raise ValueError(f"Missing tuning columns: {', '.join(absent)}")
    wanted = dict.fromkeys((score, "iou", "precision", "recall", "specificity", "abs_error_vessel_density", "abs_error_skeleton_length_density", "runtime_seconds"))
    ok = F.col("error").isNull()
    s = tuning.groupBy("requested_method", "method", "candidate_index", "candidate_params_json").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_success"), *[F.avg(F.when(ok, F.col(c))).alias(f"mean_{c}") for c in wanted if c in tuning.columns])
    first = F.desc_nulls_last(f"mean_{score}") if higher_is_better else F.asc_nulls_last(f"mean_{score}")
    ties = [F.asc_nulls_last(c) for c in ("mean_abs_error_vessel_density", "mean_runtime_seconds", "candidate_index") if c in s.columns]
    w = Window.partitionBy("requested_method").orderBy(F.desc(F.col("n_success") > 0), first, *ties)
    return s.withColumn("selected", (F.row_number().over(w) == 1) & (F.col("n_success") > 0))


def best_params(summary: DataFrame) -> dict[str, dict]:
    """The selected parameters: a row per method."""
    import json

    return {r.requested_method: json.loads(r.candidate_params_json) for r in summary.where("selected").select("requested_method", "candidate_params_json").collect()}


def _images(spark, sf_dir) -> DataFrame:
    """A small file is one partition, but each image costs much work: spread them."""
    return masks(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "image_id")


def benchmark_with_errors(spark, sf_dir):
    return benchmark(_images(spark, sf_dir), params={"random_walker": {"min_size": 2}, "frangi": {"min_size": 2}}).drop("runtime_seconds", "diagnostics_json")


def score_tuning(spark, sf_dir):
    images = _images(spark, sf_dir).withColumn("score", F.transform("gray", lambda x: F.least(F.greatest(x + 0.5, F.lit(0.0)), F.lit(1.0))))
    return summarize(tune_scores(images, "unet", {"threshold": [0.4, 0.5, 0.6], "min_size": [0, 4]}).drop("runtime_seconds"))


QUERIES = {"benchmark_with_errors": benchmark_with_errors, "score_tuning": score_tuning}
