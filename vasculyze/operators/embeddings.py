"""Maps of a feature table: exact scaling, separation of groups, t-SNE, and what needs libraries that aren't here."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, normalize_diagnosis
from ..sources.adapters import FEATURES, cohort


def prepare(df: DataFrame, features, scaler: str = "robust") -> tuple[DataFrame, dict]:
    """x__<feature> imputed by the median (0 where nothing is known) and scaled by quartiles or population deviation; with what was done."""
    if scaler not in ("robust", "standard", "none"):
        raise ValueError("scaler must be 'robust', 'standard', or 'none'.")
    features = list(features)
    v = df.withColumns({f"x__{f}": finite(F.col(f).try_cast("double")) for f in features})
    m = v.agg(*[F.median(f"x__{f}").alias(f) for f in features], *[F.count_if(F.col(f"x__{f}").isNull()).alias(f"n_{f}") for f in features]).head()
    medians = {f: m[f] if m[f] is not None else 0.0 for f in features}
    v = v.withColumns({f"x__{f}": F.coalesce(f"x__{f}", F.lit(medians[f])) for f in features})
    facts = {"feature_cols": features, "scaler": scaler, "impute": "median", "imputation_counts_by_feature": {f: m[f"n_{f}"] for f in features}, "n_missing_values_imputed": sum(m[f"n_{f}"] for f in features), "imputation_medians": medians}
    if scaler == "none":
        return v, facts
    if scaler == "robust":
        s = v.agg(*[F.percentile(f"x__{f}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in features]).head()
        center, scale = {f: s[f][1] for f in features}, {f: (s[f][2] - s[f][0]) or 1.0 for f in features}
    else:
        s = v.agg(*[F.avg(f"x__{f}").alias(f) for f in features], *[F.stddev_pop(f"x__{f}").alias(f"s_{f}") for f in features]).head()
        center, scale = {f: s[f] for f in features}, {f: s[f"s_{f}"] or 1.0 for f in features}
    facts |= {"scaler_center": list(center.values()), "scaler_scale": list(scale.values())}
    return v.withColumns({f"x__{f}": (F.col(f"x__{f}") - F.lit(center[f])) / F.lit(scale[f]) for f in features}), facts


#: Different points of a block; squares of them are what a task measures at once.
BLOCK = 65_536


def _distances(p: np.ndarray, q: np.ndarray, wp: np.ndarray, wq: np.ndarray, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """For each point of p the summed distance to the points of q by their weights (a column a group), and the same for q."""
    to_p, to_q = np.empty((len(p), 2)), np.zeros((len(q), 2))
    for i in range(0, len(p), step):
        d = p[i : i + step, :1] - q[:, 0]
        d *= d
        e = p[i : i + step, 1:] - q[:, 1]
        e *= e
        d += e
        np.sqrt(d, out=d)
        to_p[i : i + step] = d @ wq
        to_q += d.T @ wp[i : i + step]
    return to_p, to_q


def coordinate_columns(df: DataFrame) -> list[str]:
    for pair in (["component_1", "component_2"], ["x", "y"]):
        if set(pair) <= set(df.columns):
            return pair
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double") and not c.startswith("subject")]
    if len(numeric) < 2:
        raise ValueError("Could not infer two coordinate columns.")
    return numeric[:2]


def group_separation(coords: DataFrame, label: str = "diagnosis", n_permutations: int = 1000, random_state: int = 0) -> DataFrame:
    """One row: sizes, distance of the groups' centroids, its permutation p, silhouette by Euclidean distance (a lone point counts 0).

    Equal points are one with weights. Blocks of different points are permuted on their own once it is drawn how many of group AD
    fall into each, and every pair of blocks is a task of the silhouette's, so no task grows with the table; the silhouette
    takes time by the square of the different points."""
    x, y = coordinate_columns(coords)
    rows = coords.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), normalize_diagnosis(F.col(label)).alias("g")).where("g <> 'unknown'")
    points = rows.groupBy("x", "y").agg(F.count_if(F.col("g") == "AD").alias("a"), F.count_if(F.col("g") != "AD").alias("b"))
    points = points.withColumn("h", F.xxhash64("x", "y")).persist(StorageLevel.DISK_ONLY)
    try:
        blocks = max(1, -(-points.count() // BLOCK))
        return _separation(points.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")), blocks, n_permutations, random_state)
    finally:
        points.unpersist()


def _separation(points: DataFrame, blocks: int, n_permutations: int, random_state: int) -> DataFrame:
    spark = points.sparkSession
    schema = "n_group_a long, n_group_b long, centroid_distance double, n_permutations int, p_value double, silhouette_score double"
    sums = points.groupBy("block").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("block").toPandas()
    n, m = int(sums["a"].sum()), int(sums["b"].sum())
    if not n or not m:
        return spark.createDataFrame([(n, m, None, n_permutations, None, None)], schema)
    # Of how many the blocks have in each permutation, those of group AD; the first row is as it is.
    drawn = np.random.default_rng(random_state).multivariate_hypergeometric((sums["a"] + sums["b"]).to_numpy(), n, n_permutations, method="marginals")
    share = dict(zip(sums["block"].tolist(), drawn.T))
    mean = points.agg((F.sum(F.col("x") * (F.col("a") + F.col("b"))) / (n + m)).alias("x"), (F.sum(F.col("y") * (F.col("a") + F.col("b"))) / (n + m)).alias("y")).head()

    def permuted(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        p, a, w = pdf[["x", "y"]].to_numpy() - np.array([mean["x"], mean["y"]]), pdf["a"].to_numpy(), (pdf["a"] + pdf["b"]).to_numpy()
        rng = np.random.default_rng([random_state, int(key[0])])
        alone = bool((w == 1).all())
        out = [a.astype(float) @ p]
        for k in share[int(key[0])]:
            out.append(p[rng.permutation(len(w))[:k]].sum(0) if alone else rng.multivariate_hypergeometric(w, k, method="marginals").astype(float) @ p)
        out = np.array(out)
        return pd.DataFrame({"k": np.arange(len(out)), "block": int(key[0]), "x": out[:, 0], "y": out[:, 1]})

    moved = points.groupBy("block").applyInPandas(permuted, "k int, block int, x double, y double")
    # Centroids are apart by (1/n + 1/m) times the sum of group AD about the mean; equal splits may differ in the last bits.
    t = moved.groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).orderBy("k").toPandas()
    gap = np.hypot(t["x"], t["y"]).to_numpy() * (1 / n + 1 / m)
    p_value = (int((gap[1:] >= gap[0] * (1 - 1e-9)).sum()) + 1) / (n_permutations + 1)
    score = None
    if n + m >= 3:
        score = _silhouette(points, blocks, n, m)
    return spark.createDataFrame([(n, m, float(gap[0]), n_permutations, p_value, score)], schema)


def _silhouette(points: DataFrame, blocks: int, n: int, m: int) -> float:
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = points.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def measured(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        i, j = (pdf[pdf["block"] == k] for k in key)
        at = [v[["x", "y"]].to_numpy() for v in (i, j)]
        w = [v[["a", "b"]].to_numpy().astype(float) for v in (i, j)]
        to_i, to_j = _distances(*at, *w)
        both, d = (i, to_i) if key[0] == key[1] else (pd.concat([i, j]), np.concatenate([to_i, to_j]))
        return pd.DataFrame({"x": both["x"].to_numpy(), "y": both["y"].to_numpy(), "a": both["a"].to_numpy(), "b": both["b"].to_numpy(), "da": d[:, 0], "db": d[:, 1]})

    d = pairs.select("i", "j", "block", "x", "y", "a", "b").groupBy("i", "j").applyInPandas(measured, "x double, y double, a bigint, b bigint, da double, db double")
    d = d.groupBy("x", "y").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("da").alias("da"), F.sum("db").alias("db"))
    one = lambda own, far, size, rest: F.lit(0.0) if size < 2 else F.when(F.greatest(F.col(own) / (size - 1), F.col(far) / rest) > 0, (F.col(far) / rest - F.col(own) / (size - 1)) / F.greatest(F.col(own) / (size - 1), F.col(far) / rest)).otherwise(0.0)
    return d.agg((F.sum(F.col("a") * one("da", "db", n, m) + F.col("b") * one("db", "da", m, n)) / (n + m)).alias("s")).head()["s"]


def perplexity(n: int) -> int:
    return min(min(10, max(5, (n - 1) // 4)), n - 1)


def tsne(x: np.ndarray, random_state: int = 0, rounds: int = 1000) -> np.ndarray:
    """Exact t-SNE of a small matrix (van der Maaten and Hinton 2008): affinities to the perplexity, momentum, early exaggeration."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want, p = math.log(perplexity(n)), np.zeros((n, n))
    for i in range(n):
        low, high, beta, row = 0.0, math.inf, 1.0, np.delete(d[i], i)
        for _ in range(60):
            e = np.exp(-(row - row.min()) * beta)
            entropy = math.log(e.sum()) + beta * float(((row - row.min()) * e).sum()) / e.sum()
            if abs(entropy - want) < 1e-6:
                break
            low, high = (beta, high) if entropy > want else (low, beta)
            beta = beta * 2 if high == math.inf else (low + high) / 2
        p[i] = np.insert(e / e.sum(), i, 0)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(random_state).normal(0, 1e-4, (n, 2))
    move, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 10)
    for t in range(rounds):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(q, 0)
        w = (p * (12 if t < 250 else 1) - np.maximum(q / q.sum(), 1e-12)) * q
        g = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 250 else 0.8) * move - rate * gain * g
        y = y + move - (y + move).mean(0)
    return y


def umap(*_args, **_kwargs):
    try:
        import umap  # noqa: F401
    except ImportError as e:
        raise ImportError("UMAP embedding needs the optional package umap-learn.") from e
    raise NotImplementedError("UMAP isn't wired up; use principal components or t-SNE.")


def deep_comparators(*_args, **_kwargs):
    try:
        import torch  # noqa: F401
    except ImportError as e:
        raise RuntimeError("Deep comparators need the optional package torch.") from e
    raise NotImplementedError("Deep comparators are deferred.")


def _deferred(what: str):
    def fail(*_args, **_kwargs):
        raise NotImplementedError(f"{what} is deferred: it needs validated artery and vein labels.")

    return fail


segment_arteries_and_veins = _deferred("Artery and vein segmentation")
detect_optic_disc = _deferred("Optic disc detection")
measure_zone_b_widths = _deferred("Measurement of vessel widths in zone B")
automated_avr = _deferred("An automated arteriole-to-venule ratio")


def separation(spark, sf_dir):
    d, _ = prepare(cohort(spark, sf_dir).groupBy("subject_id").agg(F.max("raw_diagnosis").alias("diagnosis"), *[F.avg(f).alias(f) for f in FEATURES]), FEATURES)
    return group_separation(d.select("diagnosis", F.col("x__quantity").alias("component_1"), F.col("x__price").alias("component_2")), n_permutations=200)


QUERIES = {"separation": separation}
