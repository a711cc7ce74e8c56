"""Outliers of a feature table within groups: robust z, distance, leverage on two principal components.

A group is summarised by aggregates (medians, spreads, a covariance matrix of the features); only that matrix reaches Python,
and rows get their scores from columns of their group, so no task holds a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..sources.adapters import FEATURES, cohort


def _beside(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the facts of their group; null keys meet null keys."""
    if not keys:
        return df.crossJoin(F.broadcast(facts))  # one row
    named = facts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = c if on is None else on & c
    return df.join(named, on).drop(*[f"_k_{k}" for k in keys])


def _once(df: DataFrame) -> DataFrame:
    """Computed once, as later steps read it twice each: checkpointed where the cluster names a folder, else cached with spill to disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def robust_z(df: DataFrame, features, by=("layer",)) -> DataFrame:
    """Adds z__<feature>: missing values count as the median; the scale is 1.4826 MAD, else the deviation, else 1. A feature without a value is null."""
    features, by = list(features), list(by)
    v = _once(df).withColumns({f"_v_{f}": finite(F.col(f).try_cast("double")) for f in features})
    v = _beside(v, v.groupBy(*by).agg(*[F.median(f"_v_{f}").alias(f"_m_{f}") for f in features]), by)
    v = v.withColumns({f"_v_{f}": F.coalesce(f"_v_{f}", f"_m_{f}") for f in features})
    v = _beside(v, v.groupBy(*by).agg(*[(F.median(F.abs(F.col(f"_v_{f}") - F.col(f"_m_{f}"))) * 1.4826).alias(f"_a_{f}") for f in features], *[F.stddev_samp(f"_v_{f}").alias(f"_s_{f}") for f in features]), by)
    scale = lambda f: F.when(F.col(f"_a_{f}") > 0, F.col(f"_a_{f}")).when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(F.lit(1.0))
    v = v.withColumns({f"z__{f}": (F.col(f"_v_{f}") - F.col(f"_m_{f}")) / scale(f) for f in features})
    return v.drop(*[f"_{p}_{f}" for p in "vmas" for f in features])


def _axes(z: DataFrame, features, by, k: int = 2) -> DataFrame:
    """Per group its size and up to k principal axes (flattened), of the covariance of the z columns."""
    p = len(features)
    c = [F.coalesce(F.col(f"z__{f}"), F.lit(0.0)) for f in features]
    facts = z.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.covar_samp(c[i], c[j]) for i in range(p) for j in range(p)]).alias("_c"))

    def solve(frames):
        for f in frames:
            axes = []
            for n, flat in zip(f["_n"], f["_c"]):
                out = np.zeros((k, p))
                if n >= 3:
                    values, vectors = np.linalg.eigh(np.nan_to_num(np.array([0.0 if x is None else x for x in flat], float)).reshape(p, p))
                    top = np.argsort(values)[::-1][: min(k, p, n - 1)]
                    out[: len(top)] = vectors[:, top].T
                axes.append(out.ravel())
            yield pd.DataFrame({**{b: f[b] for b in by}, "_n": f["_n"], "_axes": axes})

    types = dict(facts.dtypes)
    return facts.mapInPandas(solve, ", ".join([*(f"`{b}` {types[b]}" for b in by), "_n long, _axes array<double>"]))


def outlier_scores(df: DataFrame, features, by=("layer",)) -> DataFrame:
    """Adds to each row z__<feature>, its largest and mean size, distance, leverage with its group's threshold, the five most
    extreme features as text, and is_feature_outlier. Groups under three rows have no leverage; under five none is flagged by it."""
    features, by = list(features), list(by)
    z = _once(robust_z(df, features, by))
    z = _beside(z, _axes(z, features, by), by)
    p = len(features)
    filled = [F.coalesce(F.col(f"z__{f}"), F.lit(0.0)) for f in features]
    z = z.withColumns({f"_t{a}": sum((filled[i] * F.col("_axes")[a * p + i] for i in range(p)), F.lit(0.0)) for a in (0, 1)})
    z = _beside(z, z.groupBy(*by).agg(F.median("_t0").alias("_c0"), F.median("_t1").alias("_c1")), by)
    z = z.withColumn("pca_leverage_score", F.when(F.col("_n") >= 3, F.pow(F.col("_t0") - F.col("_c0"), 2) + F.pow(F.col("_t1") - F.col("_c1"), 2)).otherwise(0.0))
    z = _once(z)
    z = _beside(z, z.groupBy(*by).agg(F.when(F.count(F.lit(1)) < 5, F.max("pca_leverage_score") + 1).otherwise(F.greatest(F.lit(3.0), F.percentile("pca_leverage_score", 0.95))).alias("pca_leverage_threshold")), by)
    size = F.array_compact(F.array(*[F.abs(f"z__{f}") for f in features]))
    total = lambda a, g: F.aggregate(a, F.lit(0.0), lambda s, x: s + g(x))
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(F.coalesce(F.col(f"z__{f}"), F.lit(0.0)))).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("f"), F.col(f"z__{f}").alias("z")) for i, f in enumerate(features)]))
    out = z.withColumns(
        {
            "max_abs_zscore": F.coalesce(F.array_max(size), F.lit(0.0)),
            "mean_abs_zscore": F.coalesce(F.try_divide(total(size, lambda x: x), F.size(size)), F.lit(0.0)),
            "robust_mahalanobis_distance": F.sqrt(total(size, lambda x: x * x)) / max(1, p) ** 0.5,
            "n_extreme_features_abs_z_gt_3": F.size(F.filter(size, lambda x: x > 3)),
            "top_extreme_features": F.array_join(F.transform(F.slice(ranked, 1, 5), lambda r: F.format_string("%s:%.2f", r["f"], r["z"])), ";"),
        }
    )
    out = out.withColumn("is_feature_outlier", (F.col("max_abs_zscore") > 3) | (F.col("pca_leverage_score") > F.col("pca_leverage_threshold")))
    return out.drop("_n", "_axes", "_t0", "_t1", "_c0", "_c1")


def feature_outliers(spark, sf_dir):
    return outlier_scores(cohort(spark, sf_dir), FEATURES)


QUERIES = {"feature_outliers": feature_outliers}
