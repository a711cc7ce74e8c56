"""Subjects and their layers: one row a subject, paired contrasts of layers, outlier flags joined back, effects with and without.

Every operator is a grouping by subject or a join on keys; nothing is gathered in one task. Each query's SQL twin is written
from the definition, not from the expressions here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, log_ratio, normalize_diagnosis, ratio
from ..sources.adapters import FEATURES, NEEDS, TWINS, cohort
from .outliers import robust_z

# The layers in their order, and the names of contrasts with the layers that they set against each other.
LAYERS = ("SVC", "DVC", "SVC+DVC")
PAIRS = {"DVC_SVC": ("DVC", "SVC"), "SVCplusDVC_SVC": ("SVC+DVC", "SVC"), "SVCplusDVC_DVC": ("SVC+DVC", "DVC")}
KINDS = ("minus", "div", "logratio")


def subject_diagnosis(label: Column) -> Column:
    """Of a subject's rows: the one group that they name; conflict if they name both, unknown if none."""
    named = F.array_remove(F.collect_set(normalize_diagnosis(label)), "unknown")
    return F.when(F.size(named) == 1, F.element_at(named, 1)).when(F.size(named) == 0, "unknown").otherwise("conflict")


def join_unique(c: Column) -> Column:
    """The distinct texts that aren't empty, ascending, with semicolons between."""
    return F.array_join(F.array_sort(F.array_remove(F.collect_set(c.cast("string")), "")), ";")


def _number(c: str) -> Column:
    return finite(F.col(c).try_cast("double"))


def _first(layer: str, feature: str, order) -> Column:
    """A feature's value in a subject's first row of a layer; null if there is none, or if it has no number."""
    here = F.col("layer") == layer
    return F.min_by(F.when(here, F.struct(_number(feature).alias("v"))), F.when(here, F.struct(*order)))["v"]


def _order(df: DataFrame, order) -> list[Column]:
    """The order in which a layer's rows are first: the named columns, then all others that can be compared."""
    plain = [c.name for c in df.schema.fields if "map<" not in c.dataType.simpleString()]
    return [F.col(c) for c in dict.fromkeys([*order, *plain])]


def _texts(df: DataFrame, names) -> list[Column]:
    return [join_unique(F.col(c)).alias(c) if c in df.columns else F.lit("").alias(c) for c in names]


def aggregate_subjects(df: DataFrame, features=FEATURES, order=()) -> DataFrame:
    """One row per subject: diagnosis, layers at hand and missing, each feature's mean, min, max, range and deviation over the
    layers, and its value in each layer's first row. Layers are never filled in. Text that is no number counts as missing; a
    deviation of fewer than two values is 0; null subjects have no row."""
    have, rows = F.array_sort(F.collect_set("layer")), _order(df, order)
    aggs = [subject_diagnosis(F.col("diagnosis")).alias("diagnosis"), *_texts(df, ["label_source"]), F.size(have).alias("n_layers_available"), F.array_join(F.array_except(F.array(*map(F.lit, LAYERS)), have), ",").alias("missing_layers")]
    aggs += [join_unique(F.col(c)).alias(c) for c in ("split_group", "official_split") if c in df.columns]
    for f in features:
        v = _number(f)
        aggs += [F.avg(v).alias(f"mean_{f}"), F.min(v).alias(f"min_{f}"), F.max(v).alias(f"max_{f}"), (F.max(v) - F.min(v)).alias(f"range_{f}"), F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0).alias(f"std_{f}")]
    aggs += [_first(layer, f, rows).alias(f"{layer}_{f}") for layer in LAYERS for f in features]
    return df.where("subject_id is not null").groupBy("subject_id").agg(*aggs)


def layer_contrasts(df: DataFrame, features=FEATURES, order=(), eps: float = 1e-8) -> DataFrame:
    """One row per subject: differences, ratios and log ratios of each pair of layers, null where a layer or its value lacks.

    A ratio's denominator has eps added, and a log ratio both sides, which must then be positive."""
    rows = _order(df, order)
    aggs = [subject_diagnosis(F.col("diagnosis")).alias("diagnosis"), *_texts(df, ["label_source"]), *[join_unique(F.col(c)).alias(c) for c in ("split_group",) if c in df.columns]]
    heads = [a for a in ("diagnosis", "label_source", "split_group") if a != "split_group" or a in df.columns]
    wide = df.where("subject_id is not null").groupBy("subject_id").agg(*aggs, *[_first(layer, f, rows).alias(f"_{i}_{f}") for i, layer in enumerate(LAYERS) for f in features])
    made = {"minus": lambda a, b: a - b, "div": lambda a, b: ratio(a, b, eps), "logratio": lambda a, b: log_ratio(a, b, eps)}
    out = []
    for kind in KINDS:
        for name, (a, b) in PAIRS.items():
            over, under = name.split("_")
            out += [made[kind](F.col(f"_{LAYERS.index(a)}_{f}"), F.col(f"_{LAYERS.index(b)}_{f}")).alias(f"{over}_{kind}_{under}_{f}") for f in features]
    return wide.select("subject_id", *heads, *out)


def attach_flags(df: DataFrame, flags: DataFrame, keys=("subject_id", "layer"), flag: str = "is_feature_outlier") -> DataFrame:
    """df with the flag of its key, false where flags have no row of it. A key that flags have twice is flagged if any is.
    Null keys meet null keys; a flag column that df has already is replaced."""
    once = flags.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias("_flag"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = c if on is None else on & c
    return df.drop(flag).join(once, on, "left").withColumn(flag, F.coalesce("_flag", F.lit(False))).drop("_flag", *[f"_k_{k}" for k in keys])


def drop_flagged(df: DataFrame, flags: DataFrame, keys=("subject_id", "layer"), flag: str = "is_feature_outlier") -> DataFrame:
    """df without flagged rows; with keys=("subject_id",), without every row of a subject that has one."""
    return attach_flags(df, flags, keys, flag).where(~F.col(flag)).drop(flag)


def group_effects(df: DataFrame, features=FEATURES, by=("layer",)) -> DataFrame:
    """Per group and feature: sizes and the difference of medians, AD less control."""
    rows = df.select(*by, normalize_diagnosis(F.col("diagnosis")).alias("_g"), *[_number(f).alias(f) for f in features]).unpivot([*by, "_g"], list(features), "feature", "_v")
    a, c = F.when(F.col("_g") == "AD", F.col("_v")), F.when(F.col("_g") == "control", F.col("_v"))
    return rows.groupBy(*by, "feature").agg(F.count(a).alias("n_AD"), F.count(c).alias("n_control"), (F.median(a) - F.median(c)).alias("diff_median_AD_minus_control"))


def outlier_sensitivity(full: DataFrame, filtered: DataFrame, keys=("analysis", "layer", "feature"), effect: str = "diff_median_AD_minus_control", p: str = "permutation_p") -> DataFrame:
    """Effects of all rows beside those without outliers, and what to make of it: too_few_samples where either lacks,
    outlier_sensitive where the sign turns or the effect moves by more than half of itself, else stable."""
    keys = [k for k in keys if k in full.columns and k in filtered.columns]
    pick = lambda d, c: finite(F.col(c).try_cast("double")) if c in d.columns else F.lit(None).cast("double")
    a = full.select(*keys, pick(full, effect).alias("effect_full"), pick(full, p).alias("p_full"))
    b = filtered.select(*[F.col(k).alias(f"_k_{k}") for k in keys], pick(filtered, effect).alias("effect_without_outliers"), pick(filtered, p).alias("p_without_outliers"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = c if on is None else on & c
    j = a.join(b, on, "left").withColumn("delta_effect", F.col("effect_without_outliers") - F.col("effect_full"))
    x, y = F.col("effect_full"), F.col("effect_without_outliers")
    turns = (x != 0) & (F.signum(x) != F.signum(y))
    flag = F.when(x.isNull() | y.isNull(), "too_few_samples").when(turns | (F.abs(y - x) > 0.5 * F.greatest(F.abs(x), F.lit(1e-12))), "outlier_sensitive").otherwise("stable")
    return j.select(*keys, "effect_full", "effect_without_outliers", "delta_effect", "p_full", "p_without_outliers", flag.alias("interpretation_flag"))


# Queries over the driver's tables, and their twins.


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _flags(df: DataFrame) -> DataFrame:
    """The part of the outlier rule that SQL can say: a robust z beyond 3 in any feature."""
    z = robust_z(df, FEATURES)
    return z.select("subject_id", "layer", (F.greatest(*[F.abs(f"z__{f}") for f in FEATURES]) > 3).alias("is_feature_outlier"))


def _outlier_table(spark, sf_dir):
    z = robust_z(cohort(spark, sf_dir), FEATURES)
    size = F.array(*[F.abs(f"z__{f}") for f in FEATURES])
    total = lambda g: F.aggregate(size, F.lit(0.0), lambda s, x: s + g(x))
    ranked = F.array_sort(F.array(*[F.struct((-F.round(F.abs(f"z__{f}"), 9)).alias("o"), F.lit(f).alias("f"), F.col(f"z__{f}").alias("z")) for f in FEATURES]))
    return _rounded(z.select("subject_id", "layer", *[f"z__{f}" for f in FEATURES], F.array_max(size).alias("max_abs_zscore"), (total(lambda x: x) / len(FEATURES)).alias("mean_abs_zscore"), (F.sqrt(total(lambda x: x * x)) / len(FEATURES) ** 0.5).alias("robust_mahalanobis_distance"), F.size(F.filter(size, lambda x: x > 3)).cast("long").alias("n_extreme_features_abs_z_gt_3"), F.array_join(F.transform(F.slice(ranked, 1, 5), lambda r: r["f"]), ";").alias("top_extreme_features")))


def _sensitivity(spark, sf_dir):
    df = cohort(spark, sf_dir)
    return _rounded(outlier_sensitivity(group_effects(df), group_effects(drop_flagged(df, _flags(df)))).drop("p_full", "p_without_outliers"))


def _with(name: str, text: str) -> str:
    need = [*NEEDS.get(name, ()), name]
    return "WITH " + ", ".join(f"{n} AS ({TWINS[n]})" for n in need) + " " + text


_WHO = "CASE WHEN bool_or(diagnosis = 'AD') AND bool_or(diagnosis = 'control') THEN 'conflict' WHEN bool_or(diagnosis = 'AD') THEN 'AD' WHEN bool_or(diagnosis = 'control') THEN 'control' ELSE 'unknown' END AS diagnosis"
_AT = "max({f}) FILTER (WHERE layer = '{layer}')"
_CONTRAST = {"minus": "{a} - {b}", "div": "{a} / ({b} + 1E-8)", "logratio": "CASE WHEN {a} + 1E-8 > 0 AND {b} + 1E-8 > 0 THEN ln(({a} + 1E-8) / ({b} + 1E-8)) END"}
_ALL_CONTRASTS = ", ".join(
    f"round({_CONTRAST[kind].format(a=_AT.format(f=f, layer=a), b=_AT.format(f=f, layer=b))}, 6) AS {name.split('_')[0]}_{kind}_{name.split('_')[1]}_{f}" for kind in KINDS for name, (a, b) in PAIRS.items() for f in FEATURES
)
_ALL_STATS = ", ".join(
    f"round(avg({f}), 6) AS mean_{f}, round(min({f}), 6) AS min_{f}, round(max({f}), 6) AS max_{f}, round(max({f}) - min({f}), 6) AS range_{f}, round(coalesce(stddev_samp({f}), 0), 6) AS std_{f}" for f in FEATURES
) + ", " + ", ".join(f'round({_AT.format(f=f, layer=layer)}, 6) AS "{layer}_{f}"' for layer in LAYERS for f in FEATURES)
# Each value beside its group's median, then beside its group's spread.
_MEDIANS = ", ".join(f"(SELECT median({f}) FROM cohort b WHERE b.layer = c.layer) AS m_{f}" for f in FEATURES)
_Z = "SELECT subject_id, c.layer, diagnosis, " + ", ".join(f"{f}, ({f} - m_{f}) / (CASE WHEN d_{f} > 0 THEN d_{f} WHEN s_{f} > 0 THEN s_{f} ELSE 1 END) AS z_{f}" for f in FEATURES) + " FROM cohort c JOIN mid USING (layer) JOIN spread USING (layer)"
_ZS = "mid AS (SELECT layer, " + ", ".join(f"median({f}) AS m_{f}" for f in FEATURES) + " FROM cohort GROUP BY layer), spread AS (SELECT c.layer, " + ", ".join(f"1.4826 * median(abs({f} - m_{f})) AS d_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES) + f" FROM cohort c JOIN mid USING (layer) GROUP BY c.layer), zs AS ({_Z})"
_LIST = "[" + ", ".join(f"abs(z_{f})" for f in FEATURES) + "]"
_EFFECTS = " UNION ALL ".join(f"SELECT layer, '{f}' AS feature, median({f}) FILTER (WHERE diagnosis = 'AD') - median({f}) FILTER (WHERE diagnosis = 'control') AS e FROM {{t}} GROUP BY layer" for f in FEATURES)

QUERIES = {
    "subject_aggregate": lambda spark, sf_dir: _rounded(aggregate_subjects(cohort(spark, sf_dir)).withColumn("n_layers_available", F.col("n_layers_available").cast("long"))),
    "layer_contrasts": lambda spark, sf_dir: _rounded(layer_contrasts(cohort(spark, sf_dir)).drop("label_source")),
    "outlier_table": _outlier_table,
    "flag_join": lambda spark, sf_dir: (lambda df: attach_flags(df, _flags(df)).select("subject_id", "layer", "is_feature_outlier"))(cohort(spark, sf_dir)),
    "effects_without_outliers": lambda spark, sf_dir: (lambda df: _rounded(group_effects(drop_flagged(df, _flags(df)))))(cohort(spark, sf_dir)),
    "outlier_sensitivity": _sensitivity,
}
ORACLE_SQL = {
    "subject_aggregate": _with("cohort", f"SELECT subject_id, {_WHO}, '' AS label_source, count(DISTINCT layer) AS n_layers_available, concat_ws(',', CASE WHEN NOT bool_or(layer = 'SVC') THEN 'SVC' END, CASE WHEN NOT bool_or(layer = 'DVC') THEN 'DVC' END, CASE WHEN NOT bool_or(layer = 'SVC+DVC') THEN 'SVC+DVC' END) AS missing_layers, {_ALL_STATS} FROM cohort GROUP BY subject_id"),
    "layer_contrasts": _with("cohort", f"SELECT subject_id, {_WHO}, {_ALL_CONTRASTS} FROM cohort GROUP BY subject_id"),
    "outlier_table": _with("cohort", "SELECT 1").replace(" SELECT 1", f", {_ZS}, ranked AS (SELECT subject_id, layer, string_agg(f, ';' ORDER BY round(a, 9) DESC, f) AS top FROM (" + " UNION ALL ".join(f"SELECT subject_id, layer, '{f}' AS f, abs(z_{f}) AS a FROM zs" for f in FEATURES) + ") GROUP BY subject_id, layer) SELECT subject_id, layer, " + ", ".join(f"round(z_{f}, 6) AS z__{f}" for f in FEATURES) + f", round(list_max({_LIST}), 6) AS max_abs_zscore, round(list_sum({_LIST}) / {len(FEATURES)}, 6) AS mean_abs_zscore, round(sqrt((" + " + ".join(f"z_{f} * z_{f}" for f in FEATURES) + f") / {len(FEATURES)}), 6) AS robust_mahalanobis_distance, len(list_filter({_LIST}, lambda x: x > 3)) AS n_extreme_features_abs_z_gt_3, top AS top_extreme_features FROM zs JOIN ranked USING (subject_id, layer)"),
    "flag_join": _with("cohort", "SELECT 1").replace(" SELECT 1", f", {_ZS} SELECT subject_id, layer, list_max({_LIST}) > 3 AS is_feature_outlier FROM zs"),
    "effects_without_outliers": _with("cohort", "SELECT 1").replace(" SELECT 1", f", {_ZS}, kept AS (SELECT * FROM zs WHERE list_max({_LIST}) <= 3) " + " UNION ALL ".join(f"SELECT layer, '{f}' AS feature, count({f}) FILTER (WHERE diagnosis = 'AD') AS \"n_AD\", count({f}) FILTER (WHERE diagnosis = 'control') AS n_control, round(median({f}) FILTER (WHERE diagnosis = 'AD') - median({f}) FILTER (WHERE diagnosis = 'control'), 6) AS \"diff_median_AD_minus_control\" FROM kept GROUP BY layer" for f in FEATURES)),
    "outlier_sensitivity": _with("cohort", "SELECT 1").replace(" SELECT 1", f", {_ZS}, kept AS (SELECT * FROM zs WHERE list_max({_LIST}) <= 3), a AS ({_EFFECTS.format(t='cohort')}), b AS ({_EFFECTS.format(t='kept')}) SELECT layer, feature, round(a.e, 6) AS effect_full, round(b.e, 6) AS effect_without_outliers, round(b.e - a.e, 6) AS delta_effect, CASE WHEN a.e IS NULL OR b.e IS NULL THEN 'too_few_samples' WHEN a.e * b.e < 0 OR (a.e <> 0 AND b.e = 0) OR abs(b.e - a.e) > greatest(abs(a.e), 1E-12) / 2 THEN 'outlier_sensitive' ELSE 'stable' END AS interpretation_flag FROM a LEFT JOIN b USING (layer, feature)"),
}
