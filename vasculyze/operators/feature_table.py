"""From a manifest of masks to the long feature table: one row per subject and layer.

The manifest is grouped by partial minima (no window, no sort of the whole), and only the chosen rows meet their masks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_diagnosis
from ..sources.adapters import table
from ..sources.manifests import require_columns
from .kernels import masks as driver_masks
from .kernels import octa_vector
from .segment import drop_small
from .validation import guard_label_source

# The features that embeddings use, in their order, and the columns that a manifest may have besides.
MASK_FEATURES = (
    "vessel_area_fraction", "skeleton_length_density", "branchpoint_density", "endpoint_density", "connected_component_count", "largest_component_fraction", "fractal_dimension_boxcount", "mean_segment_length_px",
    "median_segment_length_px", "mean_tortuosity_arc_chord", "high_tortuosity_fraction", "caliber_proxy_mean_px", "caliber_proxy_median_px", "caliber_proxy_std_px", "hole_fraction_or_dropout_proxy", "small_component_fraction",
    "orientation_entropy",
)
OPTIONAL = ("eye_id", "scanner", "field_of_view", "pixel_size_um", "quality_flag", "official_split", "split_group")
_SIZES = ("mask_height", "mask_width", "foreground_fraction")


def first_rows(manifest: DataFrame) -> DataFrame:
    """Of each subject and layer the row of the least image_id (ties by the other columns), and source_row_count. Null subjects
    and layers are groups like others; a null image_id comes last."""
    rest = [c for c in manifest.columns if c not in ("subject_id", "layer")]
    plain = [c.name for c in manifest.schema.fields if c.name in rest and "map<" not in c.dataType.simpleString()]
    order = F.struct(F.col("image_id").isNull(), "image_id", *[F.col(c) for c in plain if c != "image_id"])
    out = manifest.groupBy("subject_id", "layer").agg(F.min_by(F.struct(*rest), order).alias("_row"), F.count(F.lit(1)).alias("source_row_count"))
    return out.select("subject_id", "layer", *[F.col(f"_row.{c}").alias(c) for c in rest], "source_row_count")


def mask_features(masks: DataFrame, min_component_size: int = 0) -> DataFrame:
    """(mask_path, h, w, mask array<boolean>) -> mask_path, the mask's size and share, the features. Pieces under
    min_component_size pixels are dropped first."""

    def one(mask, h, w):
        m = np.array(mask, bool).reshape(h, w)
        m = drop_small(m, min_component_size, True) if min_component_size > 1 else m
        made = octa_vector(m)
        return [float(h), float(w), float(m.mean()) if m.size else 0.0, *(made[f] for f in MASK_FEATURES)]

    def run(frames):
        for f in frames:
            rows = [one(m, h, w) for m, h, w in zip(f["mask"], f["h"], f["w"])]
            yield pd.DataFrame(rows, columns=[*_SIZES, *MASK_FEATURES], dtype=float).assign(mask_path=f["mask_path"].to_numpy())[["mask_path", *_SIZES, *MASK_FEATURES]]

    kind = dict(masks.dtypes)["mask_path"]
    out = masks.select("mask_path", "h", "w", "mask").mapInPandas(run, ", ".join([f"mask_path {kind}", *(f"{c} double" for c in (*_SIZES, *MASK_FEATURES))]))
    return out.withColumns({c: F.col(c).cast("int") for c in _SIZES[:2]})


def build(manifest: DataFrame, masks: DataFrame, min_component_size: int = 0) -> DataFrame:
    """The long feature table of a manifest; masks: (path, h, w, mask). A row whose mask can't be found is left out. Raises where
    a column lacks or a diagnosis doesn't say its source. Extra columns of either table aren't read, but for OPTIONAL."""
    require_columns(manifest, ["subject_id", "image_id", "layer", "mask_path", "diagnosis", "label_source"])
    guard_label_source(manifest)
    more = [c for c in OPTIONAL if c in manifest.columns]
    rows = first_rows(manifest.select("subject_id", "layer", "image_id", "diagnosis", "label_source", "mask_path", *more))
    rows = rows.withColumn("diagnosis", normalize_diagnosis(F.col("diagnosis"))).withColumn("label_source", F.coalesce("label_source", F.lit("unknown")))
    wanted = masks.select(F.col("path").alias("mask_path"), "h", "w", "mask").join(rows.select("mask_path").distinct(), "mask_path", "left_semi")
    made = mask_features(wanted, min_component_size).withColumnRenamed("mask_path", "_path")
    return rows.join(made, F.col("mask_path") == F.col("_path")).select("subject_id", "image_id", "layer", "diagnosis", "label_source", "mask_path", "source_row_count", *_SIZES, *MASK_FEATURES, *more)


def first_layer_feature_table(spark, sf_dir):
    """The driver's 8 by 8 masks as a cohort of 40 subjects in three layers."""
    i = F.col("vec_id")
    manifest = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("S"), (i % 40).cast("string")).alias("subject_id"), F.when(i % 3 == 0, "SVC").when(i % 3 == 1, "DVC").otherwise("SVC+DVC").alias("layer"), i.cast("long").alias("image_id"),
        F.when(i % 2 == 0, " AD").otherwise("Control").alias("diagnosis"), F.lit("manifest").alias("label_source"), i.cast("string").alias("mask_path"),
    )
    masks = driver_masks(spark, sf_dir).select(F.col("image_id").cast("string").alias("path"), "h", "w", "mask")
    made = build(manifest, masks)
    return made.select("subject_id", "layer", "image_id", "diagnosis", "source_row_count", "mask_height", "mask_width", F.round("foreground_fraction", 9).alias("foreground_fraction"), F.round("vessel_area_fraction", 9).alias("vessel_area_fraction"))


QUERIES = {"first_layer_feature_table": first_layer_feature_table}
ORACLE_SQL = {
    "first_layer_feature_table": """WITH m AS (SELECT 'S' || (vec_id % 40)::VARCHAR AS subject_id, CASE vec_id % 3 WHEN 0 THEN 'SVC' WHEN 1 THEN 'DVC' ELSE 'SVC+DVC' END AS layer, min(vec_id)::BIGINT AS image_id, count(*) AS source_row_count FROM embeddings GROUP BY 1, 2)
        SELECT subject_id, layer, image_id, CASE WHEN image_id % 2 = 0 THEN 'AD' ELSE 'control' END AS diagnosis, source_row_count, 8::INT AS mask_height, 8::INT AS mask_width, round(len(list_filter(embedding, lambda x: x > 0)) / 64, 9) AS foreground_fraction,
        round(len(list_filter(embedding, lambda x: x > 0)) / 64, 9) AS vessel_area_fraction FROM m JOIN embeddings ON vec_id = image_id"""
}
