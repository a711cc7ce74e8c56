"""The long feature table: first rows, masks by path, features against the kernel, rows that lack a mask, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vasculyze.operators import feature_table as T
from vasculyze.operators.kernels import octa_vector


def test_build(spark):
    m = np.zeros((12, 16), bool)
    m[5, 2:14] = True
    m[0, 0] = True
    rows = [("s1", "SVC", "b", "AD", "x", "p2", "L"), ("s1", "SVC", "a", "AD", "x", "p1", "R"), ("s1", "DVC", None, None, None, "p1", None), ("s2", "SVC", "c", "normal", "x", "lost", "L"), (None, "SVC", "d", "cn", "x", "p2", "L"), ("s1", "DVC", None, None, None, "p1", None)]
    manifest = spark.createDataFrame(rows, "subject_id string, layer string, image_id string, diagnosis string, label_source string, mask_path string, eye_id string").withColumn("h", F.lit(3))
    masks = spark.createDataFrame([("p1", 12, 16, m.ravel().tolist()), ("p2", 4, 4, [False] * 16), ("p3", 1, 1, [True])], "path string, h int, w int, mask array<boolean>")
    got = {(r["subject_id"], r["layer"]): r.asDict() for r in T.build(manifest, masks).collect()}
    assert set(got) == {("s1", "SVC"), ("s1", "DVC"), (None, "SVC")}
    one = got["s1", "SVC"]
    assert (one["image_id"], one["source_row_count"], one["eye_id"], one["mask_height"], one["mask_width"], one["diagnosis"]) == ("a", 2, "R", 12, 16, "AD")
    want = octa_vector(m)
    assert len(T.MASK_FEATURES) == 17 and all(one[f] == pytest.approx(want[f]) for f in T.MASK_FEATURES) and one["foreground_fraction"] == pytest.approx(13 / 192)
    assert got["s1", "DVC"]["source_row_count"] == 2 and got["s1", "DVC"]["diagnosis"] == "unknown" and got[None, "SVC"]["foreground_fraction"] == 0
    less = T.build(manifest, masks, min_component_size=2).where("subject_id = 's1' and layer = 'SVC'").head()
    assert less["connected_component_count"] == 1 and less["foreground_fraction"] == pytest.approx(12 / 192)
    assert T.build(manifest.limit(0), masks).count() == 0 and T.build(manifest, masks.limit(0)).count() == 0
    with pytest.raises(ValueError, match="label_source"):
        T.build(manifest.withColumn("label_source", F.lit("")), masks)
    with pytest.raises(ValueError, match="mask_path"):
        T.build(manifest.drop("mask_path"), masks)


def test_command_lines(spark, tmp_path):
    from vasculyze import cli

    rng = np.random.default_rng(0)
    rows = [(f"s{i}", layer, "AD" if i % 2 else "control", *rng.normal(size=2).tolist()) for i in range(8) for layer in ("SVC", "DVC", "SVC+DVC")]
    spark.createDataFrame(rows, "subject_id string, layer string, diagnosis string, a double, b double").write.parquet(f"{tmp_path}/t")
    assert cli.main(["layer-stats", "--features", f"{tmp_path}/none.csv,{tmp_path}/t", "--out", f"{tmp_path}/out", "--n-boot", "20", "--n-perm", "20"]) == 0
    for name in ("layer_effects", "effects_without_outliers", "outlier_sensitivity", "subject_features", "layer_contrasts", "subject_effects", "contrast_effects", "artifact_audit"):
        assert spark.read.csv(f"{tmp_path}/out/{name}", header=True).count() > 0
    with pytest.raises(FileNotFoundError):
        cli.read_features(spark, [f"{tmp_path}/none"])
