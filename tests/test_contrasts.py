"""Subjects, contrasts, flags, splits and samples on hand-made rows with nulls, conflicts, ties, repeats and empty tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vasculyze.operators import contrasts, sampling

ROWS = [
    ("s1", "SVC", "AD", "2", 1.0, "z"), ("s1", "DVC", "alzheimer", "4", 2.0, "a"), ("s1", "SVC+DVC", None, "x", 3.0, "a"),
    ("s2", "SVC", "AD", "1", 1.0, ""), ("s2", "SVC", "control", "9", 7.0, None), ("s2", "SVC", "control", "9", 7.0, None),
    ("s3", "DVC", None, None, float("nan"), None), ("s4", "DVC", "healthy", "-0.00000001", 5.0, "b"), ("s4", "SVC", " Control ", "-1", 5.0, "b"), (None, "SVC", "AD", "5", 5.0, None),
]
SCHEMA = "subject_id string, layer string, diagnosis string, a string, b double, label_source string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.monotonically_increasing_id()).repartition(3)


def test_subjects(spark, rows):
    got = {r["subject_id"]: r.asDict() for r in contrasts.aggregate_subjects(rows, ["a", "b"], ["row"]).collect()}
    assert {k: v["diagnosis"] for k, v in got.items()} == {"s1": "AD", "s2": "conflict", "s3": "unknown", "s4": "control"}
    assert (got["s1"]["mean_a"], got["s1"]["range_a"], got["s1"]["std_a"], got["s1"]["label_source"]) == (3.0, 2.0, pytest.approx(math.sqrt(2)), "a;z")
    assert (got["s2"]["SVC_a"], got["s2"]["SVC_b"], got["s2"]["DVC_a"], got["s2"]["missing_layers"]) == (1.0, 1.0, None, "DVC,SVC+DVC")
    assert (got["s3"]["mean_a"], got["s3"]["std_a"], got["s3"]["mean_b"], got["s1"]["SVC+DVC_a"]) == (None, 0.0, None, None)
    assert contrasts.aggregate_subjects(rows.limit(0), ["a"]).count() == 0


def test_contrasts(spark, rows):
    got = {r["subject_id"]: r.asDict() for r in contrasts.layer_contrasts(rows, ["a", "b"], ["row"]).collect()}
    assert len([c for c in got["s1"] if c.endswith("_b")]) == 9
    one = got["s1"]
    assert (one["DVC_minus_SVC_a"], one["SVCplusDVC_minus_DVC_b"], one["SVCplusDVC_minus_SVC_a"]) == (2.0, 1.0, None)
    assert one["SVCplusDVC_div_DVC_b"] == pytest.approx(1.5) and one["SVCplusDVC_logratio_SVC_b"] == pytest.approx(math.log(3), abs=1e-7)
    # A denominator below zero has a ratio but no log ratio.
    assert got["s4"]["DVC_div_SVC_a"] == pytest.approx(1e-8) and got["s4"]["DVC_logratio_SVC_a"] is None
    swapped = rows.withColumn("layer", F.translate("layer", "SD", "DS"))
    assert {r["subject_id"]: r["DVC_div_SVC_a"] for r in contrasts.layer_contrasts(swapped, ["a"], ["row"]).collect()}["s4"] is None
    assert all(v is None for k, v in got["s3"].items() if k.endswith(("_a", "_b")))


def test_flags(spark, rows):
    flags = spark.createDataFrame([("s1", "SVC", True), ("s1", "SVC", False), ("s4", "DVC", None), (None, "SVC", True), ("s9", "SVC", True)], "subject_id string, layer string, is_feature_outlier boolean")
    got = contrasts.attach_flags(rows, flags)
    assert got.count() == len(ROWS) and sorted((str(r["subject_id"]), r["layer"]) for r in got.where("is_feature_outlier").collect()) == [("None", "SVC"), ("s1", "SVC")]
    assert contrasts.attach_flags(got, flags).columns.count("is_feature_outlier") == 1
    assert contrasts.drop_flagged(rows, flags).count() == len(ROWS) - 2
    assert contrasts.drop_flagged(rows, flags, ("subject_id",)).where("subject_id = 's1'").count() == 0
    assert contrasts.drop_flagged(rows, flags.limit(0)).count() == len(ROWS)


def test_sensitivity(spark):
    effects = lambda xs: spark.createDataFrame(xs, "layer string, feature string, diff_median_AD_minus_control double, permutation_p double")
    full = effects([("x", "turns", 1.0, 0.1), ("x", "moves", 1.0, 0.1), ("x", "stays", 1.0, 0.1), ("x", "zero", 0.0, 0.1), ("x", "still", 0.0, 0.1), ("x", "gone", 1.0, None), (None, "null", 2.0, 0.2), ("x", "nan", float("nan"), 0.1)])
    less = effects([("x", "turns", -0.9, 0.2), ("x", "moves", 1.51, 0.2), ("x", "stays", 1.5, 0.2), ("x", "zero", 1e-9, 0.2), ("x", "still", 0.0, 0.2), (None, "null", 2.5, 0.3), ("x", "nan", 1.0, 0.1)])
    got = {r["feature"]: r for r in contrasts.outlier_sensitivity(full, less).collect()}
    assert {k: r["interpretation_flag"] for k, r in got.items()} == {"turns": "outlier_sensitive", "moves": "outlier_sensitive", "stays": "stable", "zero": "outlier_sensitive", "still": "stable", "gone": "too_few_samples", "null": "stable", "nan": "too_few_samples"}
    assert got["null"]["p_without_outliers"] == 0.3 and got["stays"]["delta_effect"] == 0.5


def test_group_split(spark):
    d = spark.createDataFrame([(f"g{i}", "x" if i % 3 else "y", j) for i in range(30) for j in range(3)] + [(None, "x", 0)], "g string, y string, j int")
    sides = {r["g"]: r["side"] for r in sampling.group_split(d, "g", "y").collect()}
    count = Counter(("y" if int(g[1:]) % 3 == 0 else "x", side) for g, side in sides.items())
    assert len(sides) == 30 and sum(n for (_, s), n in count.items() if s == "test") == 8 and count["x", "test"] == 5 and count["y", "test"] == 3
    assert sides == {r["g"]: r["side"] for r in sampling.group_split(d.repartition(5), "g", "y").collect()} != {r["g"]: r["side"] for r in sampling.group_split(d, "g", "y", seed=1).collect()}
    bare = d.withColumn("y", F.when((F.col("g") == "g1") & (F.col("j") == 0), None).otherwise(F.col("y")))
    clash = d.withColumn("y", F.when((F.col("g") == "g1") & (F.col("j") == 0), "z").otherwise(F.col("y")))
    for bad in (bare, clash):
        with pytest.raises(ValueError, match="conflicting labels.*g1"):
            sampling.group_split(bad, "g", "y")
    lone = d.withColumn("y", F.when(F.col("g") == "g1", "z").otherwise(F.lit("x")))
    assert Counter(r["side"] for r in sampling.group_split(lone, "g", "y").collect()) == {"test": 8, "train": 22}
    for wrong in (lambda: sampling.group_split(d, "h"), lambda: sampling.group_split(d, "g", test_size=1.0), lambda: sampling.group_split(d.where("g = 'g1'"), "g")):
        with pytest.raises(ValueError):
            wrong()


def test_binary_target(spark):
    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "label string")
    got = sampling.binary_target(of(" Normal", "AMD", "DR", None, " ", "healthy")).collect()
    assert [(r["label"].strip(), r["target"], r["target_name"]) for r in got] == [("Normal", 0, "disease_vs_normal"), ("AMD", 1, "disease_vs_normal"), ("DR", 1, "disease_vs_normal"), ("healthy", 0, "disease_vs_normal")]
    assert {(r["label"], r["target"], r["target_name"]) for r in sampling.binary_target(of("b", "A", "B")).collect()} == {("b", 1, "b_vs_a"), ("A", 0, "b_vs_a"), ("B", 1, "b_vs_a")}
    assert {r["target_name"] for r in sampling.binary_target(of("normal", "control")).collect()} == {"normal_vs_control"}
    for bad in (of("a"), of("a", "b", "c"), of(None), of("normal", "control", "healthy")):
        with pytest.raises(ValueError):
            sampling.binary_target(bad)


def test_balanced_sample(spark):
    d = spark.createDataFrame([(i, f"i{i}", ("Disease", "control", None)[i % 3]) for i in range(30)] + [(1, "i0", "disease")], "o int, image_id string, label string")
    got = sampling.balanced_sample(d, 6, "o").collect()
    assert sorted(r["image_id"] for r in got) == ["i0", "i1", "i3", "i4", "i7"]
    assert len(sampling.balanced_sample(d, 1, "o").collect()) == 1 and sampling.balanced_sample(d.limit(0), 5, "o").count() == 0
    assert sampling.balanced_sample(d.where("label is null"), 4, "o").count() == 4


def test_calibration_bins_share_ties(spark):
    d = spark.createDataFrame([(0.5, i % 2) for i in range(40)] + [(0.9, 1), (None, 1), (0.1, None), (0.0, 0)], "p double, y int")
    got = sorted((r["bin"], r["n"]) for r in sampling.calibration_bins(d).collect())
    assert got == [(1, 41), (8, 1)] and sampling.calibration_bins(d.limit(0)).count() == 0
