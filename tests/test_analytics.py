"""Manifests, inference, outliers, segmenters, benchmark and sinks on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vasculyze.cli import main
from vasculyze.functions.metadata import metadata_of
from vasculyze.operators import benchmark as B
from vasculyze.operators import embeddings as E
from vasculyze.operators import inference as I
from vasculyze.operators import kernels as K
from vasculyze.operators import outliers as O
from vasculyze.operators import segment as S
from vasculyze.sources import images, manifests, sinks


def _image(path, a=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(sinks.png(np.eye(16, dtype=bool) if a is None else a))


def test_fundus_layout(spark, tmp_path):
    for split in ("train", "test"):
        for n in ("1_A", "2_N", "3_G"):
            _image(tmp_path / "FIVES set" / split / "Original" / f"{n}.png")
            _image(tmp_path / "FIVES set" / split / "Ground Truth" / f"{n}.PNG")
    _image(tmp_path / "FIVES set" / "train" / "Original" / "9_D.png")
    rows = manifests.load_fundus_manifest(spark, str(tmp_path)).collect()
    assert {(r.image_id, r.label) for r in rows} == {(f"{s}_{n}", l) for s in ("train", "test") for n, l in (("1_A", "AMD"), ("2_N", "normal"), ("3_G", "glaucoma"))}


def test_octa_layouts(spark, tmp_path):
    for layer, split, n in itertools.product(("SVC", "DVC", "SVC_DVC"), ("train", "test"), ("01", "08", "25")):
        _image(tmp_path / "ROSE" / "ROSE-1" / layer / split / "img" / f"{n}.tif")
        _image(tmp_path / "ROSE" / "ROSE-1" / layer / split / "gt" / f"{n}.tif")
    _image(tmp_path / "ROSE" / "ROSE-2" / "test" / "original" / "11_OD_SVP.png")
    _image(tmp_path / "ROSE" / "ROSE-2" / "test" / "gt" / "11_OD_SVP.png")
    rows = {r.image_id: r for r in manifests.load_octa_manifest(spark, str(tmp_path)).collect()}
    assert len(rows) == 19 and rows["ROSE-2_test_11_OD_SVP"].subject_id == "ROSE-2_11" and rows["ROSE-2_test_11_OD_SVP"].layer == "SVP"
    assert rows["ROSE-1_train_01_SVC+DVC"].label == "disease" and rows["ROSE-1_test_08_SVC"].diagnosis == "control" and rows["ROSE-1_test_25_DVC"].label is None


def test_pairs_manifest_and_errors(spark, tmp_path):
    with pytest.raises(manifests.DataNotFoundError):
        manifests.load_octa_manifest(spark, str(tmp_path / "absent"))
    _image(tmp_path / "a" / "subject7_svc.png")
    _image(tmp_path / "a" / "subject7_svc_mask.png")
    (row,) = manifests.load_octa_manifest(spark, str(tmp_path / "a")).collect()
    assert (row.subject_id, row.layer) == ("7", "SVC") and row.mask_path.endswith("_mask.png")
    _image(tmp_path / "b" / "left.png")
    _image(tmp_path / "b" / "left_gt.png")
    with pytest.raises(ValueError, match="confidently"):
        manifests.load_octa_manifest(spark, str(tmp_path / "b"))
    (tmp_path / "a" / "manifest.csv").write_text("image_path,mask_path,subject_id,layer\nx.png,/m/x.png,s1,SVC\n")
    (row,) = manifests.load_octa_manifest(spark, str(tmp_path / "a")).collect()
    assert row.image_path == f"{tmp_path}/a/x.png" and row.mask_path == "/m/x.png" and row.image_id == "x" and row.split_group == "s1"


def test_cross_split_guard(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "subject_id string, official_split string")
    with pytest.raises(ValueError, match="multiple official splits: a"):
        manifests.guard_splits(df, "ROSE")


def _brute_u(x, y):
    both, m = np.array([*x, *y]), len(x)
    u = lambda a, b: sum(i > j for i in a for j in b)
    all_u = [u(both[list(c)], np.delete(both, list(c))) for c in itertools.combinations(range(len(both)), m)]
    top = max(u(x, y), len(x) * len(y) - u(x, y))
    return min(1.0, 2 * sum(v >= top for v in all_u) / len(all_u))


def _brute_ks(x, y):
    both, m = np.array([*x, *y]), len(x)
    d = lambda a, b: max(abs((a <= v).mean() - (b <= v).mean()) for v in both)
    all_d = [d(both[list(c)], np.delete(both, list(c))) for c in itertools.combinations(range(len(both)), m)]
    return sum(v >= d(np.array(x), np.array(y)) - 1e-9 for v in all_d) / len(all_d)


def test_exact_p_values_match_enumeration():
    rng = np.random.default_rng(3)
    for m, n in ((3, 4), (5, 4), (4, 6)):
        x, y = rng.normal(size=m), rng.normal(0.7, 1, n)
        assert I.mannwhitney_p(x, y)[1] == pytest.approx(_brute_u(x, y))
        assert I.ks_p(x, y)[1] == pytest.approx(_brute_ks(x, y))


def test_tails_and_fdr():
    assert I.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and I.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05) and I.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)
    p = I.fdr_bh([0.01, 0.2, math.nan, 0.03])
    assert math.isnan(p[2]) and p[[0, 1, 3]] == pytest.approx([0.03, 0.2, 0.045])
    assert I.permutation_p([1, 2, 3], [1, 2, 3], n_perm=200) > 0.5 and I.permutation_p(range(10, 20), range(10), "mean", 500) < 0.05
    low, high = I.bootstrap_difference([10, 11, 12], [1, 2, 3], n_boot=200)
    assert 0 < low < high and math.isnan(I.bootstrap_difference([], [1])[0])


def test_compare_groups_handles_missing(spark):
    rows = [("AD", v, "1") for v in (5.0, 6.0, 7.0, 8.0)] + [("control", v, "x") for v in (1.0, 2.0, 3.0, 4.0)] + [("control", math.nan, None), (None, 9.0, "4")]
    df = spark.createDataFrame(rows, "diagnosis string, feature_a double, feature_b string")
    (r,) = [x for x in I.compare_groups(df, ["feature_a", "feature_b"], n_boot=50, n_perm=50).collect() if x.feature == "feature_a"]
    assert (r.n_AD, r.n_control, r.diff_median_AD_minus_control) == (4, 4, 4.0) and 0 <= r.fdr_bh_permutation_p <= 1 and r.mannwhitney_p == pytest.approx(2 / 70)


def test_outliers(spark):
    rows = [("s1", "SVC", 1.0, 2.0), ("s2", "SVC", 1.1, 2.1), ("s3", "SVC", 0.9, 1.9), ("s4", "SVC", 1.2, 2.2), ("s5", "SVC", 10.0, 20.0), ("s6", None, 1.0, None)]
    got = {r.subject_id: r for r in O.outlier_scores(spark.createDataFrame(rows, "subject_id string, layer string, a double, b double"), ["a", "b"]).collect()}
    assert len(got) == 6 and got["s5"].is_feature_outlier and got["s5"].max_abs_zscore > 3 and not got["s1"].is_feature_outlier and got["s6"].max_abs_zscore == 0
    x = np.array([[r[2], r[3]] for r in rows[:5]])
    m = np.median(x, 0)
    z = (x - m) / (1.4826 * np.median(np.abs(x - m), 0))
    c = (z - z.mean(0)) @ np.linalg.svd(z - z.mean(0))[2].T
    assert [got[f"s{i}"].pca_leverage_score for i in range(1, 6)] == pytest.approx(((c - np.median(c, 0)) ** 2).sum(1))


def _vessels():
    a = np.linspace(0, 0.2, 64)[None].repeat(64, 0)
    for r in (16, 32, 48):
        a[r - 1 : r + 2, 6:58] = 1.0
    return a


@pytest.mark.parametrize("method", sorted(set(S.SEGMENTERS)))
def test_segmenters(method):
    a, fov = _vessels(), np.ones((64, 64), bool)
    fov[:8] = fov[:, :4] = False
    one, two = S.SEGMENTERS[method](a, fov), S.SEGMENTERS[method](a, fov)
    assert one.mask.shape == a.shape and one.mask.dtype == bool and not one.mask[~fov].any() and (one.mask == two.mask).all()
    assert one.mask[32, 20:45].mean() > 0.5
    with pytest.raises(ValueError, match="does not match"):
        S.SEGMENTERS[method](a, fov[:5])


def test_postprocess_and_tuning(spark):
    score, true = np.zeros((24, 24)), np.zeros((24, 24), bool)
    score[12, 4:20], score[2:6, 2:6], true[12, 4:20] = 0.7, 0.45, True
    assert (S.postprocess(score, threshold=0.6, min_size=3) == true).all()
    df = spark.createDataFrame([("i", 24, 24, score.ravel().tolist(), true.ravel().tolist(), score.ravel().tolist()), ("j", 24, 24, None, true.ravel().tolist(), None)], "image_id string, h int, w int, gray array<double>, mask array<boolean>, score array<double>")
    s = B.summarize(B.tune_scores(df, "unet", {"threshold": [0.4, 0.6], "min_size": 3}))
    (best,) = s.where("selected").collect()
    assert best.mean_dice == 1.0 and (best.n_rows, best.n_success) == (2, 1) and B.best_params(s)["unet"]["threshold"] == 0.6


def test_benchmark_row_errors(spark):
    a = _vessels()
    df = spark.createDataFrame([("ok", 64, 64, a.ravel().tolist(), (a > 0.5).ravel().tolist()), ("flat", 64, 64, [0.0] * 4096, [False] * 4096)], "image_id string, h int, w int, gray array<double>, mask array<boolean>")
    rows = {(r.image_id, r.method): r for r in B.benchmark(df, ["frangi", "random_walker"]).collect()}
    assert len(rows) == 4 and rows["ok", "frangi"].error is None and rows["ok", "frangi"].dice > 0.5 and "vessel seeds" in rows["flat", "random_walker"].error
    with pytest.raises(ValueError, match="Unknown"):
        B.benchmark(df, ["none"])
    same = B.feature_errors(K.fundus_vector(a > 0.5), K.fundus_vector(a > 0.5))
    assert all(v == 0 for k, v in same.items() if "error" in k)


def test_command_line(spark, tmp_path):
    a = _vessels() > 0.5
    _image(tmp_path / "x.png", a)
    _image(tmp_path / "x_mask.png", a)
    (tmp_path / "m.csv").write_text(f"image_id,image_path,mask_path\nx,{tmp_path}/x.png,{tmp_path}/x_mask.png\n")
    assert main(["benchmark", "--manifest", str(tmp_path / "m.csv"), "--out", str(tmp_path / "out"), "--methods", "frangi", "--output-root", str(tmp_path / "planes")]) == 0
    (row,) = spark.read.csv(str(tmp_path / "out"), header=True).collect()
    assert row.method == "frangi" and row.error is None
    (back,) = images.read_gray(spark, str(tmp_path / "planes" / "masks" / "x_frangi.png")).collect()
    assert set(back.gray) <= {0.0, 255.0} and images.read_arrays(spark, str(tmp_path / "planes" / "scores")).count() == 1


def test_vectors_crossings_and_metadata():
    x = np.zeros((25, 25), bool)
    for i in range(-7, 8):
        x[12 + i, 12 + i] = x[12 + i, 12 - i] = True
    assert K.crossings(K.thin(x)) == 1
    assert len(K.fundus_vector(x)) == 18 and len(K.octa_vector(x)) == 21 and all(v == 0 for v in K.fundus_vector(np.zeros((9, 9), bool)).values())
    assert metadata_of("mean_segment_tortuosity")["timing"] == "early" and metadata_of("DVC_minus_SVC_mean_endpoint_density")["timing"] == "late" and metadata_of("other")["timing"] == "context"


def test_maps(spark):
    rng = np.random.default_rng(0)
    y = E.tsne(np.concatenate([rng.normal(0, 0.1, (8, 3)), rng.normal(5, 0.1, (8, 3))]))
    assert np.linalg.norm(y[:8].mean(0) - y[8:].mean(0)) > max(np.linalg.norm(y[:8] - y[:8].mean(0), axis=1).max(), np.linalg.norm(y[8:] - y[8:].mean(0), axis=1).max())
    df = spark.createDataFrame([(0.0, 0.0, "AD"), (0.2, 0.1, "AD"), (2.0, 2.0, "control"), (2.2, 2.1, "control")], "component_1 double, component_2 double, diagnosis string")
    (r,) = E.group_separation(df, n_permutations=50).collect()
    assert r.centroid_distance > 0 and 0 <= r.p_value <= 1 and r.silhouette_score > 0.8
    with pytest.raises(ImportError):
        E.umap()
    with pytest.raises(RuntimeError):
        E.deep_comparators()
    with pytest.raises(NotImplementedError, match="deferred"):
        E.automated_avr()


def test_separation_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = np.round(rng.normal(0, 1, (120, 2)), 1)
    g = rng.random(120) < 0.4
    p[g] += 0.3
    p[:9], g[:9] = p[0], [True] * 4 + [False] * 5
    df = spark.createDataFrame([(float(a), float(b), "AD" if k else "control") for (a, b), k in zip(p, g)], "component_1 double, component_2 double, diagnosis string")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    own = np.array([d[i, g == g[i]].sum() / ((g == g[i]).sum() - 1) for i in range(120)])
    far = np.array([d[i, g != g[i]].mean() for i in range(120)])
    gap = lambda s: np.linalg.norm(p[s].mean(0) - p[~s].mean(0))
    plain = np.mean([gap(rng.permutation(g)) >= gap(g) for _ in range(4000)])
    for block in (8192, 17):
        monkeypatch.setattr(E, "BLOCK", block)
        (r,) = E.group_separation(df, n_permutations=1000).collect()
        assert (r.n_group_a, r.n_group_b) == (g.sum(), (~g).sum()) and abs(r.centroid_distance - gap(g)) < 1e-9
        assert abs(r.silhouette_score - ((far - own) / np.maximum(own, far)).mean()) < 1e-9 and abs(r.p_value - plain) < 0.05
        assert E.group_separation(df, n_permutations=1000).collect() == [r]
    (r,) = E.group_separation(df.where("diagnosis = 'AD'")).collect()
    assert r.n_group_b == 0 and r.p_value is None and r.silhouette_score is None


def test_validation(spark):
    from vasculyze.operators import validation as V

    schema = "subject_id string, image_id string, layer string, diagnosis string, label_source string, mask_path string, mask_height int, a double, b string"
    rows = [("s1", "i1", "SVC", "AD", "manifest", "m", 8, 0.4, "1"), ("s2", "i2", "SVC", "control", "manifest", "m", 8, 0.2, "x")]
    df = spark.createDataFrame(rows, schema)
    assert V.validate(df) == ["a", "b"] and V.infer_features(df, include_qc=True) == ["mask_height", "a", "b"]
    V.guard_label_source(df)
    make = lambda *more: spark.createDataFrame([*rows, *more], schema)
    for bad, text in (
        (df.drop("mask_path"), "Missing required"),
        (make(("s1", "i3", "DVC", "control", "manifest", "m", 8, 0.1, "2")), "conflicting diagnosis"),
        (make(("s1", "i3", "SVC", "AD", "manifest", "m", 8, 0.1, "2")), "at most one row"),
        (make(("s3", "i3", "SVP", "AD", "manifest", "m", 8, 0.1, "2")), "Unexpected layer"),
        (make((None, "i3", "SVC", "AD", "manifest", "m", 8, 0.1, "2")), "null"),
        (df.withColumn("c", F.lit(float("nan"))), "entirely NaN: c"),
    ):
        with pytest.raises(ValueError, match=text):
            V.validate(bad)
    with pytest.raises(ValueError, match="label_source"):
        V.guard_label_source(make(("s3", "i3", "SVC", "AD", " ", "m", 8, 0.1, "2")))
    V.guard_leakage(df.limit(1), df.where("subject_id = 's2'"))
    with pytest.raises(ValueError, match="leakage"):
        V.guard_leakage(df, df)
