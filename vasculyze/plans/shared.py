"""Queries whose plan reads best as SQL. Spark runs them over the relations of sources.adapters; the same text over the
relations' SQL twins is their oracle. Every grouping is by feature, layer or subject; windows are partitioned."""

from __future__ import annotations

_EFFECT = """
    count(CASE WHEN diagnosis = 'AD' THEN v END) AS n_ad, count(CASE WHEN diagnosis = 'control' THEN v END) AS n_control,
    round(avg(CASE WHEN diagnosis = 'AD' THEN v END), 6) AS mean_ad, round(avg(CASE WHEN diagnosis = 'control' THEN v END), 6) AS mean_control,
    median(CASE WHEN diagnosis = 'AD' THEN v END) AS median_ad, median(CASE WHEN diagnosis = 'control' THEN v END) AS median_control,
    round(avg(CASE WHEN diagnosis = 'AD' THEN v END) - avg(CASE WHEN diagnosis = 'control' THEN v END), 6) AS diff_mean,
    round(median(CASE WHEN diagnosis = 'AD' THEN v END) - median(CASE WHEN diagnosis = 'control' THEN v END), 6) AS diff_median,
    var_samp(CASE WHEN diagnosis = 'AD' THEN v END) AS va, var_samp(CASE WHEN diagnosis = 'control' THEN v END) AS vc"""
_SIZES = """*, sqrt(((n_ad - 1) * va + (n_control - 1) * vc) / (n_ad + n_control - 2)) AS s"""


def _effects(keys: str, source: str) -> str:
    return f"""SELECT {keys}, n_ad, n_control, mean_ad, mean_control, median_ad, median_control, diff_mean, diff_median,
      CASE WHEN n_ad < 2 OR n_control < 2 THEN NULL WHEN s = 0 THEN CASE WHEN diff_mean = 0 THEN 0E0 END ELSE round(diff_mean / s, 4) END AS cohens_d,
      CASE WHEN n_ad < 2 OR n_control < 2 THEN NULL WHEN s = 0 THEN CASE WHEN diff_mean = 0 THEN 0E0 END ELSE round(diff_mean / s * (1 - 3E0 / (4 * (n_ad + n_control - 2) - 1)), 4) END AS hedges_g
    FROM (SELECT {_SIZES} FROM (SELECT {keys}, {_EFFECT} FROM {source} GROUP BY {keys}) g) h"""


_WIDE = """SELECT subject_id, feature, CASE count(DISTINCT CASE WHEN diagnosis <> 'unknown' THEN diagnosis END) WHEN 1 THEN max(CASE WHEN diagnosis <> 'unknown' THEN diagnosis END) WHEN 0 THEN 'unknown' ELSE 'conflict' END AS diagnosis, max(CASE WHEN layer = 'SVC' THEN v END) AS svc, max(CASE WHEN layer = 'DVC' THEN v END) AS dvc,
    max(CASE WHEN layer = 'SVC+DVC' THEN v END) AS joined, round(avg(v), 6) AS mean_v, min(v) AS min_v, max(v) AS max_v, count(v) AS n, stddev_samp(v) AS sd FROM {long} GROUP BY subject_id, feature"""
_CONTRASTS = f"""SELECT subject_id, diagnosis, feature, dvc - svc AS dvc_minus_svc FROM ({_WIDE}) w"""
_RANKS = """SELECT layer, feature, diagnosis, v, rank() OVER (PARTITION BY layer, feature ORDER BY v) + (count(*) OVER (PARTITION BY layer, feature, v) - 1) / 2E0 AS r FROM {long} WHERE diagnosis <> 'unknown' AND v IS NOT NULL"""
_TRUE = "SELECT image_id, r, c, x > 0 AS t, x > 0.05E0 AS p, r BETWEEN 1 AND 6 AS f FROM {pixels}"
_CELLS = """count(CASE WHEN t AND p THEN 1 END) AS tp, count(CASE WHEN NOT t AND p THEN 1 END) AS fp, count(CASE WHEN t AND NOT p THEN 1 END) AS fn, count(CASE WHEN NOT t AND NOT p THEN 1 END) AS tn"""
_METRICS = """tp, fp, fn, tn, CASE WHEN 2 * tp + fp + fn = 0 THEN 1E0 ELSE 2E0 * tp / (2 * tp + fp + fn) END AS dice, CASE WHEN tp + fp + fn = 0 THEN 1E0 ELSE 1E0 * tp / (tp + fp + fn) END AS iou,
    CASE WHEN tp + fp = 0 THEN 1E0 ELSE 1E0 * tp / (tp + fp) END AS prec, CASE WHEN tp + fn = 0 THEN 1E0 ELSE 1E0 * tp / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 1E0 ELSE 1E0 * tn / (tn + fp) END AS specificity"""
_ON = "SELECT image_id, r, c FROM {pixels} WHERE x > 0"
_BOXES = " UNION ALL ".join(f"SELECT image_id, {s} AS s, count(DISTINCT CAST(floor(r / {s}E0) * 8 + floor(c / {s}E0) AS INT)) AS k FROM ({_ON}) o{s} GROUP BY image_id" for s in (2, 4, 8))
_NEAR = f"""SELECT a.image_id, a.r, a.c, count(b.r) AS neighbors,
    count(CASE WHEN b.r = a.r THEN 1 END) AS h, count(CASE WHEN b.c = a.c THEN 1 END) AS vv, count(CASE WHEN b.r - a.r = b.c - a.c THEN 1 END) AS d1, count(CASE WHEN b.r - a.r = a.c - b.c THEN 1 END) AS d2
    FROM ({_ON}) a LEFT JOIN (SELECT image_id, r, c, r + dr AS ar, c + dc AS ac FROM ({_ON}) q CROSS JOIN (SELECT -1 AS dr UNION ALL SELECT 0 UNION ALL SELECT 1) x CROSS JOIN (SELECT -1 AS dc UNION ALL SELECT 0 UNION ALL SELECT 1) y WHERE dr <> 0 OR dc <> 0) b
    ON a.image_id = b.image_id AND a.r = b.ar AND a.c = b.ac GROUP BY a.image_id, a.r, a.c"""
_PV = "SELECT feature, layer, (1 + count(CASE WHEN diagnosis = 'AD' THEN 1 END) % 97) / 100E0 AS p FROM {long} GROUP BY feature, layer"

SHARED: dict[str, str] = {
    "layer_effects": _effects("layer, feature", "{long}"),
    "subject_effects": _effects("feature", f"(SELECT feature, diagnosis, mean_v AS v FROM ({_WIDE}) w)"),
    "contrast_effects": _effects("feature", f"(SELECT feature, diagnosis, round(dvc_minus_svc, 9) AS v FROM ({_CONTRASTS}) c)"),
    "table_summary": "SELECT feature, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_rows, round(avg(CASE WHEN v IS NULL THEN 1E0 ELSE 0E0 END), 6) AS missing, round(var_samp(v), 4) AS variance FROM {long} GROUP BY feature",
    "missingness": "SELECT layer, count(*) AS n, count(CASE WHEN raw_diagnosis IS NULL THEN 1 END) AS no_diagnosis, round(avg(CASE WHEN raw_diagnosis IS NULL THEN 1E0 ELSE 0E0 END), 6) AS share FROM {cohort} GROUP BY layer",
    "value_counts": "SELECT raw_diagnosis, diagnosis, count(*) AS n FROM {cohort} GROUP BY raw_diagnosis, diagnosis",
    "layer_by_diagnosis_pivot": "SELECT layer, count(CASE WHEN diagnosis = 'AD' THEN 1 END) AS ad, count(CASE WHEN diagnosis = 'control' THEN 1 END) AS control, count(CASE WHEN diagnosis = 'unknown' THEN 1 END) AS unknown FROM {cohort} GROUP BY layer",
    "crosstab_chi2": """SELECT round(sum(g * g / e), 6) AS chi2, min(round(e, 6)) AS min_expected, max(dof) AS dof FROM (SELECT e, dof, CASE WHEN dof = 1 THEN greatest(abs(o - e) - 0.5E0, 0E0) ELSE abs(o - e) END AS g FROM (
        SELECT coalesce(o, 0) AS o, 1E0 * nl * nd / n AS e, (levels - 1) * (groups_ - 1) AS dof FROM (SELECT layer, count(*) AS nl FROM {cohort} WHERE diagnosis <> 'unknown' GROUP BY layer) l CROSS JOIN (SELECT diagnosis, count(*) AS nd FROM {cohort} WHERE diagnosis <> 'unknown' GROUP BY diagnosis) d
        CROSS JOIN (SELECT count(*) AS n, count(DISTINCT layer) AS levels, count(DISTINCT diagnosis) AS groups_ FROM {cohort} WHERE diagnosis <> 'unknown') t LEFT JOIN (SELECT layer AS layer_, diagnosis AS diagnosis_, count(*) AS o FROM {cohort} WHERE diagnosis <> 'unknown' GROUP BY layer, diagnosis) c ON layer = layer_ AND diagnosis = diagnosis_) u) v""",
    "layer_availability": """SELECT subject_id, count(DISTINCT layer) AS n_layers, concat_ws('+', max(CASE WHEN layer = 'DVC' THEN layer END), max(CASE WHEN layer = 'SVC' THEN layer END), max(CASE WHEN layer = 'SVC+DVC' THEN layer END)) AS layers,
        concat_ws(',', CASE WHEN count(CASE WHEN layer = 'SVC' THEN 1 END) = 0 THEN 'SVC' END, CASE WHEN count(CASE WHEN layer = 'DVC' THEN 1 END) = 0 THEN 'DVC' END, CASE WHEN count(CASE WHEN layer = 'SVC+DVC' THEN 1 END) = 0 THEN 'SVC+DVC' END) AS missing_layers FROM {cohort} GROUP BY subject_id""",
    "first_per_subject_layer": "SELECT o_custkey AS subject, o_orderstatus AS layer, o_orderkey AS image, n AS source_row_count FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM {orders}) t WHERE rn = 1",
    "validate_duplicates": "SELECT o_custkey AS subject, o_orderstatus AS layer, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1",
    "validate_conflicts": "SELECT source AS subject_id, count(DISTINCT lang) AS labels, min(lang) AS first_label, max(lang) AS last_label FROM {documents} WHERE lang IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) > 1",
    "leakage_intersect": "SELECT DISTINCT o_custkey AS subject FROM {orders} WHERE o_orderkey % 5 = 0 AND o_custkey IS NOT NULL INTERSECT SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderkey % 5 <> 0",
    "anti_exclude": "SELECT subject_id, layer, diagnosis FROM {cohort} a WHERE NOT EXISTS (SELECT 1 FROM {cohort} b WHERE b.subject_id = a.subject_id AND b.quantity > 27)",
    "semi_groups": "SELECT subject_id, layer, diagnosis FROM {cohort} a WHERE EXISTS (SELECT 1 FROM {cohort} b WHERE b.subject_id = a.subject_id AND b.quantity > 27)",
    "combine_predictions": "SELECT c.c_custkey AS image, c.c_mktsegment AS own, coalesce(c.c_mktsegment, p.pred) AS prediction FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS pred FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) p ON c.c_custkey = p.o_custkey",
    "fdr_bh": f"SELECT feature, layer, p, least(1E0, min(p * n / r) OVER (ORDER BY p DESC, feature DESC, layer DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM (SELECT *, row_number() OVER (ORDER BY p, feature, layer) AS r, count(*) OVER () AS n FROM ({_PV}) v) w",
    "rank_pct": "SELECT subject_id, layer, feature, CASE WHEN v IS NULL THEN 0E0 ELSE CAST((rank() OVER (PARTITION BY layer, feature, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY layer, feature, v) - 1) / 2E0) / count(v) OVER (PARTITION BY layer, feature) AS DOUBLE) END AS pct FROM {long}",
    "mannwhitney_u": f"SELECT layer, feature, n1, n2, r1 - n1 * (n1 + 1) / 2E0 AS u, round(2 * (r1 - n1 * (n1 + 1) / 2E0) / n1 / n2 - 1, 9) AS rank_biserial FROM (SELECT layer, feature, sum(CASE WHEN diagnosis = 'AD' THEN r END) AS r1, count(CASE WHEN diagnosis = 'AD' THEN 1 END) AS n1, count(CASE WHEN diagnosis = 'control' THEN 1 END) AS n2 FROM ({_RANKS}) k GROUP BY layer, feature) s",
    "ks_statistic": """SELECT layer, feature, round(max(abs(fa / na - fc / nc)), 9) AS ks FROM (SELECT layer, feature, 1E0 * count(CASE WHEN diagnosis = 'AD' THEN 1 END) OVER w AS fa, 1E0 * count(CASE WHEN diagnosis = 'control' THEN 1 END) OVER w AS fc,
        count(CASE WHEN diagnosis = 'AD' THEN 1 END) OVER (PARTITION BY layer, feature) AS na, count(CASE WHEN diagnosis = 'control' THEN 1 END) OVER (PARTITION BY layer, feature) AS nc
        FROM {long} WHERE diagnosis <> 'unknown' WINDOW w AS (PARTITION BY layer, feature ORDER BY v)) t GROUP BY layer, feature""",
    "permutation_md5": """SELECT b, CAST(sum(CASE WHEN k <= n1 THEN cents END) AS BIGINT) AS sum_a, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT b, cents, n1, row_number() OVER (PARTITION BY b ORDER BY md5(concat(subject_id, '|', CAST(b AS STRING))), subject_id) AS k FROM (
        SELECT subject_id, CAST(round(price * 100) AS BIGINT) AS cents, count(CASE WHEN diagnosis = 'AD' THEN 1 END) OVER () AS n1 FROM {cohort} WHERE layer = 'SVC' AND diagnosis <> 'unknown') s CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) d) t GROUP BY b""",
    "group_separation": "SELECT round(sqrt(sum(d * d)), 6) AS centroid_distance FROM (SELECT avg(CASE WHEN diagnosis = 'AD' THEN v END) - avg(CASE WHEN diagnosis = 'control' THEN v END) AS d FROM {long} GROUP BY feature) t",
    "mask_confusion": f"SELECT image_id, {_METRICS} FROM (SELECT image_id, {_CELLS} FROM ({_TRUE}) t GROUP BY image_id) m",
    "fov_metrics": f"SELECT image_id, {_METRICS} FROM (SELECT image_id, {_CELLS} FROM ({_TRUE}) t WHERE f GROUP BY image_id) m",
    "vessel_density": "SELECT image_id, count(CASE WHEN x > 0 THEN 1 END) AS on_px, 1E0 * count(CASE WHEN x > 0 THEN 1 END) / count(*) AS density FROM {pixels} GROUP BY image_id",
    "neighbor_counts": f"SELECT image_id, neighbors, count(*) AS n FROM ({_NEAR}) t GROUP BY image_id, neighbors",
    "branch_and_endpoints": f"SELECT image_id, count(CASE WHEN neighbors >= 3 THEN 1 END) AS branchpoints, count(CASE WHEN neighbors = 1 THEN 1 END) AS endpoints FROM ({_NEAR}) t GROUP BY image_id",
    "crossing_candidates": f"SELECT image_id, count(*) AS candidates FROM ({_NEAR}) t WHERE neighbors >= 4 AND (CASE WHEN h = 2 THEN 1 ELSE 0 END + CASE WHEN vv = 2 THEN 1 ELSE 0 END + CASE WHEN d1 = 2 THEN 1 ELSE 0 END + CASE WHEN d2 = 2 THEN 1 ELSE 0 END) >= 2 GROUP BY image_id",
    "box_count_fd": f"SELECT image_id, round(regr_slope(ln(k), ln(1E0 / s)), 6) AS fd FROM ({_BOXES}) b GROUP BY image_id",
    "tile_density_cv": "SELECT image_id, round(CASE WHEN avg(d) > 0 THEN stddev_pop(d) / avg(d) ELSE 0E0 END, 6) AS cv FROM (SELECT image_id, tr, tc, avg(CASE WHEN x > 0 THEN 1E0 ELSE 0E0 END) AS d FROM (SELECT image_id, x, CASE WHEN r < 3 THEN 0 WHEN r < 6 THEN 1 ELSE 2 END AS tr, CASE WHEN c < 3 THEN 0 WHEN c < 6 THEN 1 ELSE 2 END AS tc FROM {pixels}) q GROUP BY image_id, tr, tc) t GROUP BY image_id",
    "feature_errors": f"SELECT image_id, tp + fn AS manual, tp + fp AS predicted, abs(fp - fn) AS abs_error, CASE WHEN tp + fn = 0 THEN CASE WHEN tp + fp = 0 THEN 0E0 ELSE CAST('Infinity' AS DOUBLE) END ELSE 1E0 * abs(fp - fn) / (tp + fn) END AS rel_error FROM (SELECT image_id, {_CELLS} FROM ({_TRUE}) t GROUP BY image_id) m",
    "threshold_grid_tune": """SELECT k, n_rows, mean_dice, rn = 1 AS selected FROM (SELECT k, n_rows, mean_dice, row_number() OVER (ORDER BY mean_dice DESC NULLS LAST, k) AS rn FROM (SELECT k, count(*) AS n_rows, round(avg(CASE WHEN a + b = 0 THEN 1E0 ELSE 2E0 * i / (a + b) END), 9) AS mean_dice FROM (
        SELECT image_id, k, count(CASE WHEN x > 0 THEN 1 END) AS a, count(CASE WHEN x >= k / 20E0 THEN 1 END) AS b, count(CASE WHEN x > 0 AND x >= k / 20E0 THEN 1 END) AS i FROM {pixels} CROSS JOIN (SELECT -2 AS k UNION ALL SELECT -1 UNION ALL SELECT 1 UNION ALL SELECT 2) g GROUP BY image_id, k) m GROUP BY k) t) u""",
    "auroc": "SELECT round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2E0) / (1E0 * n1 * n0), 9) AS auroc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2E0 AS r, count(CASE WHEN y = 1 THEN 1 END) OVER () AS n1, count(CASE WHEN y = 0 THEN 1 END) OVER () AS n0 FROM {scores}) t GROUP BY n1, n0",
    "average_precision": "SELECT round(sum(1E0 * pos / n1 * tp / k), 6) AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k, sum(pos) OVER () AS n1 FROM (SELECT p, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(*) AS n FROM {scores} GROUP BY p) g) t",
    "brier": "SELECT round(avg((p - y) * (p - y)), 9) AS brier FROM {scores}",
    "prob_histogram": "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, y, count(*) AS n FROM {scores} GROUP BY CAST(least(floor(p * 10), 9) AS INT), y",
    "robust_scale_impute": "SELECT subject_id, layer, feature, round((coalesce(v, m) - m) / CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1E0 END, 6) AS scaled FROM (SELECT l.subject_id, l.layer, l.feature, l.v, q.m, q.q1, q.q3 FROM {long} l JOIN (SELECT feature, percentile_cont(0.5) WITHIN GROUP (ORDER BY v) AS m, percentile_cont(0.25) WITHIN GROUP (ORDER BY v) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY v) AS q3 FROM {long} GROUP BY feature) q ON l.feature = q.feature) t",
    "path_parse_manifest": r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS split, regexp_extract(url, '/([0-9]+)', 1) AS image, lower(regexp_replace(url, '[^A-Za-z0-9]+', '')) = url AS plain FROM {pages}",
}
