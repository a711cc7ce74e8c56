"""What is known of each feature: when in the disease it was reported to change, and on which kind of image it is measured."""

from __future__ import annotations

# Timing and datasets of the features.
EARLY_BOTH = ("tortuous_segment_fraction", "tortuous_length_fraction", "mean_segment_tortuosity", "median_segment_tortuosity", "p90_segment_tortuosity", "p95_segment_tortuosity")
EARLY_FUNDUS = ("caliber_cv", "mean_vessel_caliber_px", "caliber_p90_minus_p10_px", "large_vessel_caliber_cv", "candidate_crossing_density", "candidate_crossing_count")
EARLY_OCTA = ("mean_tortuosity_arc_chord", "high_tortuosity_fraction")
LATE_BOTH = ("vessel_density", "skeleton_length_density", "branchpoint_density", "connected_component_count")
LATE_FUNDUS = ("major_branch_count",)
LATE_OCTA = ("vessel_area_fraction", "endpoint_density", "largest_component_fraction", "small_component_fraction", "mean_segment_length_px", "median_segment_length_px")
CONTEXT_BOTH = ("fractal_dimension_boxcount",)
CONTEXT_OCTA = ("caliber_proxy_mean_px", "caliber_proxy_median_px", "caliber_proxy_std_px", "orientation_entropy")
INTERPRETIVE_OCTA = ("dropout_heterogeneity", "hole_fraction_or_dropout_proxy")
# Prefixes of derived features.
CONTRASTS = ("DVC_minus_SVC_", "SVCplusDVC_minus_SVC_", "SVCplusDVC_minus_DVC_", "DVC_div_SVC_", "SVCplusDVC_div_SVC_", "SVCplusDVC_div_DVC_", "DVC_logratio_SVC_", "SVCplusDVC_logratio_SVC_", "SVCplusDVC_logratio_DVC_")
AGGREGATES = ("mean_", "min_", "max_", "range_", "std_", "SVC_", "DVC_", "SVC+DVC_")

_GROUPS = (
    ("early", "FIVES+ROSE", EARLY_BOTH), ("early", "FIVES", EARLY_FUNDUS), ("early", "ROSE", EARLY_OCTA), ("late", "FIVES+ROSE", LATE_BOTH), ("late", "FIVES", LATE_FUNDUS), ("late", "ROSE", LATE_OCTA),
    ("context", "FIVES+ROSE", CONTEXT_BOTH), ("context", "ROSE", CONTEXT_OCTA), ("interpretive", "ROSE", INTERPRETIVE_OCTA),
)
METADATA = {n: {"timing": t, "datasets": d.split("+")} for t, d, names in _GROUPS for n in names}
DEFAULT = {"timing": "context", "datasets": ["FIVES", "ROSE"]}


def metadata_of(feature: str) -> dict:
    """The feature's own entry, else that of its name without a derived feature's prefix, else the default."""
    while feature not in METADATA:
        head = next((p for p in (*CONTRASTS, *AGGREGATES) if feature.startswith(p)), None)
        if head is None:
            return DEFAULT
        feature = feature[len(head) :]
    return METADATA[feature]


_PREFIX = "^(" + "|".join((*CONTRASTS, *AGGREGATES)).replace("+", "[+]") + ")"
_ROWS = ", ".join(f"('{n}', '{m['timing']}', '{'+'.join(m['datasets'])}')" for n, m in METADATA.items())
_DIM = f"(SELECT * FROM (VALUES {_ROWS}) AS v(name, timing, datasets))"
_HEADS = ", ".join(f"('{p}')" for p in ("", "mean_", "DVC_minus_SVC_", "SVC+DVC_", "DVC_div_SVC_mean_", "other_"))

#: Names with up to two prefixes against the table of features (32 rows). Valid in both engines.
LOOKUP_SQL = f"""SELECT f.feature, coalesce(a.timing, b.timing, c.timing, '{DEFAULT["timing"]}') AS timing, coalesce(a.datasets, b.datasets, c.datasets, '{"+".join(DEFAULT["datasets"])}') AS datasets
    FROM (SELECT feature, one, regexp_replace(one, '{_PREFIX}', '') AS two FROM (SELECT feature, regexp_replace(feature, '{_PREFIX}', '') AS one FROM (
        SELECT concat(h.head, n.name) AS feature FROM (SELECT * FROM (VALUES {_HEADS}) AS w(head)) h CROSS JOIN {_DIM} n) x) y) f
    LEFT JOIN {_DIM} a ON f.feature = a.name LEFT JOIN {_DIM} b ON f.one = b.name LEFT JOIN {_DIM} c ON f.two = c.name"""
