"""Queries whose text differs between the engines: Spark's, and the twin's for DuckDB."""

from __future__ import annotations

from ..functions.metadata import LOOKUP_SQL
from ..operators.kernels import COMPONENTS_SQL

# Poisson(1) cut points in millionths, for weights 0 to 6.
POISSON = (367879, 735759, 919699, 981012, 996340, 999406)
_WEIGHT = "CASE " + " ".join(f"WHEN u < {c} THEN {w}" for w, c in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def _bootstrap(draws: str, unit: str) -> str:
    """Brier score of Poisson resamples: a row's weight in a draw comes from its own hash, so a draw is a map and a partial sum."""
    return f"""SELECT CAST(b AS BIGINT) AS b, CAST(sum(w) AS BIGINT) AS rows_drawn, round(sum(w * loss) / 1E6 / sum(w), 9) AS brier FROM (
        SELECT b, loss, {_WEIGHT} AS w FROM (SELECT b, CAST((k - 1000 * y) * (k - 1000 * y) AS BIGINT) AS loss, {unit} AS u FROM (SELECT l.doc_id AS id, l.quality AS y, d.n_chars % 1000 AS k FROM {{labels}} l JOIN {{documents}} d ON l.doc_id = d.doc_id) s CROSS JOIN {draws}) t) v GROUP BY b"""


def _intervals(draws: str, unit: str, low_high: str) -> str:
    """AUROC, average precision and Brier score of all rows with the 95 % interval of 500 Poisson resamples; a draw without both classes is skipped.

    Draw -1 is the rows as they are. Weights are summed by draw and score before anything is ordered, and ranks come in two levels, a
    bucket of scores and the scores within it, so an ordered group is a bucket of one draw. Where no draw has both classes, values and ends are null.
    """
    return f"""SELECT metric, round(max(CASE WHEN b < 0 THEN value END), 6) AS value, {low_high}, count(CASE WHEN b >= 0 THEN value END) AS draws FROM (
        WITH drawn AS (SELECT b, p, y, CASE WHEN b < 0 THEN 1 ELSE {_WEIGHT} END AS w FROM (SELECT b, p, y, {unit} AS u FROM {{scores}} s CROSS JOIN {draws} WHERE p IS NOT NULL AND y IS NOT NULL) t),
        sums AS (SELECT b, p, floor(p * 1024) AS bucket, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS neg FROM drawn GROUP BY b, p),
        buckets AS (SELECT b, bucket, sum(pos) OVER (PARTITION BY b ORDER BY bucket) - pos AS pos_before, sum(neg) OVER (PARTITION BY b ORDER BY bucket) - neg AS neg_before, sum(pos) OVER (PARTITION BY b) AS n1, sum(neg) OVER (PARTITION BY b) AS n0
            FROM (SELECT b, bucket, sum(pos) AS pos, sum(neg) AS neg FROM sums GROUP BY b, bucket) g),
        ranked AS (SELECT s.b, s.p, s.pos, s.neg, n1, n0, neg_before + sum(s.neg) OVER (PARTITION BY s.b, s.bucket ORDER BY s.p) - s.neg AS neg_below, n1 - pos_before - sum(s.pos) OVER (PARTITION BY s.b, s.bucket ORDER BY s.p) + s.pos AS tp, n0 - neg_before - sum(s.neg) OVER (PARTITION BY s.b, s.bucket ORDER BY s.p) + s.neg AS fp
            FROM sums s JOIN buckets k ON s.b = k.b AND s.bucket = k.bucket WHERE n1 > 0 AND n0 > 0),
        measured AS (SELECT b, sum(1E0 * pos * (2 * neg_below + neg)) / (2E0 * max(n1) * max(n0)) AS auroc, sum(CASE WHEN pos > 0 THEN 1E0 * pos * tp / (tp + fp) ELSE 0E0 END) / max(n1) AS ap,
            sum(pos * (1 - p) * (1 - p) + neg * p * p) / (max(n1) + max(n0)) AS brier FROM ranked GROUP BY b)
        SELECT b, 'auroc' AS metric, auroc AS value FROM measured UNION ALL SELECT b, 'average_precision', ap FROM measured UNION ALL SELECT b, 'brier', brier FROM measured) m GROUP BY metric"""


_KEYS = ("k",)
SPARK: dict[str, str] = {
    "metadata_lookup": LOOKUP_SQL,
    "cross_split": "SELECT o_custkey AS subject, count(DISTINCT o_orderstatus) AS splits FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
    "bootstrap_md5": _bootstrap("(SELECT explode(sequence(0, 49)) AS b) g", "CAST(conv(substr(md5(concat(CAST(id AS STRING), '|', CAST(b AS STRING))), 1, 13), 16, 10) AS BIGINT) % 1000000"),
    "metric_intervals": _intervals("(SELECT explode(sequence(-1, 499)) AS b) g", "CAST(conv(substr(md5(concat(CAST(id AS STRING), '|', CAST(b AS STRING))), 1, 13), 16, 10) AS BIGINT) % 1000000", "round(percentile(CASE WHEN b >= 0 THEN value END, 0.025), 6) AS ci_low, round(percentile(CASE WHEN b >= 0 THEN value END, 0.975), 6) AS ci_high"),
    "json_params": "SELECT event_id, user_id, " + ", ".join(f"get_json_object(props, '$.{k}') AS {k}" for k in _KEYS) + " FROM {events}",
}
TWINS: dict[str, str] = {
    "metadata_lookup": LOOKUP_SQL,
    "cross_split": SPARK["cross_split"],
    "bootstrap_md5": _bootstrap("(SELECT unnest(range(50)) AS b) g", "('0x' || substr(md5(concat(id::VARCHAR, '|', b::VARCHAR)), 1, 13))::BIGINT % 1000000"),
    "metric_intervals": _intervals("(SELECT unnest(range(-1, 500)) AS b) g", "('0x' || substr(md5(concat(id::VARCHAR, '|', b::VARCHAR)), 1, 13))::BIGINT % 1000000", "round(quantile_cont(CASE WHEN b >= 0 THEN value END, 0.025), 6) AS ci_low, round(quantile_cont(CASE WHEN b >= 0 THEN value END, 0.975), 6) AS ci_high"),
    "json_params": "SELECT event_id, user_id, " + ", ".join(f"json_extract_string(props, '$.{k}') AS {k}" for k in _KEYS) + " FROM {events}",
}
#: Twins of queries that are no SQL in Spark.
KERNEL_TWINS = {"component_sizes": COMPONENTS_SQL}
