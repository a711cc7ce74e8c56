"""Splits, targets and samples: leakage-safe group splits, binary targets, balanced samples, calibration bins, chi-square.

Orders are two-level, parts of a hash or of the rows first, or top-k: no window holds a whole label or table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import TWINS, cohort, scores, table

# Labels that mean no disease.
NORMAL = ("normal", "control", "healthy", "no disease", "no_disease")


def _alike(df: DataFrame, other: DataFrame, name: str, to: str):
    return df.join(other.withColumnRenamed(name, f"_k_{name}"), F.col(to).eqNullSafe(F.col(f"_k_{name}"))).drop(f"_k_{name}")


def group_split(df: DataFrame, group: str, label: str | None = None, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """(group, side): test or train for every group, so that no group is on both sides.

    With a label, of which a group must have one only, each label gives its share of groups, the odd ones by largest
    remainder; with a label of fewer than two groups, or none, groups are drawn from all alike. Groups are taken in the order
    of the md5 of seed and name. Rows of a null group (and, where labels count, of a null label) are on neither side. Raises
    where a column lacks, test_size isn't between 0 and 1, there are fewer than two groups, or a group's labels conflict.
    """
    if group not in df.columns:
        raise ValueError(f"Missing required group column: {group}")
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    named = df.where(F.col(group).isNotNull())
    with_label = label is not None and label in df.columns
    y = F.col(label) if with_label else F.lit(None).cast("string")
    groups = named.groupBy(F.col(group).alias("g")).agg(F.min(y).alias("y"), F.count_distinct(y).alias("kinds"), F.max(y.isNull()).alias("bare"))
    if with_label:
        bad = [str(r["g"]) for r in groups.where((F.col("kinds") > 1) | ((F.col("kinds") == 1) & F.col("bare"))).orderBy("g").limit(5).collect()]
        if bad:
            raise ValueError(f"conflicting labels ({label}) within groups: {', '.join(bad)}")
    sizes = {r["y"]: r["n"] for r in groups.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) < 2:
        raise ValueError("a grouped split needs at least two non-null groups")
    labelled = {k: n for k, n in sizes.items() if k is not None}
    if len(labelled) >= 2 and min(labelled.values()) >= 2:
        groups = groups.where("y is not null").select("g", F.col("y").cast("string").alias("part"))
        sizes = {str(k): n for k, n in labelled.items()}
    else:
        groups, sizes = groups.select("g", F.lit("").alias("part")), {"": sum(sizes.values())}
    wanted = math.ceil(test_size * sum(sizes.values()) - 1e-9)
    take = {k: math.floor(test_size * n + 1e-9) for k, n in sizes.items()}
    odd = sorted(sizes, key=lambda k: (take[k] - test_size * sizes[k], k))
    for k in odd[: wanted - sum(take.values())]:
        take[k] += 1
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("g").cast("string")).cast("binary"))
    ranked = groups.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    w = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n")).select("part", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    goal = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part", "bucket").orderBy("h", "g"))
    out = ranked.join(before, ["part", "bucket"]).withColumn("rank", rank)
    return out.select(F.col("g").alias(group), F.when(F.col("rank") <= goal[F.col("part")], "test").otherwise("train").alias("side"))


def binary_target(df: DataFrame, label: str = "label") -> DataFrame:
    """df's rows that have a label, with target and target_name: not normal against normal where both occur, else, of exactly two
    labels, the later against the earlier. Labels count in lower case without blanks around them. Raises on any other set."""
    if label not in df.columns:
        raise ValueError(f"Missing label column: {label}")
    x = F.lower(F.trim(F.col(label).cast("string")))
    rows = df.where(x.isNotNull() & (x != ""))
    r = rows.agg(F.count_distinct(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.max(x.isin(*NORMAL)).alias("some"), F.min(x.isin(*NORMAL)).alias("only")).head()
    if r["some"] and not r["only"]:
        return rows.withColumns({"target": (~x.isin(*NORMAL)).cast("int"), "target_name": F.lit("disease_vs_normal")})
    if r["n"] == 2:
        return rows.withColumns({"target": (x == r["high"]).cast("int"), "target_name": F.lit(f"{r['high']}_vs_{r['low']}")})
    raise ValueError(f"{r['n']} labels of {label} make no binary target")


def balanced_sample(df: DataFrame, most: int, order: str, label: str = "label", image: str = "image_id") -> DataFrame:
    """At most `most` rows: up to half (one at least) of disease, then as many of control, then others, each in the order of
    `order` (ties by image), an image once. Only top-k steps, so nothing but `most` rows is ever ordered in one place."""
    by = [F.col(order).asc_nulls_last(), F.col(image).asc_nulls_last()]
    half, x = max(1, most // 2), F.lower(F.col(label).cast("string"))
    picked = [df.where(x == name).orderBy(*by).limit(half).withColumn("_turn", F.lit(i)) for i, name in enumerate(("disease", "control"))]
    chosen = picked[0].unionByName(picked[1])
    ids = chosen.select(F.col(order).alias("_o"), F.col(image).alias("_i"))
    rest = df.join(ids, F.col(order).eqNullSafe(F.col("_o")) & F.col(image).eqNullSafe(F.col("_i")), "left_anti").orderBy(*by).limit(most).withColumn("_turn", F.lit(2))
    rows = chosen.unionByName(rest).orderBy("_turn", *by).limit(most)
    once = Window.partitionBy(image).orderBy("_turn", *by)
    return rows.withColumn("_no", F.row_number().over(once)).where("_no = 1").drop("_no", "_turn")


def calibration_bins(df: DataFrame, bins: int = 8) -> DataFrame:
    """(bin, n, rate, mean_p) between quantile edges of the score: equal scores share a bin, empty bins have no row."""
    d = df.where("p is not null and y is not null")
    edges = d.agg(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e")).head()["e"] or []
    at = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in edges), F.lit(0))
    return d.groupBy((at + 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("y").cast("double")), 9).alias("rate"), F.round(F.avg("p"), 9).alias("mean_p"))


def _split(spark, sf_dir):
    """Customers, who each have one segment, split by segment."""
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return _named(group_split(who, "c_custkey", "c_mktsegment"))


def _named(df):
    return df.select(F.col("c_custkey").alias("subject"), "side")


def _sample(spark, sf_dir):
    d = scores(spark, sf_dir).select(F.col("id").alias("image_id"), F.when(F.col("y") == 1, "disease").otherwise("control").alias("label"), "p")
    return balanced_sample(d, 25, "p").select("image_id", "label")


_COHORT = f"WITH cohort AS ({TWINS['cohort']})"
_SCORES = f"WITH scores AS ({TWINS['scores']})"
QUERIES = {
    "stratified_group_split": _split,
    "binary_target": lambda spark, sf_dir: binary_target(cohort(spark, sf_dir), "raw_diagnosis").select("subject_id", "layer", "target", "target_name"),
    "balanced_sample": _sample,
    "calibration_bins": lambda spark, sf_dir: calibration_bins(scores(spark, sf_dir)),
}
ORACLE_SQL = {
    "stratified_group_split": """WITH s AS (SELECT c_mktsegment AS y, count(*) AS n, floor(0.25 * count(*))::BIGINT AS low, 0.25 * count(*) - floor(0.25 * count(*)) AS odd FROM customer GROUP BY c_mktsegment),
        t AS (SELECT y, low + CASE WHEN row_number() OVER (ORDER BY odd DESC, y) <= (SELECT ceil(0.25 * sum(n)) - sum(low) FROM s) THEN 1 ELSE 0 END AS k FROM s),
        r AS (SELECT c_custkey, c_mktsegment AS y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|' || c_custkey::VARCHAR), c_custkey) AS no FROM customer)
        SELECT c_custkey AS subject, CASE WHEN no <= k THEN 'test' ELSE 'train' END AS side FROM r JOIN t USING (y)""",
    "binary_target": _COHORT + " SELECT subject_id, layer, CASE WHEN diagnosis = 'control' THEN 0 ELSE 1 END::INT AS target, 'disease_vs_normal' AS target_name FROM cohort WHERE raw_diagnosis IS NOT NULL",
    "balanced_sample": _SCORES + """, a AS (SELECT id, p, CASE WHEN y = 1 THEN 'disease' ELSE 'control' END AS label, row_number() OVER (PARTITION BY y ORDER BY p, id) <= 12 AS half FROM scores),
        b AS (SELECT *, row_number() OVER (ORDER BY half DESC, p, id) AS no FROM a) SELECT id AS image_id, label FROM b WHERE no <= 25""",
    "calibration_bins": _SCORES + """, q AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM scores),
        b AS (SELECT y, p, 1 + len(list_filter(e, lambda x: x < p)) AS bin FROM scores, q) SELECT bin, count(*) AS n, round(avg(y), 9) AS rate, round(avg(p), 9) AS mean_p FROM b GROUP BY bin""",
}
