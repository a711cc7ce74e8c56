"""Driver tables as the analytics' own relations: cohort, its long form, pixels and classifier scores.

Each has a twin in SQL (TWINS) that the oracle queries start from. Means are sums of integer hundredths divided once, so
that engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalize_diagnosis

FEATURES = ("quantity", "price", "discount", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and layer. The fact table is aggregated by order and layer before it meets the dimensions."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *[F.round(F.col(c) * 100).cast("long").alias(f) for c, f in zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), FEATURES)])
    per = line.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in FEATURES])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per = per.join(orders, per.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_returnflag").agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in FEATURES])
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    raw = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'AD' WHEN 'AUTOMOBILE' THEN 'Disease ' WHEN 'FURNITURE' THEN 'control' WHEN 'HOUSEHOLD' THEN 'Healthy' END")
    layer = F.expr("CASE l_returnflag WHEN 'A' THEN 'SVC' WHEN 'N' THEN 'DVC' ELSE 'SVC+DVC' END")
    return per.join(who, per.o_custkey == who.c_custkey).select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("subject_id"), layer.alias("layer"), raw.alias("raw_diagnosis"), normalize_diagnosis(raw).alias("diagnosis"),
        F.col("n").alias("n_rows"), *[(F.col(f).cast("double") / F.col("n") / 100.0).alias(f) for f in FEATURES],
    )


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).unpivot(["subject_id", "layer", "diagnosis"], list(FEATURES), "feature", "v")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 images: (image_id, r, c, x)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("image_id", F.expr("pos div 8").cast("int").alias("r"), (F.col("pos") % 8).cast("int").alias("c"), F.col("x").cast("double").alias("x"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p, grp): a binary label and a deterministic score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") % 1000).cast("double") / 1000.0).alias("p"), F.col("source").alias("grp"))


_N = "CASE WHEN lower(trim({0})) IN ('ad','alzheimers','alzheimer','alzheimer''s disease','disease') THEN 'AD' WHEN lower(trim({0})) IN ('control','controls','healthy','normal','cn') THEN 'control' ELSE 'unknown' END"
_RAW = "CASE c_mktsegment WHEN 'BUILDING' THEN 'AD' WHEN 'AUTOMOBILE' THEN 'Disease ' WHEN 'FURNITURE' THEN 'control' WHEN 'HOUSEHOLD' THEN 'Healthy' END"
_MEANS = ", ".join(f"sum(round({c} * 100)::BIGINT)::DOUBLE / count(*) / 1E2 AS {f}" for c, f in zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), FEATURES))
TWINS = {
    "cohort": f"SELECT 'S' || c_custkey::VARCHAR AS subject_id, CASE l_returnflag WHEN 'A' THEN 'SVC' WHEN 'N' THEN 'DVC' ELSE 'SVC+DVC' END AS layer, {_RAW} AS raw_diagnosis, {_N.format(_RAW)} AS diagnosis, count(*)::BIGINT AS n_rows, {_MEANS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, l_returnflag",
    "long": " UNION ALL ".join(f"SELECT subject_id, layer, diagnosis, '{f}' AS feature, {f} AS v FROM cohort" for f in FEATURES),
    "pixels": "SELECT vec_id AS image_id, ((pos - 1) // 8)::INT AS r, ((pos - 1) % 8)::INT AS c, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)",
    "scores": "SELECT l.doc_id AS id, quality AS y, (n_chars % 1000)::DOUBLE / 1000.0::DOUBLE AS p, source AS grp FROM labels l JOIN documents d USING (doc_id)",
}
NEEDS = {"long": ["cohort"]}
