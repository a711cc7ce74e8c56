"""Models on feature tables: balanced logistic regression and principal components."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import FEATURES, cohort


def _scaled(df: DataFrame, train: DataFrame, columns) -> DataFrame:
    """Centred and scaled by the training rows' mean and population deviation; missing values count as the mean."""
    s = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).head()
    out = df.select("*", *[(F.coalesce(F.col(c) - (s[f"m_{c}"] or 0.0), F.lit(0.0)) / (s[f"s_{c}"] or 1.0)).alias(f"z_{c}") for c in columns])
    return VectorAssembler(inputCols=[f"z_{c}" for c in columns], outputCol="z").transform(out)


def logistic_scores(spark, sf_dir):
    """AD against control, trained on three quarters of the subjects, classes weighted alike, L2 as C = 1."""
    d = cohort(spark, sf_dir).where("diagnosis <> 'unknown'").withColumn("y", (F.col("diagnosis") == "AD").cast("double"))
    d = d.withColumn("test", F.pmod(F.xxhash64("subject_id"), F.lit(4)) == 0)
    train = d.where("not test")
    n = train.agg(F.count(F.lit(1)), F.sum("y")).head()
    w = F.when(F.col("y") == 1, n[0] / (2 * max(1.0, n[1]))).otherwise(n[0] / (2 * max(1.0, n[0] - n[1])))
    z = _scaled(d, train, FEATURES).withColumn("w", w)
    fit = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1 / max(1, n[0]), standardization=False, maxIter=1000).fit(z.where("not test"))
    return fit.transform(z.where("test")).select("subject_id", "layer", "y", vector_to_array("probability")[1].alias("p"))


def pca_embedding(spark, sf_dir, k: int = 2):
    d = cohort(spark, sf_dir)
    z = _scaled(d, d, FEATURES)
    model = PCA(k=k, inputCol="z", outputCol="c").fit(z)
    sign = [1.0 if max(col, key=abs) >= 0 else -1.0 for col in model.pc.toArray().T.tolist()]
    c = vector_to_array("c")
    return model.transform(z).select("subject_id", "layer", "diagnosis", *[(c[i] * sign[i]).alias(f"component_{i + 1}") for i in range(k)])


QUERIES = {"logistic_scores": logistic_scores, "pca_embedding": pca_embedding}
