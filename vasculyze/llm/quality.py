"""Quality by hierarchical empirical Bayes.

A document's own evidence is a log likelihood ratio from a logistic classifier of its text's shape. Where it comes from
speaks too: the labelled documents of its host, and of its path below the host, give rates of good documents; each
level's rates shrink towards the level above (path to host, host to the whole corpus) with a strength that the spread
between groups itself implies. Posterior log odds = evidence + log odds of the shrunken path rate.

Documents carry no address, so by default source is the host and (source, lang) the path.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, small_batches, tidy

#: Labelled documents that the classifier learns from at most.
SAMPLE_DOCS = 12_000
_KIND = np.full(256, 6, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-?", b"!#$%&*|<>{}[]()=+/\\@^_~`")):
    _KIND[list(_chars)] = _i
FEATURES = 12


def features(texts: list[str | None]) -> np.ndarray:
    """A row per whole text: shares of byte kinds, length, lengths of words and lines, repeated words and lines."""
    out = np.zeros((len(texts), FEATURES))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        n = len(raw)
        if not n:
            continue
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
        ws, ls = raw.split(), raw.split(b"\n")
        out[i, :7] = kinds / n
        out[i, 7:] = math.log1p(n), n / (len(ws) + 1) / 10, math.log1p(n / len(ls)), 1 - len(set(ls)) / len(ls), len(set(ws)) / (len(ws) + 1)
    return out


class Evidence:
    """A ridge logistic classifier; evidence is its log odds less those of its training sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        z = np.column_stack([self._basis(x), np.ones(len(x))])
        b = np.zeros(z.shape[1])
        if len(np.unique(y)) == 2:
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
                h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(b))
                b += np.clip(np.linalg.solve(h, z.T @ (y - p) - b), -4, 4)
            rate = y.mean()
            b[-1] -= math.log(rate / (1 - rate))
        self.b = b

    def _basis(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([s, s * s / 8])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self._basis(x), np.ones(len(x))]) @ self.b


def _strength(groups: DataFrame, centre) -> float:
    """Prior strength by the method of moments: from how far rates of groups lie from `centre` beyond what chance explains."""
    v = F.greatest(centre * (1 - centre), F.lit(1e-6))
    r = groups.agg(F.sum(F.col("n") * F.pow(F.col("pos") / F.col("n") - centre, 2) / v).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn")).head()
    if not r["n"]:
        return 1.0
    free = r["n"] - r["nn"] / r["n"] - (r["g"] - 1)
    rho = (r["s"] - (r["g"] - 1)) / free if free > 0 else 0.0
    return 1 / min(max(rho, 1e-4), 0.99) - 1


def posteriors(labelled: DataFrame, host: str = "source", path: str = "lang") -> tuple[DataFrame, DataFrame, float]:
    """labelled: host and path columns and y (0 or 1). -> (host, host_rate), (host, path, path_rate), the corpus rate."""
    paths = labelled.groupBy(host, path).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("pos"))
    whole = paths.agg(F.sum("pos"), F.sum("n")).head()
    mu = min(max((whole[0] or 0.0) / (whole[1] or 1.0), 0.01), 0.99) if whole[1] else 0.5
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    k = _strength(hosts, F.lit(mu))
    hosts = hosts.select(F.col(host).alias("_h"), ((F.col("pos") + k * mu) / (F.col("n") + k)).alias("host_rate"))
    below = paths.join(hosts, F.col(host).eqNullSafe(F.col("_h")))
    k = _strength(below, F.col("host_rate"))
    below = below.select(F.col("_h"), F.col(path).alias("_p"), ((F.col("pos") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    return hosts, below, mu


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """Per row: key, evidence, host_rate, path_rate, score (posterior probability of quality 1) and keep (score >= 0.5).

    labels: key, quality; nulls are left out, a doubly labelled key counts as good if any label is. Null hosts and paths
    are groups like others; unseen ones have the rate of the level above. Null and empty texts have the evidence of an
    empty text; repeated rows each come back; with no labels all evidence is 0 and every rate a half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.max("quality") > 0).cast("int").alias("y"))
    picked = [(r[0], r[1]) for r in marks.orderBy(F.xxhash64(F.lit("quality"), key), key).limit(SAMPLE_DOCS).collect()]
    few = spark.createDataFrame(picked, f"`{key}` bigint, y int")

    def shapes(batches):
        for b in batches:
            x = features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = docs.select(key, "text").join(F.broadcast(few), key).select("text", "y").mapInArrow(shapes, "x array<double>, y int").collect()
    model = Evidence(np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got], float))
    hosts, below, mu = posteriors(docs.select(key, host, path).join(marks, key), host, path)
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shared.value(features(b.column(3).to_pylist())))], names=[key, host, path, "evidence"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    d = docs.select(key, host, path, "text").mapInArrow(tidy(evidence), f"`{key}` {kinds[key]}, `{host}` {kinds[host]}, `{path}` {kinds[path]}, evidence double")
    d = d.join(hosts, F.col(host).eqNullSafe(F.col("_h")), "left").drop("_h").join(below, F.col(host).eqNullSafe(F.col("_h")) & F.col(path).eqNullSafe(F.col("_p")), "left")
    d = d.withColumn("host_rate", F.coalesce("host_rate", F.lit(mu))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return d.withColumn("score", 1 / (1 + F.exp(-odds))).select(key, "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Learns from labels of documents whose crc32(doc_id as text) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = crc32_of("doc_id") % 5 == 0
    return classify(docs, labels.where(~held)).select("doc_id", held.alias("held_out"), "evidence", "host_rate", "path_rate", "score", "keep")
