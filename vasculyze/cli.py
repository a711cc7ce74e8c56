"""Command lines: `python -m vasculyze.cli benchmark|layer-stats ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import benchmark, contrasts, feature_table, inference, outliers
from .plans import report
from .sources import images, manifests, sinks


def load_images(manifest: DataFrame) -> DataFrame:
    """A manifest's rows with gray plane and mask, joined by path; the paths named come to the driver as the readers' input."""
    spark = manifest.sparkSession
    paths = sorted({p for r in manifest.select("image_path", "mask_path").collect() for p in r})
    files = images.read_gray(spark, paths)
    mask = files.select(F.col("path").alias("mask_path"), images.as_mask().alias("mask"))
    return manifest.join(files.withColumnRenamed("path", "image_path"), "image_path").join(mask, "mask_path")


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.csv(a.manifest, header=True)
    manifests.require_columns(rows, ["image_id", "image_path", "mask_path"])
    rows = rows.orderBy("image_id").limit(a.max_rows) if a.max_rows else rows
    out = benchmark.benchmark(load_images(rows), a.methods.split(","), keep_planes=bool(a.output_root))
    if a.output_root:
        sinks.write_masks(out.join(load_images(rows).select("image_id", "h", "w"), "image_id"), a.output_root).write.mode("overwrite").parquet(f"{a.output_root}/paths")
        out = out.drop("mask", "score")
    sinks.write_table(out, a.out, "csv")


def run_features(spark: SparkSession, a: argparse.Namespace) -> None:
    """Masks are read from their folder by Spark and meet the manifest by path: no path comes to the driver."""
    manifest = spark.read.csv(a.manifest, header=True)
    masks = images.read_gray(spark, a.masks).select("path", "h", "w", images.as_mask().alias("mask"))
    feature_table.build(manifest, masks, a.min_component_size).write.mode("overwrite").parquet(a.out)


def read_features(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first of the candidates that can be read, Parquet or (by its name) CSV."""
    for path in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    raise FileNotFoundError(f"no feature table among {', '.join(candidates)}")


def run_layer_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    t = read_features(spark, a.features.split(","))
    names = [c for c, kind in t.dtypes if kind in ("double", "float") and not c.startswith("_")]
    compare = lambda df, what, keys, columns: inference.compare_groups(df, columns, keys, n_boot=a.n_boot, n_perm=a.n_perm).withColumn("analysis", F.lit(what))
    effects = compare(t, "layer", ["layer"], names)
    scores = outliers.outlier_scores(t, names)
    kept = contrasts.drop_flagged(t, scores)
    without = compare(kept, "layer", ["layer"], names)
    subjects, pairs = contrasts.aggregate_subjects(t, names), contrasts.layer_contrasts(t, names)
    numbers = lambda df: [c for c, kind in df.dtypes if kind == "double"]
    tables = {
        "layer_effects": effects, "effects_without_outliers": without, "outlier_sensitivity": contrasts.outlier_sensitivity(effects, without), "subject_features": subjects, "layer_contrasts": pairs,
        "subject_effects": compare(subjects, "subject", [], numbers(subjects)), "contrast_effects": compare(pairs, "contrast", [], numbers(pairs)), "artifact_audit": inference.audit_artifacts(t, n_boot=a.n_boot, n_perm=a.n_perm),
    }
    for name, made in tables.items():
        sinks.write_table(made, f"{a.out}/{name}", "csv")
    sinks.write_table(scores.drop("top_extreme_features"), f"{a.out}/outliers")
    flagged = scores.where("is_feature_outlier").orderBy(F.desc("max_abs_zscore"), "subject_id")
    body = [("Effects", report.table(report.top_effects(effects))), ("Outliers", report.table(flagged, 12, ["subject_id", "layer", "max_abs_zscore", "top_extreme_features"]))]
    report.write(f"{a.out}/report.html", report.page("Layer statistics", body))


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="vasculyze")
    kinds = parser.add_subparsers(dest="kind", required=True)
    b = kinds.add_parser("benchmark")
    b.add_argument("--manifest", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--methods", default="frangi,diffusion_threshold,random_walker,geodesic_voting")
    b.add_argument("--output-root")
    b.add_argument("--max-rows", type=int)
    b.set_defaults(run=run_benchmark)
    f = kinds.add_parser("features")
    f.add_argument("--manifest", required=True)
    f.add_argument("--masks", required=True, help="folder of the mask images")
    f.add_argument("--out", required=True)
    f.add_argument("--min-component-size", type=int, default=0)
    f.set_defaults(run=run_features)
    s = kinds.add_parser("layer-stats")
    s.add_argument("--features", required=True, help="candidates, comma between; the first that exists is read")
    s.add_argument("--out", required=True)
    s.add_argument("--n-boot", type=int, default=500)
    s.add_argument("--n-perm", type=int, default=1000)
    s.set_defaults(run=run_layer_stats)
    a = parser.parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
