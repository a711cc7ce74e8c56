"""Manifests of image folders: one row per image with its mask, from a CSV, an official layout or paired names.

Files are listed by the binaryFile source with only `path` read, so a listing costs no image bytes. Layouts are regular
expressions over the path below the root, and images meet masks by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import CODES, stem

# File endings, manifest names, tokens that mark a mask, directory names (letters and digits only).
SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
MANIFESTS = ("manifest.csv", "metadata.csv", "rose_manifest.csv", "fives_manifest.csv")
MASK_TOKENS = ("mask", "masks", "manual", "label", "labels", "gt", "groundtruth", "ground_truth", "ground truth", "annotation", "annotations")
FUNDUS_IMAGES, FUNDUS_MASKS = ("original", "images", "image"), ("groundtruth", "masks", "mask", "annotations")
OCTA_IMAGES, OCTA_MASKS = ("img", "image", "images", "original"), ("gt", "mask", "masks", "vessel")
SPLITS = ("train", "test")
SPLIT_PARTS = ("train", "test", "val", "valid", "validation")
# Subject numbers of the first OCTA cohort, by split (first, last).
COHORT_DISEASE = {"train": (1, 20), "test": (1, 6)}
COHORT_CONTROL = {"train": (21, 30), "test": (7, 9)}
COHORT_SOURCE = "ROSE-1 official AD/control cohort ordering: train 1-20 disease, train 21-30 control, test 1-6 disease, test 7-9 control"
# Path parts that name a group.
DISEASE_PARTS, CONTROL_PARTS, OTHER_PARTS = ("ad", "alzheimers", "alzheimer", "dementia"), ("control", "controls", "normal", "healthy", "cn"), ("amd", "dr", "glaucoma")


class DataNotFoundError(FileNotFoundError):
    """A dataset's folder is absent or holds nothing usable."""


def _missing(name: str, root: str, more: str = "") -> DataNotFoundError:
    return DataNotFoundError(f"{name} data were not found at {root}. Place the dataset there or add a manifest.csv. {more}".strip())


def require_columns(df: DataFrame, columns) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Missing required metadata columns: {', '.join(absent)}")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel) of image files below root, whatever the case of their ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)).withColumn("rel", F.expr(f"substr(path, {len(root.rstrip('/')) + 2})"))


def plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def is_mask(path: Column) -> Column:
    """A token anywhere in the whole path marks a mask, parents included."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(t)) for t in MASK_TOKENS])


def pairing_stem(path: Column) -> Column:
    """Lower-case stem without mask tokens, removed one after the other, and with single separators."""
    out = F.lower(stem(path))
    for t in MASK_TOKENS:
        out = F.regexp_replace(out, rf"(^|[_\-\s]){t}($|[_\-\s])", "_")
    return F.trim(F.regexp_replace(out, r"[_\-\s]+", "_"), F.lit("_"))


def layer_of(path: Column) -> Column:
    low = F.lower(path)
    svc, dvc = F.contains(low, F.lit("svc")), F.contains(low, F.lit("dvc"))
    return F.when(svc & dvc, "SVC+DVC").when(svc, "SVC").when(dvc, "DVC")


def group_of(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    first = F.try_element_at(F.filter(parts, lambda p: p.isin(*OTHER_PARTS)), F.lit(1))
    return F.when(has(DISEASE_PARTS), "AD").when(has(CONTROL_PARTS), "control").when(has(OTHER_PARTS), first)


def subject_of(path: Column) -> Column:
    none = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(none(F.regexp_extract(stem(path), r"(?i)(?:subject|subj|sub|patient|pt)[_\-\s]*(\d+)", 1)), none(F.regexp_extract(stem(path), r"\d+", 0)))


def split_of(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(*SPLIT_PARTS)), F.lit(1))


def diagnosis_code(path: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(stem(path), r"(?i)(?:^|[_\-\s])([ADGN])$", 1)), F.lit(""))


def cohort_label(split: Column, number: Column) -> Column:
    """Disease or control by the official order of subject numbers; null where the stem is no number or out of range."""
    n, out = number.try_cast("int"), F.lit(None).cast("string")
    for name, ranges in (("control", COHORT_CONTROL), ("disease", COHORT_DISEASE)):
        for s, (low, high) in ranges.items():
            out = F.when((split == s) & n.between(low, high), name).otherwise(out)
    return out


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The first manifest CSV there is."""
    for name in MANIFESTS:
        try:
            return spark.read.csv(f"{root.rstrip('/')}/{name}", header=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None


def standardize(df: DataFrame, root: str, dataset: str, modality: str) -> DataFrame:
    """Defaults for dataset, modality, image_id and split_group; paths made absolute. Other columns stay."""
    add = {}
    for name, value in (("dataset", dataset), ("modality", modality)):
        if name not in df.columns:
            add[name] = F.lit(value)
    for name in ("image_path", "mask_path"):
        if name in df.columns:
            add[name] = F.when(F.startswith(F.col(name), F.lit("/")), F.col(name)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(name)))
    if "image_id" not in df.columns and "image_path" in df.columns:
        add["image_id"] = stem(F.col("image_path"))
    if "split_group" not in df.columns and "subject_id" in df.columns:
        add["split_group"] = F.col("subject_id")
    return df.withColumns(add) if add else df


def _sides(found: DataFrame, keys: list[str], images, masks) -> DataFrame:
    """Images joined to masks of the same keys and stem. Of several folders of a kind the first by name counts, of several masks the last."""
    kind = F.when(plain(F.col("kind_dir")).isin(*images), "image").when(plain(F.col("kind_dir")).isin(*masks), "mask")
    f = found.withColumn("kind", kind).where("kind is not null")
    first = f.groupBy(*keys, "kind").agg(F.min("kind_dir").alias("kind_dir"))
    f = f.join(first, [*keys, "kind", "kind_dir"]).withColumn("stem", stem(F.col("path")))
    m = f.where("kind = 'mask'").groupBy(*keys, "stem").agg(F.max("path").alias("mask_path"))
    return f.where("kind = 'image'").select(*keys, "stem", F.col("path").alias("image_path")).join(m, [*keys, "stem"])


def fundus_layout(files: DataFrame) -> DataFrame:
    """train/test folders with images and masks at the root or one level below; the first such place by name counts."""
    at = r"^(?:([^/]+)/)?([^/]+)/([^/]+)/.+$"
    found = files.select("path", *[F.regexp_extract("rel", at, i).alias(n) for i, n in enumerate(("place", "split_dir", "kind_dir"), 1)])
    # The root itself is a place too: the same file read with no folder above the split.
    found = found.unionByName(files.select("path", F.lit("").alias("place"), F.regexp_extract("rel", "^([^/]+)/([^/]+)/.+$", 1).alias("split_dir"), F.regexp_extract("rel", "^([^/]+)/([^/]+)/.+$", 2).alias("kind_dir"))).distinct()
    found = found.withColumn("official_split", plain(F.col("split_dir"))).where(F.col("official_split").isin(*SPLITS)).drop("split_dir")
    pairs = _sides(found, ["place", "official_split"], FUNDUS_IMAGES, FUNDUS_MASKS)
    pairs = pairs.join(F.broadcast(pairs.agg(F.min("place").alias("place"))), "place")
    code, ident = diagnosis_code(F.col("image_path")), F.concat_ws("_", "official_split", "stem")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code), F.when(code.isNull(), group_of(F.col("image_path"))))
    return pairs.select(
        F.lit("FIVES").alias("dataset"), ident.alias("subject_id"), ident.alias("image_id"), "image_path", "mask_path", F.lit("fundus").alias("modality"),
        label.alias("label"), code.alias("diagnosis_code"), "official_split", ident.alias("split_group"),
    )


def octa_layout(files: DataFrame) -> DataFrame:
    """Both official OCTA layouts, at any depth; the second has no diagnosis, so its rows are null there."""
    pick = lambda pattern, names: files.select("path", *[F.regexp_extract("rel", pattern, i).alias(n) for i, n in enumerate(names, 1)])
    one = pick(r"^(.*?)ROSE-1/([^/]+)/([^/]+)/([^/]+)/.+$", ("place", "layer_dir", "split_dir", "kind_dir")).where(F.regexp_like("path", F.lit("/ROSE-1/")))
    one = one.withColumn("official_split", plain(F.col("split_dir"))).where(F.col("official_split").isin(*SPLITS)).drop("split_dir")
    one = one.withColumn("layer", layer_of(F.regexp_extract("path", r"^(.*/ROSE-1/[^/]+)/", 1))).where("layer is not null")
    one = _sides(one, ["place", "layer_dir", "layer", "official_split"], OCTA_IMAGES, OCTA_MASKS)
    subject, label = F.concat_ws("_", F.lit("ROSE-1"), "official_split", "stem"), cohort_label(F.col("official_split"), F.col("stem"))
    one = one.select(
        F.lit("ROSE-1").alias("dataset"), subject.alias("subject_id"), F.concat_ws("_", subject, "layer").alias("image_id"), "image_path", "mask_path", F.lit("OCTA").alias("modality"), "layer",
        label.alias("label"), F.when(label == "disease", "Alzheimer's disease").otherwise(label).alias("diagnosis"), F.when(label.isNotNull(), COHORT_SOURCE).alias("label_source"), "official_split", subject.alias("split_group"),
    )
    two = pick(r"^(.*?)ROSE-2/([^/]+)/([^/]+)/.+$", ("place", "split_dir", "kind_dir")).where(F.regexp_like("path", F.lit("/ROSE-2/")))
    two = two.withColumn("official_split", plain(F.col("split_dir"))).where(F.col("official_split").isin(*SPLITS)).drop("split_dir")
    two = _sides(two, ["place", "official_split"], OCTA_IMAGES, OCTA_MASKS)
    raw = F.coalesce(F.nullif(F.regexp_extract("stem", r"^[A-Za-z]*\d+(-\d+)?", 0), F.lit("")), subject_of(F.col("image_path")), F.col("stem"))
    subject = F.concat(F.lit("ROSE-2_"), raw)
    two = two.select(
        F.lit("ROSE-2").alias("dataset"), subject.alias("subject_id"), F.concat_ws("_", F.lit("ROSE-2"), "official_split", "stem").alias("image_id"), "image_path", "mask_path", F.lit("OCTA").alias("modality"),
        F.coalesce(layer_of(F.col("image_path")), F.lit("SVP")).alias("layer"), F.lit(None).cast("string").alias("label"), "official_split", subject.alias("split_group"),
    )
    return one.unionByName(two, allowMissingColumns=True)


def paired(files: DataFrame) -> DataFrame:
    """(image_path, mask_path) of equal stems once tokens are stripped; unmatched images go, the last of several masks counts."""
    f = files.select("path", is_mask(F.col("path")).alias("m"), pairing_stem(F.col("path")).alias("stem"))
    masks = f.where("m").groupBy("stem").agg(F.max("path").alias("mask_path"))
    return f.where("not m").select("stem", F.col("path").alias("image_path")).join(masks, "stem").drop("stem")


def guard_splits(df: DataFrame, name: str) -> DataFrame:
    """Raises if a subject is in more than one official split."""
    bad = df.groupBy("subject_id").agg(F.count_distinct("official_split").alias("n")).where("n > 1").orderBy("subject_id").limit(5).collect()
    if bad:
        raise ValueError(f"{name} subject_id appears under multiple official splits: {', '.join(r.subject_id for r in bad)}. Supply a manifest.csv with explicit subject_id and split_group columns.")
    return df


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    try:
        return listing(spark, root)
    except AnalysisException as e:
        raise _missing(name, root) from e


def load_octa_manifest(spark: SparkSession, root: str, require_split_safe: bool = True) -> DataFrame:
    """One row per image and layer: a manifest CSV, else an official layout, else pairs of names that say layer and subject."""
    files = _files(spark, root, "ROSE")
    given = read_manifest(spark, root)
    if given is not None:
        out = standardize(given, root, "ROSE", "OCTA")
        require_columns(out, ["image_path", "mask_path", "subject_id", "layer"])
        return out if "label" in out.columns else out.withColumn("label", F.lit(None).cast("string"))
    out = octa_layout(files)
    if not out.isEmpty():
        return guard_splits(out, "ROSE") if require_split_safe else out
    p = F.col("image_path")
    rows = paired(files).select("image_path", "mask_path", layer_of(p).alias("layer"), group_of(p).alias("label"), subject_of(p).alias("subject_id"), split_of(p).alias("split"))
    if rows.isEmpty():
        raise _missing("ROSE", root, "Expected a manifest.csv or image and mask files with matching stems.")
    unsure = rows.where("layer is null or subject_id is null or split is not null").orderBy("image_path").limit(5).collect()
    if unsure:
        raise ValueError("Could not confidently infer ROSE subject_id and layer from filenames; add a manifest.csv. Ambiguous examples: " + ", ".join(r.image_path for r in unsure))
    return rows.select(F.lit("ROSE").alias("dataset"), "subject_id", stem(p).alias("image_id"), "image_path", "mask_path", F.lit("OCTA").alias("modality"), "layer", "label", F.col("subject_id").alias("split_group"))


def load_fundus_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per image: a manifest CSV, else the official layout, else pairs; an image is its own subject where nothing else is said."""
    files = _files(spark, root, "FIVES")
    given = read_manifest(spark, root)
    if given is not None:
        out = standardize(given, root, "FIVES", "fundus")
        require_columns(out, ["image_path", "mask_path"])
        for name, value in (("subject_id", F.col("image_id")), ("split_group", F.col("subject_id")), ("label", F.lit(None).cast("string"))):
            out = out if name in out.columns else out.withColumn(name, value)
        return out
    out = fundus_layout(files)
    if not out.isEmpty():
        return out
    rows, p = paired(files), F.col("image_path")
    if rows.isEmpty():
        raise _missing("FIVES", root, "Expected a manifest.csv or image and mask files with matching stems.")
    code = diagnosis_code(p)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code), F.when(code.isNull(), group_of(p)))
    return rows.select(F.lit("FIVES").alias("dataset"), stem(p).alias("subject_id"), stem(p).alias("image_id"), "image_path", "mask_path", F.lit("fundus").alias("modality"), label.alias("label"), code.alias("diagnosis_code"), stem(p).alias("split_group"))


def merge_predictions(manifest: DataFrame, predictions: DataFrame, root: str, column: str) -> DataFrame:
    """The manifest's own prediction path, else that of the predictions' first row for the image; relative paths are below root."""
    w = Window.partitionBy("image_id").orderBy(column)
    p = predictions.where(F.col(column).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    p = p.select("image_id", F.when(F.startswith(F.col(column), F.lit("/")), F.col(column)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(column))).alias("_other"))
    own = F.col(column) if column in manifest.columns else F.lit(None).cast("string")
    return manifest.join(p, "image_id", "left").withColumn(column, F.coalesce(own, F.col("_other"))).drop("_other")
