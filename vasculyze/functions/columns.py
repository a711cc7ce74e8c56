"""Column functions: label normalisation, guarded arithmetic, path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the two diagnosis groups.
DISEASE = ("ad", "alzheimers", "alzheimer", "alzheimer's disease", "disease")
CONTROL = ("control", "controls", "healthy", "normal", "cn")
# The codes that end an image's stem.
CODES = {"A": "AMD", "D": "DR", "G": "glaucoma", "N": "normal"}


def normalize_diagnosis(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(*DISEASE), "AD").when(x.isin(*CONTROL), "control").otherwise("unknown")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite: null is what counts as missing here."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return finite(F.try_divide(a, b + F.lit(eps)))


def log_ratio(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return F.when((a + eps > 0) & (b + eps > 0), F.log((a + eps) / (b + eps)))


def relative_error(manual: Column, predicted: Column) -> Column:
    return F.when(manual == 0, F.when(predicted == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(predicted - manual) / F.abs(manual))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def safe_stem(path: Column) -> Column:
    return F.trim(F.regexp_replace(stem(path), r"[^A-Za-z0-9_-]", "_"), F.lit("_"))


def label_of_code(path: Column) -> Column:
    code = F.regexp_extract(stem(path), r"[_\-\s]([ADGN])$", 1)
    out = F.lit(None).cast("string")
    for k, v in CODES.items():
        out = F.when(code == k, v).otherwise(out)
    return out
