"""Per-image NumPy kernels behind mapInPandas: thinning, labelling, distance, and the feature vectors built on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import table

_AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def _shifted(m: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from the one above."""
    p = np.pad(m, 1)
    h, w = m.shape
    return [p[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a, b in _AROUND]


def neighbors(m: np.ndarray) -> np.ndarray:
    return sum(x.astype(int) for x in _shifted(m)) * m


def thin(mask: np.ndarray) -> np.ndarray:
    """Guo and Hall's two-subiteration thinning (1989)."""
    m = mask.astype(bool).copy()
    changed = True
    while changed:
        changed = False
        for odd in (0, 1):
            p2, p3, p4, p5, p6, p7, p8, p9 = _shifted(m)
            c = (~p2 & (p3 | p4)).astype(int) + (~p4 & (p5 | p6)) + (~p6 & (p7 | p8)) + (~p8 & (p9 | p2))
            n = np.minimum((p9 | p2).astype(int) + (p3 | p4) + (p5 | p6) + (p7 | p8), (p2 | p3).astype(int) + (p4 | p5) + (p6 | p7) + (p8 | p9))
            side = ((p6 | p7 | ~p9) & p8) if odd == 0 else ((p2 | p3 | ~p5) & p4)
            gone = m & (c == 1) & (n >= 2) & (n <= 3) & ~side
            if gone.any():
                m &= ~gone
                changed = True
    return m


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Connected components by flooding; numbers from 1."""
    out, n = np.zeros(mask.shape, int), 0
    steps = _AROUND if diagonal else _AROUND[::2]
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start] = n
        todo = [start]
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                y, x = r + a, c + b
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo.append((y, x))
    return out, n


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each pixel to the background: columns first, then the least of shifted squares by row."""
    h, w = mask.shape
    far = h + w
    d = np.where(mask, far, 0)
    for r in range(1, h):
        d[r] = np.minimum(d[r], d[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        d[r] = np.minimum(d[r], d[r + 1] + 1)
    x = np.arange(w)
    gap = (x[:, None] - x[None]) ** 2
    return np.sqrt(np.array([(row[None].astype(float) ** 2 + gap).min(1) for row in d]).reshape(h, w))  # a row at a time: w * w cells


def fill_holes(mask: np.ndarray) -> np.ndarray:
    parts, n = label(~np.pad(mask, 1), diagonal=False)
    return ~(parts == parts[0, 0])[1:-1, 1:-1] if n else mask


def segments(skeleton: np.ndarray, least: int = 5) -> list[tuple[float, float]]:
    """(arc, chord) of each skeleton piece between branchpoints that has at least `least` pixels."""
    parts, n = label(skeleton & (neighbors(skeleton) < 3))
    out = []
    for i in range(1, n + 1):
        at = np.argwhere(parts == i)
        if len(at) < least:
            continue
        here = {tuple(x) for x in at}
        arc = sum(math.hypot(a, b) for r, c in here for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)) if (r + a, c + b) in here)
        near = [sum((r + a, c + b) in here for a, b in _AROUND) for r, c in at.tolist()]
        ends = at[np.array(near) <= 1]
        pts = ends if len(ends) >= 2 else at
        chord = float(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)).max())
        if chord > 0:
            out.append((arc, chord))
    return out


def fractal_dimension(mask: np.ndarray) -> float:
    top = int(math.log2(min(mask.shape))) if min(mask.shape) > 0 else 0
    if top < 2:
        return 0.0
    xs, ys = [], []
    for k in range(1, top + 1):
        s = 1 << k
        h, w = (-(-n // s) * s for n in mask.shape)
        p = np.zeros((h, w), bool)
        p[: mask.shape[0], : mask.shape[1]] = mask
        n = int(p.reshape(h // s, s, w // s, s).any((1, 3)).sum())
        if n:
            xs.append(math.log(1 / s))
            ys.append(math.log(n))
    return float(np.polyfit(xs, ys, 1)[0]) if len(xs) >= 2 else 0.0


def vessel_features(mask: np.ndarray, threshold: float = 1.10) -> dict[str, float]:
    """Features of one binary mask; the skeleton, distances and labels are made once. An empty mask has zeros."""
    area = mask.size
    sk = thin(mask)
    nb = neighbors(sk)
    seg = np.array(segments(sk)).reshape(-1, 2)
    tort = seg[:, 0] / seg[:, 1] if len(seg) else np.zeros(0)
    curved = tort >= threshold
    widths = 2 * distance(mask)[sk]
    parts, n = label(mask)
    sizes = np.bincount(parts.ravel())[1:]
    total = max(1, int(mask.sum()))
    junctions = label(sk & (nb >= 3))[1]
    filled = fill_holes(mask)
    tiles = [t.mean() for row in np.array_split(mask, 3, 0) for t in np.array_split(row, 3, 1) if t.size]
    gy, gx = np.gradient(sk.astype(float))
    angle = np.mod(np.arctan2(gy, gx), math.pi)[sk]
    hist = np.histogram(angle, 8, (0, math.pi))[0]
    share = hist[hist > 0] / max(1, hist.sum())
    stat = lambda f, x: float(f(x)) if len(x) else 0.0
    return {
        "vessel_density": mask.sum() / area, "skeleton_length_density": sk.sum() / area, "branchpoint_density": junctions / area, "endpoint_density": (sk & (nb == 1)).sum() / area,
        "connected_component_count": float(n), "largest_component_fraction": stat(np.max, sizes) / total, "small_component_fraction": float(sizes[sizes < 16].sum()) / total,
        "mean_segment_tortuosity": stat(np.mean, tort), "median_segment_tortuosity": stat(np.median, tort), "tortuous_segment_fraction": stat(np.mean, curved), "tortuous_length_fraction": float(seg[curved, 0].sum() / seg[:, 0].sum()) if len(seg) else 0.0,
        "mean_segment_length_px": stat(np.mean, seg[:, 0]), "mean_vessel_caliber_px": stat(np.mean, widths), "caliber_cv": stat(np.std, widths) / stat(np.mean, widths) if len(widths) else 0.0,
        "caliber_p90_minus_p10_px": float(np.subtract(*np.percentile(widths, [90, 10]))) if len(widths) else 0.0, "fractal_dimension_boxcount": fractal_dimension(mask),
        "dropout_heterogeneity": float(np.std(tiles) / np.mean(tiles)) if np.mean(tiles) > 0 else 0.0, "hole_fraction": float((filled & ~mask).sum()) / max(1, int(filled.sum())), "orientation_entropy": float(-(share * np.log2(share)).sum() / 3) if len(share) else 0.0,
    }


def crossings(skeleton: np.ndarray) -> int:
    """Blobs of skeleton pixels with at least four neighbours, two of whose opposite pairs are set."""
    x = _shifted(skeleton)
    pairs = sum((x[i] & x[i + 4]).astype(int) for i in range(4))
    return label(skeleton & (neighbors(skeleton) >= 4) & (pairs >= 2))[1]


def _parts(mask: np.ndarray, fov: np.ndarray | None):
    """What both vectors start from: the mask inside the field of view, its area, skeleton, segments and widths."""
    mask = np.asarray(mask, bool)
    if mask.ndim != 2 or (fov is not None and np.shape(fov) != mask.shape):
        raise ValueError("A mask is 2D, and its field of view has its shape.")
    mask, area = (mask, mask.size) if fov is None else (mask & np.asarray(fov, bool), int(np.sum(fov)))
    sk = thin(mask)
    seg = np.array(segments(sk)).reshape(-1, 2)
    return mask, area, sk, neighbors(sk), seg, seg[:, 0] / seg[:, 1], 2 * distance(mask)


def _spread(w: np.ndarray) -> float:
    return float(np.std(w) / np.mean(w)) if len(w) and np.mean(w) > 0 else 0.0


def fundus_vector(mask: np.ndarray, fov: np.ndarray | None = None, threshold: float = 1.10) -> dict[str, float]:
    """The 18 features of a fundus mask, in their fixed order. An empty mask has zeros."""
    mask, area, sk, nb, seg, tort, wide = _parts(mask, fov)
    w, curved = wide[sk], tort >= threshold
    major = sk & (wide >= np.quantile(w, 0.75)) if len(w) else sk
    stat = lambda f, x: float(f(x)) if len(x) else 0.0
    share = lambda n: float(n / area) if area else 0.0
    crossed = crossings(sk)
    return {
        "tortuous_segment_fraction": stat(np.mean, curved), "tortuous_length_fraction": float(seg[curved, 0].sum() / seg[:, 0].sum()) if len(seg) else 0.0,
        "mean_segment_tortuosity": stat(np.mean, tort), "median_segment_tortuosity": stat(np.median, tort), "p90_segment_tortuosity": stat(lambda x: np.percentile(x, 90), tort), "p95_segment_tortuosity": stat(lambda x: np.percentile(x, 95), tort),
        "caliber_cv": _spread(w), "large_vessel_caliber_cv": _spread(w[w >= np.quantile(w, 0.5)]) if len(w) else 0.0, "caliber_p90_minus_p10_px": stat(lambda x: np.percentile(x, 90) - np.percentile(x, 10), w), "mean_vessel_caliber_px": stat(np.mean, w),
        "candidate_crossing_density": crossed / max(1, int(sk.sum())), "candidate_crossing_count": float(crossed), "major_branch_count": float(label(major & (neighbors(major) >= 3))[1]),
        "fractal_dimension_boxcount": fractal_dimension(mask), "vessel_density": share(mask.sum()), "skeleton_length_density": share(sk.sum()), "branchpoint_density": share(label(sk & (nb >= 3))[1]), "connected_component_count": float(label(mask)[1]),
    }


def octa_vector(mask: np.ndarray, fov: np.ndarray | None = None, threshold: float = 1.10) -> dict[str, float]:
    """The 21 features of an OCTA mask, in their fixed order. An empty mask has zeros."""
    mask, area, sk, nb, seg, tort, wide = _parts(mask, fov)
    w, curved, rest = wide[sk], tort >= threshold, vessel_features(mask, threshold)
    stat = lambda f, x: float(f(x)) if len(x) else 0.0
    share = lambda n: float(n / area) if area else 0.0
    return {
        "tortuous_segment_fraction": stat(np.mean, curved), "tortuous_length_fraction": rest["tortuous_length_fraction"], "vessel_density": share(mask.sum()), "dropout_heterogeneity": rest["dropout_heterogeneity"],
        "vessel_area_fraction": share(mask.sum()), "skeleton_length_density": share(sk.sum()), "branchpoint_density": share(label(sk & (nb >= 3))[1]), "endpoint_density": share((sk & (nb == 1)).sum()),
        "connected_component_count": rest["connected_component_count"], "largest_component_fraction": rest["largest_component_fraction"], "fractal_dimension_boxcount": rest["fractal_dimension_boxcount"],
        "mean_segment_length_px": stat(np.mean, seg[:, 0]), "median_segment_length_px": stat(np.median, seg[:, 0]), "mean_tortuosity_arc_chord": stat(np.mean, tort), "high_tortuosity_fraction": stat(np.mean, curved),
        "caliber_proxy_mean_px": stat(np.mean, w), "caliber_proxy_median_px": stat(np.median, w), "caliber_proxy_std_px": stat(np.std, w), "hole_fraction_or_dropout_proxy": rest["hole_fraction"], "small_component_fraction": rest["small_component_fraction"], "orientation_entropy": rest["orientation_entropy"],
    }


def equivalent_width(widths, coefficient: float) -> float | None:
    """Knudtson's equivalent: the widest is paired with the narrowest, again and again."""
    w = sorted(float(x) for x in widths)
    if not w or not all(math.isfinite(x) and x > 0 for x in w):
        return None
    while len(w) > 1:
        rest = w[1:-1]
        rest += [coefficient * math.hypot(w[0], w[-1])] if len(w) > 1 else []
        w = sorted(rest)
    return w[0]


_NAMES = list(vessel_features(np.zeros((8, 8), bool)))


def vector_rows(masks: DataFrame, kind: str = "fundus") -> DataFrame:
    """(image_id, h, w, mask array<boolean>, fov array<boolean> or null) -> image_id and the fundus or octa features."""
    make = {"fundus": fundus_vector, "octa": octa_vector}[kind]
    names = list(make(np.zeros((8, 8), bool)))

    def run(frames):
        for f in frames:
            rows = [make(np.array(m, bool).reshape(h, w), None if v is None else np.array(v, bool).reshape(h, w)) for m, v, h, w in zip(f["mask"], f["fov"], f["h"], f["w"])]
            yield pd.DataFrame(rows, columns=names, dtype=float).assign(image_id=f["image_id"].to_numpy())[["image_id", *names]]

    fov = "fov" if "fov" in masks.columns else F.lit(None).cast("array<boolean>").alias("fov")
    masks = masks.select("image_id", "h", "w", "mask", fov)
    return masks.mapInPandas(run, ", ".join([f"image_id {dict(masks.dtypes)['image_id']}", *(f"{n} double" for n in names)]))


def feature_rows(masks: DataFrame) -> DataFrame:
    """(image_id, bits array<boolean>, side) -> image_id and a column per feature."""

    def run(frames):
        for f in frames:
            rows = [vessel_features(np.array(b, bool).reshape(s, -1)) for b, s in zip(f["bits"], f["side"])]
            yield pd.DataFrame(rows, columns=_NAMES, dtype=float).assign(image_id=f["image_id"].to_numpy())[["image_id", *_NAMES]]

    return masks.select("image_id", "bits", "side").mapInPandas(run, ", ".join(["image_id bigint", *(f"{n} double" for n in _NAMES)]))


def mask_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return feature_rows(e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: x > 0).alias("bits"), F.lit(8).alias("side")))


def avr_equivalent_width(spark, sf_dir):
    """Arteriole and venule equivalents and their ratio, per order."""

    @F.pandas_udf("double")
    def artery(w: pd.Series) -> pd.Series:
        return w.map(lambda x: equivalent_width(x, 0.88))

    @F.pandas_udf("double")
    def vein(w: pd.Series) -> pd.Series:
        return w.map(lambda x: equivalent_width(x, 0.95))

    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("w"))
    w = w.select("l_orderkey", artery("w").alias("crae"), vein("w").alias("crve"))
    return w.withColumn("avr", F.try_divide("crae", "crve"))


def masks(spark, sf_dir) -> DataFrame:
    """The embeddings as 8 by 8 images: a gray plane and the mask of its positive cells."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("gray"), F.transform("embedding", lambda x: x > 0).alias("mask"))


def component_sizes(spark, sf_dir):
    """(image_id, component, size): a component is named by its first pixel in row order."""

    def run(frames):
        for f in frames:
            rows = []
            for i, m, h, w in zip(f["image_id"], f["mask"], f["h"], f["w"]):
                parts, _ = label(np.array(m, bool).reshape(h, w))
                _, first, size = np.unique(parts.ravel(), return_index=True, return_counts=True)
                rows += [(i, int(a), int(n)) for a, n in zip(first, size) if parts.ravel()[a]]
            yield pd.DataFrame(rows, columns=["image_id", "component", "size"])

    return masks(spark, sf_dir).mapInPandas(run, "image_id long, component long, size long")


#: Reachability over set neighbours, for DuckDB; the kernel labels each image in one pass instead.
COMPONENTS_SQL = """WITH RECURSIVE px AS (SELECT vec_id AS i, pos - 1 AS a, (pos - 1) // 8 AS r, (pos - 1) % 8 AS c FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) WHERE x > 0),
    near AS (SELECT p.i, p.a, q.a AS b FROM px p JOIN px q ON p.i = q.i AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1),
    reach AS (SELECT i, a, a AS b FROM px UNION SELECT r.i, r.a, n.b FROM reach r JOIN near n ON r.i = n.i AND r.b = n.a)
    SELECT i AS image_id, component::BIGINT AS component, count(*)::BIGINT AS size FROM (SELECT i, a, min(b) AS component FROM reach GROUP BY i, a) GROUP BY i, component"""

QUERIES = {"component_sizes": component_sizes, "fundus_vectors": lambda spark, sf_dir: vector_rows(masks(spark, sf_dir), "fundus"), "octa_vectors": lambda spark, sf_dir: vector_rows(masks(spark, sf_dir), "octa"), "mask_features": mask_features, "avr_equivalent_width": avr_equivalent_width}
