"""Reports: small result tables and metrics as one HTML page. Only tables cut to a stated number of rows come to the driver."""

from __future__ import annotations

import html
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAVEAT = "Exploratory summaries of demonstration data; not validated biomarkers and no diagnostic claim."
_STYLE = "body{font-family:sans-serif;max-width:70rem;margin:2rem auto;color:#222}table{border-collapse:collapse}td,th{border-bottom:1px solid #ccc;padding:.3rem .6rem;text-align:left}.cards{display:flex;gap:1rem}.card{border:1px solid #ccc;padding:1rem}"


def number(v, digits: int = 4) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "n/a"
    return f"{v:.{digits}g}" if isinstance(v, float) else str(v)


def interval(metrics: dict, name: str) -> str:
    """'0.826 (95% CI 0.772 to 0.885)', or what there is of it."""
    v, ci = metrics.get(name), metrics.get(f"{name}_ci") or []
    if v is None:
        return "not available"
    return f"{v:.3f}" + (f" (95% CI {ci[0]:.3f} to {ci[1]:.3f})" if len(ci) == 2 else "")


def top_effects(effects: DataFrame, n: int = 12, core=()) -> DataFrame:
    """The core features, and the n largest by |hedges_g| (or, where it's missing, the difference of medians)."""
    size = F.abs(F.coalesce(F.col("hedges_g"), F.col("diff_median_AD_minus_control")))
    best = effects.orderBy(F.desc_nulls_last(size), "feature").limit(n)
    return best.union(effects.where(F.col("feature").isin(*core))).distinct() if core else best


def table(df: DataFrame, rows: int = 20, columns=None) -> str:
    df = df.select(*columns) if columns else df
    body = "".join("<tr>" + "".join(f"<td>{html.escape(number(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + f"</tr>{body}</table>"


def page(title: str, sections: list[tuple[str, str]], metrics: dict | None = None) -> str:
    """A section's body is HTML already; titles and metrics are escaped here."""
    cards = "".join(f'<div class="card"><b>{html.escape(k)}</b><br>{html.escape(interval(metrics, k))}</div>' for k in sorted(metrics or {}) if isinstance(metrics[k], float))
    parts = "".join(f"<section><h2>{html.escape(t)}</h2>{b}</section>" for t, b in sections)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><p>{CAVEAT}</p><div class="cards">{cards}</div>{parts}</body></html>\n'


def write(path: str, text: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return path
