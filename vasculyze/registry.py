"""Every query of the feature analytics, by name, with its SQL twin."""

from __future__ import annotations

import re

from .operators import benchmark, contrasts, embeddings, feature_table, inference, kernels, models, outliers, sampling
from .plans import extra
from .plans.shared import SHARED
from .sources import adapters

_NAME = re.compile(r"\{(\w+)\}")


def _spark(text: str):
    names = sorted(set(_NAME.findall(text)))

    def run(spark, sf_dir):
        made = {n: getattr(adapters, n)(spark, sf_dir) if n in adapters.TWINS else adapters.table(spark, sf_dir, n) for n in names}
        return spark.sql(text, **made)

    return run


def _twin(text: str) -> str:
    names = sorted(set(_NAME.findall(text)))
    need = [n for m in names if m in adapters.TWINS for n in (*adapters.NEEDS.get(m, ()), m)]
    head = ", ".join(f"{n} AS ({adapters.TWINS[n]})" for n in dict.fromkeys(need))
    return (f"WITH {head} " if head else "") + _NAME.sub(r"\1", text)


QUERIES: dict = {name: _spark(text) for name, text in (SHARED | extra.SPARK).items()} | kernels.QUERIES | models.QUERIES | inference.QUERIES | outliers.QUERIES | embeddings.QUERIES | benchmark.QUERIES | contrasts.QUERIES | sampling.QUERIES | feature_table.QUERIES
ORACLE_SQL: dict = {name: _twin(text) for name, text in (SHARED | extra.TWINS).items()} | extra.KERNEL_TWINS | contrasts.ORACLE_SQL | sampling.ORACLE_SQL | feature_table.ORACLE_SQL
