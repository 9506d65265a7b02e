"""Interval binning with right-closed intervals ``(a, b]``.

Spark's ``Bucketizer`` is left-closed ``[a, b)``, so bins are generated as a ``CASE``
expression instead: one comparison chain per row, inside codegen, no model to fit.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from abode.functions.scalars import col_of


def _is_inf(x: float) -> bool:
    return isinstance(x, float) and math.isinf(x) and x > 0


def interval_bin(c, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False,
                 missing: str | None = None) -> Column:
    """D14 (+D14a, D14b): label of the interval ``(edges[i], edges[i+1]]`` holding the value.

    Values at or below the lowest edge, above the highest, NaN or null get no label (null),
    unless ``include_lowest`` (exact equality to ``edges[0]`` joins the first bin) or
    ``missing`` (a label used instead of null, e.g. ``'unselect'``).
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    x = col_of(c).cast("double")
    out = None
    for i, label in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = (x >= lo) if (i == 0 and include_lowest) else (x > lo)
        if not _is_inf(hi):
            cond = cond & (x <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    # NaN sorts above every number in Spark; keep it out of the top bin.
    out = F.when(F.isnan(x), F.lit(None).cast("string")).otherwise(out)
    if missing is not None:
        out = F.coalesce(out, F.lit(missing))
    return out


def interval_bin_sql(x: str, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False,
                     missing: str | None = None) -> str:
    """The same binning as a SQL ``CASE`` text (for SQL users and the oracle)."""
    parts = []
    for i, label in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        cond = f"{x} >= {lo!r}" if (i == 0 and include_lowest) else f"{x} > {lo!r}"
        if not _is_inf(hi):
            cond += f" AND {x} <= {hi!r}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    expr = "CASE " + " ".join(parts) + " END"
    if missing is not None:
        expr = f"coalesce({expr}, '{missing}')"
    return expr
