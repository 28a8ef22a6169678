"""Vectors as whole numbers, shared by the operators that compute exactly on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this (plus or minus) are held at it.
EDGE = 2.0**62


def whole(rows: DataFrame, vector_col: str, scale: float, shift: int = 0) -> F.Column:
    """``floor(scale * c) + shift`` of every component, in double precision, held within +-2^62."""
    edge = F.lit(EDGE)
    return F.transform(F.col(vector_col), lambda c: F.floor(F.greatest(-edge, F.least(edge, F.lit(float(scale)) * c.cast("double")))).cast("long") + F.lit(shift).cast("long"))


def finite(vector_col: str) -> F.Column:
    """Not null, not empty, and every component a finite number."""
    v = F.col(vector_col)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def commonest_length(rows: DataFrame, vector_col: str) -> int:
    """Of the vectors; the greater of equally common ones, and 0 of none."""
    got = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return got[0].d if got else 0


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length and without nulls."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def exact_squares(d: np.ndarray) -> list[int | None]:
    """Sums over rows of squares, exact; None where the sum is no long."""
    if not d.size:
        return [0] * len(d)
    if d.dtype != object and float(np.abs(d.astype(np.float64)).max()) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    big = [sum(int(x) * int(x) for x in row) for row in d]
    return [s if s < 2**63 else None for s in big]
