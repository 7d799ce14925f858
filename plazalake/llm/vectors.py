"""What the operators on embeddings share: rows that count, packed blocks, sums over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries are integers no further from zero than this: float32 values of a sane embedding lie far below it.
MOST = 1 << 52


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector isn't null and holds neither nulls nor entries that aren't finite, in double precision.

    Vectors of another length than the most frequent one (of a tie the longest) go too, as do empty ones.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.withColumn(vector_col, v).where(F.coalesce(finite, F.lit(False)) & (F.size(v) > 0))


def common_length(rows: DataFrame, vector_col: str) -> int | None:
    """The most frequent length of vectors, of a tie the longest; None without rows."""
    found = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).take(1)
    return found[0]["d"] if found else None


def scaled(vector: Column, by: int, shift: int = 0) -> Column:
    """floor(by * entry) + shift as long, within MOST."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.lit(float(by)) * x), F.lit(MOST)), F.lit(-MOST)).cast("long") + F.lit(shift).cast("long"))


def matrix(column: pa.Array, d: int, kind=np.float64) -> np.ndarray:
    """The lists of an Arrow column, each of d entries, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pa.compute.list_flatten(column)).astype(kind, copy=False).reshape(-1, d)
