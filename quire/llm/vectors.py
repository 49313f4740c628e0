"""Vector columns as fixed-width bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid(col):
    """True for a non-empty vector without null or non-finite components."""
    c = F.col(col).cast("array<double>")
    return F.col(col).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, raw, dim) of the valid vectors; raw holds float32 where the column does, else float64."""
    narrow = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    kind = np.float32 if narrow else np.float64

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            end = np.cumsum(size)
            raw = [flat[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(size)], names=["id", "raw", "dim"])

    typed = F.col(vec_col) if narrow else F.col(vec_col).cast("array<double>")
    return df.filter(valid(vec_col)).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), typed.alias("v")).mapInArrow(run, "id long, raw binary, dim int")


def matrix(raw: list[bytes], dim: int, to=np.float64) -> np.ndarray:
    """Rows as float64, or as they were packed if ``to`` is None."""
    data = b"".join(raw)
    kind = np.float32 if len(data) == 4 * dim * len(raw) else np.float64
    rows = np.frombuffer(data, kind).reshape(len(raw), dim)
    return rows if to is None else rows.astype(to)
