"""Sparse vectors: lists of numbered coordinates and their weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dots(ids_a: pa.ListArray, w_a: pa.ListArray, ids_b: pa.ListArray, w_b: pa.ListArray) -> np.ndarray:
    """Products of the rows' vectors, all rows at once: coordinates of both sides are
    numbered within their row and looked up. Lists hold no coordinate twice."""
    n = len(ids_a)
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    size = lambda x: np.diff(x.offsets.to_numpy())
    a, b = flat(ids_a), flat(ids_b)
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    row_a, row_b = np.repeat(np.arange(n), size(ids_a)), np.repeat(np.arange(n), size(ids_b))
    width = int(code.max()) + 1 if len(code) else 1
    key_a, key_b = row_a * width + code[: len(a)], row_b * width + code[len(a) :]
    order = np.argsort(key_b, kind="stable")
    sorted_b = key_b[order]
    at = np.minimum(np.searchsorted(sorted_b, key_a), max(len(sorted_b) - 1, 0))
    found = np.flatnonzero(sorted_b[at] == key_a) if len(sorted_b) else np.zeros(0, np.int64)
    products = flat(w_a)[found] * flat(w_b)[order[at[found]]]
    return np.bincount(row_a[found], products, n)


def with_dots(pairs: DataFrame, ids: tuple[str, str], weights: tuple[str, str], name: str) -> DataFrame:
    """``pairs`` with the product of both vectors in place of their columns, none of which is null."""
    keep = [f for f in pairs.schema.fields if f.name not in ids + weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            value = dots(get(ids[0]), get(weights[0]), get(ids[1]), get(weights[1]))
            yield pa.record_batch([*(get(f.name) for f in keep), pa.array(value)], [*(f.name for f in keep), name])

    return pairs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{name}` double"]))
