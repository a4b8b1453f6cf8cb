"""Volumes in columns, resampled onto a common grid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.functions.arrays import resampled


def onto_grid(volumes: DataFrame, to_affine: np.ndarray, to_shape: tuple[int, int, int], fill: float = 0.0) -> DataFrame:
    """volumes with shape, affine and voxels of the grid.

    volumes: any columns, among them shape (three numbers), affine (16, by rows), voxels (in C
    order) and labels (whether values are labels and stay what they are; null: no). Volumes
    whose parts are null or don't fit each other get null voxels. A task holds one volume and its
    result at a time.
    """
    names, at = volumes.columns, {c: volumes.columns.index(c) for c in ("shape", "affine", "voxels", "labels")}

    def one(shape, affine, voxels, labels) -> list[float] | None:
        if shape is None or affine is None or voxels is None or len(shape) != 3 or len(affine) != 16 or len(voxels) != np.prod(shape) or not len(voxels):
            return None
        m = np.array(affine, np.float64).reshape(4, 4)
        if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
            return None
        return resampled(voxels.reshape(shape), m, to_affine, to_shape, bool(labels), fill).ravel()

    def run(batches):
        for b in batches:
            cols = {c: b.column(i) for c, i in at.items()}
            arrays = lambda c: [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in c]
            found = [one(*x) for x in zip(cols["shape"].to_pylist(), cols["affine"].to_pylist(), arrays(cols["voxels"]), cols["labels"].to_pylist(), strict=True)]
            new = {"shape": pa.array([list(to_shape)] * b.num_rows, pa.list_(pa.int32())), "affine": pa.array([to_affine.ravel().tolist()] * b.num_rows, pa.list_(pa.float64())), "voxels": pa.array(found, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(i)) for i, c in enumerate(names)], names=names)

    kinds = {"shape": "array<int>", "affine": "array<double>", "voxels": "array<double>"}
    schema = ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in volumes.schema)
    return volumes.mapInArrow(run, schema)
