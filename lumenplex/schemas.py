"""Fixed schemas of the data model.

LONG    one row per frame and voxel: n, m0, m1[, m2], v. Voxels that are absent are zeros.
VOXEL   one row per voxel with all its frames: m0, m1[, m2], obs ARRAY<DOUBLE>.
CODES   one row per frame and code: n, j, c; an unknown entry is NULL, never NaN.
POINTS  one row per point: m0, m1[, m2], j.
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_INT = lambda *names: [StructField(x, IntegerType()) for x in names]

STACK = StructType([*_INT("n", "m0", "m1", "m2"), StructField("v", DoubleType())])
CODES = StructType([*_INT("n", "j"), StructField("c", DoubleType())])
POINTS = StructType(_INT("m0", "m1", "m2", "j"))
ROLONIES = StructType([*_INT("j", "m0", "m1", "m2"), StructField("remarks", StringType()), StructField("status", StringType())])
TRANSLATIONS = StructType([*_INT("n", "axis"), StructField("t", DoubleType())])
MESH_VERTICES = StructType([StructField("mesh", LongType()), StructField("vid", LongType()), *[StructField(x, DoubleType()) for x in "xyz"]])
MESH_FACES = StructType([StructField(x, LongType()) for x in ("mesh", "fid", "a", "b", "c")])


def check(df, required: StructType) -> None:
    """Raise if a required column is missing."""
    missing = [f.name for f in required if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
