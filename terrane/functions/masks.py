"""Quality masks as boolean columns, and the shares of an image that they hide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def udm(mask: Column) -> Column:
    """Unusable data mask of one band."""
    return mask != 0


def not_clear(b1: Column) -> Column:
    return b1 == 0


def cloud_shadow(b3: Column, b6: Column) -> Column:
    return (b6 != 0) | (b3 != 0)


def cloud_shadow_udm(b3: Column, b6: Column, b8: Column) -> Column:
    return cloud_shadow(b3, b6) | (b8 != 0)


def blackfill(b8: Column) -> Column:
    return b8 == 1


#: Scene classes by how strict the mask is.
SCENE_CLASSES = {"light": [8, 9], "full": [2, 8, 9, 10], "shadow": [2], "low_quality": [0, 1, 11]}


def scene(scl: Column, kind: str = "full", shadow: bool = False, low_quality: bool = False) -> Column:
    classes = set(SCENE_CLASSES[kind]) | set(SCENE_CLASSES["shadow"] * shadow) | set(SCENE_CLASSES["low_quality"] * low_quality)
    return scl.isin(sorted(classes))


def binary(mask: Column) -> Column:
    return mask != 0


def apply(value: Column, mask: Column) -> Column:
    """The value where it is not masked, else null."""
    return F.when(~mask, value)


def nodata(value: Column, fill: float = 0) -> Column:
    """Null for the fill value and for NaN."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.nullif(v, F.lit(float(fill)))


def percent_masked(valid: Column, masked: Column) -> Column:
    """Share of the valid pixels of a group that a mask hides; 100 where none is valid."""
    n = F.count_if(valid)
    gone = F.count_if(valid & masked)
    return F.coalesce(100.0 * F.try_divide(gone, n), F.lit(100.0))
