"""Column expressions on bands: masks, reflectance scaling, spectral indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
INDICES = ("ndvi", "ndbi", "mndwi", "nbi", "bsi")
FEATURES = BANDS + INDICES

# Scene-classification codes that are kept, quality bits that are bad
# (1 dilated cloud, 3 cloud, 4 shadow, 5 snow), and the guard of every ratio.
SCL_CLEAR = (4, 5, 6, 7)
QA_BAD_BITS = 0b111010
RATIO_GUARD = 1e-6


def scl_is_clear(scl: Column) -> Column:
    return scl.isin(*SCL_CLEAR)


def qa_is_clear(qa: Column) -> Column:
    return qa.isNotNull() & (F.round(qa).cast("bigint").bitwiseAND(QA_BAD_BITS) == 0)


def saturate(x: Column) -> Column:
    """Clamp to [0, 1]; NULL takes neither branch and stays NULL."""
    return F.when(x < 0.0, 0.0).when(x > 1.0, 1.0).otherwise(x)


def sentinel_reflectance(dn: Column) -> Column:
    return saturate(dn.cast("double") / 10000.0)


def landsat_reflectance(dn: Column) -> Column:
    return saturate(dn.cast("double") * 0.0000275 - 0.2)


def guarded_ratio(num: Column, den: Column) -> Column:
    return num / (den + F.lit(RATIO_GUARD))


def ndvi(nir: Column, red: Column) -> Column:
    return guarded_ratio(nir - red, nir + red)


def ndbi(swir: Column, nir: Column) -> Column:
    return guarded_ratio(swir - nir, swir + nir)


def mndwi(green: Column, swir: Column) -> Column:
    return guarded_ratio(green - swir, green + swir)


def nbi(red: Column, swir: Column, nir: Column) -> Column:
    return guarded_ratio(red * swir, nir)


def bsi(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    return guarded_ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def index_columns() -> dict[str, Column]:
    """The five indices over the canonical band names."""
    blue, green, red, nir, swir = (F.col(b) for b in ("b02", "b03", "b04", "b08", "b11"))
    return {
        "ndvi": ndvi(nir, red),
        "ndbi": ndbi(swir, nir),
        "mndwi": mndwi(green, swir),
        "nbi": nbi(red, swir, nir),
        "bsi": bsi(swir, red, nir, blue),
    }
