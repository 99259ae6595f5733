"""Column expressions on class codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from landgrid.config import LABELS

# Source land-cover codes by target class.
WORLDCOVER = {1: (50,), 2: (10, 20, 30, 40, 90, 95, 96), 3: (60, 70), 4: (80,)}
GLOBELAND30 = {1: (80,), 2: (10, 20, 30, 40, 50, 70, 100), 3: (90,), 4: (60,)}


def remap(code: Column, table: Mapping[int, Sequence[int]]) -> Column:
    """Translate codes to classes; unknown codes become NULL."""
    out = F.lit(None).cast("int")
    for cls, codes in table.items():
        out = F.when(code.isin(*codes), F.lit(cls)).otherwise(out)
    return out


def clamp_class(value: Column) -> Column:
    rounded = F.round(value).cast("int")
    return F.when(rounded.isNotNull(), F.least(F.greatest(rounded, F.lit(1)), F.lit(4)))


def sanitize_class(value: Column) -> Column:
    rounded = F.round(value).cast("int")
    return F.when(rounded.isNull(), None).when(rounded.isin(*LABELS), rounded).otherwise(0)


def class_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, label in LABELS.items():
        out = F.when(code == value, F.lit(label)).otherwise(out)
    return out


def became(pre: Column, post: Column, cls: int = 1) -> Column:
    """1 where the class is new, 0 where it is not, NULL where the two inputs do not decide it."""
    hit = (pre != cls) & (post == cls)
    return F.when(hit.isNull(), None).when(hit, 1).otherwise(0)


def spectral_rules(cls: Column, mndwi: Column, ndvi: Column) -> Column:
    """Water where MNDWI > 0.3, then vegetation where NDVI > 0.6. A NULL test keeps the class,
    and a NULL class stays NULL only where no rule fires."""
    wet = F.when(mndwi > 0.3, F.lit(4)).otherwise(cls)
    return F.when(ndvi > 0.6, F.lit(2)).otherwise(wet)


def entropy_band(h_rel: Column) -> Column:
    return (F.when(h_rel >= 0.7, "high").when(h_rel >= 0.5, "moderate")
            .when(h_rel.isNotNull(), "low"))


def argmax_class(counts: Mapping[int, Column]) -> Column:
    """Class with the largest positive count, the lowest class on ties, NULL when all are zero."""
    top = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    out = F.lit(None).cast("int")
    for cls in sorted(counts, reverse=True):
        out = F.when((top > 0) & (counts[cls] == top), F.lit(cls)).otherwise(out)
    return out
