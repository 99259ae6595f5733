"""Tables behind charts and maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.config import Grid
from landgrid.functions import geo
from landgrid.functions.classes import class_label, entropy_band, sanitize_class
from landgrid.operators import focal, pixels


def growth_trajectory(area: DataFrame) -> DataFrame:
    return area.select("Year", "Urban_km2", F.round("Urban_km2", 1).alias("label")).orderBy("Year")


def entropy_trend(entropy: DataFrame) -> DataFrame:
    return entropy.select("year", F.round("H_rel", 3).alias("H_rel"),
                          entropy_band(F.col("H_rel")).alias("band")).orderBy("year")


def landscape_long(metrics: DataFrame, names: Sequence[str] = ("PD", "LPI", "ED")) -> DataFrame:
    """(year, metric, value) of the years where every shown metric is known."""
    full = metrics.dropna(subset=list(names))
    return full.unpivot(["year"], list(names), "metric", "value")


def driver_ci(terms: DataFrame) -> DataFrame:
    """Coefficients without intercept, 95 % interval, direction, strongest first."""
    est, se = F.col("estimate"), F.col("std_error")
    return (terms.filter(F.col("term") != "(Intercept)").select(
        "term", "estimate", (est - 1.96 * se).alias("lo"), (est + 1.96 * se).alias("hi"),
        F.when(est >= 0, "Increases P(growth)").otherwise("Decreases P(growth)").alias("direction"))
        .orderBy(F.desc(F.abs("estimate"))))


def corr_lower(matrix: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lower triangle, diagonal included, of a correlation matrix in long form."""
    place = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    long = matrix.unpivot(["variable"], list(order), "other", "r")
    return long.filter(place[F.col("variable")] >= place[F.col("other")])


def hotspot_popups(hotspots: DataFrame, ueii: DataFrame) -> DataFrame:
    """Hotspot zones with the UEII of the latest transition (latest end, then latest start)."""
    last = ueii.agg(F.max(F.struct("post_year", "pre_year")).alias("m")).select("m").scalar()
    latest = ueii.filter(F.struct("post_year", "pre_year") == last).select("zone_id", "ueii")
    # The wording of the popups here and in ring_labels.
    value = F.when(F.col("ueii").isNull(), "—").otherwise(
        F.format_string("%.2f", F.round("ueii", 2)))
    return hotspots.select("zone_id").join(latest, "zone_id", "left").select(
        "zone_id", F.concat(F.lit("Sprawl hotspot (zone "), F.col("zone_id").cast("string"),
                            F.lit(")<br>UEII: "), value, F.lit(" % / yr")).alias("popup"))


def ring_labels(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", F.format_string(
        "Zone %d<br>Ring: %.0f–%.0f km", "zone_id", "inner_km", "outer_km").alias("label"))


def display_classes(lulc: DataFrame) -> DataFrame:
    """Codes outside 0..4 become 0; labels attached."""
    return lulc.withColumn("cls", sanitize_class(F.col("cls"))) \
               .withColumn("label", class_label(F.col("cls")))


def change_overlay(pairs: DataFrame, change: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Class map of the first date with the new urban cells marked 1 on top; ``change`` is joined where the pairs do not
    carry the flag themselves."""
    new = F.when(F.col("change") == 1, 1).alias("new_urban")
    if change is None:
        return pairs.select(*keys, sanitize_class(F.col("pre_cls")).alias("cls"), new).withColumn("label", class_label(F.col("cls")))
    base = pairs.select(*keys, sanitize_class(F.col("pre_cls")).alias("cls"))
    return base.join(change.select(*keys, new), list(keys), "left").withColumn("label", class_label(F.col("cls")))


@dataclass
class Dashboard:
    points: DataFrame
    extent: DataFrame
    layers: tuple[str, ...]


def dashboard(lulc: DataFrame | None, change: DataFrame | None, grid: Grid, factor: int, zone: int, south: bool) -> Dashboard | None:
    """The map of the last year, coarsened and placed in degrees, with the change layer where there is one, and the box the map
    opens on: the outer edges of the coarse cells. No class map, no dashboard."""
    if lulc is None:
        return None
    points = focal.aggregate_modal(lulc, factor, by=())
    layers: tuple[str, ...] = ("cls",)
    if change is not None:
        points = points.join(focal.aggregate_modal(change, factor, by=(), classes=(0, 1), value="change"), ["r", "c"], "left")
        layers = ("cls", "change")
    coarse = Grid(res=grid.res * factor, nrows=-(-grid.nrows // factor), ncols=-(-grid.ncols // factor), x0=grid.x0, y0=grid.y0)
    points = points.select("r", "c", F.col("cls").cast("int").alias("cls"), *layers[1:])
    placed = geo.from_utm(pixels.cell_xy(points, coarse), "x", "y", "lon", "lat", zone, south)
    # The four corners of every coarse cell: edges of a projected grid bend.
    ends = points.groupBy().agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rim = ends.select(F.explode(F.concat(
        F.flatten(F.transform(F.sequence(F.col("c0"), F.col("c1") + 1), lambda c: F.array(_corner(F.col("r0"), c), _corner(F.col("r1") + 1, c)))),
        F.flatten(F.transform(F.sequence(F.col("r0"), F.col("r1") + 1), lambda r: F.array(_corner(r, F.col("c0")), _corner(r, F.col("c1") + 1)))))).alias("p"))
    corners = rim.select((F.lit(coarse.x0) + F.col("p.c") * coarse.res).alias("x"), (F.lit(coarse.y0) + F.col("p.r") * coarse.res).alias("y"))
    extent = geo.from_utm(corners, "x", "y", "lon", "lat", zone, south).agg(
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))
    return Dashboard(placed.drop("x", "y"), extent, layers)


def _corner(r: Column, c: Column) -> Column:
    return F.struct(r.alias("r"), c.alias("c"))
