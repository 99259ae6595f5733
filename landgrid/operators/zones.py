"""Rings and wedges as analytic predicates, and the statistics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrid.config import SECTORS, Grid, Sprawl
from landgrid.functions import geo
from landgrid.session import join_bounded


def _offsets(grid: Grid, centre: tuple[float, float]) -> tuple[Column, Column]:
    return (geo.cell_x(F.col("c"), grid) - centre[0], geo.cell_y(F.col("r"), grid) - centre[1])


def ring_count(cfg: Sprawl) -> int:
    return int(-(-cfg.ring_max // cfg.ring_step))


def with_ring(px: DataFrame, grid: Grid, cfg: Sprawl, bounds: bool = False) -> DataFrame:
    """Cells by the ring that holds their centre; cells beyond the last ring are dropped."""
    dx, dy = _offsets(grid, cfg.centre_xy)
    out = (px.withColumn("zone_id", geo.ring_of(F.sqrt(dx * dx + dy * dy), cfg.ring_step,
                                                cfg.ring_max))
           .filter(F.col("zone_id").isNotNull()))
    return with_ring_bounds(out, cfg) if bounds else out


def with_ring_bounds(df: DataFrame, cfg: Sprawl) -> DataFrame:
    km = cfg.ring_step / 1000.0
    return df.withColumns({"inner_km": (F.col("zone_id") - 1) * F.lit(km),
                           "outer_km": F.col("zone_id") * F.lit(km)})


def with_rings_touched(px: DataFrame, grid: Grid, cfg: Sprawl) -> DataFrame:
    """One row per ring that a cell's square reaches, so border cells count in both rings."""
    def reach(df: DataFrame, index: str, origin: float, centre: float) -> DataFrame:
        """Nearest (``n_``) and farthest (``f_``) distance of the square along one axis."""
        lo = F.col(index) * grid.res + (origin - centre)
        df = df.withColumns({f"a_{index}": F.abs(lo), f"b_{index}": F.abs(lo + grid.res),
                             f"in_{index}": (lo <= 0) & (lo >= -grid.res)})
        a, b = F.col(f"a_{index}"), F.col(f"b_{index}")
        return df.withColumns({
            f"n_{index}": F.when(F.col(f"in_{index}"), 0.0).otherwise(F.least(a, b)),
            f"f_{index}": F.greatest(a, b)})

    long = reach(reach(px, "c", grid.x0, cfg.centre_xy[0]), "r", grid.y0, cfg.centre_xy[1])
    length = lambda t: F.sqrt(F.col(f"{t}_c") * F.col(f"{t}_c")
                              + F.col(f"{t}_r") * F.col(f"{t}_r"))
    ring = lambda d: F.ceil(d / cfg.ring_step).cast("bigint")
    long = long.withColumns({
        "first_": F.greatest(ring(length("n")), F.lit(1).cast("bigint")),
        "last_": F.least(ring(length("f")), F.lit(ring_count(cfg)).cast("bigint"))})
    return long.filter("first_ <= last_").select(
        *px.columns, F.explode(F.sequence("first_", "last_")).alias("zone_id"))


def with_sector(px: DataFrame, grid: Grid, cfg: Sprawl) -> DataFrame:
    dx, dy = _offsets(grid, cfg.centre_xy)
    return (px.filter(F.sqrt(dx * dx + dy * dy) <= cfg.sector_radius)
            .withColumn("sector_id", geo.sector_of(dx, dy)))


def zone_counts(zoned: DataFrame, years: Sequence[int] | None = None, zone: str = "zone_id",
                zone_ids: Sequence[int] | None = None) -> DataFrame:
    """Urban and known cells per zone and year, zones without cells in a year included as 0.

    A year without a map has no rows (of ``years``, where given, those that are there), and zones
    are those that the maps reach unless ``zone_ids`` names them."""
    if years is not None:
        zoned = zoned.filter(F.col("yr").isin(*years))
    counted = zoned.groupBy("yr", zone).agg(
        F.count(F.when(F.col("cls") == 1, 1)).alias("urban_px"),
        F.count("cls").alias("total_px"))
    kind = zoned.schema[zone].dataType.simpleString()
    if zone_ids is None:
        zones = counted.select(zone).distinct()
    else:
        zones = zoned.sparkSession.createDataFrame([(int(z),) for z in zone_ids], f"{zone} {kind}")
    # One value: the list of years.
    there = zoned.agg(F.collect_set("yr").alias("years")).scalar()
    frame = zones.select(zone, F.explode(there).alias("yr"))
    return frame.join(counted, ["yr", zone], "left").fillna(0, ["urban_px", "total_px"])


def zone_area(px: DataFrame, grid: Grid, cfg: Sprawl) -> DataFrame:
    """Area of each ring inside the raster, from its distinct cells."""
    cells = px.groupBy("r", "c").agg(F.count(F.lit(1)).alias("k"))
    return (with_ring(cells, grid, cfg).groupBy("zone_id")
            .agg((F.count(F.lit(1)) * F.lit(grid.cell_km2)).alias("zone_area_km2")))


def zone_wide(counts: DataFrame, area: DataFrame, years: Sequence[int], grid: Grid,
              cfg: Sprawl) -> DataFrame:
    """One row per ring with urban cells and km2 per year."""
    per_year = counts.groupBy("zone_id").agg(*[
        e for y in years for e in (
            F.max(F.when(F.col("yr") == y, F.col("urban_px"))).alias(f"urban_px_{y}"),
            F.max(F.when(F.col("yr") == y, F.col("urban_px") * F.lit(grid.cell_km2)))
            .alias(f"urban_km2_{y}"))])
    return with_ring_bounds(area.join(per_year, "zone_id", "left"), cfg)


def dissolve(pieces: DataFrame, key: str, order: str, attrs: Sequence[str],
             area: str) -> DataFrame:
    """Pieces of one zone to one row: the first piece's attributes and the summed area."""
    lead = F.min(F.struct(F.col(order).alias("order_"), *attrs)).alias("lead")
    return pieces.groupBy(key).agg(lead, F.sum(area).alias(area)).select(
        key, *[F.col(f"lead.{a}").alias(a) for a in attrs], area)


def zone_shares(counts: DataFrame) -> DataFrame:
    """Share of each zone in the urban area of its year (0 when the year has none)."""
    total = F.sum("urban_px").over(Window.partitionBy("yr"))
    return counts.withColumn("pi", F.when(total > 0, F.col("urban_px") / total).otherwise(0.0))


def shannon_entropy(counts: DataFrame) -> DataFrame:
    """H = -sum(Pi ln Pi) and H / ln(n) per year, n the zones of the maps; both 0 without urban area."""
    p = F.col("pi")
    g = zone_shares(counts).groupBy("yr").agg(
        F.coalesce(-F.sum(F.when(p > 0, p * F.log(p))), F.lit(0.0)).alias("h"),
        F.count(F.lit(1)).alias("n"))
    rel = F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n"))).otherwise(0.0)
    return g.select(F.col("yr").alias("year"), F.col("h").alias("H"), rel.alias("H_rel"),
                    F.col("n").alias("n_zones"))


def expansion_intensity(counts: DataFrame, area: DataFrame,
                        transitions: Sequence[tuple[int, int]], grid: Grid) -> DataFrame:
    """UEII: yearly urban growth in percent of the zone area, per zone and transition.
    Transitions with a missing year are skipped; a non-positive time step gives NULL."""
    years = sorted({y for t in transitions for y in t})
    wide = counts.filter(F.col("yr").isin(*years)).groupBy("zone_id").agg(
        *[F.max(F.when(F.col("yr") == y, F.col("urban_px"))).alias(f"u_{y}") for y in years])
    rows = [F.struct(F.lit(i).alias("transition_id"), F.lit(a).alias("pre_year"),
                     F.lit(b).alias("post_year"), F.lit(b - a).alias("delta_years"),
                     F.col(f"u_{a}").alias("u1"), F.col(f"u_{b}").alias("u2"))
            for i, (a, b) in enumerate(transitions, start=1)]
    long = wide.select("zone_id", F.inline(F.array(*rows))).filter(
        F.col("u1").isNotNull() & F.col("u2").isNotNull())
    gain = (F.col("u2") - F.col("u1")) * F.lit(grid.cell_km2)
    ueii = gain / (F.col("zone_area_km2") * F.col("delta_years")) * 100.0
    return long.join(area, "zone_id").select(
        "zone_id", "transition_id", "pre_year", "post_year", "delta_years",
        F.when(F.col("delta_years") > 0, ueii).alias("ueii"))


def hotspots(ueii: DataFrame, cfg: Sprawl, transition_id: int) -> DataFrame:
    """Zones beyond the fringe whose UEII in the given transition exceeds mean + one
    standard deviation. The input has one row per zone, so the statistics fit one task."""
    one = with_ring_bounds(ueii.filter(F.col("transition_id") == transition_id), cfg)
    stats = one.agg(F.avg("ueii").alias("m"), F.stddev_samp("ueii").alias("s"))
    s = F.col("s")
    spread = F.when(s.isNotNull() & ~F.isnan(s) & (s > 0), s).otherwise(0.0)
    limit = stats.select((F.col("m") + spread).alias("hot_limit")).scalar()
    return one.filter((F.col("ueii") > limit) & (F.col("inner_km") > cfg.fringe_km))


def sector_counts(lulc: DataFrame, grid: Grid, cfg: Sprawl, years: Sequence[int]) -> DataFrame:
    counts = zone_counts(with_sector(lulc, grid, cfg), years, "sector_id", range(1, len(SECTORS) + 1))
    return counts.select("yr", "sector_id", geo.sector_name(F.col("sector_id")).alias("sector_name"),
                         "urban_px", (F.col("urban_px") * F.lit(grid.cell_km2)).alias("urban_km2"))


def directional_growth(sectors: DataFrame, y0: int, y1: int) -> DataFrame:
    """Urban growth per wedge in percent of the first year; NULL without a base."""
    at = lambda y: F.max(F.when(F.col("yr") == y, F.col("urban_km2")))
    g = sectors.groupBy("sector_id", F.col("sector_name").alias("sector")).agg(
        at(y0).alias("urban_km2_t0"), at(y1).alias("urban_km2_t1"))
    base, last = F.col("urban_km2_t0"), F.col("urban_km2_t1")
    return g.withColumn("growth_pct", F.when(base > 0, (last - base) / base * 100.0)) \
            .orderBy("sector_id")


def paint(px_zones: DataFrame, values: DataFrame, on: Sequence[str],
          attrs: Sequence[str]) -> DataFrame:
    """Attribute of its zone on every cell; the zone side is broadcast after a size check."""
    return join_bounded(px_zones, values.select(*on, *attrs), list(on), "left")
