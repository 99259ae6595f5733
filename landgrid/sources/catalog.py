"""Scene catalog: search, cloud cover, platform names and best-scene choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
# Asset keys that are tried after the configured ones.
FALLBACK_ASSETS = ("map", "classification", "data", "landcover")


def season_bounds(year: Column, first_month: int, last_month: int) -> tuple[Column, Column]:
    """First day of the first month to the last day of the last month."""
    start = F.make_date(year, F.lit(first_month), F.lit(1))
    return start, F.last_day(F.make_date(year, F.lit(last_month), F.lit(1)))


def effective_cloud(scene: Column, land: Column) -> Column:
    """Smaller of the finite cloud figures, NULL when there is none."""
    finite = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF), x)
    return F.least(finite(scene), finite(land))


def normalize_platform(name: Column) -> Column:
    return F.replace(F.trim(F.lower(name)), F.lit("_"), F.lit("-"))


def _hits(items: DataFrame, collection: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    xmin, ymin, xmax, ymax = bbox
    return items.filter((F.col("collection") == collection)
                        & (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin)
                        & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def catalog_search(items: DataFrame, collection: str, bbox, t0: str, t1: str,
                   limit: int | None = None) -> DataFrame:
    """Items of a collection that touch the box within the dates; with ``limit`` the first ones in item order."""
    inside = F.col("dt").between(F.lit(t0).cast("date"), F.lit(t1).cast("date"))
    found = _hits(items, collection, bbox).filter(inside)
    return found if limit is None else found.orderBy("item_seq").limit(limit)


def catalog_search_relaxed(items: DataFrame, collection: str, bbox, t0: str, t1: str,
                           limit: int | None = None) -> DataFrame:
    """As :func:`catalog_search`, but without the dates when nothing lies within them."""
    inside = F.coalesce(F.col("dt").between(F.lit(t0).cast("date"), F.lit(t1).cast("date")), F.lit(False))
    hits = _hits(items, collection, bbox).withColumn("inside", inside)
    # One value: whether any hit is dated.
    dated = hits.agg(F.coalesce(F.max("inside"), F.lit(False)).alias("dated")).scalar()
    found = hits.filter(F.col("inside") | ~dated).drop("inside")
    return found if limit is None else found.orderBy("item_seq").limit(limit)


def _ladder_level(cloud: Column, ladder: Sequence[float]) -> Column:
    """Index of the first threshold that admits the item; unknown cloud passes the first."""
    level = F.when(cloud.isNull(), 0)
    for i, top in enumerate(ladder):
        level = level.when(cloud <= top, i) if top < INF else level.otherwise(i)
    return level


def _rank_struct(*lead: Column) -> Column:
    cloud = F.col("cloud")
    return F.struct(*lead, F.coalesce(cloud, F.lit(INF)).alias("sort_cloud"),
                    F.col("item_seq").alias("item_seq"), F.col("item_id").alias("item_id"),
                    F.col("dt").alias("dt"), cloud.alias("cloud"))


def best_scene(items: DataFrame, by: Sequence[str], ladder: Sequence[float]) -> DataFrame:
    """Clearest scene per group: the first threshold with a candidate decides, then the lowest
    cloud (unknown last), then item order. A minimum of structs needs no sort."""
    cand = items.withColumn("cloud", effective_cloud(F.col("eo_cloud"), F.col("land_cloud")))
    cand = cand.withColumn("level", _ladder_level(F.col("cloud"), ladder))
    best = cand.filter(F.col("level").isNotNull()).groupBy(*by).agg(
        F.min(_rank_struct(F.col("level").alias("level"))).alias("b"))
    return best.select(*by, "b.item_id", "b.cloud", "b.level")


def best_scene_platform(items: DataFrame, acquisitions: Sequence[tuple[int, str]],
                        season: tuple[int, int], ladder: Sequence[float]) -> DataFrame:
    """Clearest scene per (year, platform): in season, else in the whole year, else of any
    platform when the year has none of the wanted one."""
    spark = items.sparkSession
    want = spark.createDataFrame(
        [(int(y), str(p)) for y, p in acquisitions], "yr int, want string")
    t0, t1 = season_bounds(F.col("yr"), *season)
    cand = (items.join(F.broadcast(want), "yr")
            .withColumn("cloud", effective_cloud(F.col("eo_cloud"), F.col("land_cloud"))))
    match = F.coalesce(normalize_platform(F.col("platform"))
                       == normalize_platform(F.col("want")), F.lit(False))
    stage = (F.when(match & F.col("dt").between(t0, t1), 0).when(match, 1).otherwise(2))
    best = cand.groupBy("yr", "want").agg(
        F.min(_rank_struct(stage.alias("stage"),
                           _ladder_level(F.col("cloud"), ladder).alias("level"))).alias("b"))
    return best.select("yr", F.col("want").alias("platform"), "b.item_id", "b.cloud", "b.stage")


def asset_pick(items: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Raster link of the first item that has one: configured keys, the usual keys, then any
    link to a TIFF."""
    want = list(dict.fromkeys([*keys, *FALLBACK_ASSETS]))
    pairs = items.select(*by, "item_seq", "item_id",
                         F.posexplode(F.map_entries("assets")).alias("pos", "a"))
    pairs = pairs.select(*by, "item_seq", "item_id", "pos", F.col("a.key").alias("asset"),
                         F.col("a.value.href").alias("href"))
    rank = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(want))):
        rank = F.when((F.col("asset") == key) & (F.col("href") != ""), i).otherwise(rank)
    is_tiff = F.lower("href").rlike(r"\.tiff?(\?|$)")
    rank = F.coalesce(rank, F.when(is_tiff, F.col("pos") + len(want)))
    best = pairs.withColumn("rank", rank).filter(F.col("rank").isNotNull()).groupBy(*by).agg(
        F.min(F.struct("item_seq", "rank", "item_id", "asset", "href")).alias("b"))
    return best.select(*by, "b.item_id", "b.asset", "b.href")
