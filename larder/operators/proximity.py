"""Nearest shops and nearest chains, by grid cells instead of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed
from larder.functions import geo
from larder.functions.text import let

LEVELS = 6
RINGS = 3
MIN_SIDE_M = 100.0


def snap_origins(origins: DataFrame) -> DataFrame:
    """Origins rounded to 0.001 degrees, so those a few steps apart share one answer."""
    return origins.withColumns({"lat": geo.snap(F.col("lat")), "lng": geo.snap(F.col("lng"))})


def clamp_radius(radius_m: float) -> float:
    return float(min(max(radius_m, 0), fixed.MAX_RADIUS_M))


def _pack(level: Column | int, y: Column, x: Column) -> Column:
    """A cell as one long (level, row, column), so that joins and shuffles compare plain numbers."""
    level = F.lit(level) if isinstance(level, int) else level
    return level.cast("bigint") * 2**56 + (y.cast("bigint") + 2**27) * 2**28 + (x.cast("bigint") + 2**27)


def _level_cells(lat: Column, lng: Column, side_m: float, max_abs_lat: float, levels: int) -> Column:
    """One struct (level, y, x) per level of the grid; the side halves from one level to the next."""
    cells = []
    for level in range(levels):
        lat_step, lng_step = geo.steps(side_m / 2**level, max_abs_lat)
        cells.append(
            F.struct(F.lit(level).alias("level"), geo.cell(lat, lat_step).alias("y"), geo.cell(lng, lng_step).alias("x"))
        )
    return F.array(*cells)


def _packed(cells: Column) -> Column:
    return F.transform(cells, lambda c: _pack(c["level"], c["y"], c["x"]))


def _around(cell: Column, rings: int) -> Column:
    """The packed cell and its neighbours up to ``rings`` away."""
    offsets = [dy * 2**28 + dx for dy in range(-rings, rings + 1) for dx in range(-rings, rings + 1)]
    near = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    # named first: a lambda works out again whatever its body spells out
    return let(cell, lambda c: let(_pack(c["level"], c["y"], c["x"]), lambda here: F.transform(near, lambda o: here + o)))


def _nearest(
    origins: DataFrame, branches: DataFrame, per: list[str], radius: float, limit: int, max_abs_lat: float, levels: int
) -> DataFrame:
    """The ``limit`` nearest active shops of each distinct origin, per value of ``per``, with ``_metres`` and ``rank``."""
    side = max(radius, MIN_SIDE_M)
    spot = Window.partitionBy(*per, "latitude", "longitude").orderBy("id")
    shops = (
        branches.where("is_active")
        .withColumn("_spot", F.row_number().over(spot))
        .where(F.col("_spot") <= limit)
        .drop("_spot")
        .withColumn("cell", F.explode(_packed(_level_cells(F.col("latitude"), F.col("longitude"), side, max_abs_lat, levels))))
    )
    asked = origins.select("lat", "lng").distinct()
    counts = shops.groupBy("cell", *per).agg(F.count(F.lit(1)).alias("shops"))
    cells = _level_cells(F.col("lat"), F.col("lng"), side, max_abs_lat, levels)
    level_of = (
        asked.withColumn("cell", F.explode(F.flatten(F.transform(cells, lambda c: _around(c, 1)))))
        .join(counts, "cell")
        .groupBy("lat", "lng", *per, F.shiftright("cell", 56).cast("int").alias("level"))
        .agg(F.sum("shops").alias("shops"))
        .groupBy("lat", "lng", *per)
        .agg(F.coalesce(F.max(F.when(F.col("shops") >= limit, F.col("level"))), F.lit(0)).alias("level"))
    )
    own = F.get(cells, F.col("level"))
    # at the coarsest level the cells are as wide as the radius, so one ring is enough there
    ring = F.when(F.col("level") == 0, _around(own, 1)).otherwise(_around(own, RINGS))
    metres = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    rank = F.row_number().over(Window.partitionBy("lat", "lng", *per).orderBy("_metres", "id"))
    return (
        level_of.withColumn("cell", F.explode(ring))
        .join(shops, ["cell", *per])
        .withColumn("_metres", metres)
        .where(F.col("_metres") <= radius)
        .withColumn("rank", rank)
        .where(F.col("rank") <= limit)
        .drop("cell", "level")
    )


def nearest_branches(
    origins: DataFrame,
    branches: DataFrame,
    radius_m: float = fixed.DEFAULT_RADIUS_M,
    limit: int = fixed.DEFAULT_NEAREST,
    max_abs_lat: float = fixed.LAT_RANGE[1],
    levels: int = LEVELS,
) -> DataFrame:
    """Active shops within the radius of each origin, nearest first, at most ``limit`` (1 to 100).

    ``origins``: origin_id, lat, lng. ``branches``: id, store_id, name, latitude, longitude, is_active, any number of
    them. Exact at every density: cells of side ``radius`` and of its halves are counted, each distinct origin takes
    the finest level whose 3 x 3 cells already hold ``limit`` shops, and reads 7 x 7 cells there, which no nearer shop
    can lie outside of; where no level does, it reads 3 x 3 cells of the coarsest, which cover the radius. Shops on
    one spot are cut to the ``limit`` lowest ids beforehand, as equal distances go by id. ``max_abs_lat`` bounds the
    latitudes of the data, so that no cell is narrower than its side.
    """
    radius, limit = clamp_radius(radius_m), min(max(limit, 1), fixed.MAX_NEAREST)
    found = _nearest(origins, branches, [], radius, limit, max_abs_lat, levels)
    return (
        origins.select("origin_id", "lat", "lng")
        .join(found, ["lat", "lng"])
        .withColumn("distance_m", F.round("_metres").cast("bigint"))
        .drop("_metres", "is_active")
    )


def nearest_chains(
    origins: DataFrame,
    branches: DataFrame,
    radius_m: float = fixed.DEFAULT_RADIUS_M,
    max_abs_lat: float = fixed.LAT_RANGE[1],
    levels: int = LEVELS,
) -> DataFrame:
    """Distance from each origin to the nearest active shop of every chain within the radius: one shop per chain."""
    shops = branches.select("id", "store_id", "latitude", "longitude", "is_active")
    found = _nearest(origins, shops, ["store_id"], clamp_radius(radius_m), 1, max_abs_lat, levels)
    return origins.select("origin_id", "lat", "lng").join(found.select("lat", "lng", "store_id", "_metres"), ["lat", "lng"])


def stores_near(
    origins: DataFrame,
    branches: DataFrame,
    summary: DataFrame,
    radius_m: float = fixed.DEFAULT_RADIUS_M,
    max_abs_lat: float = fixed.LAT_RANGE[1],
) -> DataFrame:
    """Chains near each origin with their summary: those that can be browsed first, then by distance and name."""
    near = nearest_chains(origins, branches, radius_m, max_abs_lat)
    browsable = F.col("is_active") & (F.coalesce("product_count", F.lit(0)) > 0)
    # chains are a dimension, so one origin ranks a handful of rows
    rank = F.row_number().over(Window.partitionBy("origin_id").orderBy(F.desc("browsable"), "_metres", "name"))
    return (
        near.join(summary.withColumnRenamed("id", "store_id"), "store_id")
        .withColumn("browsable", browsable)
        .withColumn("rank", rank)
        .withColumn("nearest_m", F.round("_metres").cast("bigint"))
        .drop("_metres", "lat", "lng")
    )


def add_distances(pairs: DataFrame, seconds: str | None = None) -> DataFrame:
    """Metres between (lat, lng) and (latitude, longitude), labels for lists and map, travel mode and duration."""
    out = pairs.withColumn(
        "distance_m", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    )
    out = out.withColumns(
        {
            "list_label": geo.distance_label(F.col("distance_m"), 100),
            "map_label": geo.distance_label(F.col("distance_m"), 10),
            "mode": geo.travel_mode(F.col("distance_m")),
        }
    )
    return out if seconds is None else out.withColumn("duration_label", geo.duration_label(F.col(seconds)))


def register_functions(spark) -> None:
    """SQL functions over the same rules: ``larder_fold``, ``larder_distance_m``, ``larder_unit_price``.

    They are SQL macros, so Catalyst sees through them; none is a Python function.
    """
    from larder.functions.text import MARKED, PLAIN

    spark.sql(
        "create or replace temporary function larder_fold(t string) returns string return "
        f"regexp_replace(translate(lower(t), '{MARKED}', '{PLAIN}'), '[\\\\u0300-\\\\u036f]', '')"
    )
    spark.sql(
        "create or replace temporary function larder_distance_m(lat1 double, lng1 double, lat2 double, lng2 double) "
        f"returns double return 2 * {fixed.EARTH_RADIUS_M} * asin(sqrt(least(1.0D, "
        "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * "
        "pow(sin(radians(lng2 - lng1) / 2), 2))))"
    )
    spark.sql(
        "create or replace temporary function larder_unit_price(price bigint, amount double, measure string) "
        "returns bigint return case when amount > 0 and measure is not null then cast(floor(price / (amount * "
        "case when measure in ('kg', 'l') then 1000 else 1 end) * case when measure = 'un' then 1 else 100 end + 0.5) "
        "as bigint) end"
    )
