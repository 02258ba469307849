"""Map columns: great-circle distance, grid cells, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.fixed import EARTH_RADIUS_M, LAT_RANGE, LNG_RANGE, M_PER_DEGREE, WALKING_LIMIT_M

METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(
        half_lng
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def in_country(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(*LAT_RANGE) & lng.between(*LNG_RANGE), F.lit(False))


def snap(degrees: Column, decimals: int = 3) -> Column:
    """Round to a grid of 0.001 degrees, halves upwards, so nearby origins share their work."""
    grid = 10.0**-decimals
    return F.round(F.floor(degrees / grid + 0.5) * grid, decimals)


def steps(side_m: float, max_abs_lat: float) -> tuple[float, float]:
    """Cell height and width in degrees; no cell is narrower than ``side_m`` up to that latitude."""
    lat_step = side_m / METRES_PER_DEGREE
    return lat_step, lat_step / math.cos(math.radians(max_abs_lat))


def cell(degrees: Column, step: float) -> Column:
    return F.floor(degrees / step).cast("int")


def _decimal_comma(value: Column, digits: int) -> Column:
    return F.replace(F.format_string(f"%.{digits}f", value), F.lit("."), F.lit(","))


def distance_label(metres: Column, step: int = 100) -> Column:
    """Steps of 100 m for lists, 10 m for the map; kilometres with a comma below ten."""
    rounded = F.floor(metres / step + 0.5) * step
    if step == 100:
        km = rounded / 1000.0
        label = F.when(metres < step, f"menos de {step} m")
    else:
        rounded = F.greatest(F.lit(step).cast("bigint"), rounded)
        km = metres / 1000.0
        label = F.when(F.lit(False), "")
    return (
        label.when(rounded < 1000, F.concat(rounded.cast("bigint").cast("string"), F.lit(" m")))
        .when(km < 10, F.concat(_decimal_comma(km, 1), F.lit(" km")))
        .otherwise(F.concat(F.floor(km + 0.5).cast("string"), F.lit(" km")))
    )


def travel_mode(metres: Column) -> Column:
    return F.when(metres < WALKING_LIMIT_M, "foot").otherwise("car")


def duration_label(seconds: Column) -> Column:
    minutes = F.greatest(F.lit(1).cast("bigint"), F.floor(seconds / 60 + 0.5).cast("bigint"))
    hours, rest = F.floor(minutes / 60).cast("bigint"), minutes % 60
    text = lambda c: c.cast("string")
    return (
        F.when(minutes < 60, F.concat(text(minutes), F.lit(" min")))
        .when(rest == 0, F.concat(text(hours), F.lit(" h")))
        .otherwise(F.concat(text(hours), F.lit(" h "), text(rest), F.lit(" min")))
    )


def box_diagonal_m(south: Column, north: Column, west: Column, east: Column) -> Column:
    high = (north - south) * M_PER_DEGREE
    wide = (east - west) * M_PER_DEGREE * F.cos(F.radians((north + south) / 2))
    return F.hypot(high, wide)


def box_gap_m(a: Column, b: Column) -> Column:
    """Gap between two boxes, given as structs south, north, west, east; zero where they overlap."""
    zero = F.lit(0.0)
    high = F.greatest(zero, a["south"] - b["north"], b["south"] - a["north"]) * M_PER_DEGREE
    wide = F.greatest(zero, a["west"] - b["east"], b["west"] - a["east"]) * M_PER_DEGREE
    return F.hypot(high, wide * F.cos(F.radians((a["north"] + a["south"]) / 2)))
