"""Places: facet geo (key, member, lon, lat). Positions are kept as 52-bit cells, 26 bits for each side, interleaved."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.operators import keyed

# The grid's limits and the sphere's radius in metres.
LON, LAT, STEPS, RADIUS = 180.0, 85.05112878, 26, 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _spread(x: Column) -> Column:
    """Bits of a 26-bit number moved to the even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gathered(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _cell(x: Column, limit: float) -> Column:
    return F.least(F.floor((x + limit) / (2 * limit) * (1 << STEPS)), F.lit((1 << STEPS) - 1)).cast("long")


def encode(lon: Column, lat: Column) -> Column:
    return F.shiftleft(_spread(_cell(lon, LON)), 1).bitwiseOR(_spread(_cell(lat, LAT)))


def decode(cell: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the cell's lower corner."""
    side = lambda x, limit: _gathered(x) / F.lit(float(1 << STEPS)) * (2 * limit) - limit
    return side(F.shiftright(cell, 1), LON), side(cell, LAT)


def geohash(cell: Column) -> Column:
    """Eleven base-32 digits of the cell, from its highest bits down; the first has two bits."""
    digits = [F.substring(F.lit(BASE32), F.shiftright(cell, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10, -1, -1)]
    return F.concat(*digits)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Great-circle distance by the haversine formula."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2.0 * RADIUS * F.asin(F.sqrt(a)) / UNITS[unit]


def _box(lon: float, lat: float, metres: float) -> Column:
    """A latitude band and, away from the poles, a longitude band that hold the circle: comparisons that reach the Parquet scan."""
    dlat = math.degrees(metres / RADIUS) * 1.0001
    inside = (F.col("lat") >= lat - dlat) & (F.col("lat") <= lat + dlat)
    edge = abs(lat) + dlat
    if edge < 89:
        dlon = math.degrees(math.asin(min(1.0, math.sin(min(metres / RADIUS, math.pi / 2)) / math.cos(math.radians(lat))))) * 1.0001
        if lon - dlon >= -180 and lon + dlon <= 180 and math.radians(dlon) < math.pi / 2:
            inside = inside & (F.col("lon") >= lon - dlon) & (F.col("lon") <= lon + dlon)
    return inside


def radius(geo: DataFrame, lon: float, lat: float, reach: float, unit: str = "m", count: int | None = None, desc: bool = False) -> DataFrame:
    """Places within reach, with dist, nearest first where counted."""
    d = distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    found = geo.where(_box(lon, lat, reach * UNITS[unit])).withColumn("dist", d).where(F.col("dist") <= reach)
    return found if count is None else keyed.first_n(found, ["key"], count, F.desc("dist") if desc else F.asc("dist"), F.asc("member"))


def box(geo: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m", as_circle: bool = False) -> DataFrame:
    """Places in a box around a point; as_circle: in the circle around the box."""
    if as_circle:
        return radius(geo, lon, lat, math.hypot(width, height) / 2, unit)
    tall = distance(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat"), unit) <= height / 2
    wide = distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat"), unit) <= width / 2
    band = math.degrees(height * UNITS[unit] / 2 / RADIUS) * 1.0001
    d = distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit)
    return geo.where((F.col("lat") >= lat - band) & (F.col("lat") <= lat + band)).where(tall & wide).withColumn("dist", d)


def _columns(band: Column, height: float) -> Column:
    """How many columns divide a latitude band: each at least as wide as the band is high, also at its edge nearer to a pole."""
    edge = F.greatest(F.abs(band.cast("double")), F.abs(band.cast("double") + 1)) * height
    return F.when(edge >= 89, 1).otherwise(F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / height)), F.lit(1))).cast("long")


def radius_by_member(geo: DataFrame, members: DataFrame, reach: float, unit: str = "m") -> DataFrame:
    """For each of members (key, member) the places of its key within reach: member, other, dist.

    Places meet in cells: latitude bands half as high as the reach, divided into columns of about that width. Each goes to its own cell and asks those that
    its circle may touch, across the date line as well (all columns of its bands where it is as near to a pole as that), so the join is an equi-join.
    """
    angle = min(reach * UNITS[unit] / RADIUS, math.pi)
    span = max(math.degrees(angle) * 1.0001, 1e-6)
    height = span / 2
    turn = F.pmod(F.col("lon"), F.lit(360.0))
    band, columns = F.floor(F.col("lat") / height), _columns(F.col("band"), height)
    here = geo.select("key", F.col("member").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), turn.alias("turn"), band.alias("band"))
    here = here.withColumn("column", F.pmod(F.floor(F.col("turn") / 360 * columns), columns)).drop("turn")
    # Half of the circle's width in degrees: asin(sin(reach) / cos(lat)), and all longitudes where it may hold a pole.
    wide = F.when(F.abs("lat") + span < 89.9, F.degrees(F.asin(F.least(math.sin(min(angle, math.pi / 2)) / F.cos(F.radians("lat")), F.lit(1.0)))) * 1.0001 + 1e-9).otherwise(180.0)
    bands = F.sequence(F.floor((F.col("lat") - span) / height), F.floor((F.col("lat") + span) / height))
    asks = geo.join(members, ["key", "member"], "left_semi").where((F.abs("lon") < math.inf) & (F.abs("lat") < math.inf))
    asks = asks.select("key", "member", "lon", "lat", turn.alias("turn"), wide.alias("wide"), F.explode(bands).alias("band")).withColumn("columns", columns)
    low, high = (F.floor((F.col("turn") + side * F.col("wide")) / 360 * F.col("columns")) for side in (-1, 1))
    asks = asks.select("key", "member", "lon", "lat", "band", "columns", F.explode(F.sequence(low, F.least(high, low + F.col("columns") - 1))).alias("column"))
    asks = asks.select("key", "member", "lon", "lat", "band", F.pmod("column", "columns").alias("column"))
    d = distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"), unit)
    # Dealt by cell even if one side is small: the work is in the pairs, and a broadcast would leave it to the few tasks that read the places.
    return asks.join(here.hint("merge"), ["key", "band", "column"]).withColumn("dist", d).where(F.col("dist") <= reach).select("key", "member", "other", "dist")


def dist(geo: DataFrame, a: str, b: str, unit: str = "m") -> DataFrame:
    two = geo.where(F.col("member").isin(a, b)).groupBy("key").agg(*(F.max(F.when(F.col("member") == m, F.col(c))).alias(f"{c}{i}") for i, m in enumerate((a, b)) for c in ("lon", "lat")))
    return two.select("key", F.round(distance(F.col("lon0"), F.col("lat0"), F.col("lon1"), F.col("lat1"), unit), 4).alias("dist"))


def add(geo: DataFrame, delta: DataFrame, rule: str = "always") -> DataFrame:
    """Upserts places; nx adds only, xx moves only. Positions outside the grid raise an error."""
    old = geo.select("key", "member")
    new = delta if rule == "always" else delta.join(old, ["key", "member"], "left_anti" if rule == "nx" else "left_semi")
    bad = (F.abs("lon") > LON) | (F.abs("lat") > LAT)
    return keyed.upsert(geo, new.withColumn("lon", F.when(bad, F.raise_error(F.lit("no such place")).cast("double")).otherwise(F.col("lon"))), ["key", "member"])


def store(found: DataFrame, target: str, with_dist: bool = False) -> DataFrame:
    """Found places as a sorted set: by cell, or by distance."""
    return found.select(F.lit(target).alias("key"), "member", (F.col("dist") if with_dist else encode(F.col("lon"), F.col("lat")).cast("double")).alias("score"))
