"""Map geometry on columns: Web Mercator pixels, zoom choice, tiles and destination points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import MAP, TILE_SOURCES, MapStyle

EARTH_RADIUS_M = 6378137.0


def world_x(lon: Column, zoom: Column, style: MapStyle = MAP) -> Column:
    return (lon + 180.0) / 360.0 * style.tile_size * F.pow(F.lit(2.0), zoom)


def world_y(lat: Column, zoom: Column, style: MapStyle = MAP) -> Column:
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(style.max_latitude)), F.lit(-style.max_latitude))))
    return (0.5 - F.log((1.0 + s) / (1.0 - s)) / (4.0 * math.pi)) * style.tile_size * F.pow(F.lit(2.0), zoom)


def best_zoom(lon_min: Column, lat_min: Column, lon_max: Column, lat_max: Column, style: MapStyle = MAP) -> Column:
    """The largest zoom at which the bounds fill no more than their share of the canvas; else the least."""

    def fits(z: Column) -> Column:
        wide = F.abs(world_x(lon_max, z, style) - world_x(lon_min, z, style)) <= style.width * style.fill
        return wide & (F.abs(world_y(lat_min, z, style) - world_y(lat_max, z, style)) <= style.height * style.fill)

    zooms = F.sequence(F.lit(style.max_zoom), F.lit(style.min_zoom), F.lit(-1))
    return F.coalesce(F.try_element_at(F.filter(zooms, fits), F.lit(1)), F.lit(style.min_zoom))


def tile_index(px: Column, style: MapStyle = MAP) -> Column:
    return F.floor(px / style.tile_size).cast("int")


def tile_url(zoom: Column, x: Column, y: Column, style: str = "osm") -> Column:
    """Address of a tile; any style but satellite is the street map."""
    source = TILE_SOURCES.get(style, TILE_SOURCES["osm"])[1]
    out = F.lit(source)
    for mark, value in (("{z}", zoom), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def destination(lon: Column, lat: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Longitude, in [-180, 180), and latitude reached on a sphere."""
    d, b, phi = distance_m / EARTH_RADIUS_M, F.radians(bearing_deg), F.radians(lat)
    s = F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b)
    to = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * s)
    return F.pmod(F.degrees(to) + 540.0, F.lit(360.0)) - 180.0, F.degrees(F.asin(s))
