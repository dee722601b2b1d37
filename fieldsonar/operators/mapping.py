"""Records and geometry for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps, projection
from ..settings import MAP, MapStyle
from .numbering import numbered as numbers


def site_records(sites: DataFrame, style: MapStyle = MAP) -> DataFrame:
    return sites.select("site_id", F.concat_ws(" ", F.lit(style.label_prefix), F.col("site_id").cast("string")).alias("label"), "n_detections", F.col("canonical_lon_deg").alias("lon"), F.col("canonical_lat_deg").alias("lat")).orderBy("site_id")


def bearing_lines(detections: DataFrame) -> DataFrame:
    """Two rows a detection, one a bearing: det_id (from 1, by site and time), site_id, branch_index, bearing_deg, centre.

    Time is corrected_event_time, or event_time where there is none. Numbers are added up over sorted ranges, so neither
    all detections nor those of a site are one task. Ties keep the order of row_id where there is one.
    """
    time = next(c for c in ("corrected_event_time", "event_time", "t", "site_id") if c in detections.columns)
    order = list(dict.fromkeys(["site_id", time, *(["row_id"] if "row_id" in detections.columns else []), "bearing_1_deg"]))
    rows = detections.select(*order, "bearing_2_deg", "canonical_easting_m", "canonical_northing_m")
    numbered = numbers(rows, order, "place")
    numbered = projection.with_lon_lat(numbered, F.col("canonical_easting_m"), F.col("canonical_northing_m"), "center_lon", "center_lat")
    rows = numbered.select((F.col("place") + 1).alias("det_id"), "site_id", "center_lon", "center_lat", F.posexplode(F.array("bearing_1_deg", "bearing_2_deg")).alias("pos", "bearing_deg"))
    return rows.select("det_id", "site_id", (F.col("pos") + 1).alias("branch_index"), "bearing_deg", "center_lon", "center_lat")


def call_records(solutions: DataFrame) -> DataFrame:
    # degrees are null exactly where the grid position is; a filter on what was projected would be pushed below and copied
    kept = solutions.where("triangulation_success and solution_easting_m is not null and solution_northing_m is not null")
    return kept.select("event_id", "n_sites", "quality_pass", F.col("solution_lon_deg").alias("lon"), F.col("solution_lat_deg").alias("lat")).orderBy("event_id")


def as_json(records: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("json"))


def bounds(records: DataFrame, style: MapStyle = MAP) -> DataFrame:
    """lon_min, lat_min, lon_max, lat_max of the records, widened on every side by a share of a least span."""
    a = records.agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    pad = lambda lo, hi: F.greatest(F.col(hi) - F.col(lo), F.lit(style.least_span_deg)) * style.pad_fraction
    return a.select(
        (F.col("x0") - pad("x0", "x1")).alias("lon_min"), (F.col("y0") - pad("y0", "y1")).alias("lat_min"), (F.col("x1") + pad("x0", "x1")).alias("lon_max"), (F.col("y1") + pad("y0", "y1")).alias("lat_max")
    )


def with_zoom(box: DataFrame, style: MapStyle = MAP) -> DataFrame:
    return box.withColumn("zoom", maps.best_zoom(F.col("lon_min"), F.col("lat_min"), F.col("lon_max"), F.col("lat_max"), style))


def canvas(box: DataFrame, style: MapStyle = MAP) -> DataFrame:
    """Bounds and zoom with the whole tiles that cover them (first and last column and row) and the canvas's origin and
    size in world pixels."""
    z = F.col("zoom")
    at = lambda f, c: maps.tile_index(f(F.col(c), z, style), style)
    out = with_zoom(box, style).withColumns({"tile_x_min": at(maps.world_x, "lon_min"), "tile_x_max": at(maps.world_x, "lon_max"), "tile_y_min": at(maps.world_y, "lat_max"), "tile_y_max": at(maps.world_y, "lat_min")})
    size = style.tile_size
    return out.withColumns(
        {
            "origin_x": F.col("tile_x_min") * size,
            "origin_y": F.col("tile_y_min") * size,
            "canvas_width": (F.col("tile_x_max") - F.col("tile_x_min") + 1) * size,
            "canvas_height": (F.col("tile_y_max") - F.col("tile_y_min") + 1) * size,
        }
    )


def tiles(drawn: DataFrame, style: MapStyle = MAP, source: str = "osm") -> DataFrame:
    """Tiles of a canvas: zoom, tile_x, tile_y, place on the canvas and address. Fetching and drawing is the caller's."""
    span = lambda c: F.explode(F.sequence(F.col(f"{c}_min"), F.col(f"{c}_max"))).alias(c)
    rows = drawn.select("*", span("tile_x")).select("*", span("tile_y"))
    place = lambda c: (F.col(c) - F.col(f"{c}_min")) * style.tile_size
    return rows.select("zoom", "tile_x", "tile_y", place("tile_x").alias("canvas_x"), place("tile_y").alias("canvas_y"), maps.tile_url(F.col("zoom"), F.col("tile_x"), F.col("tile_y"), source).alias("url"))


def on_canvas(records: DataFrame, drawn: DataFrame, style: MapStyle = MAP) -> DataFrame:
    """Records with their place on the canvas (one row, joined to all)."""
    both = records.crossJoin(F.broadcast(drawn.select("zoom", "origin_x", "origin_y").limit(1)))
    z = F.col("zoom")
    return both.withColumns({"canvas_x": maps.world_x(F.col("lon"), z, style) - F.col("origin_x"), "canvas_y": maps.world_y(F.col("lat"), z, style) - F.col("origin_y")}).drop("zoom", "origin_x", "origin_y")
