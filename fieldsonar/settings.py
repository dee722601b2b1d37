"""Fixed values of the localisation pipeline: thresholds, scales and limits that results depend on."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values.
TDOA_THRESHOLD_MS = 0.025
TDOA_WEIGHT_HIGH_MS = 0.25
MIN_WEIGHT = 0.05
MIC_SPACING_M = 0.15
SPEED_OF_SOUND_M_S = 343.0
EVENT_WINDOW_SECONDS = 180.0
MAX_PAIR_DELTA_SECONDS = 180.0
WINDOW_SWEEP_SECONDS = (0.5, 0.75, 1.0, 1.5, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 180.0)
MIN_SITES_PER_EVENT = 2
MAX_EVENTS_PER_BLOCK = 10
TARGET_SITE_COUNT = 6
CLUSTER_MIN_RADIUS_M, CLUSTER_MAX_RADIUS_M, CLUSTER_STEP_M = 1.0, 20.0, 0.25
ORIENTATION_SIGMA_DEG = 10.0
MAX_RMS_DEG = 18.0
MIN_GEOMETRY_SCORE = math.sin(math.radians(10.0))
MIN_BRANCH_MARGIN = 0.2
MAX_DISTANCE_M = 1000.0
UNIQUENESS_TOLERANCE_M = 25.0
FIELD_TIMEZONE = "Europe/London"
BAND_LOW_HZ, BAND_HIGH_HZ, BAND_ORDER = 500.0, 2000.0, 4
INTERPOLATION = 16
MIN_CONFIDENCE, OVERLAP_SECONDS, WINDOW_SECONDS = 0.25, 0.0, 3.0


@dataclass(frozen=True)
class MapStyle:
    """Canvas and tile geometry of the site map."""

    tile_size: int = 256
    width: int = 1400
    height: int = 1000
    fill: float = 0.9
    pad_fraction: float = 0.25
    least_span_deg: float = 1e-4
    max_zoom: int = 18
    min_zoom: int = 3
    max_latitude: float = 85.05112878
    label_prefix: str = "Recorder"
    title: str = "Recorder locations"


MAP = MapStyle()

# Tile sources.
TILE_SOURCES = {
    "osm": ("OpenStreetMap", "https://tile.openstreetmap.org/{z}/{x}/{y}.png", "&copy; OpenStreetMap contributors"),
    "satellite": ("Esri World Imagery", "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{z}/{y}/{x}", "Tiles &copy; Esri, Maxar, Earthstar Geographics, and the GIS User Community"),
}
