"""Sinks: CSV tables and the interactive site map."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import MAP, TILE_SOURCES
from .schemas import DETECTIONS


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows with all columns: those of the detections file first, in its order, others as first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    first = [c for c in DETECTIONS.names if c in out.columns]
    return out.select(*[F.col(f"`{c}`") for c in [*first, *(c for c in out.columns if c not in first)]])


def write_csv(df: DataFrame, path: str, one_file: bool = False, skip_empty: bool = False) -> bool:
    """Write with a header; an empty table gives a header alone, or with skip_empty nothing. Says whether it wrote."""
    if skip_empty and df.isEmpty():
        return False
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    flat = df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in arrays})
    if one_file:
        flat = flat.coalesce(1)
    if df.isEmpty():  # Spark writes no header for a table without partitions
        flat = df.sparkSession.createDataFrame([tuple(flat.columns)], ", ".join(f"c{i} string" for i in range(len(flat.columns)))).coalesce(1)
        flat.write.mode("overwrite").csv(path, header=False)
        return True
    flat.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return True


#: Rows of any one layer that a page may hold; a larger layer is left out and named: a page of it would be no use.
PAGE_ROWS = 200_000


def _records(df: DataFrame) -> list[dict] | None:
    rows = df.limit(PAGE_ROWS + 1).toJSON().collect()
    return [json.loads(r) for r in rows] if len(rows) <= PAGE_ROWS else None


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>%(title)s</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css">
<script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html,body,#map{height:100%%;margin:0}#bar{position:absolute;z-index:1000;right:1em;bottom:2em;background:#fff;padding:.5em}</style></head>
<body><div id="map"></div><div id="bar"><label>Half length <input id="len" type="range" min="100" max="1000" step="25" value="100"> <span id="m">100</span> m</label></div>
<script>
const data = %(data)s;
const map = L.map('map');
const base = {};
for (const s of data.sources) base[s.name] = L.tileLayer(s.url, {attribution: s.attribution, maxZoom: %(max_zoom)d});
Object.values(base)[0].addTo(map);
const layers = {Recorders: L.layerGroup(), Bearings: L.layerGroup(), Calls: L.layerGroup()};
for (const s of data.sites) L.circleMarker([s.lat, s.lon], {radius: 7}).bindPopup(s.label + ': ' + s.n_detections).addTo(layers.Recorders);
for (const c of data.calls) L.circleMarker([c.lat, c.lon], {radius: 5, color: c.quality_pass ? 'green' : 'orange'}).bindPopup('event ' + c.event_id + ', sites ' + c.n_sites).addTo(layers.Calls);
const rad = Math.PI / 180, R = 6378137;
const reach = (p, t, d) => {
  const a = d / R, f = p.center_lat * rad, s = Math.sin(f) * Math.cos(a) + Math.cos(f) * Math.sin(a) * Math.cos(t * rad);
  const g = p.center_lon + Math.atan2(Math.sin(t * rad) * Math.sin(a) * Math.cos(f), Math.cos(a) - Math.sin(f) * s) / rad;
  return [Math.asin(s) / rad, ((g + 540) %% 360) - 180];
};
const draw = (m) => { layers.Bearings.clearLayers(); for (const b of data.bearings) L.polyline([reach(b, b.bearing_deg + 180, m), reach(b, b.bearing_deg, m)], {weight: 1}).addTo(layers.Bearings); };
const slider = document.getElementById('len');
slider.oninput = () => { document.getElementById('m').textContent = slider.value; draw(+slider.value); };
draw(100);
L.control.layers(base, layers).addTo(map);
for (const l of Object.values(layers)) l.addTo(map);
for (const name of data.left_out) document.getElementById('bar').append(' Too many rows to draw: ' + name + '.');
map.fitBounds(data.bounds, {padding: [30, 30]});
</script></body></html>
"""


def site_map_html(sites: DataFrame, bearings: DataFrame, calls: DataFrame, title: str = MAP.title) -> str:
    """A page of recorders, bearing lines and located calls; no sites is an error. A layer of over PAGE_ROWS rows is left out, which the page says."""
    edge = sites.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    if edge[0] is None:
        raise ValueError("there are no sites to draw")
    layers = {"sites": _records(sites), "bearings": _records(bearings), "calls": _records(calls)}
    data = {
        **{name: rows or [] for name, rows in layers.items()},
        "left_out": [name for name, rows in layers.items() if rows is None],
        "bounds": [[edge[0], edge[1]], [edge[2], edge[3]]],
        "sources": [{"name": n, "url": u, "attribution": a} for n, u, a in TILE_SOURCES.values()],
    }
    text = json.dumps(data).replace("</", "<\\/")
    return _PAGE % {"title": title, "data": text, "max_zoom": MAP.max_zoom}


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, by the file system of its path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
