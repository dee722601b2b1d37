"""One query for each operator on the driver's tables, with its SQL where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import maps, projection, scalars
from ..operators import audio, events, mapping, sessions, sites, solver, timejoin
from ..sources import ingest, sinks
from ..storage import new_path, owned, settled
from . import views
from .views import rounded, usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_HEAD = f"WITH RECURSIVE {views.SQL}"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        run = QUERIES[f.__name__] = settled(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def _r(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


def _pmod(expr: str, n: str = "360") -> str:
    return f"(({expr}) - {n} * floor(({expr}) / {n}))"


@query(f"{_HEAD} SELECT row_id, site_id, {_r('tdoa_ms')} AS tdoa_ms FROM good")
def tdoa_filter(spark, sf):
    return usable(spark, sf).select("row_id", "site_id", rounded(F.col("tdoa_ms")).alias("tdoa_ms"))


@query(
    """WITH x AS (SELECT event_id AS row_id, 'Recorder  ' || (event_id % 40 + 1) || ' - 1004 to 1704' AS folder,
  ' ' || (event_id % 180) || '.' || lpad(CAST(event_id * 7 % 100000 AS VARCHAR), 5, '0') || CASE event_id % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'e' WHEN 2 THEN 'S' ELSE 'N' END AS coord FROM events)
SELECT row_id, CAST(regexp_extract(folder, 'Recorder\\s+(\\d+)', 1) AS INTEGER) AS recorder,
  round(CAST(regexp_extract(trim(coord), '^(.*).$', 1) AS DOUBLE) * CASE WHEN upper(right(coord, 1)) IN ('W', 'S') THEN -1 ELSE 1 END, 6) + 0.0 AS degrees FROM x"""
)
def text_parse(spark, sf):
    e, i = views.table(spark, sf, "events"), F.col("event_id")
    folder = F.concat(F.lit("Recorder  "), (i % 40 + 1).cast("string"), F.lit(" - 1004 to 1704"))
    side = F.element_at(F.array(*[F.lit(c) for c in "WeSN"]), (i % 4 + 1).cast("int"))
    text = F.concat(F.lit(" "), (i % 180).cast("string"), F.lit("."), F.lpad((i * 7 % 100000).cast("string"), 5, "0"), side)
    return e.select(i.alias("row_id"), scalars.recorder_number(folder).alias("recorder"), rounded(scalars.coordinate(text)).alias("degrees"))


@query(
    """WITH x AS (SELECT event_id AS row_id, (event_id % 28 + 1) || '-' || (event_id % 12 + 1) || '-2026' AS d, (event_id % 24) || ':' || (event_id % 60) || ':' || (event_id * 7 % 60) AS h FROM events),
y AS (SELECT row_id, coalesce(try_strptime(d || ' ' || h, '%m-%d-%Y %H:%M:%S'), try_strptime(d || ' ' || h, '%d-%m-%Y %H:%M:%S')) AS ts FROM x)
SELECT row_id, strftime(ts, '%Y-%m-%d_%H:%M:%S') AS block_key, strftime(ts, '%Y-%m-%d_%H:%M') AS minute_key, strftime(ts + to_microseconds(row_id * 1001), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM y"""
)
def dual_format_timestamp(spark, sf):
    e, i = views.table(spark, sf, "events"), F.col("event_id")
    date = F.concat_ws("-", (i % 28 + 1).cast("string"), (i % 12 + 1).cast("string"), F.lit("2026"))
    time = F.concat_ws(":", (i % 24).cast("string"), (i % 60).cast("string"), (i * 7 % 60).cast("string"))
    ts = scalars.recording_start(date, time)
    event = scalars.plus_seconds(ts, i * 1001 / 1e6)
    return e.select(i.alias("row_id"), scalars.block_key(ts).alias("block_key"), scalars.minute_key(ts).alias("minute_key"), F.date_format(event, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


@query(f"{_HEAD} SELECT row_id, {_r('bearing_1_deg')} AS bearing_1_deg, {_r('bearing_2_deg')} AS bearing_2_deg, {_r('k / 16.0::DOUBLE')} AS lag_samples FROM det")
def bearings(spark, sf):
    d = views.detections(spark, sf)
    return d.select("row_id", rounded(F.col("bearing_1_deg")).alias("bearing_1_deg"), rounded(F.col("bearing_2_deg")).alias("bearing_2_deg"), rounded(F.col("k") / 16.0).alias("lag_samples"))


@query(f"{_HEAD} SELECT row_id, {_r('greatest(least(greatest((abs_tdoa_ms - 0.025) / 0.225, 0), 1), 0.05)')} AS weight FROM det")
def tdoa_weight(spark, sf):
    return views.detections(spark, sf).select("row_id", rounded(scalars.tdoa_weight(F.col("abs_tdoa_ms"))).alias("weight"))


@query(f"SELECT event_id AS row_id, {_r(_pmod('value * 7 - 900 + 180') + ' - 180')} AS wrapped FROM events")
def angle_wrap(spark, sf):
    return views.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), rounded(scalars.wrap_degrees(F.col("value") * 7 - 900)).alias("wrapped"))


@query(f"{_HEAD} SELECT row_id, {_r(_pmod('degrees(atan2(405600 + row_id % 701 - canonical_easting_m, 115700 + row_id % 503 - canonical_northing_m)) + 360'))} AS bearing FROM det")
def bearing_points(spark, sf):
    x, y = F.lit(405600) + F.col("row_id") % 701, F.lit(115700) + F.col("row_id") % 503
    b = scalars.bearing_between(F.col("canonical_easting_m"), F.col("canonical_northing_m"), x, y)
    return views.detections(spark, sf).select("row_id", rounded(b).alias("bearing"))


def _geodetic_sql(source: str, a: float, rf: float, name: str) -> str:
    """CTEs that take (id, x, y, z) of source to (id, lon, lat) in radians, called name."""
    e2 = projection._e2(rf)
    out = [f"{name}0 AS (SELECT id, x, y, z, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * {1 - e2!r}) AS lat FROM {source})"]
    for i in range(5):
        out.append(f"{name}{i + 1} AS (SELECT id, x, y, z, p, atan2(z + {e2!r} * ({a!r} / sqrt(1 - {e2!r} * sin(lat) * sin(lat))) * sin(lat), p) AS lat FROM {name}{i})")
    return ",\n".join([*out, f"{name} AS (SELECT id, atan2(y, x) AS lon, lat FROM {name}5)"])


def _ecef_sql(source: str, a: float, rf: float, name: str) -> str:
    e2 = projection._e2(rf)
    n = f"({a!r} / sqrt(1 - {e2!r} * sin(lat) * sin(lat)))"
    return f"{name} AS (SELECT id, {n} * cos(lat) * cos(lon) AS x, {n} * cos(lat) * sin(lon) AS y, {n} * {1 - e2!r} * sin(lat) AS z FROM {source})"


_P = projection
_FORWARD = f"""WITH points AS (SELECT event_id AS id, radians(-2.5 + (event_id % 1000) / 1000.0::DOUBLE) AS lon, radians(50.5 + (event_id * 7 % 1000) / 1000.0::DOUBLE) AS lat FROM events),
{_ecef_sql('points', _P.WGS84_A, _P.WGS84_RF, 'w')},
o AS (SELECT id, x - {_P.SHIFT_M[0]!r} AS u, y - ({_P.SHIFT_M[1]!r}) AS v, z - {_P.SHIFT_M[2]!r} AS w FROM w),
h AS (SELECT id, (u + {_P._RZ!r} * v - {_P._RY!r} * w) / {_P._SCALE!r} AS x, (-{_P._RZ!r} * u + v + {_P._RX!r} * w) / {_P._SCALE!r} AS y, ({_P._RY!r} * u - {_P._RX!r} * v + w) / {_P._SCALE!r} AS z FROM o),
{_geodetic_sql('h', _P.AIRY_A, _P.AIRY_RF, 'g')},
c AS (SELECT id, sinh(atanh(sin(lat)) - {_P._E!r} * atanh({_P._E!r} * sin(lat))) AS t, lon - ({math.radians(_P.LON0)!r}) AS d FROM g),
k AS (SELECT id, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM c)
SELECT id AS row_id, round({_P.EAST0!r} + {_P.F0 * _P._RADIUS!r} * (eta {''.join(f'+ {a!r} * cos({2 * i + 2} * xi) * sinh({2 * i + 2} * eta)' for i, a in enumerate(_P._ALPHA))}), 2) AS easting_m,
  round({_P._TRUE_NORTH!r} + {_P.F0 * _P._RADIUS!r} * (xi {''.join(f'+ {a!r} * sin({2 * i + 2} * xi) * cosh({2 * i + 2} * eta)' for i, a in enumerate(_P._ALPHA))}), 2) AS northing_m FROM k"""


@query(_FORWARD)
def project_forward(spark, sf):
    i = F.col("event_id")
    rows = projection.with_grid(views.table(spark, sf, "events").select("event_id"), -2.5 + (i % 1000) / 1000.0, 50.5 + (i * 7 % 1000) / 1000.0)
    return rows.select(i.alias("row_id"), F.round("easting_m", 2).alias("easting_m"), F.round("northing_m", 2).alias("northing_m"))


def _inverse_sql(points: str, name: str = "ll") -> str:
    """CTEs from points(id, e, n) to name(id, lon, lat) in degrees."""
    u = "".join(f" - {b!r} * sin({2 * i + 2} * xi) * cosh({2 * i + 2} * eta)" for i, b in enumerate(_P._BETA))
    v = "".join(f" - {b!r} * cos({2 * i + 2} * xi) * sinh({2 * i + 2} * eta)" for i, b in enumerate(_P._BETA))
    m = _P.F0 * _P._RADIUS
    steps = [f"s{name}{i + 1} AS (SELECT id, lon, psi, tanh(psi + {_P._E!r} * atanh({_P._E!r} * s)) AS s FROM s{name}{i})" for i in range(6)]
    return ",\n".join(
        [
            f"x{name} AS (SELECT id, (n - ({_P._TRUE_NORTH!r})) / {m!r} AS xi, (e - {_P.EAST0!r}) / {m!r} AS eta FROM {points})",
            f"u{name} AS (SELECT id, xi{u} AS u, eta{v} AS v FROM x{name})",
            f"t{name} AS (SELECT id, asinh(sin(u) / sqrt(sinh(v) * sinh(v) + cos(u) * cos(u))) AS psi, {math.radians(_P.LON0)!r} + atan2(sinh(v), cos(u)) AS lon FROM u{name})",
            f"s{name}0 AS (SELECT id, lon, psi, tanh(psi) AS s FROM t{name})",
            *steps,
            f"w{name} AS (SELECT id, lon, asin(s) AS lat FROM s{name}6)",
            _ecef_sql(f"w{name}", _P.AIRY_A, _P.AIRY_RF, f"b{name}"),
            f"c{name} AS (SELECT id, {_P.SHIFT_M[0]!r} + {_P._SCALE!r} * (x - {_P._RZ!r} * y + {_P._RY!r} * z) AS x, ({_P.SHIFT_M[1]!r}) + {_P._SCALE!r} * ({_P._RZ!r} * x + y - {_P._RX!r} * z) AS y, {_P.SHIFT_M[2]!r} + {_P._SCALE!r} * (-{_P._RY!r} * x + {_P._RX!r} * y + z) AS z FROM b{name})",
            _geodetic_sql(f"c{name}", _P.WGS84_A, _P.WGS84_RF, f"g{name}"),
            f"{name} AS (SELECT id, degrees(lon) AS lon, degrees(lat) AS lat FROM g{name})",
        ]
    )


@query(f"WITH p AS (SELECT event_id AS id, 405000 + (event_id % 1000) AS e, 115000 + (event_id * 7 % 1000) AS n FROM events), {_inverse_sql('p')} SELECT id AS row_id, round(lon, 8) AS lon_deg, round(lat, 8) AS lat_deg FROM ll")
def project_inverse(spark, sf):
    i = F.col("event_id")
    rows = projection.with_lon_lat(views.table(spark, sf, "events").select("event_id"), 405000 + i % 1000, 115000 + i * 7 % 1000)
    return rows.select(i.alias("row_id"), F.round("lon_deg", 8).alias("lon_deg"), F.round("lat_deg", 8).alias("lat_deg"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with placements about their site, as a field season has them."""
    i = F.col("row_id")
    return rows.withColumns({"LON": (i % 5).cast("string"), "LAT": F.when(i % 7 > 0, (i % 3).cast("string")), "easting_m": F.col("canonical_easting_m") + i % 5, "northing_m": F.col("canonical_northing_m") - i % 3})


_PLACED = "placed AS (SELECT *, CAST(row_id % 5 AS VARCHAR) AS lon, CASE WHEN row_id % 7 > 0 THEN CAST(row_id % 3 AS VARCHAR) END AS lat, canonical_easting_m + row_id % 5 AS easting_m, canonical_northing_m - row_id % 3 AS northing_m FROM good)"
_SUMMARY = "summary AS (SELECT site_id, count(*) AS n_detections, count(DISTINCT (lon, lat)) AS n_unique_locations, median(easting_m) AS e, median(northing_m) AS n FROM placed GROUP BY site_id)"


@query(f"{_HEAD}, {_PLACED}, {_SUMMARY}, p AS (SELECT site_id AS id, e, n FROM summary), {_inverse_sql('p')} SELECT site_id, n_detections, n_unique_locations, round(e, 4) AS easting_m, round(n, 4) AS northing_m, round(lon, 8) AS lon_deg, round(lat, 8) AS lat_deg FROM summary JOIN ll ON id = site_id")
def site_summary(spark, sf):
    s = sites.site_summary(_placed(usable(spark, sf)))
    place = lambda c, n: F.round(f"canonical_{c}", n).alias(c)
    return s.select("site_id", "n_detections", "n_unique_locations", place("easting_m", 4), place("northing_m", 4), place("lon_deg", 8), place("lat_deg", 8))


@query(f"{_HEAD}, {_PLACED}, {_SUMMARY} SELECT row_id, site_id, round(e, 4) AS canonical_easting_m, round(n, 4) AS canonical_northing_m FROM good LEFT JOIN summary USING (site_id)")
def site_join(spark, sf):
    rows = _placed(usable(spark, sf))
    joined = sites.with_sites(rows.drop("canonical_easting_m", "canonical_northing_m"), sites.site_summary(rows), check=False)
    return joined.select("row_id", "site_id", F.round("canonical_easting_m", 4).alias("canonical_easting_m"), F.round("canonical_northing_m", 4).alias("canonical_northing_m"))


@query("""WITH w AS (SELECT user_id AS rec, epoch_us(ts) // 86400000000 AS day, CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'left' ELSE 'right' END AS channel FROM events)
SELECT rec, CAST(day AS DOUBLE) AS start_s, CAST(day + 3 AS DOUBLE) AS end_s, string_agg(DISTINCT channel, ',' ORDER BY channel) AS detected_by FROM w GROUP BY rec, day HAVING count(DISTINCT channel) = 2""")
def channel_agreement(spark, sf):
    e = views.table(spark, sf, "events")
    day = F.floor(timejoin.micros(F.col("ts")) / F.lit(86_400_000_000))
    channel = F.when(F.col("event_type").isin("click", "purchase", "view"), "left").otherwise("right")
    return audio.agreed(e.select(F.col("user_id").alias("rec"), day.cast("double").alias("start_s"), (day + 3).cast("double").alias("end_s"), channel.alias("channel")), ["rec"])


@query("""WITH meta AS (SELECT event_id AS row_id, user_id AS rec, CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 13 = 0 THEN NULL ELSE ' ' || (event_id % 50) || '.wav ' END AS file FROM events),
files AS (SELECT DISTINCT user_id AS rec, (event_id % 47) || '.wav' AS wav FROM events), named AS (SELECT row_id, rec, trim(file) AS wav FROM meta WHERE trim(coalesce(file, '')) != '')
SELECT row_id, wav AS wav_file, EXISTS (SELECT 1 FROM files f WHERE f.rec = n.rec AND f.wav = n.wav) AS there FROM named n""")
def recording_presence(spark, sf):
    from ..sources import ingest

    e, i = views.table(spark, sf, "events"), F.col("event_id")
    rec = F.col("user_id").cast("string").alias("recorder_folder")
    name = F.when(i % 11 == 0, "  ").when(i % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), (i % 50).cast("string"), F.lit(".wav ")))
    named = ingest.named_recordings(e.select(i.alias("row_id"), rec, name.alias("FILE")))
    files = e.select(rec, F.concat((i % 47).cast("string"), F.lit(".wav")).alias("file"), F.lit("").alias("path")).distinct()
    there = ingest.present(named, files).select("row_id", "wav_file", F.lit(True).alias("there"))
    return there.unionByName(ingest.missing(named, files).select("row_id", "wav_file", F.lit(False).alias("there")))


_PAIRS = """pr AS (SELECT a.site_id AS site_a, b.site_id AS site_b FROM (SELECT DISTINCT site_id FROM good) a JOIN (SELECT DISTINCT site_id FROM good) b ON a.site_id < b.site_id),
pa AS (SELECT site_a, site_b, row_id, t FROM pr JOIN good ON site_id = site_a),
pb AS (SELECT site_a, site_b, t, min(row_id) AS row_id FROM pr JOIN good ON site_id = site_b GROUP BY ALL),
pp AS (SELECT pa.*, pb.t AS tp, pb.row_id AS rp FROM pa ASOF LEFT JOIN pb ON pa.site_a = pb.site_a AND pa.site_b = pb.site_b AND pa.t >= pb.t),
pn AS (SELECT pa.site_a, pa.site_b, pa.row_id, pb.t AS tn, pb.row_id AS rn FROM pa ASOF LEFT JOIN pb ON pa.site_a = pb.site_a AND pa.site_b = pb.site_b AND pa.t <= pb.t),
pc AS (SELECT site_a, site_b, row_id, t, CASE WHEN tn IS NULL OR t - tp <= tn - t THEN tp ELSE tn END AS tb, CASE WHEN tn IS NULL OR t - tp <= tn - t THEN rp ELSE rn END AS rb FROM pp JOIN pn USING (site_a, site_b, row_id)),
near AS (SELECT *, abs(tb - t) / 1e6::DOUBLE AS delta_s FROM pc WHERE abs(tb - t) <= 180000000)"""


@query(f"""{_HEAD}, a AS (SELECT row_id, block, t FROM good WHERE site_id = 1), b AS (SELECT block, t FROM good WHERE site_id = 2 GROUP BY ALL),
p AS (SELECT a.*, b.t AS tp FROM a ASOF LEFT JOIN b ON a.block = b.block AND a.t >= b.t), n AS (SELECT a.row_id, b.t AS tn FROM a ASOF LEFT JOIN b ON a.block = b.block AND a.t <= b.t),
c AS (SELECT row_id, t, CASE WHEN tn IS NULL OR t - tp <= tn - t THEN tp ELSE tn END AS tb FROM p JOIN n USING (row_id))
SELECT row_id, tb - t AS delta_us FROM c WHERE abs(tb - t) <= 180000000""")
def asof_nearest(spark, sf):
    d = usable(spark, sf)
    near = timejoin.nearest(d.where("site_id = 1").select("row_id", "block", "t"), d.where("site_id = 2").select("block", "t"), ["block"], S.MAX_PAIR_DELTA_SECONDS)
    return near.select("row_id", "delta_us")


@query(f"{_HEAD}, {_PAIRS} SELECT site_a, site_b, row_id, rb AS row_id_b, round(delta_s, 6) AS delta_s FROM near")
def pair_candidates(spark, sf):
    got = timejoin.pair_candidates(usable(spark, sf).select("site_id", "row_id", "t"), payload=["row_id"])
    return got.select("site_a", "site_b", "row_id", "row_id_b", F.round("delta_s", 6).alias("delta_s"))


_ALIGNED = "al AS (SELECT site_a, site_b, count(*) AS n_matches, median(delta_s) AS med, max(delta_s) AS mx, min(delta_s) AS mn FROM near GROUP BY ALL)"


@query(f"{_HEAD}, {_PAIRS}, {_ALIGNED} SELECT site_a, site_b, n_matches, round(med, 6) AS median_delta_s, round(mx, 6) AS max_delta_s, round(mn, 6) AS min_delta_s FROM al")
def pair_alignment(spark, sf):
    got = timejoin.pair_alignment(usable(spark, sf))
    return got.select("site_a", "site_b", "n_matches", *[F.round(c, 6).alias(c) for c in ("median_delta_s", "max_delta_s", "min_delta_s")])


@query(
    f"{_HEAD}, {_PAIRS}, {_ALIGNED}, both_ways AS (SELECT site_a AS i, site_b AS j, n_matches FROM al UNION ALL SELECT site_b, site_a, n_matches FROM al) SELECT site_id, "
    + ", ".join(f"CAST(coalesce(sum(n_matches) FILTER (j = {s}), 0) AS BIGINT) AS s{s}" for s in range(1, 7))
    + " FROM places LEFT JOIN both_ways ON i = site_id GROUP BY site_id"
)
def pair_matrix(spark, sf):
    wide = timejoin.pair_matrix(timejoin.pair_alignment(usable(spark, sf)), list(views.SITE_POSITIONS))
    return wide.withColumnsRenamed({str(s): f"s{s}" for s in views.SITE_POSITIONS})


_CLOCK = """sc AS (SELECT site_id, count(*) AS n FROM good GROUP BY ALL), ref AS (SELECT site_id AS r FROM sc ORDER BY n DESC, site_id LIMIT 1),
ob AS (SELECT DISTINCT site_id AS o, block, t FROM good, ref WHERE site_id != r), oo AS (SELECT DISTINCT o, block FROM ob),
ra AS (SELECT o, block, row_id, t FROM good JOIN ref ON site_id = r JOIN oo USING (block)),
cp AS (SELECT ra.*, ob.t AS tp FROM ra ASOF LEFT JOIN ob ON ra.o = ob.o AND ra.block = ob.block AND ra.t >= ob.t),
cn AS (SELECT ra.o, ra.row_id, ob.t AS tn FROM ra ASOF LEFT JOIN ob ON ra.o = ob.o AND ra.block = ob.block AND ra.t <= ob.t),
cd AS (SELECT o, (CASE WHEN tn IS NULL OR t - tp <= tn - t THEN tp ELSE tn END - t) / 1e6::DOUBLE AS d FROM cp JOIN cn USING (o, row_id)),
cm AS (SELECT o, count(*) AS n, median(d) AS m, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.9) AS p90 FROM cd WHERE abs(d) <= 180 GROUP BY o),
ca AS (SELECT o, median(abs(d - m)) AS mad FROM cd JOIN cm USING (o) WHERE abs(d) <= 180 GROUP BY o),
clock AS (SELECT r, site_id AS o, coalesce(cm.n, 0) AS n, coalesce(m, 0) AS m, mad, p10, p90 FROM ref, sc LEFT JOIN cm ON cm.o = sc.site_id LEFT JOIN ca ON ca.o = sc.site_id WHERE site_id != r)"""


@query(
    f"{_HEAD}, {_CLOCK} SELECT r AS reference_site_id, o AS other_site_id, n AS n_matches, {_r('m')} AS median_delta_s_other_minus_ref, {_r('mad')} AS mad_delta_s, {_r('p10')} AS p10_delta_s, {_r('p90')} AS p90_delta_s, {_r('-m')} AS applied_correction_s FROM clock"
)
def clock_calibration(spark, sf):
    got = timejoin.clock_offsets(usable(spark, sf), "block")
    return got.select("reference_site_id", "other_site_id", "n_matches", *[rounded(F.col(c)).alias(c) for c in ("median_delta_s_other_minus_ref", "mad_delta_s", "p10_delta_s", "p90_delta_s", "applied_correction_s")])


@query(f"{_HEAD}, {_CLOCK} SELECT row_id, {_r('coalesce(-m, 0)')} AS clock_offset_s, t + CAST(round_even(coalesce(-m, 0) * 1e6, 0) AS BIGINT) AS t_corrected FROM good LEFT JOIN clock ON o = site_id")
def offset_apply(spark, sf):
    d = usable(spark, sf)
    return timejoin.with_offsets(d, timejoin.clock_offsets(d, "block")).select("row_id", rounded(F.col("clock_offset_s")).alias("clock_offset_s"), "t_corrected")


@query(f"""{_HEAD}, v AS (SELECT site_id, k AS v, sum(1 + row_id % 4) AS w FROM good GROUP BY ALL), c AS (SELECT site_id, v, sum(w) OVER (PARTITION BY site_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY site_id) AS total FROM v)
SELECT site_id, min(v) AS weighted_median FROM c WHERE upto >= total * 0.5 GROUP BY site_id""")
def weighted_median(spark, sf):
    return timejoin.weighted_median(usable(spark, sf).withColumn("w", 1 + F.col("row_id") % 4), ["site_id"], "k", "w")


_CANDIDATES = """rk AS (SELECT *, row_number() OVER (PARTITION BY block, site_id ORDER BY peak_time_s, abs_tdoa_ms DESC, row_id) - 1 AS rank FROM good),
ct AS (SELECT block, site_id, count(*) AS n FROM good GROUP BY ALL), bl AS (SELECT block, count(*) AS n_sites, max(n) AS m FROM ct GROUP BY block HAVING count(*) >= 2),
an AS (SELECT block, site_id AS anchor FROM ct QUALIFY row_number() OVER (PARTITION BY block ORDER BY n DESC, site_id) = 1),
wa AS (SELECT block, site_id, n, m, n_sites, anchor, unnest(range(m)) AS i FROM ct JOIN bl USING (block) JOIN an USING (block)),
wb AS (SELECT block, site_id, n_sites, i AS anchor_idx, CASE WHEN site_id = anchor THEN i WHEN m <= 1 OR n <= 1 THEN 0 ELSE CAST(round_even(i::DOUBLE / (m - 1)::DOUBLE * (n - 1), 0) AS BIGINT) END AS rank FROM wa),
me AS (SELECT rk.*, n_sites, anchor_idx FROM rk JOIN wb USING (block, site_id, rank)),
cs AS (SELECT block, anchor_idx, max(n_sites) AS n_sites, round(sum(abs_tdoa_ms), 9) AS score, min(t) AS first_t FROM me GROUP BY ALL),
be AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_sites DESC, score DESC, first_t, anchor_idx) - 1 AS candidate_id FROM cs QUALIFY candidate_id < 10),
ei AS (SELECT *, row_number() OVER (ORDER BY block, candidate_id) - 1 AS event_id FROM be),
ev AS (SELECT me.*, event_id FROM me JOIN ei USING (block, anchor_idx))"""


@query(f"{_HEAD}, {_CANDIDATES} SELECT block, CAST(anchor_idx AS INTEGER) AS anchor_idx, site_id, row_id, CAST(n_sites AS INTEGER) AS n_sites FROM me")
def rank_aligned_candidates(spark, sf):
    return events.candidates(usable(spark, sf)).select("block", "anchor_idx", "site_id", "row_id", "n_sites")


@query(f"{_HEAD}, {_CANDIDATES} SELECT block, CAST(anchor_idx AS INTEGER) AS anchor_idx, CAST(candidate_id AS INTEGER) AS candidate_id, score, first_t FROM be")
def topk_per_block(spark, sf):
    return events.best_candidates(events.candidates(usable(spark, sf))).select("block", "anchor_idx", "candidate_id", "score", "first_t")


@query(f"{_HEAD}, {_CANDIDATES} SELECT block, CAST(candidate_id AS INTEGER) AS candidate_id, event_id FROM ei")
def event_ids(spark, sf):
    return events.event_ids(events.best_candidates(events.candidates(usable(spark, sf)))).select("block", "candidate_id", "event_id")


@query(f"{_HEAD}, {_CANDIDATES} SELECT event_id, site_id, row_id, round(abs_tdoa_ms, 6) AS abs_tdoa_ms FROM ev")
def event_members(spark, sf):
    return events.build_events(usable(spark, sf)).select("event_id", "site_id", "row_id", F.round("abs_tdoa_ms", 6).alias("abs_tdoa_ms"))


_EXCLUSIVE = """al AS (SELECT block, anchor_idx, max(n_sites) AS n_sites, round(sum(abs_tdoa_ms), 9) AS score, min(t) AS first_t, list(row_id) AS ids FROM me GROUP BY ALL),
ap AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_sites DESC, score DESC, first_t, anchor_idx) AS place FROM al),
gr AS (SELECT block, 0::BIGINT AS place, CAST([] AS BIGINT[]) AS used, false AS taken FROM ap GROUP BY block
  UNION ALL SELECT ap.block, ap.place, CASE WHEN list_has_any(used, ids) THEN used ELSE list_concat(used, ids) END, NOT list_has_any(used, ids) FROM gr JOIN ap ON ap.block = gr.block AND ap.place = gr.place + 1),
ex AS (SELECT block, place, row_number() OVER (PARTITION BY block ORDER BY place) - 1 AS candidate_id FROM gr WHERE taken QUALIFY candidate_id < 10)"""


@query(f"{_HEAD}, {_CANDIDATES}, {_EXCLUSIVE} SELECT block, CAST(anchor_idx AS INTEGER) AS anchor_idx, CAST(candidate_id AS INTEGER) AS candidate_id, score FROM ex JOIN ap USING (block, place)")
def exclusive_candidates(spark, sf):
    return events.best_candidates(events.candidates(usable(spark, sf)), exclusive=True).select("block", "anchor_idx", "candidate_id", "score")


@query(f"{_HEAD} SELECT block, site_id, row_id, round(abs_tdoa_ms, 6) AS abs_tdoa_ms FROM good QUALIFY row_number() OVER (PARTITION BY block, site_id ORDER BY abs_tdoa_ms DESC, row_id) = 1")
def strongest_per_site(spark, sf):
    return events.strongest(usable(spark, sf), ["block", "site_id"]).select("block", "site_id", "row_id", F.round("abs_tdoa_ms", 6).alias("abs_tdoa_ms"))


@query(f"""{_HEAD}, ti AS (SELECT DISTINCT block, t FROM good), nx AS (SELECT block, t, min(t) OVER (PARTITION BY block ORDER BY t RANGE BETWEEN 180000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ti),
se AS (SELECT block, min(t) AS anchor FROM ti GROUP BY block UNION ALL SELECT nx.block, nx.nt FROM se JOIN nx ON nx.block = se.block AND nx.t = se.anchor WHERE nx.nt IS NOT NULL)
SELECT row_id, anchor FROM good ASOF JOIN se ON good.block = se.block AND good.t >= se.anchor""")
def anchored_sessions(spark, sf):
    return sessions.anchored_sessions(usable(spark, sf).select("row_id", "block", "t"), int(S.EVENT_WINDOW_SECONDS * 1e6), ["block"]).select("row_id", "anchor")


_SWEEP = f"""wi AS (SELECT unnest([{', '.join(map(str, S.WINDOW_SWEEP_SECONDS))}])::DOUBLE AS w), kinds AS (SELECT 'raw' AS kind, row_id, site_id, t FROM good UNION ALL SELECT 'fixed', row_id, site_id, t + CAST(round_even(coalesce(-m, 0) * 1e6, 0) AS BIGINT) FROM good LEFT JOIN clock ON o = site_id),
ti AS (SELECT DISTINCT w, kind, t FROM kinds, wi), nx AS (SELECT w, kind, t, min(t) OVER (PARTITION BY w, kind ORDER BY t RANGE BETWEEN CAST(w * 1e6 AS BIGINT) + 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ti),
-- a gap wider than the width always begins a session, so stretches between gaps are followed side by side
st AS (SELECT w, kind, t FROM (SELECT *, lag(t) OVER (PARTITION BY w, kind ORDER BY t) AS p FROM ti) WHERE p IS NULL OR t - p > CAST(w * 1e6 AS BIGINT)),
se AS (SELECT w, kind, t AS anchor FROM st UNION ALL SELECT nx.w, nx.kind, nx.nt FROM se JOIN nx ON nx.w = se.w AND nx.kind = se.kind AND nx.t = se.anchor ANTI JOIN st ON st.w = nx.w AND st.kind = nx.kind AND st.t = nx.nt WHERE nx.nt IS NOT NULL),
ss AS (SELECT d.w, d.kind, se.anchor, count(DISTINCT site_id) AS n FROM (SELECT * FROM kinds, wi) d ASOF JOIN se ON d.w = se.w AND d.kind = se.kind AND d.t >= se.anchor GROUP BY ALL),
sw AS (SELECT w AS window_seconds, count(*) FILTER (n >= 2 AND kind = 'raw') AS a, count(*) FILTER (n >= 2 AND kind = 'fixed') AS b FROM ss GROUP BY w)"""


def _both_times(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = usable(spark, sf)
    offsets = timejoin.clock_offsets(d, "block")
    return timejoin.with_offsets(d, offsets), offsets


@query(f"{_HEAD}, {_CLOCK}, {_SWEEP} SELECT window_seconds, a AS multi_site_events_raw, b AS multi_site_events_offset_corrected, b - a AS improvement FROM sw")
def window_sweep(spark, sf):
    return events.window_sweep(_both_times(spark, sf)[0], S.WINDOW_SWEEP_SECONDS, "t", "t_corrected")


@query(
    f"""{_HEAD}, {_CLOCK}, {_SWEEP} SELECT 'window_sweep' AS diagnostic_type, window_seconds, a AS multi_site_events_raw, b AS multi_site_events_offset_corrected, b - a AS improvement, r AS reference_site_id,
  CAST(NULL AS INTEGER) AS other_site_id, CAST(NULL AS BIGINT) AS n_matches, CAST(NULL AS DOUBLE) AS applied_correction_s FROM sw, ref
UNION ALL BY NAME SELECT 'pair_offset' AS diagnostic_type, r AS reference_site_id, o AS other_site_id, n AS n_matches, {_r('-m')} AS applied_correction_s FROM clock"""
)
def diagnostics_union(spark, sf):
    from .localise import diagnostics

    both, offsets = _both_times(spark, sf)
    reference = F.first("reference_site_id")
    got = diagnostics(both.select("row_id", "site_id", "t"), both.select("row_id", F.col("t_corrected").alias("t")), offsets, int(offsets.agg(reference).first()[0]))
    return got.select(*got.columns[:8], rounded(F.col("applied_correction_s")).alias("applied_correction_s"))


@query(f"{_HEAD}, {_PAIRS} SELECT site_a, site_b, row_id, round(delta_s, 6) AS delta_s FROM near ORDER BY delta_s, site_a, site_b, row_id LIMIT 20")
def topk_deltas(spark, sf):
    got = timejoin.pair_candidates(usable(spark, sf).select("site_id", "row_id", "t"))
    return got.select("site_a", "site_b", "row_id", F.round("delta_s", 6).alias("delta_s")).orderBy("delta_s", "site_a", "site_b", "row_id").limit(20)


_COSTS = f"""bn AS (SELECT event_id, count(*) AS n FROM ev GROUP BY event_id), br AS (SELECT event_id, n, unnest(range(CAST(pow(2, n) AS BIGINT))) AS branch FROM bn),
si AS (SELECT event_id, site_id, canonical_easting_m AS sx, canonical_northing_m AS sy, bearing_1_deg AS b1, bearing_2_deg AS b2, greatest(least(greatest((abs_tdoa_ms - 0.025) / 0.225, 0), 1), 0.05) AS w,
  row_number() OVER (PARTITION BY event_id ORDER BY site_id) - 1 AS i FROM ev),
bx AS (SELECT event_id, branch, i, sx, sy, w, CASE WHEN (branch >> CAST(n - 1 - i AS BIGINT)) % 2 = 0 THEN b1 ELSE b2 END AS b, (branch >> CAST(n - 1 - i AS BIGINT)) % 2 AS bit FROM br JOIN si USING (event_id)),
rr AS (SELECT *, {_pmod('b - ' + _pmod('degrees(atan2(405640.0 - sx, 115750.0 - sy)) + 360') + ' + 180')} - 180 AS r FROM bx),
ge AS (SELECT a.event_id, a.branch, min(abs(sin(radians(a.b - c.b)))) AS g FROM bx a JOIN bx c ON a.event_id = c.event_id AND a.branch = c.branch AND a.i < c.i GROUP BY ALL),
co AS (SELECT event_id, branch, string_agg(CAST(bit AS VARCHAR), '' ORDER BY i) AS bits, 0.5 * sum(CASE WHEN w * r * r / 100 <= 1 THEN w * r * r / 100 ELSE 2 * sqrt(w * r * r / 100) - 1 END) AS cost, sqrt(sum(w * r * r) / sum(w)) AS rms FROM rr GROUP BY ALL)"""


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return solver.branch_costs(events.build_events(usable(spark, sf)), F.lit(405640.0), F.lit(115750.0))


@query(f"{_HEAD}, {_CANDIDATES}, {_COSTS} SELECT event_id, bits AS branch_bits, {_r('cost', 5)} AS objective, {_r('rms', 5)} AS rms_residual_deg FROM co")
def branch_costs(spark, sf):
    return _costs(spark, sf).select("event_id", "branch_bits", rounded(F.col("objective"), 5).alias("objective"), rounded(F.col("rms_residual_deg"), 5).alias("rms_residual_deg"))


@query(f"{_HEAD}, {_CANDIDATES}, {_COSTS} SELECT event_id, bits AS branch_bits, {_r('coalesce(g, 0)', 5)} AS geometry_score FROM co LEFT JOIN ge USING (event_id, branch)")
def geometry_score(spark, sf):
    return _costs(spark, sf).select("event_id", "branch_bits", rounded(F.col("geometry_score"), 5).alias("geometry_score"))


@query(f"{_HEAD}, {_CANDIDATES}, {_COSTS}, fl AS (SELECT event_id, bits, round(rms, 5) AS rms, round(coalesce(g, 0), 5) AS g, n FROM co LEFT JOIN ge USING (event_id, branch) JOIN bn USING (event_id)) SELECT event_id, bits AS branch_bits, rms <= 18 AND g >= sin(radians(10)) AND (n < 3 OR event_id % 5 / 10.0 >= 0.2) AS quality_pass FROM fl")
def quality_flag(spark, sf):
    margin = F.col("event_id") % 5 / 10.0
    return _costs(spark, sf).select("event_id", "branch_bits", scalars.quality_pass(F.round("rms_residual_deg", 5), F.round("geometry_score", 5), F.col("n_sites"), margin).alias("quality_pass"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return views.table(spark, sf, "supplier").select(k.cast("long").alias("id"), (k * 37 % 61 + k % 3 / 4).cast("double").alias("x"), (k * 91 % 53).cast("double").alias("y"))


_POINTS = "po AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey * 37 % 61 + s_suppkey % 3 / 4 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 53 AS DOUBLE) AS y FROM supplier)"


@query(f"""WITH RECURSIVE {_POINTS}, pq AS (SELECT a.id AS a, b.id AS b FROM po a, po b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25),
re AS (SELECT id, id AS r FROM po UNION SELECT pq.b, re.r FROM re JOIN pq ON pq.a = re.id), lo AS (SELECT id, min(r) AS r FROM re GROUP BY id) SELECT id, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INTEGER) AS cluster FROM lo""")
def site_components(spark, sf):
    return sites.clusters(_points(spark, sf), 5.0)


@query(f"""WITH RECURSIVE {_POINTS}, ra AS (SELECT 1 + unnest(range(77)) * 0.25::DOUBLE AS r), pq AS (SELECT r, a.id AS a, b.id AS b FROM po a, po b, ra WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= r * r),
re AS (SELECT r, id, id AS c FROM po, ra UNION SELECT pq.r, pq.b, re.c FROM re JOIN pq ON pq.a = re.id AND pq.r = re.r), lo AS (SELECT r, id, min(c) AS c FROM re GROUP BY r, id) SELECT r AS radius_m, count(DISTINCT c) AS n_clusters FROM lo GROUP BY r""")
def radius_sweep(spark, sf):
    return sites.radius_sweep(_points(spark, sf), S.TARGET_SITE_COUNT)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return views.table(spark, sf, "supplier").select(k.alias("site_id"), (-1.93 + k % 100 / 10000).alias("lon"), (50.93 + k % 37 / 5000).alias("lat"))


_BOX = """WITH re AS (SELECT s_suppkey AS site_id, -1.93 + s_suppkey % 100 / 10000::DOUBLE AS lon, 50.93 + s_suppkey % 37 / 5000::DOUBLE AS lat FROM supplier),
ex AS (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1, greatest(max(lon) - min(lon), 0.0001) * 0.25 AS px, greatest(max(lat) - min(lat), 0.0001) * 0.25 AS py FROM re),
bo AS (SELECT x0 - px AS lon_min, y0 - py AS lat_min, x1 + px AS lon_max, y1 + py AS lat_max FROM ex),
zo AS (SELECT *, z, 256 * pow(2, z) AS s FROM bo, (SELECT unnest(range(3, 19)) AS z)),
px AS (SELECT *, (lon_min + 180) / 360 * s AS wx0, (lon_max + 180) / 360 * s AS wx1, (0.5 - ln((1 + sin(radians(lat_max))) / (1 - sin(radians(lat_max)))) / (4 * pi())) * s AS wy0, (0.5 - ln((1 + sin(radians(lat_min))) / (1 - sin(radians(lat_min)))) / (4 * pi())) * s AS wy1 FROM zo),
bz AS (SELECT * FROM px WHERE abs(wx1 - wx0) <= 1260 AND abs(wy1 - wy0) <= 900 ORDER BY z DESC LIMIT 1)"""


@query(f"{_BOX} SELECT {_r('lon_min')} AS lon_min, {_r('lat_min')} AS lat_min, {_r('lon_max')} AS lon_max, {_r('lat_max')} AS lat_max, CAST(z AS INTEGER) AS zoom FROM bz")
def bounds_zoom(spark, sf):
    box = mapping.with_zoom(mapping.bounds(_records(spark, sf)))
    return box.select(*[rounded(F.col(c)).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")], "zoom")


@query(
    f"""{_BOX}, tr AS (SELECT z, CAST(floor(wx0 / 256) AS INTEGER) AS a, CAST(floor(wx1 / 256) AS INTEGER) AS b, CAST(floor(wy0 / 256) AS INTEGER) AS c, CAST(floor(wy1 / 256) AS INTEGER) AS d FROM bz),
tx AS (SELECT *, unnest(range(a, b + 1)) AS tile_x FROM tr), ty AS (SELECT *, unnest(range(c, d + 1)) AS tile_y FROM tx)
SELECT CAST(z AS INTEGER) AS zoom, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, CAST((tile_x - a) * 256 AS INTEGER) AS canvas_x, CAST((tile_y - c) * 256 AS INTEGER) AS canvas_y,
  'https://tile.openstreetmap.org/' || z || '/' || tile_x || '/' || tile_y || '.png' AS url FROM ty"""
)
def tile_cover(spark, sf):
    return mapping.tiles(mapping.canvas(mapping.bounds(_records(spark, sf))))


@query(
    f"""{_BOX} SELECT site_id, {_r('(lon + 180) / 360 * s - floor(wx0 / 256) * 256', 3)} AS canvas_x, {_r('(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * s - floor(wy0 / 256) * 256', 3)} AS canvas_y FROM re, bz"""
)
def canvas_places(spark, sf):
    r = _records(spark, sf)
    return mapping.on_canvas(r, mapping.canvas(mapping.bounds(r))).select("site_id", rounded(F.col("canvas_x"), 3).alias("canvas_x"), rounded(F.col("canvas_y"), 3).alias("canvas_y"))


@query(
    f"""WITH x AS (SELECT event_id AS row_id, radians(-1.92 + event_id % 10 / 1000::DOUBLE) AS lon, radians(50.94::DOUBLE) AS lat, radians(event_id % 360) AS b, (100 + event_id % 37 * 25) / 6378137.0::DOUBLE AS d FROM events),
y AS (SELECT *, sin(lat) * cos(d) + cos(lat) * sin(d) * cos(b) AS s FROM x)
SELECT row_id, {_r(_pmod('degrees(lon + atan2(sin(b) * sin(d) * cos(lat), cos(d) - sin(lat) * s)) + 540') + ' - 180')} AS lon, {_r('degrees(asin(s))')} AS lat FROM y"""
)
def destination_point(spark, sf):
    i = F.col("event_id")
    lon, lat = maps.destination(-1.92 + i % 10 / 1000, F.lit(50.94), (i % 360).cast("double"), (100 + i % 37 * 25).cast("double"))
    return views.table(spark, sf, "events").select(i.alias("row_id"), rounded(lon).alias("lon"), rounded(lat).alias("lat"))


@query(
    f"""{_HEAD}, p AS (SELECT site_id AS id, sx AS e, sy AS n FROM places), {_inverse_sql('p')},
nu AS (SELECT row_number() OVER (ORDER BY site_id, t, row_id, bearing_1_deg) AS det_id, * FROM good), br AS (SELECT *, unnest([1, 2]) AS j FROM nu)
SELECT det_id, site_id, CAST(j AS INTEGER) AS branch_index, {_r('CASE j WHEN 1 THEN bearing_1_deg ELSE bearing_2_deg END')} AS bearing_deg, round(lon, 8) AS center_lon, round(lat, 8) AS center_lat FROM br JOIN ll ON id = site_id"""
)
def bearing_lines(spark, sf):
    got = mapping.bearing_lines(usable(spark, sf))
    return got.select("det_id", "site_id", "branch_index", rounded(F.col("bearing_deg")).alias("bearing_deg"), F.round("center_lon", 8).alias("center_lon"), F.round("center_lat", 8).alias("center_lat"))


@query("SELECT s_suppkey AS site_id, 'Recorder ' || s_suppkey AS label, count(*) AS n_detections FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def map_records_json(spark, sf):
    s, lines = views.table(spark, sf, "supplier"), views.table(spark, sf, "lineitem")
    counts = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_detections"))
    table = s.join(counts, "s_suppkey").select(F.col("s_suppkey").alias("site_id"), "n_detections", F.lit(-1.92).alias("canonical_lon_deg"), F.lit(50.94).alias("canonical_lat_deg"))
    kind = table.schema["site_id"].dataType.simpleString()
    back = mapping.as_json(mapping.site_records(table)).select(F.from_json("json", f"site_id {kind}, label string, n_detections long").alias("r"))
    return back.select("r.*")


@query()
def triangulate(spark, sf):
    """The flagship: events of all usable detections, located."""
    members = events.build_events(usable(spark, sf)).withColumn("event_time", F.timestamp_micros("t"))
    return solver.solve(members).drop("bearings")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("rec"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, each of which stands for a recording, in as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _recordings() -> audio.Contents:
    """What makes a stereo recording for each rec, in the pass that reads it: a burst, late in one channel by a known lag."""

    def made(batch):
        import io
        import wave

        for k in batch.column("rec").to_pylist():
            rng, rate = np.random.default_rng(k), 48_000
            call = rng.normal(0, 0.2, int(0.4 * rate)) * np.hanning(int(0.4 * rate))
            lag, frames = k % 41 - 20, np.zeros((3 * rate, 2), "<i4")
            frames[60_000 : 60_000 + len(call), 1] = frames[60_000 + lag : 60_000 + lag + len(call), 0] = np.clip(call, -1, 1) * (2**31 - 1)
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(2)
                f.setsampwidth(4)
                f.setframerate(rate)
                f.writeframes(frames.tobytes())
            yield out.getvalue()

    return made


@query()
def gcc_phat_tdoa(spark, sf):
    """Delays of one window of every made recording, in one narrow pass."""
    return audio.calls(_dealt(_suppliers(spark, sf)), lambda channel, rate, allowed, confidence, overlap: [(0.0, 3.0, "call", 1.0)], keys=("rec",), contents=_recordings())


def _known_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Events of three sites that measured the bearing of a place without error; the other bearing is its mirror image."""
    k = F.col("s_suppkey")
    place = lambda i: F.element_at(F.array(*[F.lit(views.SITE_POSITIONS[s][i]) for s in (1, 4, 5)]), F.col("site_id"))
    rows = views.table(spark, sf, "supplier").select(k.cast("long").alias("event_id"), (405560 + k * 37 % 181).cast("double").alias("x"), (115700 + k * 91 % 173).cast("double").alias("y"))
    rows = rows.withColumn("site_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = rows.withColumns({"canonical_easting_m": place(0), "canonical_northing_m": place(1)})
    rows = rows.withColumn("bearing_1_deg", scalars.bearing_between(F.col("canonical_easting_m"), F.col("canonical_northing_m"), F.col("x"), F.col("y")))
    return rows.withColumns({"bearing_2_deg": F.pmod(180 - F.col("bearing_1_deg"), F.lit(360.0)), "abs_tdoa_ms": F.lit(0.3), "event_time": F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("event_id") + F.col("site_id"))})


@query("""SELECT CAST(s_suppkey AS BIGINT) AS event_id, 3 AS n_sites, to_timestamp(1700000001 + 60 * s_suppkey) AT TIME ZONE 'UTC' AS event_time_min, to_timestamp(1700000003 + 60 * s_suppkey) AT TIME ZONE 'UTC' AS event_time_max,
  true AS triangulation_success, '000' AS branch_bits, CAST(405560 + s_suppkey * 37 % 181 AS DOUBLE) AS easting, CAST(115700 + s_suppkey * 91 % 173 AS DOUBLE) AS northing, 0.0::DOUBLE AS objective, 0.0::DOUBLE AS rms_residual_deg FROM supplier""")
def located_sources(spark, sf):
    """Sources whose true bearings are known are found where they are, on the branch of the true bearings."""
    got = solver.solve(_known_sources(spark, sf))
    place = lambda c: rounded(F.col(c), 1).alias(c.split("_")[1])
    small = lambda c: rounded(F.col(c), 3).alias(c)
    return got.select("event_id", "n_sites", F.col("event_time_min").cast("timestamp_ntz").alias("event_time_min"), F.col("event_time_max").cast("timestamp_ntz").alias("event_time_max"), "triangulation_success", "branch_bits", place("solution_easting_m"), place("solution_northing_m"), small("objective"), small("rms_residual_deg"))


def _many_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Events of 24 sites that measured the bearing of a place without error; in every third event one site's two bearings are the same."""
    k, i = F.col("s_suppkey"), F.col("site_id")
    rows = views.table(spark, sf, "supplier").select(k.cast("long").alias("event_id"), (405560 + k * 37 % 181).cast("double").alias("x"), (115700 + k * 91 % 173).cast("double").alias("y"))
    rows = rows.withColumn("site_id", F.explode(F.sequence(F.lit(1), F.lit(24))))
    rows = rows.withColumns({"canonical_easting_m": (405300.5 + i * 137 % 23 * 25).cast("double"), "canonical_northing_m": (115500.25 + i * 89 % 29 * 20).cast("double"), "abs_tdoa_ms": F.lit(0.3), "event_time": F.timestamp_seconds(F.lit(1_700_000_000) + i)})
    rows = rows.withColumn("bearing_1_deg", scalars.bearing_between(F.col("canonical_easting_m"), F.col("canonical_northing_m"), F.col("x"), F.col("y")))
    mirrored = F.pmod(180 - F.col("bearing_1_deg"), F.lit(360.0))
    return rows.withColumn("bearing_2_deg", F.when((F.col("event_id") % 3 == 0) & (i == 7), F.col("bearing_1_deg")).otherwise(mirrored))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS event_id, 24 AS n_sites, true AS triangulation_success, repeat('0', 24) AS branch_bits, CAST(405560 + s_suppkey * 37 % 181 AS DOUBLE) AS easting, CAST(115700 + s_suppkey * 91 % 173 AS DOUBLE) AS northing,
  0.0::DOUBLE AS objective, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE END AS tied_margin, s_suppkey % 3 <> 0 AS clear FROM supplier""")
def many_site_events(spark, sf):
    """Events of 24 sites, 2^24 branches each: the true branch, and a margin of zero where a bearing is its own mirror image."""
    got = solver.solve(_many_sites(spark, sf))
    place = lambda c: rounded(F.col(c), 1).alias(c.split("_")[1])
    tied = F.when(F.col("event_id") % 3 == 0, rounded(F.col("branch_margin"), 6))
    return got.select("event_id", "n_sites", "triangulation_success", "branch_bits", place("solution_easting_m"), place("solution_northing_m"), rounded(F.col("objective"), 3).alias("objective"), tied.alias("tied_margin"), (F.col("branch_margin") > 1e-6).alias("clear"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS rec, CAST(s_suppkey % 41 - 20 AS BIGINT) AS lag, 'left,right' AS detected_by, 0.5::DOUBLE AS cut_s, false AS too_short FROM supplier")
def known_lags(spark, sf):
    """The lag of every made recording, to the nearest sample, by the frequencies that the filter passes, and the length of its cut."""
    windows = views.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("rec"), F.lit(0.0).alias("start_s"), F.lit(3.0).alias("end_s"), F.lit("left,right").alias("detected_by"))
    # windows meet what names a recording, never its content
    rows = _suppliers(spark, sf).join(audio.gathered(windows, ("rec",)).hint("merge"), "rec")
    got = audio.window_delays(_dealt(rows), ("rec",), (S.BAND_LOW_HZ, S.BAND_HIGH_HZ), _recordings())
    return got.select("rec", F.round("lag_samples").cast("long").alias("lag"), "detected_by", F.round(F.col("gcc_end_s") - F.col("gcc_start_s"), 6).alias("cut_s"), "too_short")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS event_id, 2 AS n_sites, false AS triangulation_success, false AS quality_pass, CAST(NULL AS VARCHAR) AS branch_bits, CAST(NULL AS DOUBLE) AS objective, true AS no_time FROM supplier""")
def ambiguous_pairs(spark, sf):
    """Events of two sites whose bearings cross at a place and, as far away, at its mirror image: none is located."""
    k = F.col("s_suppkey")
    rows = views.table(spark, sf, "supplier").select(k.cast("long").alias("event_id"), (405560 + k * 37 % 81).cast("double").alias("x"), (115750 + 40 + k * 91 % 173).cast("double").alias("y"))
    rows = rows.withColumn("site_id", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = rows.withColumns({"canonical_easting_m": F.when(F.col("site_id") == 1, 405500.0).otherwise(405700.0), "canonical_northing_m": F.lit(115750.0), "abs_tdoa_ms": F.lit(0.3), "event_time": F.timestamp_seconds(F.lit(1_700_000_000))})
    rows = rows.withColumn("bearing_1_deg", scalars.bearing_between(F.col("canonical_easting_m"), F.col("canonical_northing_m"), F.col("x"), F.col("y")))
    got = solver.solve(rows.withColumn("bearing_2_deg", F.pmod(180 - F.col("bearing_1_deg"), F.lit(360.0))))
    return got.select("event_id", "n_sites", "triangulation_success", "quality_pass", "branch_bits", "objective", F.col("event_time_min").isNull().alias("no_time"))


@query(f"""WITH RECURSIVE p AS (SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(405560 + s_suppkey * 37 % 181 AS DOUBLE) AS e, CAST(115700 + s_suppkey * 91 % 173 AS DOUBLE) AS n FROM supplier), {_inverse_sql('p')}
SELECT id AS event_id, 3 AS n_sites, round(lon, 4) AS lon, round(lat, 4) AS lat FROM ll""")
def call_map_records(spark, sf):
    """Map records of located calls, in degrees, through JSON and back."""
    sources = _known_sources(spark, sf)
    back = mapping.as_json(mapping.call_records(solver.solve(sources))).select(F.from_json("json", "event_id long, n_sites int, quality_pass boolean, lon double, lat double").alias("r"))
    return back.select("r.event_id", "r.n_sites", F.round("r.lon", 4).alias("lon"), F.round("r.lat", 4).alias("lat"))


@query("""SELECT event_id AS row_id, printf('%.3f|%.3f', (event_id * 37 % 2880) / 8.0::DOUBLE, (event_id * 91 % 2880) / 8.0::DOUBLE) AS joined FROM events""")
def joined_bearings(spark, sf):
    i = F.col("event_id")
    return views.table(spark, sf, "events").select(i.alias("row_id"), scalars.joined_bearings(F.array((i * 37 % 2880) / 8.0, (i * 91 % 2880) / 8.0)).alias("joined"))


@query(f"""{_HEAD} SELECT 'Recorder ' || site_id AS recorder_folder, count(*) AS n, count(*) FILTER (site_id <= 3) AS with_note, 2 AS files, {_r('sum(round(abs_tdoa_ms, 6))', 3)} AS sum_abs FROM good GROUP BY site_id, files""")
def csv_files(spark, sf):
    """Detections written as two CSV files with unlike columns and read back as one table with the file each came from."""
    rows = usable(spark, sf).select(F.concat(F.lit("Recorder "), F.col("site_id").cast("string")).alias("recorder_folder"), F.round("abs_tdoa_ms", 6).alias("tdoa_ms"), "site_id")
    paths = [owned(new_path(spark, f"csv-{half}")) for half in ("a", "b")]
    sinks.write_csv(rows.where("site_id <= 3").select("recorder_folder", "tdoa_ms", F.lit("x").alias("NOTE")), paths[0], one_file=True)
    sinks.write_csv(rows.where("site_id > 3").select("tdoa_ms", "recorder_folder"), paths[1], one_file=True)
    back = ingest.detections(spark, paths)
    files = back.select("source_file").distinct().agg(F.count("*").cast("int").alias("files"))
    each = back.groupBy("recorder_folder").agg(F.count("*").alias("n"), F.count("NOTE").alias("with_note"), rounded(F.sum("tdoa_ms"), 3).alias("sum_abs"))
    return each.crossJoin(files)  # of one row


@query("SELECT CAST(s_suppkey AS BIGINT) AS site_id, 'Recorder ' || s_suppkey AS label, 1 AS pages FROM supplier")
def map_page(spark, sf):
    """The site map written as a page, and the records that a reader of it finds."""
    folder = owned(new_path(spark, "page"))
    places = _records(spark, sf).select("site_id", F.lit(1).alias("n_detections"), F.col("lon").alias("canonical_lon_deg"), F.col("lat").alias("canonical_lat_deg"))
    calls = places.where("false").select(F.col("site_id").alias("event_id"))
    sinks.write_text(spark, sinks.site_map_html(mapping.site_records(places), calls, calls), f"{folder}/map.html")
    data = spark.read.text(f"{folder}/map.html", wholetext=True).select(F.regexp_extract("value", r"const data = (.*);\nconst map", 1).alias("json"))
    sites_ = data.select(F.explode(F.from_json("json", "sites array<struct<site_id: long, label: string>>")["sites"]).alias("s"))
    return sites_.select("s.site_id", "s.label", F.lit(1).alias("pages"))


@query("SELECT DISTINCT lower(p_type) AS species FROM part WHERE p_type IS NOT NULL")
def species_list(spark, sf):
    """A list of names, one a line with blank lines between, written and read as an allow-list."""
    path = owned(new_path(spark, "species"))
    names = views.table(spark, sf, "part").select(F.lower("p_type").alias("value")).where("value IS NOT NULL").distinct()
    names.unionByName(names.select(F.lit(" ").alias("value")).limit(1)).write.text(path)
    return ingest.species(spark, path).toDF("species")
