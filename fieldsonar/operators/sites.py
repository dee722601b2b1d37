"""Sites: summaries, the broadcast join back, clusters by distance and the choice of a cluster radius."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import projection
from ..settings import CLUSTER_MAX_RADIUS_M, CLUSTER_MIN_RADIUS_M, CLUSTER_STEP_M
from ..storage import remove, written
from .components import components
from .numbering import numbered
from .quantiles import quantiles


def site_summary(detections: DataFrame) -> DataFrame:
    """Per site: rows, different placements (a null coordinate is a value) and median position, also in degrees."""
    out = detections.groupBy("site_id").agg(F.count("*").alias("n_detections"), F.count_distinct(F.struct("LON", "LAT")).alias("n_unique_locations"))
    axis = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("at")) for c in ("easting_m", "northing_m")]))
    middle = quantiles(detections.select("site_id", axis.alias("x")).select("site_id", "x.*"), ["site_id", "axis"], "at", {"middle": 0.5})
    places = [F.max(F.when(F.col("axis") == c, F.col("middle"))).alias(f"canonical_{c}") for c in ("easting_m", "northing_m")]
    middle = middle.groupBy(F.col("site_id").alias("site")).agg(*places)
    out = out.join(middle, F.col("site_id").eqNullSafe(F.col("site")), "left").drop("site")
    return projection.with_lon_lat(out, F.col("canonical_easting_m"), F.col("canonical_northing_m"), "canonical_lon_deg", "canonical_lat_deg")


def with_sites(detections: DataFrame, sites: DataFrame, check: bool = True) -> DataFrame:
    """Detections with their site's position. Sites must be unique; the planner broadcasts them while they are few."""
    right = sites.select("site_id", "canonical_easting_m", "canonical_northing_m")
    if check and not right.groupBy("site_id").count().where("count > 1").isEmpty():
        raise ValueError("a site is there more than once")
    return detections.join(right, "site_id", "left")


def near_pairs(points: DataFrame, radius: float, id_column: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (a < b) of points no further apart than the radius, with their distance.

    A grid of cells as wide as the radius makes it an equi-join: each point meets its own and the adjoining cells.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    here = points.select(F.col(id_column).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("cx"), cell(y).alias("cy"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    there = points.select(F.col(id_column).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("gx"), cell(y).alias("gy"))
    there = there.withColumn("dx", step).withColumn("dy", step).select("b", "bx", "by", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy"))
    d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    return here.join(there, ["cx", "cy"]).where("a < b").withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("a", "b", F.sqrt("d2").alias("distance"))


def cell_links(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """What clusters under a radius need of points (id, x, y), however dense: each point's cell by its least member
    (id, cell), and the pairs of cells (a, b) that have points no further apart than the radius.

    A cell's diagonal is at most the radius, so all of its points are together. Whether two cells touch is mostly
    told by the eight outermost points of each; only where it is not are points of one near the other's bounds compared.
    """
    side = radius / 1.41422
    cut = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = points.withColumns({"cx": cut("x"), "cy": cut("y")})
    point = F.struct("x", "y")
    ways = (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y"))
    outer = F.array(*[f(point, w) for w in ways for f in (F.min_by, F.max_by)])
    cells = placed.groupBy("cx", "cy").agg(F.min("id").alias("cell"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), outer.alias("outer"))
    cells = written(cells, "cells")
    members = placed.join(cells.select("cx", "cy", "cell"), ["cx", "cy"]).select("id", "cell")
    one, two = (cells.select(F.struct(*cells.columns).alias(c)) for c in "ab")
    # half of the cells about each, so that a pair is met once
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]))
    one = one.withColumn("to", around).select("a", (F.col("a.cx") + F.col("to.dx")).alias("cx"), (F.col("a.cy") + F.col("to.dy")).alias("cy"))
    two = two.withColumns({"cx": F.col("b.cx"), "cy": F.col("b.cy")})
    d2 = lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)
    apart = lambda low, high, v: F.greatest(low - v, v - high, F.lit(0.0))
    gap = lambda c: F.greatest(F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.lit(0.0))
    # bounds only leave out what is surely too far: the comparison of points decides
    loose = F.lit(radius * radius * (1 + 1e-9))
    met = one.join(two, ["cx", "cy"]).where(F.pow(gap("x"), 2) + F.pow(gap("y"), 2) <= loose)
    touch = F.exists("a.outer", lambda p: F.exists("b.outer", lambda q: d2(p, q) <= radius * radius))
    met = written(met.select("a", "b", touch.alias("touch")), "cell-pairs")
    open_ = met.where("NOT touch")

    def near_other(own: str, other: str) -> DataFrame:
        """Points of a cell of an undecided pair that may be within reach of the other cell's bounds."""
        rows = placed.join(open_.withColumns({"cx": F.col(f"{own}.cx"), "cy": F.col(f"{own}.cy")}), ["cx", "cy"])
        dx, dy = (apart(F.col(f"{other}.{c}0"), F.col(f"{other}.{c}1"), F.col(c)) for c in "xy")
        return rows.where(dx * dx + dy * dy <= loose).select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), point.alias(own + "_at"))

    both = near_other("a", "b").join(near_other("b", "a"), ["a", "b"])
    found = both.where(d2(F.col("a_at"), F.col("b_at")) <= radius * radius).select("a", "b").distinct()
    return members, met.where("touch").select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b")).unionByName(found)


def clusters(points: DataFrame, radius: float, id_column: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Connected components under a radius: id and cluster, numbered from 0 by least member. Points without a place are alone."""
    at = points.select(F.col(id_column).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    somewhere = F.coalesce(F.abs("x") + F.abs("y") < F.lit(float("inf")), F.lit(False))
    members, links = cell_links(at.where(somewhere), radius)
    joined = members.join(components(links).withColumnRenamed("node", "cell"), "cell", "left").select("id", F.coalesce("label", "cell").alias("label"))
    labels = written(joined.unionByName(at.where(~somewhere).select("id", F.col("id").alias("label"))), "labels")
    names = numbered(labels.select("label").distinct(), "label", "cluster")
    return labels.join(names, "label").select("id", F.col("cluster").cast("int").alias("cluster"))


#: Cells of a level on each side of one of the next.
COARSER = 8
_EDGES = "a {t}, b {t}, distance double, ea {t}, eb {t}, ax long, ay long, bx long, by long"


def radius_sweep(points: DataFrame, target: int, id_column: str = "id", x: str = "x", y: str = "y", low: float = CLUSTER_MIN_RADIUS_M, high: float = CLUSTER_MAX_RADIUS_M, step: float = CLUSTER_STEP_M) -> DataFrame:
    """For each radius of the sweep, how many clusters it makes: radius_m, n_clusters.

    Clusters under a radius are the points less the edges of a minimum spanning forest that are no longer than it, so
    one forest answers the whole sweep: its edges are counted by the step that they first count in, and the counts added up
    over the steps. Edges no longer than the least radius need only be counted, which its clusters tell. Points without a
    place are alone.
    """
    spark = points.sparkSession
    steps = int(round((high - low) / step))
    first = F.greatest(F.ceil((F.col("distance") - low) / step), F.lit(0)).cast("int")
    # the quotient may round to either side of a step: the comparison with the radius itself decides
    first = F.when((first > 0) & (F.col("distance") <= (first - 1) * step + low), first - 1).when(F.col("distance") > first * step + low, first + 1).otherwise(first)
    at = points.select(F.col(id_column).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    somewhere = F.coalesce(F.abs("x") + F.abs("y") < F.lit(float("inf")), F.lit(False))
    alone = at.where(~somewhere).agg(F.count("*").alias("alone"))
    places = written(at.where(somewhere).groupBy("x", "y").agg(F.min("id").alias("id")), "places")
    forest, parts = long_edges(places, low, high)
    counts = forest.select(first.alias("k")).groupBy("k").agg(F.count("*").alias("joined"))
    n = alone.crossJoin(parts)
    radii = spark.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row a radius
    sums = radii.join(counts, "k", "left").select("k", F.sum(F.coalesce("joined", F.lit(0))).over(upto).alias("joined"))
    return sums.crossJoin(n).select((F.col("k") * step + low).alias("radius_m"), (F.col("alone") + F.col("parts") - F.col("joined")).alias("n_clusters"))


def long_edges(places: DataFrame, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Of places (id, x, y; no two the same): the lengths (distance) of those edges of a minimum spanning forest of the pairs
    within `high` that are longer than `low`, and in one row how many clusters there are under `low` (parts).

    Lengths are taken up by octaves. Under an octave's lower end all places of a cell are in one cluster, so only pairs of
    near cells of different clusters matter, and of these the shortest distance: a cell has few near cells, however many
    places lie in them. Each octave's edges join its clusters to those of the next.
    """
    spark, radius = places.sparkSession, low
    links = cell_links(places, low)
    named = links[0].join(components(links[1]).withColumnRenamed("node", "cell"), "cell", "left").select("id", F.coalesce("label", "cell").alias("part"))
    now = written(places.join(named, "id").select("id", "x", "y", "part"), "parts")
    parts = written(now.agg(F.count_distinct("part").alias("parts")), "parts-number")
    out = spark.createDataFrame([], "distance double")
    while radius < high:
        wide = min(2 * radius, high)
        near = written(nearest_parts(now, radius, wide), "near-parts")
        if not near.isEmpty():
            forest = written(forest_of(near, wide).select("a", "b", "distance"), "forest")
            out = out.unionByName(forest.select("distance"))
            labels = components(forest.select("a", "b")).withColumnsRenamed({"node": "part", "label": "whole"})
            now = written(now.join(labels, "part", "left").select("id", "x", "y", F.coalesce("whole", "part").alias("part")), "parts")
        radius = wide
    return out, parts


def nearest_parts(places: DataFrame, radius: float, wide: float) -> DataFrame:
    """Pairs of clusters (a < b) under a radius that are no further apart than `wide`, their distance, and a place of each (ax, ay, bx, by).

    places has id, x, y and part, the cluster under `radius`. How far the outermost places of two cells are apart bounds
    the distance of their clusters; only places that may be within the least of such bounds are compared.
    """
    side = radius / 1.41422
    cut = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = places.withColumns({"cx": cut("x"), "cy": cut("y")})
    point, ways = F.struct("x", "y"), (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y"))
    outer = F.array(*[f(point, w) for w in ways for f in (F.min_by, F.max_by)])
    cells = placed.groupBy("cx", "cy", "part").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), outer.alias("outer"))
    cells = written(cells, "cells")
    reach = int(wide / side) + 1
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(reach + 1) for dy in range(-reach, reach + 1) if (dx, dy) > (0, 0)]))
    one, two = (cells.select(F.struct(*cells.columns).alias(c)) for c in "ab")
    one = one.withColumn("to", around).select("a", (F.col("a.cx") + F.col("to.dx")).alias("cx"), (F.col("a.cy") + F.col("to.dy")).alias("cy"))
    two = two.withColumns({"cx": F.col("b.cx"), "cy": F.col("b.cy")})
    d2 = lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)
    apart = lambda low, high, v: F.greatest(low - v, v - high, F.lit(0.0))
    gap = lambda c: F.greatest(F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.lit(0.0))
    slack = 1 + 1e-9
    met = one.join(two.hint("merge"), ["cx", "cy"]).where("a.part != b.part").withColumn("least", F.pow(gap("x"), 2) + F.pow(gap("y"), 2))
    bound = F.array_min(F.transform("a.outer", lambda p: F.array_min(F.transform("b.outer", lambda q: d2(p, q)))))
    met = met.where(F.col("least") <= wide * wide * slack).withColumn("bound", F.least(bound, F.lit(wide * wide)))
    met = met.withColumns({"p": F.least("a.part", "b.part"), "q": F.greatest("a.part", "b.part")}).drop("cx", "cy")
    met = written(met, "cell-pairs")
    bounds = met.groupBy("p", "q").agg(F.min("bound").alias("limit"))
    met = written(met.join(bounds, ["p", "q"]).where(F.col("least") <= F.col("limit") * slack), "cell-pairs-near")

    def near_other(own: str, other: str) -> DataFrame:
        """Places of a cell that may be within the bound of the other cell's."""
        rows = placed.join(met.withColumns({"cx": F.col(f"{own}.cx"), "cy": F.col(f"{own}.cy"), "part": F.col(f"{own}.part")}), ["cx", "cy", "part"])
        dx, dy = (apart(F.col(f"{other}.{c}0"), F.col(f"{other}.{c}1"), F.col(c)) for c in "xy")
        rows = rows.where(dx * dx + dy * dy <= F.col("limit") * slack)
        cell = [F.col(f"{c}.{k}").alias(f"{c}{k}") for c in "ab" for k in ("cx", "cy", "part")]
        return rows.select(*cell, point.alias(own + "_at"))

    both = near_other("a", "b").join(near_other("b", "a"), [f"{c}{k}" for c in "ab" for k in ("cx", "cy", "part")])
    both = both.withColumn("d2", d2(F.col("a_at"), F.col("b_at"))).where(F.col("d2") <= wide * wide)
    pair = both.select(F.least("apart", "bpart").alias("a"), F.greatest("apart", "bpart").alias("b"), "d2").groupBy("a", "b").agg(F.sqrt(F.min("d2")).alias("distance"))
    # a cluster lies where its least place, whose id is its name, lies
    homes = [places.where("id = part").select(F.col("id").alias(c), F.col("x").alias(c + "x"), F.col("y").alias(c + "y")) for c in "ab"]
    return pair.join(homes[0], "a").join(homes[1], "b")


def spanning_forest(points: DataFrame, radius: float, id_column: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Edges (a, b, distance) of a minimum spanning forest of the pairs within a radius; equal lengths go by a and b."""
    at = points.select(F.col(id_column).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    here, there = (at.toDF(c, c + "x", c + "y") for c in "ab")
    return forest_of(near_pairs(points, radius, id_column, x, y).join(here, "a").join(there, "b"), radius)


def forest_of(pairs: DataFrame, radius: float) -> DataFrame:
    """Edges (a, b, distance) of a minimum spanning forest of pairs (a, b, distance, and where each is: ax, ay, bx, by); equal lengths go by a and b.

    The plane is cut into cells of COARSER radii, whose tasks take edges in ascending length. An edge between two parts of
    which one has no edge out of the cell is the shortest that leaves that part, so it is in the forest; those between
    two parts with edges out wait, unless they close a circle. Cells then grow by COARSER on each side until none is
    left. What goes on to the next level is what touches the borders, so no task holds a whole plane of points.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    cell = lambda c: F.floor(F.col(c) / (COARSER * radius)).cast("long").alias(c)
    edges = pairs.select("a", "b", "distance", F.col("a").alias("ea"), F.col("b").alias("eb"), *[cell(c) for c in ("ax", "ay", "bx", "by")])
    edges = written(edges, "edges")
    # cells are counted from the least one, so that all of them are one in the end, also those on two sides of zero
    west, south = edges.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by"))).first()
    edges = edges.withColumns({c: F.col(c) - F.lit(west if c[1] == "x" else south) for c in ("ax", "ay", "bx", "by")})
    schema = f"{_EDGES.format(t=kind)}, kind int"
    out = spark.createDataFrame([], f"a {kind}, b {kind}, distance double")
    while True:
        inside = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        # an edge between cells goes to both, whose tasks give its end there its part's name
        sides = edges.withColumn("kind", F.when(inside, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))).withColumn("kind", F.explode("kind"))
        sides = sides.withColumns({"cx": F.when(F.col("kind") == 2, F.col("bx")).otherwise(F.col("ax")), "cy": F.when(F.col("kind") == 2, F.col("by")).otherwise(F.col("ay"))})
        done = written(sides.repartition("cx", "cy").sortWithinPartitions("cx", "cy", "distance", "ea", "eb").mapInArrow(_contracted, schema), "contracted")
        out = out.unionByName(done.where("kind = 0").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "distance"))
        waiting = done.where("kind = 3").drop("kind")
        ends = done.where("kind = 1").drop("kind", "b").join(done.where("kind = 2").select("b", "ea", "eb"), ["ea", "eb"]).select(*waiting.columns)
        coarser = {c: F.floor(F.col(c) / COARSER).cast("long") for c in ("ax", "ay", "bx", "by")}
        last, edges = edges, written(waiting.unionByName(ends).withColumns(coarser), "edges")
        remove(spark, last)
        if edges.isEmpty():
            return out


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell's edges after its pass (spanning_forest): kind 0 in the forest, 1 and 2 the ends of edges out, 3 waiting."""
    names: list[str] = []
    now, rows = None, []
    for batch in batches:
        names = names or batch.schema.names
        kinds = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[-2:] != now:
                if rows:
                    yield _as_batch(_cell_pass(rows), kinds)
                now, rows = row[-2:], []
            rows.append(row)
    if rows:
        yield _as_batch(_cell_pass(rows), kinds)


def _as_batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    fields = list(kinds)[:10]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], names=[f.name for f in fields])


def _cell_pass(rows: list[tuple]) -> list[tuple]:
    """rows are (a, b, distance, ea, eb, ax, ay, bx, by, kind, cx, cy) in ascending length."""
    up: dict = {}

    def root(v: object) -> object:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    open_ = {r[0] if r[9] == 1 else r[1] for r in rows if r[9]}
    forest, wait = [], []
    for r in rows:
        if r[9]:
            continue
        a, b = root(r[0]), root(r[1])
        if a == b:
            continue
        if a in open_ and b in open_:
            wait.append(r)
            continue
        up[b] = a
        if b in open_:
            open_.add(a)
        forest.append((*r[:9], 0))
    # those that wait join open parts; one that closes a circle of shorter ones is the longest of it and no forest's
    out, joined = forest, up.copy()
    up, own = joined.copy(), joined

    def name(v: object) -> object:
        while (w := own.get(v, v)) != v:
            v = w
        return v

    for r in wait:
        a, b = root(r[0]), root(r[1])
        if a != b:
            up[b] = a
            out.append((name(r[0]), name(r[1]), *r[2:9], 3))
    for r in rows:
        if r[9] == 1:
            out.append((name(r[0]), *r[1:10]))
        elif r[9] == 2:
            out.append((r[0], name(r[1]), *r[2:10]))
    return out


def chosen_radius(sweep: DataFrame, target: int) -> DataFrame:
    """The radius whose clusters come closest in number to the target; ties go to the smaller radius."""
    best = F.min_by(F.struct("radius_m", "n_clusters"), F.struct(F.abs(F.col("n_clusters") - target), "radius_m"))
    return sweep.agg(best.alias("s")).select("s.*")
