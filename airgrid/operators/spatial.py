"""Range joins, nearest neighbours and point-in-polygon joins by grid cells.

Distances are never taken over all pairs. Points are placed in cells at least as wide as the search
radius, so every pair in reach lies in touching cells and meets in an equi join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.session import BROADCAST_ROWS, broadcast_if_small, reliable_checkpoint

HALF_TURN_KM = math.pi * geo.EARTH_KM


def _lat_row(lat: Column, step: float) -> Column:
    return F.floor(lat / F.lit(step)).cast("long")


def _lon_width(row: Column, step: float, radius_km: float, sphere_km: float) -> Column:
    """Cell width in degrees that holds every longitude gap in reach of rows row-1 .. row+1."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * F.lit(step)), F.abs((row + 2) * F.lit(step))))
    reach = math.sin(min(radius_km / (2 * sphere_km), math.pi / 2)) * (1 + 1e-9)
    gap = F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.lit(reach) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))))
    return F.least(F.lit(360.0), F.degrees(gap) * (1 + 1e-9))


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    radius_km: float,
    sphere_km: float = geo.EARTH_KM,
    salts: int = 1,
    by: list[str] = (),
) -> DataFrame:
    """All (by, left_id, right_id, distance_km) with great-circle distance up to ``radius_km``.

    Both frames need ``lon`` and ``lat``. Rows without coordinates match nothing. ``salts`` spreads a
    crowded cell over several tasks. Rows meet only where they agree in the columns ``by``.
    """
    step = math.degrees(radius_km / sphere_km) * (1 + 1e-9)
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    row = _lat_row(F.col("lat"), step)
    by = list(by)
    a = left.where(known).select(
        *by, F.col(left_id).alias("_a"), F.col("lon").alias("_x1"), F.col("lat").alias("_y1"), row.alias("_row"),
        F.floor(F.col("lon") / _lon_width(row, step, radius_km, sphere_km)).cast("long").alias("_cell"),
    )
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    rows = F.transform(around, lambda i: F.struct((row + i).alias("_row"), _lon_width(row + i, step, radius_km, sphere_km).alias("_width")))
    b = right.where(known).select(
        *by, F.col(right_id).alias("_b"), F.col("lon").alias("_x2"), F.col("lat").alias("_y2"), F.inline(rows)
    )
    # Copies shifted by a full turn serve points on both sides of the date line.
    turns = F.filter(
        F.array(*[F.col("_x2") + F.lit(t) for t in (-360.0, 0.0, 360.0)]), lambda x: F.abs(x) <= 180 + F.col("_width")
    )
    places = F.flatten(F.transform(turns, lambda x: F.transform(around, lambda i: F.struct(
        x.alias("_xt"), (F.floor(x / F.col("_width")).cast("long") + i).alias("_cell")))))
    b = b.select(*by, "_b", "_x2", "_y2", "_row", F.inline(places))
    keys = [*by, "_row", "_cell"]
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(salts)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    gap = F.col("_x1") - F.col("_xt")
    d = geo.haversine_km(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2"), sphere_km)
    right_out = right_id if right_id != left_id else right_id + "_to"
    near = a.join(b, keys).where((gap > -180) & (gap <= 180))
    near = near.select(*by, F.col("_a").alias(left_id), F.col("_b").alias(right_out), d.alias("distance_km"))
    return near.where(F.col("distance_km") <= radius_km)


def planar_pairs_within(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: float, ellipsoid: bool = False
) -> DataFrame:
    """Pairs by straight distance in the azimuthal-equidistant plane around the box of both frames.

    The plane is the spherical one, tens of metres off at 50 km, or with ``ellipsoid`` that of WGS84.
    """
    plane = geo.aeqd_xy_ellipsoid if ellipsoid else geo.aeqd_xy
    box = left.select("lon", "lat").unionByName(right.select("lon", "lat"))
    mid = box.agg(
        ((F.min("lon") + F.max("lon")) / 2).alias("lon0"), ((F.min("lat") + F.max("lat")) / 2).alias("lat0")
    )
    lon0, lat0 = mid.select("lon0").scalar(), mid.select("lat0").scalar()

    def place(df: DataFrame, key: str, name: str, suffix: str) -> DataFrame:
        x, y = plane(F.col("lon"), F.col("lat"), F.col("_lon0"), F.col("_lat0"))
        out = df.withColumn("_lon0", lon0).withColumn("_lat0", lat0)
        return out.select(F.col(key).alias(name), x.alias("_x" + suffix), y.alias("_y" + suffix))

    a, b = place(left, left_id, "_a", "1"), place(right, right_id, "_b", "2")
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius_km))).cast("long")
    a = a.withColumn("_cx", cell("_x1")).withColumn("_cy", cell("_y1"))
    shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    b = b.withColumn("_cx", F.explode(F.transform(shifts, lambda i: cell("_x2") + i)))
    b = b.withColumn("_cy", F.explode(F.transform(shifts, lambda i: cell("_y2") + i)))
    d = F.sqrt((F.col("_x1") - F.col("_x2")) ** 2 + (F.col("_y1") - F.col("_y2")) ** 2)
    near = a.join(b, ["_cx", "_cy"]).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)
    right_out = right_id if right_id != left_id else right_id + "_to"
    return near.select(F.col("_a").alias(left_id), F.col("_b").alias(right_out), "distance_km")


def nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    k: int = 1,
    start_km: float = 5.0,
    positive_only: bool = False,
    by: list[str] = (),
) -> DataFrame:
    """The k nearest right points of every left point with their rank; ties go to the smaller id.

    The radius doubles until every left point has k partners or the sphere is covered. A point leaves
    the search once its k partners lie inside the radius, so the answer is exact. Points without
    coordinates have no partners and take no part. With ``by`` only points that agree in these columns
    are partners. Where no more than k right points are known, the whole sphere is searched at once.
    """
    by = list(by)
    right_out = right_id if right_id != left_id else right_id + "_to"
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    pending, found, radius = left.where(known), None, start_km
    right = right.where(known)
    if by:
        # Groups of so few points meet whole, k times their left points at most.
        few = reliable_checkpoint(right.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= k).select(*by))
        if not few.isEmpty():
            near = pairs_within(pending.join(few, by, "left_semi"), right.join(few, by, "left_semi"), left_id, right_id, HALF_TURN_KM, by=by)
            found = reliable_checkpoint(rank_nearest(near.where(F.col("distance_km") > 0) if positive_only else near, left_id, right_out, k, by))
            pending = reliable_checkpoint(pending.join(few, by, "left_anti"))
    elif right.limit(k).count() < k:
        radius = HALF_TURN_KM
    while True:
        last = radius >= HALF_TURN_KM
        near = pairs_within(pending, right, left_id, right_id, min(radius, HALF_TURN_KM), by=by)
        if positive_only:
            near = near.where(F.col("distance_km") > 0)
        ranked = rank_nearest(near, left_id, right_out, k, by)
        if not last:
            # Ranks beyond the k-th are gone, so the k-th is there or the point stays in the search.
            full = ranked.where(F.col("rank") == k).select(*by, left_id)
            ranked = ranked.join(full, [*by, left_id], "left_semi")
        ranked = reliable_checkpoint(ranked)
        found = ranked if found is None else found.unionByName(ranked)
        if last:
            return found
        pending = reliable_checkpoint(pending.join(ranked.where(F.col("rank") == k).select(*by, left_id), [*by, left_id], "left_anti"))
        if pending.isEmpty():
            return found
        radius *= 2


def rank_nearest(pairs: DataFrame, left_id: str, right_id: str, k: int, by: list[str] = ()) -> DataFrame:
    """First k partners per left id by (distance, right id).

    The rank filter lets Spark keep only k rows per key in every task before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by, left_id).orderBy("distance_km", right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def with_box(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Add the bounding box of the rings."""
    pts = F.flatten(F.col(rings))
    xs, ys = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    return (
        polygons.withColumn("_x_lo", F.array_min(xs))
        .withColumn("_x_hi", F.array_max(xs))
        .withColumn("_y_lo", F.array_min(ys))
        .withColumn("_y_hi", F.array_max(ys))
    )


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join by cell in which a crowded cell is no single task's: the smaller side comes to the other, spread evenly.

    Both are written and counted. Where the smaller is beyond the bound of broadcasts, both are shuffled and adaptive
    execution splits the crowded cells.
    """
    (few, small), (_, large) = sorted(((w.count(), w) for w in (reliable_checkpoint(left), reliable_checkpoint(right))), key=lambda x: x[0])
    if few > BROADCAST_ROWS:
        return small.join(large, keys)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return large.repartition(n).join(F.broadcast(small), keys)


#: Where in its cell, as shares of its sides, the point lies whose side of each polygon is known; odd shares keep it off vertices.
ANCHOR_X, ANCHOR_Y = 0.3819660112501, 0.6180339887498


def edge_cells(polygons: DataFrame, polygon_id: str, size: float) -> DataFrame:
    """Edges (polygon_id, x1, y1, x2, y2, _cx, _cy), once for each cell they touch; long edges follow their own line."""
    edges = _edges(polygons, polygon_id, "").where(F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())
    rows = edges.withColumn("_cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    at = lambda y: F.col("x1") + slope * (y - F.col("y1"))
    low = F.greatest(F.least("y1", "y2"), F.col("_cy") * size)
    high = F.least(F.greatest("y1", "y2"), (F.col("_cy") + 1) * size)
    a, b = F.coalesce(at(low), F.col("x1")), F.coalesce(at(high), F.col("x2"))
    margin = 1e-9
    return rows.withColumn("_cx", F.explode(_cells(F.least(a, b) - margin, F.greatest(a, b) + margin, size)))


def anchors_inside(polygons: DataFrame, polygon_id: str, size: float) -> DataFrame:
    """Cells (polygon_id, _cx, _cy) whose anchor lies in the polygon, from where its edges cross the anchors' latitudes."""
    from pyspark.sql import Window

    edges = _edges(polygons, polygon_id, "")
    first = F.floor(F.least("y1", "y2") / size - ANCHOR_Y).cast("long")
    last = F.floor(F.greatest("y1", "y2") / size - ANCHOR_Y).cast("long") + 1
    rows = edges.where(F.col("y1") != F.col("y2")).withColumn("_cy", F.explode(F.sequence(first, last)))
    y = (F.col("_cy") + ANCHOR_Y) * size
    rows = rows.where((F.col("y1") > y) != (F.col("y2") > y))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))
    along = Window.partitionBy(polygon_id, "_cy").orderBy("_x")
    rows = rows.select(polygon_id, "_cy", x.alias("_x")).withColumns({"_to": F.lead("_x").over(along), "_n": F.row_number().over(along)})
    # Between an odd crossing and the next lies the inside.
    begin = F.ceil(F.col("_x") / size - ANCHOR_X).cast("long")
    end = F.ceil(F.col("_to") / size - ANCHOR_X).cast("long") - 1
    spans = rows.where((F.col("_n") % 2 == 1) & F.col("_to").isNotNull() & (begin <= end))
    return spans.select(polygon_id, "_cy", F.explode(F.sequence(begin, end)).alias("_cx"))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell_deg: float = 0.05
) -> DataFrame:
    """(point_id, polygon_id) for every point inside a polygon.

    Each cell has an anchor whose side of every polygon is known. A point is inside if the anchor is, turned round by
    each edge between the two; only edges of its own cell can lie there. So a point meets the edges of one cell,
    however many cells or edges its polygon has, and rings are never copied. ``point_id`` should differ between rows.
    """
    polygons = polygons.select(polygon_id, "rings")
    placed = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(
        F.col(point_id).alias("_point"), "lon", "lat",
        F.floor(F.col("lon") / cell_deg).cast("long").alias("_cx"),
        F.floor(F.col("lat") / cell_deg).cast("long").alias("_cy"),
    )
    ax, ay = (F.col("_cx") + ANCHOR_X) * cell_deg, (F.col("_cy") + ANCHOR_Y) * cell_deg
    x1, y1, x2, y2, lon, lat = (F.col(c) for c in ("x1", "y1", "x2", "y2", "lon", "lat"))

    def between(value: Column, a: Column, b: Column) -> Column:
        return F.coalesce((value > F.least(a, b)) & (value <= F.greatest(a, b)), F.lit(False))

    # From the anchor up or down its meridian to the point's latitude, then along that to the point.
    up = ((x1 > ax) != (x2 > ax)) & between(y1 + (y2 - y1) * (ax - x1) / F.nullif(x2 - x1, F.lit(0.0)), ay, lat)
    along = ((y1 > lat) != (y2 > lat)) & between((x2 - x1) * (lat - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1, ax, lon)
    met = _meet(placed, edge_cells(polygons, polygon_id, cell_deg), ["_cx", "_cy"])
    turns = met.select("_point", polygon_id, (up.cast("int") + along.cast("int")).alias("_turns"))
    known = _meet(placed, anchors_inside(polygons, polygon_id, cell_deg), ["_cx", "_cy"]).select("_point", polygon_id, F.lit(1).alias("_turns"))
    sums = turns.unionByName(known).groupBy("_point", polygon_id).agg(F.sum("_turns").alias("_turns"))
    return sums.where(F.col("_turns") % 2 == 1).select(F.col("_point").alias(point_id), polygon_id)


def containing_unit(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell_deg: float = 0.05
) -> DataFrame:
    """First polygon by id for each point; points outside all polygons keep NULL."""
    hits = points_in_polygons(points, polygons, point_id, polygon_id, cell_deg)
    first = hits.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))
    return points.select(point_id).join(first, point_id, "left")


def edge_distances(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, radius_km: float
) -> DataFrame:
    """Distance to each polygon in reach, zero inside: local planar kilometres around the point."""
    step = math.degrees(radius_km / geo.EARTH_KM)
    per_deg = math.pi * geo.EARTH_KM / 180
    edges = polygons.select(polygon_id, F.explode(geo.polygon_edges(F.col("rings"))).alias("e")).select(
        polygon_id, F.col("e.x1").alias("x1"), F.col("e.y1").alias("y1"),
        F.col("e.x2").alias("x2"), F.col("e.y2").alias("y2"),
    )
    top = F.least(F.lit(89.0), F.greatest(F.abs(F.col("y1")), F.abs(F.col("y2"))) + step)
    grow = F.lit(step) / F.cos(F.radians(top))
    size = 4 * step
    cells = edges.withColumn(
        "_cx", F.explode(_cells(F.least("x1", "x2") - grow, F.greatest("x1", "x2") + grow, size))
    ).withColumn("_cy", F.explode(_cells(F.least("y1", "y2") - step, F.greatest("y1", "y2") + step, size)))
    placed = points.select(
        point_id, "lon", "lat",
        F.floor(F.col("lon") / size).cast("long").alias("_cx"),
        F.floor(F.col("lat") / size).cast("long").alias("_cy"),
        (F.lit(per_deg) * F.cos(F.radians(F.col("lat")))).alias("_k"),
    )
    k = F.col("_k")
    zero = F.lit(0.0)
    d = geo.segment_distance(
        zero, zero,
        (F.col("x1") - F.col("lon")) * k, (F.col("y1") - F.col("lat")) * per_deg,
        (F.col("x2") - F.col("lon")) * k, (F.col("y2") - F.col("lat")) * per_deg,
    )
    # An edge is no nearer than its box; the distance itself is compared once, after the least is taken.
    reach = radius_km * (1 + 1e-9) + 1e-9
    gap = lambda a, b, at: F.greatest(F.least(a, b) - F.col(at), F.col(at) - F.greatest(a, b))
    close = (gap("x1", "x2", "lon") * k <= reach) & (gap("y1", "y2", "lat") * per_deg <= reach)
    near = _meet(placed, cells, ["_cx", "_cy"]).where(close).select(point_id, polygon_id, d.alias("distance_km"))
    inner = points_in_polygons(points, polygons, point_id, polygon_id).withColumn("distance_km", F.lit(0.0))
    least = near.unionByName(inner).groupBy(point_id, polygon_id).agg(F.min("distance_km").alias("distance_km"))
    return least.where(F.col("distance_km") <= radius_km)


def points_near_polygons(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, radius_km: float
) -> DataFrame:
    """Points inside any polygon or within ``radius_km`` of its edge."""
    keep = edge_distances(points, polygons, point_id, polygon_id, radius_km).select(point_id).distinct()
    return points.join(broadcast_if_small(keep), point_id, "left_semi")


def _edges(polygons: DataFrame, key: str, suffix: str) -> DataFrame:
    e = polygons.select(key, F.explode(geo.polygon_edges(F.col("rings"))).alias("e"))
    return e.select(F.col(key), *[F.col(f"e.{c}").alias(c + suffix) for c in ("x1", "y1", "x2", "y2")])


def crossing_polygons(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell_deg: float = 0.05) -> DataFrame:
    """Pairs of polygons with properly crossing edges; edges meet by grid cell."""

    def place(polygons: DataFrame, key: str, s: str) -> DataFrame:
        e = _edges(polygons, key, s)
        x, y = (F.col("x1" + s), F.col("x2" + s)), (F.col("y1" + s), F.col("y2" + s))
        return e.withColumn("_cx", F.explode(_cells(F.least(*x), F.greatest(*x), cell_deg))).withColumn(
            "_cy", F.explode(_cells(F.least(*y), F.greatest(*y), cell_deg))
        )

    def side(px: str, py: str, s: str) -> Column:
        c = F.col
        return F.signum((c("x2" + s) - c("x1" + s)) * (c(py) - c("y1" + s)) - (c("y2" + s) - c("y1" + s)) * (c(px) - c("x1" + s)))

    a, b = place(left, left_id, "a"), place(right, right_id, "b")
    crossed = (side("x1b", "y1b", "a") * side("x2b", "y2b", "a") < 0) & (side("x1a", "y1a", "b") * side("x2a", "y2a", "b") < 0)
    return _meet(a, b, ["_cx", "_cy"]).where(crossed).select(left_id, right_id).distinct()


def polygon_distances(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_km: float, cell_deg: float = 0.05
) -> DataFrame:
    """Shortest distance of polygon pairs within ``radius_km``, zero where they overlap."""

    def corners(polygons: DataFrame, key: str) -> DataFrame:
        p = polygons.select(key, F.explode(F.flatten("rings")).alias("p"))
        return p.select(key, F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).withColumn(
            "_corner", F.struct(F.col(key), F.col("lon"), F.col("lat"))
        )

    def one_way(points: DataFrame, key: str, polygons: DataFrame, other: str) -> DataFrame:
        d = edge_distances(points.drop(key), polygons, "_corner", other, radius_km)
        return d.select(F.col("_corner")[key].alias(key), other, "distance_km")

    forth = one_way(corners(left, left_id), left_id, right, right_id)
    back = one_way(corners(right, right_id), right_id, left, left_id).select(left_id, right_id, "distance_km")
    crossed = crossing_polygons(left, right, left_id, right_id, cell_deg).withColumn("distance_km", F.lit(0.0))
    return forth.unionByName(back).unionByName(crossed).groupBy(left_id, right_id).agg(F.min("distance_km").alias("distance_km"))


def zones_within(zones: DataFrame, areas: DataFrame, zone_id: str, area_id: str, cell_deg: float = 0.05) -> DataFrame:
    """Zones whose representative point lies in any of the areas."""
    pts = zones.withColumn("_p", geo.representative_point(F.col("rings"))).select(
        zone_id, F.col("_p.lon").alias("lon"), F.col("_p.lat").alias("lat")
    )
    keep = points_in_polygons(pts, areas, zone_id, area_id, cell_deg).select(zone_id).distinct()
    return zones.join(keep, zone_id, "left_semi")


def metro_layers(layers: dict[str, DataFrame], code: str, codes: list[str], columns: list[str]) -> DataFrame:
    """Rows of listed codes from several layers under the same columns, tagged by layer."""
    parts = [df.where(F.col(code).isin(list(codes))).select(*columns).withColumn("layer", F.lit(name)) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dissolve(features: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Give all features of a key the same attributes; those that disagree become NULL.

    Rings stay one row per feature: membership and distance tests need no merged ring, and a key with
    very many features is never gathered.
    """
    same = [F.when(F.min(c) == F.max(c), F.max(c)).alias(c) for c in attributes]
    agreed = features.groupBy(key).agg(*same)
    return features.drop(*attributes).join(broadcast_if_small(agreed), key)


def box_summary(points: DataFrame) -> DataFrame:
    """Bounding-box midpoint and the UTM zone code it falls in."""
    mid = points.agg(
        ((F.min("lon") + F.max("lon")) / 2).alias("lon0"), ((F.min("lat") + F.max("lat")) / 2).alias("lat0")
    )
    return mid.withColumn("utm_epsg", geo.utm_epsg(F.col("lon0"), F.col("lat0")))
