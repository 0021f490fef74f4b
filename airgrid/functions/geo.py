"""Distances, planar coordinates and polygon measures as column expressions.

A ring is ``array<struct<lon double, lat double>>``; it may be open or closed. A polygon is an array
of rings under the even-odd rule, so holes need no special mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radii in kilometres.
EARTH_KM = 6378.137
S2_EARTH_KM = 6371.01
# Equatorial radius in kilometres and flattening of the WGS84 ellipsoid.
ELLIPSOID_KM, FLATTENING = 6378.137, 1 / 298.257223563
# Steps of the longitude iteration; each gains over two digits for points not nearly opposite each other.
GEODESIC_STEPS = 8


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def aeqd_xy(lon: Column, lat: Column, lon0: Column, lat0: Column, radius: float = EARTH_KM) -> tuple[Column, Column]:
    """Azimuthal-equidistant plane coordinates in kilometres around (lon0, lat0), on the sphere."""
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cosc = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosc)))
    k = F.when(F.sin(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c))
    x = F.lit(radius) * k * F.cos(p) * F.sin(dl)
    y = F.lit(radius) * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))
    return x, y


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = ELLIPSOID_KM, flattening: float = FLATTENING) -> Column:
    """struct(distance_km, azimuth) of the shortest path on the ellipsoid, azimuth in radians from north at the first point.

    The longitude on the auxiliary sphere is found by iteration, the length by Vincenty's series: half a millimetre over
    any distance, but not for nearly opposite points, where the iteration does not settle. One point gives zeros.
    """
    f, b = flattening, radius * (1 - flattening)
    one, zero = F.lit(1.0), F.lit(0.0)

    def reduced(lat: Column) -> Column:
        return F.atan(F.lit(1 - f) * F.tan(F.radians(lat)))

    start = F.struct(
        F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"),
        F.radians(lon2 - lon1).alias("gap"),
    )

    def angles(p: Column, lam: Column) -> Column:
        """Quantities of the great circle for a longitude difference."""
        x, y = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        sin_cos = F.struct(F.sqrt(x * x + y * y).alias("ss"), (p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)).alias("cs"), lam.alias("lam"), F.atan2(x, y).alias("azimuth"))

        def rest(a: Column) -> Column:
            sin_alpha = F.when(a["ss"] == 0, zero).otherwise(p["c1"] * p["c2"] * F.sin(a["lam"]) / a["ss"])
            return _bound(sin_alpha, lambda q: F.struct(
                a["ss"].alias("ss"), a["cs"].alias("cs"), F.atan2(a["ss"], a["cs"]).alias("sigma"), q.alias("sa"), (one - q * q).alias("ca2"),
                F.when(one - q * q < 1e-15, zero).otherwise(a["cs"] - 2 * p["s1"] * p["s2"] / (one - q * q)).alias("c2m"), a["azimuth"].alias("azimuth")))

        return _bound(sin_cos, rest)

    def step(p: Column, lam: Column) -> Column:
        def more(g: Column) -> Column:
            return _bound(F.lit(f / 16) * g["ca2"] * (4 + f * (4 - 3 * g["ca2"])), lambda c: p["gap"] + (one - c) * f * g["sa"] * (
                g["sigma"] + c * g["ss"] * (g["c2m"] + c * g["cs"] * (2 * g["c2m"] * g["c2m"] - 1))))

        return _bound(angles(p, lam), more)

    def length(g: Column) -> Column:
        u = g["ca2"] * ((radius * radius - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m, n = g["c2m"], small
        turn = n * g["ss"] * (m + n / 4 * (g["cs"] * (2 * m * m - 1) - n / 6 * m * (4 * g["ss"] * g["ss"] - 3) * (4 * m * m - 3)))
        return F.struct((F.lit(b) * big * (g["sigma"] - turn)).alias("distance_km"), g["azimuth"].alias("azimuth"))

    def whole(p: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_STEPS)), p["gap"], lambda x, _: step(p, x))
        return _bound(angles(p, lam), length)

    return _bound(start, whole)


def aeqd_xy_ellipsoid(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Azimuthal-equidistant plane coordinates in kilometres around (lon0, lat0), on the ellipsoid."""
    g = geodesic(lon0, lat0, lon, lat)
    return _bound(g, lambda p: p["distance_km"] * F.sin(p["azimuth"])), _bound(g, lambda p: p["distance_km"] * F.cos(p["azimuth"]))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone holding a point."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)


def ring_edges(ring: Column) -> Column:
    """Array of edges (x1, y1, x2, y2), the last one closing the ring."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")
        ),
    )


def polygon_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def inside(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against the rings."""
    crossed = F.filter(
        polygon_edges(rings),
        lambda e: ((e["y1"] > lat) != (e["y2"] > lat))
        & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]),
    )
    return F.size(crossed) % 2 == 1


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _sum_edges(rings: Column, term) -> Column:
    return F.aggregate(F.transform(polygon_edges(rings), term), F.lit(0.0), lambda s, v: s + v)


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def shoelace_area(rings: Column) -> Column:
    """Area in squared coordinate units; rings of opposite direction subtract."""
    return F.abs(_sum_edges(rings, _cross)) / 2


def centroid(rings: Column) -> Column:
    """Area-weighted centroid as struct(lon, lat)."""
    area6 = F.nullif(_sum_edges(rings, _cross), F.lit(0.0)) * 3
    cx = _sum_edges(rings, lambda e: (e["x1"] + e["x2"]) * _cross(e)) / area6
    cy = _sum_edges(rings, lambda e: (e["y1"] + e["y2"]) * _cross(e)) / area6
    return F.struct(cx.alias("lon"), cy.alias("lat"))


def scanline_point(rings: Column) -> Column:
    """A point inside: middle of the widest inner interval on the horizontal mid-line."""
    edges = polygon_edges(rings)
    ys = F.concat(F.transform(edges, lambda e: e["y1"]), F.transform(edges, lambda e: e["y2"]))
    mid = (F.array_min(ys) + F.array_max(ys)) / 2
    hits = F.filter(edges, lambda e: (e["y1"] > mid) != (e["y2"] > mid))
    xs = F.array_sort(
        F.transform(hits, lambda e: e["x1"] + (mid - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
    )
    spans = F.transform(
        F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % 2 == 0),
        lambda s: F.struct(
            (F.get(xs, s["i"] + 1) - s["x"]).alias("width"), ((F.get(xs, s["i"] + 1) + s["x"]) / 2).alias("lon")
        ),
    )
    return F.struct(F.array_max(spans)["lon"].alias("lon"), mid.alias("lat"))


def representative_point(rings: Column) -> Column:
    """Centroid when it lies inside, else an inner point of the mid-line."""
    c = centroid(rings)
    return F.when(inside(rings, c["lon"], c["lat"]), c).otherwise(scanline_point(rings))
