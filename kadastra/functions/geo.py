"""Places as columns: planar hexagons, distances, boxes, polygons. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid's origin and metres per degree there.
LAT0, LON0 = 51.128, 71.430
M_LAT = 110_574.0
M_LON = 111_320.0 * math.cos(math.radians(LAT0))
EDGE_M = 100.0
SIX = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def pseudo_place(key: Column) -> tuple[Column, Column]:
    """A fixed place for a key, within some kilometres of the origin."""
    return F.lit(51.128) + ((key * 37) % 1000 - 500) / F.lit(10000.0), F.lit(71.43) + ((key * 91) % 1000 - 500) / F.lit(10000.0)


def to_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    return (lon - LON0) * M_LON, (lat - LAT0) * M_LAT


def hex_axial(lat: Column, lon: Column, edge_m: float = EDGE_M) -> tuple[Column, Column]:
    """(q, r) of the pointy-top hexagon: each cube coordinate is rounded half to even, and the one that moved most is refitted."""
    x, y = to_xy(lat, lon)
    q = (x * (math.sqrt(3) / 3) - y / 3) / edge_m
    r = (y * (2 / 3)) / edge_m
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    return (
        F.when(fix_q, -rr - rs).otherwise(rq).cast("long"),
        F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("long"),
    )


def hex_id(lat: Column, lon: Column, edge_m: float = EDGE_M) -> Column:
    q, r = hex_axial(lat, lon, edge_m)
    return F.concat_ws(":", q.cast("string"), r.cast("string"))


def ring(q: Column, r: Column) -> Column:
    """The six neighbours, as an array of (q, r)."""
    return F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in SIX])


def hex_centre(q: Column, r: Column, edge_m: float = EDGE_M) -> tuple[Column, Column]:
    x = (q * math.sqrt(3) + r * (math.sqrt(3) / 2)) * edge_m
    y = r * 1.5 * edge_m
    return y / M_LAT + LAT0, x / M_LON + LON0


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * radius_km)


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow((lat1 - lat2) * 111_000.0, 2) + F.pow((lon1 - lon2) * F.cos(F.radians(lat1)) * 111_000.0, 2))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_ring(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a ray cast to the east crosses the ring of (lat, lon) corners an odd number of times."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(corners, corners[1:] + corners[:1], strict=True):
        if a_lat == b_lat:
            continue
        spans = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
        at = (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon
        crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Square cell (i, j), for blocking a radius join: what is within `degrees` lies in one of the 3 x 3 cells around."""
    return F.struct(F.floor(lat / degrees).alias("i"), F.floor(lon / degrees).alias("j"))


def around(lat: Column, lon: Column, degrees: float) -> Column:
    """The 3 x 3 cells around a place."""
    i, j = F.floor(lat / degrees), F.floor(lon / degrees)
    return F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
