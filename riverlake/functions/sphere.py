"""Areas of longitude/latitude polygons on a sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the Earth in metres.
EARTH_RADIUS_M = 6_371_008.8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def ring_area_m2(ring: Column) -> Column:
    """Signed area of one closed ring of [lon, lat] positions (Chamberlain & Duquette 2007).

    R^2/2 times the sum over all points of sin(lat) * (lon of the next - lon of the one
    before). The neighbours come from rotating the array by one in either direction.
    """
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    before = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
    spans = F.zip_with(
        after, before, lambda a, b: F.radians(F.get(a, F.lit(0))) - F.radians(F.get(b, F.lit(0)))
    )
    terms = F.zip_with(ring, spans, lambda p, span: F.sin(F.radians(F.get(p, F.lit(1)))) * span)
    half_square = EARTH_RADIUS_M * EARTH_RADIUS_M / 2.0
    return F.when(n < 3, F.lit(0.0)).otherwise(_total(terms) * F.lit(half_square))


def polygon_area_m2(rings: Column) -> Column:
    """The first ring less all others; the direction a ring runs in does not matter."""
    areas = F.transform(rings, lambda ring: F.abs(ring_area_m2(ring)))
    outer = F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0))
    return outer - _total(F.slice(areas, F.lit(2), F.greatest(F.size(areas), F.lit(1))))


def multipolygon_area_m2(polygons: Column) -> Column:
    return _total(F.transform(polygons, polygon_area_m2))


def positions_ok(polygons: Column) -> Column:
    """Whether every position of every ring has a longitude and a latitude."""

    def bad_position(p: Column) -> Column:
        return F.isnull(p) | F.isnull(F.get(p, F.lit(0))) | F.isnull(F.get(p, F.lit(1)))

    def bad_ring(ring: Column) -> Column:
        return F.isnull(ring) | F.coalesce(F.exists(ring, bad_position), F.lit(True))

    def bad_polygon(rings: Column) -> Column:
        return F.isnull(rings) | F.coalesce(F.exists(rings, bad_ring), F.lit(True))

    return F.coalesce(~F.exists(polygons, bad_polygon), F.lit(False))
