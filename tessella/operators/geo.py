"""Outlines for maps: rings thinned, projected and written as SVG paths, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.columns import map_position

#: Rings of less area (square degrees) are dropped; of longer rings every second vertex stays.
LEAST_AREA, LONG_RING = 0.05, 100


def ring_area(ring: Column) -> Column:
    """Area of a ring of (lon, lat) by the shoelace formula."""

    def area(r: Column) -> Column:
        terms = F.transform(r, lambda p, i: p["lon"] * F.element_at(r, (i + 1) % F.size(r) + 1)["lat"] - F.element_at(r, (i + 1) % F.size(r) + 1)["lon"] * p["lat"])
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2

    return F.transform(F.array(ring), area)[0]


def svg_path(ring: Column) -> Column:
    """``M x,y x,y ... Z`` of a ring; null for a small one or one of fewer than three different pixels."""

    def drawn(r: Column) -> Column:
        kept = F.when(F.size(r) > LONG_RING, F.filter(r, lambda p, i: (i % 2 == 0) | (i == F.size(r) - 1))).otherwise(r)

        def pixel(p: Column) -> Column:
            x, y = map_position(p["lon"], p["lat"])
            return F.concat_ws(",", x.cast("string"), y.cast("string"))

        points = F.transform(kept, pixel)
        different = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))
        return F.when((ring_area(r) >= LEAST_AREA) & (F.size(different) >= 3), F.concat(F.lit("M"), F.array_join(different, " "), F.lit("Z")))

    return F.transform(F.array(ring), drawn)[0]
