"""Nearest-place join (J7): for each point the closest place on the sphere, exact.

Both sides become unit vectors; the chord between two unit vectors grows with the great
circle distance, so the nearest by chord is the nearest on the sphere. Two structures:

**Grid.** 3-D space is cut into cubes of side ``h``; every place is copied into the 27 cubes
around its own, and each point joins on its own cube: one plain equi-join, which Spark can
shuffle, broadcast (AQE, by measured size) or split when a cube is hot. A point whose best
candidate lies within chord ``h`` is resolved: any place closer than that is in one of the
27 cubes. Points near places, usually almost all, end here.

**Pyramid.** Cells of ``LEVELS`` levels, each a fourth of the side of the level above, with the
number of places in them, the box around those places and one of them as a representative; one
aggregate over the places builds all levels. A point the grid left open goes down from the root: its
cells are joined with their occupied children; the nearest representative so far bounds its
distance from above, and only children whose box lies within that bound go on. Places are
compared at the finest level only. Every level is one equi-join, so points far from all places
and places crowded in one spot cost ``LEVELS`` joins, not a search that doubles its radius.

Cells a point keeps at a level all meet the shell between its nearest distance and that plus a cell's
diagonal: at most ``CHILDREN`` times the cells of the level above, and, as cells shrink, those along
a line of equal distance through the places. Places at one spot count once.

Ties break on the smaller place id. Points without coordinates (NULL or NaN) get no place (quirk
X11 fixed). The choice is the least chord² by point, then the smallest id at it: two aggregates of
single values, hashed and combined map-side, so only one row per point and task is shuffled or held.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fixed

PLACES_PER_CELL = 8.0          # target density of the first level
MAX_PLACES_PER_CELL = 512      # crowding bound of the first level (clustered places)
MIN_CELL = 1e-4                # about 0.6 km
FACTOR, LEVELS = 4, 7          # pyramid: cells of the last level are about 0.8 km wide
CHILDREN = FACTOR ** 3
BROADCAST_LEVELS = 3           # the unit sphere meets fewer than 6 * 64 ** 2 of the 64 ** 3 cells of the third level


def unit_vector(lat: str | Column, lon: str | Column, prefix: str) -> list[Column]:
    la = F.radians(F.col(lat) if isinstance(lat, str) else lat)
    lo = F.radians(F.col(lon) if isinstance(lon, str) else lon)
    return [(F.cos(la) * F.cos(lo)).alias(f"{prefix}x"),
            (F.cos(la) * F.sin(lo)).alias(f"{prefix}y"),
            F.sin(la).alias(f"{prefix}z")]


def _cell(c: Column, h: float) -> Column:
    return F.floor((c + F.lit(1.0)) / F.lit(h)).cast("bigint")


def first_cell_size(n_places: int) -> float:
    """Cube side for which a cube near the sphere holds about ``PLACES_PER_CELL`` places."""
    if n_places <= 0:
        return 2.0
    return min(2.0, max(MIN_CELL, math.sqrt(4.0 * math.pi * PLACES_PER_CELL / n_places)))


def _axis(c: Column, level: int) -> Column:
    """Number of the cell along one axis at a pyramid level; ``FACTOR ** level`` cells span [-1, 1]."""
    n = FACTOR ** level
    return F.least(F.floor((c + F.lit(1.0)) * F.lit(n / 2.0)), F.lit(n - 1)).cast("bigint")


def pyramid(places: DataFrame) -> DataFrame:
    """(level, cx, cy, cz, n, box, representative): the occupied cells of every level, by one aggregate."""
    cells = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[_axis(F.col(f"p{a}"), level).alias(f"c{a}") for a in "xyz"])
                                for level in range(1, LEVELS + 1)]))
    return (places.select("place_id", "px", "py", "pz", cells.alias("c")).groupBy("c").agg(
        F.count("*").alias("n"), *[f(f"p{a}").alias(f"{name}{a}") for a in "xyz" for name, f in (("lo", F.min), ("hi", F.max))],
        F.min(F.struct("place_id", "px", "py", "pz")).alias("rep")).select("c.*", "n", "lox", "loy", "loz", "hix", "hiy", "hiz", "rep"))


def grid_side(cells: DataFrame, n_places: int) -> float:
    """The cube side of the grid: even density, or finer while one cell of about that size holds more than
    ``MAX_PLACES_PER_CELL`` places. Any side is exact; this only bounds the work."""
    h = first_cell_size(n_places)
    if n_places <= MAX_PLACES_PER_CELL:          # no cube can hold more than all of them
        return h
    crowds = {r.level: r.most for r in cells.groupBy("level").agg(F.max("n").alias("most")).collect()}   # LEVELS rows
    for level in range(1, LEVELS + 1):
        side = 2.0 / FACTOR ** level
        if side < h and crowds[level - 1 if level > 1 else 1] > MAX_PLACES_PER_CELL:
            h = max(MIN_CELL, side)
    return h


def _squared(kind: str) -> Column:
    """Squared chord from a point to a cell's representative, or the least one to its box. Rounding is monotone, so the
    latter is never above the squared chord to a place in the box as computed here."""
    def axis(a: str) -> Column:
        q = F.col(f"q{a}")
        if kind == "rep":
            return (q - F.col(f"rep.p{a}")) ** 2
        return F.greatest(F.lit(0.0), F.col(f"lo{a}") - q, q - F.col(f"hi{a}")) ** 2
    return axis("x") + axis("y") + axis("z")


def descend(points: DataFrame, places: DataFrame, cells: DataFrame) -> DataFrame:
    """(pid, place_id, d2) of points (pid, qx, qy, qz) by the pyramid."""
    point, up = ["pid", "qx", "qy", "qz"], ["ux", "uy", "uz"]
    now = points.select(*point, F.lit(5.0).alias("bound"), *[F.lit(0).cast("bigint").alias(u) for u in up])
    for level in range(1, LEVELS + 1):
        children = cells.where(F.col("level") == level).select(
            *[F.floor(F.col(f"c{a}") / FACTOR).cast("bigint").alias(f"u{a}") for a in "xyz"], "cx", "cy", "cz",
            "lox", "loy", "loz", "hix", "hiy", "hiz", "rep")
        if level <= BROADCAST_LEVELS:
            children = F.broadcast(children)
        # the bound first, combined map-side; only the children within it become rows of a shuffle or a file
        reached = now.join(children, up).select("pid", F.least("bound", _squared("rep")).alias("reached"))
        bounds = reached.groupBy("pid").agg(F.min("reached").alias("bound"))
        kept = now.drop("bound").join(bounds, "pid").join(children, up).where(_squared("box") <= F.col("bound"))
        # written to the checkpoint dir: each level plans over its own input only, and survives lost executors
        now = fixed(kept.select(*point, "bound", *[F.col(f"c{a}").alias(f"u{a}") for a in "xyz"]))
    last = places.select("place_id", "px", "py", "pz", *[_axis(F.col(f"p{a}"), LEVELS).alias(f"u{a}") for a in "xyz"])
    return _best(now, last, up)


def _best(points: DataFrame, places: DataFrame, on: list[str], within: float | None = None) -> DataFrame:
    """(pid, place_id, d2): the nearest of the places that share a point's cell, ``within`` that squared chord.

    The least distance comes first, then the smallest id at that distance: both are aggregates of single values, which
    Spark hashes. One minimum of (distance, id) pairs would make it sort every candidate of a task before it combines them."""
    d2 = ((F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2 + (F.col("qz") - F.col("pz")) ** 2)
    least = points.join(places, on).select("pid", d2.alias("d2"))
    if within is not None:
        least = least.where(F.col("d2") <= F.lit(within))
    least = least.groupBy("pid").agg(F.min("d2").alias("d2"))
    at = points.join(least, "pid").join(places, on).where(d2 == F.col("d2"))
    return at.groupBy("pid", "d2").agg(F.min("place_id").alias("place_id")).select("pid", "place_id", "d2")


def _offsets() -> Column:
    r = [-1, 0, 1]
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"))
                     for a in r for b in r for c in r])


def _level(points: DataFrame, places: DataFrame, h: float) -> DataFrame:
    """Points resolved at cube side ``h``: (pid, place_id, d2)."""
    # by point: a small file of many points is one scan task, and the aggregates need no further shuffle after a broadcast
    pts = points.repartition("pid").select("pid", "qx", "qy", "qz",
                                           _cell(F.col("qx"), h).alias("cx"), _cell(F.col("qy"), h).alias("cy"),
                                           _cell(F.col("qz"), h).alias("cz"))
    # written: 27 rows a place are broadcast by their own size, not by that of the places
    spread = fixed(places.select("place_id", "px", "py", "pz", F.explode(_offsets()).alias("o"))
                   .select("place_id", "px", "py", "pz",
                           (_cell(F.col("px"), h) + F.col("o.dx")).alias("cx"),
                           (_cell(F.col("py"), h) + F.col("o.dy")).alias("cy"),
                           (_cell(F.col("pz"), h) + F.col("o.dz")).alias("cz")))
    return _best(pts, spread, ["cx", "cy", "cz"], h * h)


def with_nearest(points: DataFrame, places: DataFrame, place_id: str, take: dict[str, str],
                 point_lat: str = "lat", point_lon: str = "lon", place_lat: str = "lat", place_lon: str = "lon",
                 chord: str | None = None, cell: float | None = None) -> DataFrame:
    """Every row of ``points``, whatever its other columns hold, with columns of its nearest place: ``take`` maps columns of
    ``places`` to their new names; they are NULL for a point without coordinates or when there are no places.
    ``chord`` names a column for the chord to it. Place ids that repeat count once (the smallest row)."""
    def located(lat: str, lon: str) -> Column:
        return (F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double"))
                & ~F.isnan(F.col(lon).cast("double")))

    pl = (places.where(located(place_lat, place_lon))
          .select(F.col(place_id).alias("place_id"), *unit_vector(place_lat, place_lon, "p")))
    # places at one spot: the smallest id stands for all (it would win their ties)
    pl = fixed(pl.groupBy("px", "py", "pz").agg(F.min("place_id").alias("place_id")))
    # a row number of our own (fixed by the write): point ids may be NULL or repeat
    own = [f"_c{i}" for i in range(len(points.columns))]
    rows = fixed(points.toDF(*own).withColumn("_row", F.monotonically_increasing_id()))
    lat, lon = (own[points.columns.index(c)] for c in (point_lat, point_lon))
    pts = rows.where(located(lat, lon)).select(F.col("_row").alias("pid"), *unit_vector(lat, lon, "q"))
    fields = [F.col(place_id).alias("_place"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(take)]]
    named = places.select(F.struct(*fields).alias("_p")).groupBy(F.col("_p._place").alias("_place")).agg(F.min("_p").alias("_p"))
    n_places = pl.count()
    if n_places == 0:
        found = rows.withColumn("_p", F.lit(None).cast(named.schema["_p"].dataType)).withColumn("_d", F.lit(None).cast("double"))
    else:
        cells = fixed(pyramid(pl))
        h = cell if cell is not None else grid_side(cells, n_places)
        near = fixed(_level(pts, pl, h))
        open_points = fixed(pts.join(near.select("pid"), "pid", "left_anti"))
        if not open_points.isEmpty():
            near = near.unionByName(descend(open_points, pl, cells))
        near = near.select(F.col("pid").alias("_row"), F.col("place_id").alias("_place"), F.sqrt("d2").alias("_d"))
        # one row for each input row; those without coordinates find nothing
        found = rows.join(near, "_row", "left").join(named, "_place", "left")
    out = [F.col(o).alias(c) for o, c in zip(own, points.columns)]
    out += [F.col(f"_p._t{i}").alias(name) for i, name in enumerate(take.values())]
    return found.select(*out, *([F.col("_d").alias(chord)] if chord else []))


def nearest_place(points: DataFrame, places: DataFrame, point_id: str, place_id: str,
                  point_lat: str = "lat", point_lon: str = "lon",
                  place_lat: str = "lat", place_lon: str = "lon",
                  cell: float | None = None) -> DataFrame:
    """``(point_id, place_id, chord)`` for every point; ``place_id``/``chord`` are NULL
    for a point without coordinates or when there are no places."""
    narrow = points.select(F.col(point_id).alias("id"), F.col(point_lat).alias("lat"), F.col(point_lon).alias("lon"))
    out = with_nearest(narrow, places, place_id, {place_id: "place"}, "lat", "lon", place_lat, place_lon, "chord", cell)
    return out.select(F.col("id").alias(point_id), F.col("place").alias(place_id), "chord")
