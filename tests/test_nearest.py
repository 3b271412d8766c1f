"""Grid nearest join against a brute force over a small fixture (test-only, in NumPy)."""

import numpy as np
import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from latecomer.operators.nearest import nearest_place

PTS = StructType([StructField("id", LongType()), StructField("lat", DoubleType()), StructField("lon", DoubleType())])
PLS = StructType([StructField("pid", LongType()), StructField("name", StringType()),
                  StructField("lat", DoubleType()), StructField("lon", DoubleType())])


def brute(points, places):
    out = {}
    P = np.radians(np.array([(p[2], p[3]) for p in places], dtype=float))
    pv = np.stack([np.cos(P[:, 0]) * np.cos(P[:, 1]), np.cos(P[:, 0]) * np.sin(P[:, 1]), np.sin(P[:, 0])], 1)
    ids = np.array([p[0] for p in places])
    for i, la, lo in points:
        if la is None or lo is None:
            out[i] = None
            continue
        q = np.radians([la, lo])
        qv = np.array([np.cos(q[0]) * np.cos(q[1]), np.cos(q[0]) * np.sin(q[1]), np.sin(q[0])])
        d2 = ((pv - qv) ** 2).sum(1)
        best = d2.min()
        out[i] = int(ids[np.isclose(d2, best, rtol=0, atol=1e-15)].min())
    return out


def fixture(seed=7, n_pts=400, n_pls=60):
    rng = np.random.default_rng(seed)
    pls = [(int(i), f"p{i}", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(n_pls)]
    pls += [(1000, "twin-b", 10.0, 20.0), (999, "twin-a", 10.0, 20.0)]          # exact tie: smaller id wins
    pls += [(2000, "north", 89.9, 0.0), (2001, "dateline", 0.0, 179.95)]
    pts = [(int(i), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(n_pts)]
    pts += [(5000, 90.0, 0.0), (5001, -90.0, 45.0), (5002, 0.0, -179.99), (5003, 10.0, 20.0),
            (5004, None, 3.0), (5005, 4.0, None)]
    return pts, pls


@pytest.mark.parametrize("cell", [None, 0.01, 0.3])
def test_grid_equals_brute_force(spark, cell):
    pts, pls = fixture()
    got = nearest_place(spark.createDataFrame(pts, PTS), spark.createDataFrame(pls, PLS), "id", "pid", cell=cell)
    got = {r.id: r.pid for r in got.collect()}
    assert got == brute(pts, pls)
    assert got[5003] == 999 and got[5002] == 2001 and got[5004] is None


def test_no_places_gives_null(spark):
    pts, _ = fixture(n_pts=5)
    got = nearest_place(spark.createDataFrame(pts, PTS), spark.createDataFrame([], PLS), "id", "pid").collect()
    assert len(got) == len(pts) and all(r.pid is None for r in got)


def test_enrich_cases(spark):
    """Los Angeles, Tokyo and a town in Vanuatu, among distractors."""
    pls = [(1, "Los Angeles", 34.05, -118.24), (2, "Tokyo", 35.69, 139.69), (3, "Luganville", -15.51, 167.18),
           (4, "Honolulu", 21.31, -157.86), (5, "Sydney", -33.87, 151.21)]
    cc = {1: "US", 2: "JP", 3: "VU", 4: "US", 5: "AU"}
    pts = [(10, 34.05, -118.25), (11, 35.68, 139.69), (12, -13.09, 167.29)]
    got = nearest_place(spark.createDataFrame(pts, PTS), spark.createDataFrame(pls, PLS), "id", "pid").collect()
    assert {r.id: cc[r.pid] for r in got} == {10: "US", 11: "JP", 12: "VU"}


def test_clustered_places_start_finer_and_stay_exact(spark):
    from latecomer.operators.nearest import MAX_PLACES_PER_CELL, first_cell_size, grid_side, pyramid, unit_vector
    rng = np.random.default_rng(3)
    n = 3 * MAX_PLACES_PER_CELL
    pls = [(i, f"c{i}", float(48.85 + rng.uniform(-0.05, 0.05)), float(2.35 + rng.uniform(-0.05, 0.05)))
           for i in range(n)]
    pls += [(n + 1, "far", -30.0, 100.0)]
    places = spark.createDataFrame(pls, PLS)
    pl = places.selectExpr("pid AS place_id", "lat", "lon").select("place_id", *unit_vector("lat", "lon", "p"))
    assert grid_side(pyramid(pl), len(pls)) < first_cell_size(len(pls))
    pts = [(0, 48.851, 2.351), (1, -29.0, 101.0), (2, 48.0, 2.0)]
    got = {r.id: r.pid for r in nearest_place(spark.createDataFrame(pts, PTS), places, "id", "pid").collect()}
    assert got == brute(pts, pls)


def crowd(n=1500):
    """Places in one spot of a few hundred metres, and points near them, far away and around the antipode."""
    rng = np.random.default_rng(3)
    pls = [(int(i), f"c{i}", 48.0 + float(rng.normal(0, 1e-3)), 11.0 + float(rng.normal(0, 1e-3))) for i in range(n)]
    pls += [(n + i, "same", 48.001, 11.001) for i in range(300)] + [(9000, "lone", -10.0, 100.0)]
    pts = [(int(i), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(60)]
    pts += [(100 + i, 48.0 + float(rng.normal(0, 2e-3)), 11.0 + float(rng.normal(0, 2e-3))) for i in range(60)]
    pts += [(200 + i, -48.0 + float(rng.normal(0, 1e-2)), -169.0 + float(rng.normal(0, 1e-2))) for i in range(20)]
    return pts, pls


@pytest.mark.parametrize("cell", [None, 1e-3])
def test_crowded_places_and_far_points(spark, cell):
    pts, pls = crowd()
    got = nearest_place(spark.createDataFrame(pts, PTS), spark.createDataFrame(pls, PLS), "id", "pid", cell=cell)
    assert {r.id: r.pid for r in got.collect()} == brute(pts, pls)


def test_pyramid_alone_and_its_cells(spark):
    """Every point through the pyramid; the cells kept a level stay far below the places."""
    from pyspark.sql import functions as F

    from latecomer.operators import nearest
    pts, pls = crowd()
    q = spark.createDataFrame(pts, PTS).select(F.col("id").alias("pid"), *nearest.unit_vector("lat", "lon", "q"))
    p = spark.createDataFrame(pls, PLS).select(F.col("pid").alias("place_id"), *nearest.unit_vector("lat", "lon", "p"))
    p = p.groupBy("px", "py", "pz").agg(F.min("place_id").alias("place_id"))
    cells = nearest.pyramid(p)
    found = {r.pid: r.place_id for r in nearest.descend(q, p, cells).collect()}
    assert found == brute(pts, pls)
    sizes = {r.level: r["count"] for r in cells.groupBy("level").count().collect()}
    assert set(sizes) == set(range(1, nearest.LEVELS + 1)) and sizes[1] == 2


def test_rows_with_null_and_repeated_ids(spark):
    from latecomer.operators.nearest import with_nearest
    rows = spark.createDataFrame([(None, 34.0, -118.0, "a"), (None, 35.6, 139.6, "b"), (7, 34.1, -118.1, "c"), (7, 34.1, -118.1, "c"),
                                  (8, None, 1.0, "d")], "id bigint, lat double, lon double, _row string")
    places = spark.createDataFrame([(1, "LA", 34.05, -118.24), (2, "Tokyo", 35.69, 139.69)], PLS)
    got = with_nearest(rows, places, "pid", {"name": "city"}).collect()
    assert sorted(map(str, ((r.id, r._row, r.city) for r in got))) == sorted(map(str, [
        (None, "a", "LA"), (None, "b", "Tokyo"), (7, "c", "LA"), (7, "c", "LA"), (8, "d", None)]))


def test_candidates_are_hashed_and_only_kept_cells_are_shuffled(spark, monkeypatch):
    """No step sorts the candidates of a point, and no level of the pyramid shuffles the cells it drops."""
    from pyspark.sql import functions as F

    from latecomer.operators import nearest
    pts, pls = crowd()
    plans, write = [], nearest.fixed

    def fixed(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)
    monkeypatch.setattr(nearest, "fixed", fixed)
    q = spark.createDataFrame(pts, PTS).where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("id").alias("pid"), *nearest.unit_vector("lat", "lon", "q"))
    p = spark.createDataFrame(pls, PLS).select(F.col("pid").alias("place_id"), *nearest.unit_vector("lat", "lon", "p"))
    cells = nearest.pyramid(p)
    for found in (nearest._level(q, p, 0.1), nearest.descend(q, p, cells)):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == nearest.LEVELS + 3
    assert not any("Window" in plan for plan in plans)
    assert not any("min(struct(d2" in plan for plan in plans) and sum("min(d2" in plan for plan in plans) == 2
