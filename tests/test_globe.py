"""Hexagons of the sphere: published numbers, counts of all cells, nesting, missing coordinates."""

import pytest
from pyspark.sql import functions as F

from terrapix.operators import globe

PUBLISHED = [
    (0.0, 0.0, 0, "8075fffffffffff"),
    (0.0, 0.0, 1, "81757ffffffffff"),
    (0.0, 0.0, 5, "85754e67fffffff"),
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
    (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"),
    (37.769377, -122.388903, 9, "89283082e73ffff"),
    (40.689167, -74.044444, 10, "8a2a1072b59ffff"),
]


@pytest.mark.parametrize(("lat", "lon", "level", "want"), PUBLISHED)
def test_published_cells(spark, lat, lon, level, want):
    df = globe.with_sphere_cell(spark.createDataFrame([(lat, lon)], "lat double, lon double"), level)
    assert df.select(globe.cell_text(F.col("cell"))).first()[0] == want


def test_base_cells_are_distinct_and_agree_with_their_home_faces():
    cells, _, turns = globe.base_tables()
    assert sorted(set(cells)) == list(range(122))
    for n, (f, i, j, k) in enumerate(globe.HOMES):
        assert cells[27 * f + 9 * i + 3 * j + k] == n
    assert set(turns) == set(range(6))


def test_all_cells_of_two_levels_are_met_and_nest(spark):
    """There are 2 + 120 * 7**level cells; six of seven hexagons' areas lie in their parents."""
    points = spark.range(200_000).select(F.degrees(F.asin(2 * F.rand(1) - 1)).alias("lat"), (360 * F.rand(2) - 180).alias("lon"))
    both = globe.with_sphere_cell(globe.with_sphere_cell(points, 1, "c1"), 2, "c2")
    up = globe.parent_cell(F.col("c2"), 1)
    row = both.agg(F.count_distinct("c1").alias("n1"), F.count_distinct("c2").alias("n2"), F.count_distinct(up).alias("p"), F.avg((up == F.col("c1")).cast("int")).alias("same")).first()
    assert (row.n1, row.n2, row.p) == (842, 5882, 842)
    assert row.same > 0.9
    assert both.select(F.min(globe.level_of(F.col("c2"))), F.max(globe.level_of(F.col("c2")))).first() == (2, 2)
    assert both.where(globe.parent_cell(F.col("c1"), 2).isNotNull()).isEmpty()


def test_missing_coordinates_and_clashing_names(spark):
    rows = [(None, 1.0, 7), (float("nan"), 1.0, 7), (1.0, float("inf"), 7), (10.0, 190.0, 7), (10.0, -170.0, 7)]
    got = globe.with_sphere_cell(spark.createDataFrame(rows, "lat double, lon double, cell int"), 6).select("cell").collect()
    assert [r.cell is None for r in got] == [True, True, True, False, False]
    assert got[3] == got[4]
    assert globe.with_sphere_cell(spark.createDataFrame([], "lat double, lon double"), 6).isEmpty()
    with pytest.raises(ValueError, match="level"):
        globe.with_sphere_cell(spark.range(1).selectExpr("1.0 AS lat", "1.0 AS lon"), 16)
