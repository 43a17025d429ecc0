"""Nearest entities against all pairs, where a few places hold most of them."""

import random

import pytest
from pyspark.sql import functions as F

from tablewatch.operators import spatial


def brute(queries, points, radius, but_itself):
    out = {}
    for q, x, y in queries:
        near = [((x - a) * (x - a) + (y - b) * (y - b), i) for i, a, b in points if a is not None and x is not None and not (but_itself and i == q)]
        near = [n for n in near if n[0] <= radius * radius]
        if near:
            out[q] = min(near)[1]
    return out


@pytest.mark.parametrize("but_itself", [True, False])
def test_nearest_in_a_crowd(spark, but_itself):
    rng = random.Random(5)
    points = [(i, 3.0 + rng.gauss(0, 1e-4), 3.0 + rng.gauss(0, 1e-4)) for i in range(400)]  # a crowd in one cell
    points += [(400 + i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(200)] + [(600 + i, 1.0, 1.0) for i in range(30)]  # a place with many
    points += [(640, 0.0, 0.0), (641, 1.0, 0.0), (642, -1.0, -1.0), (643, None, 1.0)]
    queries = [p for p in points if p[0] % 2 == 0 or p[0] > 595] if but_itself else [(i, 2.5 + rng.random(), 2.5 + rng.random()) for i in range(60)] + [(90, 1.0, 1.0), (91, 100.0, 0.0), (92, None, None), (93, 3.5, 3.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, x double, y double")
    found = spatial.nearest_entity(frame(queries, "query_id"), frame(points, "id"), 1.0, but_itself, crowded=8)
    assert {r.query_id: r.id for r in found.collect()} == brute(queries, points, 1.0, but_itself)


def test_a_crowded_cell_is_split(spark):
    points = spark.range(2000).select("id", (F.rand(1) * 0.001).alias("px"), (F.rand(2) * 0.001).alias("py"), F.lit(1).alias("many"))
    levels, placed = spatial._leaves(points.cache(), 1.0, 50)
    assert len(levels) > 10 and placed.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 50
    assert placed.count() == 2000


def test_a_view_of_ones_own_is_a_candidate(spark):
    subjects = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (2, 0.0, 0.0, 0.0, -1.0, 1.0, 1.0, 0.0)], "id int, x double, y double, z double, ex double, ey double, ez double, yaw double")
    views = spark.createDataFrame([(1, 3.0, 4.0, 0.0, -5.0, 90.0), (2, 1.0, 1.0, 1.0, 0.0, 0.0)], "id int, x double, y double, z double, pitch double, yaw double")
    found = spatial.framing_candidates(subjects, views=views)
    assert found.count() == 7
    assert [tuple(r) for r in found.where("preset = 'editor_view'").select("id", "distance", "cx", "cy", "cz", "pitch", "aim_yaw").collect()] == [(1, 5.0, 3.0, 4.0, 0.0, -5.0, 90.0)]
