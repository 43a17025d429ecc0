"""Points in the plane: bounds, projection, nearest, framing poses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import staged
from .scans import met


def bounds(points: DataFrame, *extent: str) -> DataFrame:
    e = F.col(extent[0]) if extent else F.lit(0.0)
    return points.agg(F.min(F.col("x") - e).alias("min_x"), F.max(F.col("x") + e).alias("max_x"), F.min(F.col("y") - e).alias("min_y"), F.max(F.col("y") + e).alias("max_y"))


def planar_projection(points: DataFrame, padding: float = 0.08) -> DataFrame:
    """Points (id, x, y) as percent of a padded square around all, y upwards; extents are 1 at least."""
    box = bounds(points)
    side = F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) * (1 + 2 * padding)
    placed = points.join(F.broadcast(box.withColumn("side", side)), F.lit(True))  # the box is one row
    percent = lambda v, lo, hi: ((v - (lo + hi) / 2) / F.col("side") + 0.5) * 100
    return placed.select("id", percent(F.col("x"), F.col("min_x"), F.col("max_x")).alias("px"), (100 - percent(F.col("y"), F.col("min_y"), F.col("max_y"))).alias("py"))


#: A cell with more points is cut in four, down to so many levels below a radius.
CROWDED, LEVELS = 256, 24


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _leaves(points: DataFrame, radius: float, crowded: int) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level: cx, cy, n, split), and ``points`` with the level and cell of their leaf."""
    levels, left, placed = [], points, None
    for level in range(LEVELS + 1):
        own = left.withColumns({"cx": _cell(F.col("px"), radius / 2**level), "cy": _cell(F.col("py"), radius / 2**level)})
        cells = own.groupBy("cx", "cy").agg(F.sum("many").alias("n"), F.count("*").alias("places"))
        split = (F.col("places") > crowded) & F.lit(level < LEVELS)
        cells = staged(cells.withColumn("split", split).drop("places"), "grid")
        levels.append(cells)
        cut = cells.where("split").select("cx", "cy")
        here = met(own, cut, ["cx", "cy"], "id", "left_anti").withColumn("level", F.lit(level)).select(*points.columns, "level", "cx", "cy")
        placed = here if placed is None else placed.unionByName(here)
        if cut.isEmpty():
            return levels, placed
        left = staged(met(own, cut, ["cx", "cy"], "id", "left_semi").select(*points.columns), "crowded")
    raise AssertionError("the last level is not split")


def nearest_entity(queries: DataFrame, points: DataFrame, radius: float, but_itself: bool = False, crowded: int = CROWDED) -> DataFrame:
    """(query_id, id): for each query (query_id, x, y) the closest point (id, x, y) within ``radius``; ties to the smaller id.

    With ``but_itself`` queries are points too, and the one of a query's own id isn't meant. Rows without a place take no part.

    The plane is a grid of cells as wide as the radius; a cell with more than ``crowded`` places is cut in four, and so on. A query begins with
    the cells around it. Level by level, the nearest cell with a point bounds how far its answer can be, and only cells within
    that are opened or gone into; so a crowd costs a query a few leaves, and a leaf has few places. Points at one place are counted once, with their two
    smallest ids.
    """
    here = points.where("x is not null and y is not null").groupBy(F.col("x").alias("px"), F.col("y").alias("py"))
    here = here.agg(F.count("*").alias("many"), F.min("id").alias("id"), F.max("id").alias("other"))
    if but_itself:  # where the smallest is the query itself, the next one is meant
        least = here.where("many > 1").join(points.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("_id")), ["px", "py"]).where("_id > id").groupBy("px", "py").agg(F.min("_id").alias("_next"))
        here = here.join(least, ["px", "py"], "left").withColumn("other", F.coalesce("_next", "other")).drop("_next")
    here = staged(here, "places")
    levels, placed = _leaves(here, radius, crowded)
    placed = staged(placed, "leaves")

    x, y, limit = F.col("qx"), F.col("qy"), F.lit(radius * radius)
    around = F.array(*[F.struct((_cell(x, radius) + i).alias("cx"), (_cell(y, radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = queries.where("x is not null and y is not null").select("query_id", F.col("x").alias("qx"), F.col("y").alias("qy")).withColumn("bound", limit)
    front, found = asked.select("*", F.inline(around)), None
    for level, cells in enumerate(levels):
        size = radius / 2**level
        low = lambda c, v: F.greatest(F.lit(0.0), F.col(c) * size - v, v - (F.col(c) + 1) * size)
        far = lambda c, v: F.greatest(v - F.col(c) * size, (F.col(c) + 1) * size - v)
        square = lambda a, b: a * a + b * b
        seen = front.join(cells, ["cx", "cy"]).withColumns({"near": square(low("cx", x), low("cy", y)), "far": square(far("cx", x), far("cy", y))})
        own = (F.col("cx") == _cell(x, size)) & (F.col("cy") == _cell(y, size)) if but_itself else F.lit(False)
        holds = F.col("n") > F.when(own, 1).otherwise(0)
        bound = F.least("bound", F.min(F.when(holds, F.col("far"))).over(Window.partitionBy("query_id", "qx", "qy")))  # over no more cells than a few
        # a little more, for rounding
        seen = staged(seen.withColumn("bound", bound).where(F.col("near") <= F.col("bound") * (1 + 1e-9)), "front")
        open_ = seen.where("not split").select("query_id", "qx", "qy", F.lit(level).alias("level"), "cx", "cy")
        found = open_ if found is None else found.unionByName(open_)
        inner = F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
        front = seen.where("split").select("query_id", "qx", "qy", "bound", F.inline(inner))
    d = square(x - F.col("px"), y - F.col("py"))
    chosen = F.when(F.col("id") != F.col("query_id"), F.col("id")).when(F.col("many") > 1, F.col("other")) if but_itself else F.col("id")
    near = found.join(placed, ["level", "cx", "cy"]).select("query_id", d.alias("d"), chosen.alias("id")).where((F.col("d") <= limit) & F.col("id").isNotNull())
    return near.groupBy("query_id").agg(F.min(F.struct("d", "id")).alias("best")).select("query_id", F.col("best.id").alias("id"))


#: The presets' names, distance scale, elevation, yaw in degrees, and whether that is the world's or the subject's.
PRESETS = [
    ("context_three_quarter", 1.8, 0.5, 42.0, False),
    ("facade_front", 1.25, 0.08, 0.0, False),
    ("cardinal_north", 1.45, 0.18, 90.0, True),
    ("cardinal_east", 1.45, 0.18, 0.0, True),
    ("cardinal_south", 1.45, 0.18, -90.0, True),
    ("cardinal_west", 1.45, 0.18, 180.0, True),
]


def framing_candidates(subjects: DataFrame, fov: float = 60.0, margin: float = 0.1, presets: list = PRESETS, views: DataFrame | None = None) -> DataFrame:
    """Camera places for each subject (id, x, y, z, ex, ey, ez, yaw), and the angles that aim them at it.

    The distance fits a sphere around the extent (radius 1 at least) into the frame: r / sin(fov / 2) / (1 - 2 margin), times
    the preset's scale. Subjects of which a number isn't finite, or an extent is negative, have none. ``views(id, x, y, z, pitch,
    yaw)`` give some subjects one more candidate, editor_view: the place and angles of somebody's own view, as they are.
    """
    numbers = ("x", "y", "z", "ex", "ey", "ez", "yaw")
    fine = F.lit(True)
    for c in numbers:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    for c in ("ex", "ey", "ez"):
        fine = fine & (F.col(c) >= 0)
    pose = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(scale).alias("scale"), F.lit(up).alias("up"), F.lit(yaw).alias("turn"), F.lit(world).alias("world")) for n, scale, up, yaw, world in presets])
    placed = subjects.where(fine).select("id", *numbers, F.inline(pose))
    radius = F.greatest(F.lit(1.0), F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")))
    placed = placed.withColumn("distance", radius / math.sin(math.radians(fov / 2)) / (1 - 2 * margin) * F.col("scale"))
    angle = F.radians(F.when(F.col("world"), F.col("turn")).otherwise(F.col("yaw") + F.col("turn")))
    placed = placed.withColumns({"dx": F.cos(angle) * F.col("distance"), "dy": F.sin(angle) * F.col("distance"), "dz": F.col("ez") * F.col("up")})
    aim = {"pitch": F.degrees(F.atan2(-F.col("dz"), F.hypot("dx", "dy"))), "aim_yaw": F.degrees(F.atan2(-F.col("dy"), -F.col("dx")))}
    found = placed.select("id", "preset", "distance", (F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy"), (F.col("z") + F.col("dz")).alias("cz"), *[v.alias(k) for k, v in aim.items()])
    if views is None:
        return found
    own = views.select("id", F.lit("editor_view").alias("preset"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "pitch", F.col("yaw").alias("aim_yaw"))
    own = own.join(subjects.where(fine).select("id", "x", "y", "z"), "id")
    away = F.sqrt((F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("y")) * (F.col("cy") - F.col("y")) + (F.col("cz") - F.col("z")) * (F.col("cz") - F.col("z")))
    return found.unionByName(own.withColumn("distance", away).select(found.columns))
