"""Patch geometry, greedy suppression and replayable patch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import middle_split, run_of
from ..sources import scratch

SIDE = 256


def patch(x: Column, y: Column, width: Column, height: Column, side: int = SIDE, centred: bool = False) -> Column:
    """G1: struct(y0, y1, x0, x1), or null out of bounds; only the centred form refuses a negative start."""
    x0, y0 = (x - side // 2, y - side // 2) if centred else (x, y)
    inside = (x0 + side <= width) & (y0 + side <= height)
    if centred:
        inside = inside & (x0 >= 0) & (y0 >= 0)
    names = {"y0": y0, "y1": y0 + side, "x0": x0, "x1": x0 + side}
    return F.when(inside, F.struct(*[v.cast("int").alias(k) for k, v in names.items()]))


def grid(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Full tiles of every frame, row by row: ord, y0, y1, x0, x1 beside the frame's columns."""
    columns, rows = F.floor(F.col("width") / side).cast("int"), F.floor(F.col("height") / side).cast("int")
    count = F.when((columns > 0) & (rows > 0), F.sequence(F.lit(0), rows * columns - 1))
    cells = frames.withColumn("ord", F.explode(count))
    y0, x0 = F.floor(F.col("ord") / columns).cast("int") * side, F.pmod("ord", columns) * side
    return cells.withColumns({"y0": y0, "x0": x0}).withColumns({"y1": F.col("y0") + side, "x1": F.col("x0") + side})


def grid_extent(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """What ``grid`` has of each frame, without its cells: n_blocks, last_y and last_x; a frame without a full tile has no row."""
    columns, rows = F.floor(F.col("width") / side), F.floor(F.col("height") / side)
    held = frames.where((columns > 0) & (rows > 0))
    return held.withColumns({"n_blocks": columns * rows, "last_y": (rows - 1) * side, "last_x": (columns - 1) * side})


def half_of_keypoint(x0: Column, x1: Column, width: Column) -> Column:
    """0 left, 1 right, null for a patch that straddles or touches the centre from the right."""
    middle = F.floor(width / 2)
    return F.when(x1 <= middle, 0).when(x0 > middle, 1)


def half_of_cell(x1: Column, width: Column) -> Column:
    """0 when the cell ends before the centre, else 1: straddlers go right."""
    return F.when(x1 < F.floor(width / 2), 0).otherwise(1)


def half_of_pixel(x: Column, width: Column) -> Column:
    """0 for the left half plane, 1 for the right."""
    return F.when(x < F.floor(width / 2), 0).otherwise(1)


def middle_patches(width: Column, height: Column, side: int = SIDE) -> tuple[Column, Column]:
    """The cells left and right of the middle grid line, on the row nearest to the centre; null outside."""
    col, row = middle_split(width, side), middle_split(height, side)
    left = F.when(col >= side, patch(col - side, row, width, height, side))
    return left, patch(col, row, width, height, side)


def _near(a: Column, b: Column, side: int) -> Column:
    return (F.abs(a.x - b.x) < side) & (F.abs(a.y - b.y) < side)


def spread_points(points: Column, side: int = SIDE) -> Column:
    """Keep a point, in the given order, unless a kept one lies within ``side`` on both axes."""
    none = F.slice(points, 1, 0)
    return F.aggregate(points, none, lambda kept, p: F.when(F.exists(kept, lambda k: _near(k, p, side)), kept).otherwise(F.concat(kept, F.array(p))))


def spread_in_cells(points: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """G4 without an array: the same kept points of (keys..., o, x, y), ``o`` giving the order within a key.

    On a grid of cells of ``side`` two points of a cell are always near each
    other, so a cell's first point is the only one of it that can be kept
    next, and only points of the 3 x 3 cells around can be near it. A round
    takes each cell's first, keeps those before all points near them, and
    drops what is near a kept one; rounds go on until no point is left. A point
    kept is before every point that it drops, and everything before it
    that is near was dropped by one kept earlier: the greedy walk's result.
    Points of one key spread over tasks by their cells; rounds are staged.
    """
    spark = points.sparkSession
    cell = [*keys, "_cy", "_cx"]
    live = points.select(*keys, "o", "x", "y", F.floor(F.col("y") / side).cast("int").alias("_cy"), F.floor(F.col("x") / side).cast("int").alias("_cx"))
    kept = None

    def around(firsts: DataFrame) -> DataFrame:
        """Each first in the cells whose points may be near it."""
        shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
        return firsts.withColumn("_s", shift).select(*keys, (F.col("_cy") + F.col("_s.dy")).alias("_cy"), (F.col("_cx") + F.col("_s.dx")).alias("_cx"), "f")

    near = (F.abs(F.col("x") - F.col("f.x")) < side) & (F.abs(F.col("y") - F.col("f.y")) < side)
    while True:
        firsts = live.groupBy(*cell).agg(F.min(F.struct("o", "x", "y")).alias("f"))
        pairs = live.join(around(firsts), cell).where(near)
        won = pairs.groupBy(*keys, "f").agg(F.min("o").alias("_least")).where(F.col("_least") == F.col("f.o")).select(*keys, "f")
        path = scratch.folder(spark, "kept")
        won.write.parquet(path)
        now = spark.read.schema(won.schema).parquet(path)
        kept = now if kept is None else kept.unionAll(now)
        held = now.select(*keys, "f", F.floor(F.col("f.y") / side).cast("int").alias("_cy"), F.floor(F.col("f.x") / side).cast("int").alias("_cx"))
        gone = around(held).withColumnRenamed("f", "g")
        far = ~((F.abs(F.col("x") - F.col("g.x")) < side) & (F.abs(F.col("y") - F.col("g.y")) < side))
        rest = live.join(gone, cell, "left").groupBy(*cell, "o", "x", "y").agg(F.min(F.when(F.col("g").isNull(), True).otherwise(far)).alias("_far")).where("_far").drop("_far")
        path = scratch.folder(spark, "live")
        rest.select(*live.columns).write.parquet(path)
        live = spark.read.schema(live.schema).parquet(path)
        if live.isEmpty():
            break
    return kept.select(*keys, "f.o", "f.x", "f.y")


def suppressed(point: Column, pool: Column, side: int = SIDE) -> Column:
    """Whether a point is too near to one in the pool."""
    return F.exists(pool, lambda k: _near(k, point, side))


def _ranked_point(*names: str) -> list[Column]:
    """What orders keypoints, and their whole coordinates."""
    return [(-F.col("size")).alias(names[0]), (-F.col("response")).alias(names[1]), F.col("kp_id").alias(names[2])]


def spread_keypoints(keypoints: DataFrame, side: int = SIDE) -> DataFrame:
    """G4 over (frame_no, kp_id, x, y, size, response) in cells: frame_no, ord, x, y of the kept points.

    A frame keeps at most one point a cell, so numbering them is bounded by the frame's size.
    """
    points = keypoints.select("frame_no", F.struct(*_ranked_point("a", "b", "c")).alias("o"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    place = F.row_number().over(Window.partitionBy("frame_no").orderBy("o")) - 1
    return spread_in_cells(points, ["frame_no"], side).select("frame_no", place.alias("ord"), "x", "y")


def keypoint_patches(keypoints: DataFrame, frames: DataFrame, side: int = SIDE, in_cells: bool = False) -> DataFrame:
    """Per frame, patches around spread keypoints by (size, response) descending, with their half.

    One row a patch: frame_no, ord, y0, y1, x0, x1, cx, cy, half (null: neither). A frame's keypoints are one array,
    or with ``in_cells`` rows that spread over tasks; the patches are the same.
    """
    if in_cells:
        spread = spread_keypoints(keypoints, side).select("frame_no", "ord", F.struct("x", "y").alias("p"))
    else:
        point = F.struct(*_ranked_point("a", "b", "c"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
        listed = keypoints.groupBy("frame_no").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("points"))
        spread = listed.select("frame_no", F.posexplode(spread_points(F.col("points"), side)).alias("ord", "p"))
    kept = spread.join(frames.select("frame_no", "width", "height"), "frame_no")
    cut = kept.withColumn("patch", patch(F.col("p.x"), F.col("p.y"), F.col("width"), F.col("height"), side, centred=True)).where("patch is not null")
    return cut.select("frame_no", "ord", "patch.*", F.col("p.x").alias("cx"), F.col("p.y").alias("cy"), half_of_keypoint(F.col("patch.x0"), F.col("patch.x1"), F.col("width")).alias("half"))


def select_rotating(candidates: DataFrame, keys: list[str], redundancy: int, side: int = SIDE, mode: str = "as_written") -> DataFrame:
    """One patch a frame, rotating within each run of ``redundancy`` frames.

    ``candidates`` has (keys..., frame_no, ord, x0, y0, cx, cy), walked by
    ``ord``. The pool of used centres starts empty in every run, because the
    run is part of the grouping key; so runs are independent tasks and a
    detector replays them from the original alone. ``as_written``: a first
    suppressed candidate empties the pool, and the next one wins; with
    ``documented`` the pool empties only when all are suppressed. A frame
    without candidates has no row.
    """
    if mode not in ("as_written", "documented"):
        raise ValueError(f"unknown mode {mode!r}")
    one = F.struct("ord", F.col("cx").alias("x"), F.col("cy").alias("y"), "x0", "y0")
    frames = candidates.groupBy(*keys, "frame_no").agg(F.array_sort(F.collect_list(one)).alias("c"))
    runs = frames.withColumn("run", run_of(F.col("frame_no"), redundancy)).groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("frame_no", "c"))).alias("f"))
    first = F.element_at("f", 1)
    start = F.struct(F.slice(F.transform(first.c, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))), 1, 0).alias("pool"), F.slice(F.transform("f", lambda f: F.struct(f.frame_no.alias("frame_no"), F.element_at(f.c, 1).alias("p"))), 1, 0).alias("picks"))

    def step(state: Column, frame: Column) -> Column:
        near = lambda p: F.exists(state.pool, lambda k: _near(k, p, side))
        if mode == "as_written":
            head = F.element_at(frame.c, 1)
            clear = near(head)
            chosen = F.when(clear & (F.size(frame.c) > 1), F.try_element_at(frame.c, F.lit(2))).otherwise(head)
        else:
            free = F.filter(frame.c, lambda p: ~near(p))
            clear = F.size(free) == 0
            chosen = F.coalesce(F.try_element_at(free, F.lit(1)), F.element_at(frame.c, 1))
        centre = F.array(F.struct(chosen.x.alias("x"), chosen.y.alias("y")))
        return F.struct(F.when(clear, centre).otherwise(F.concat(state.pool, centre)).alias("pool"), F.concat(state.picks, F.array(F.struct(frame.frame_no.alias("frame_no"), chosen.alias("p")))).alias("picks"))

    picks = F.aggregate("f", start, step, lambda s: s.picks)
    return runs.select(*keys, "run", F.explode(picks).alias("k")).select(*keys, "run", "k.frame_no", F.col("k.p.ord").alias("ord"), F.col("k.p.x0").alias("x0"), F.col("k.p.y0").alias("y0"), F.col("k.p.x").alias("cx"), F.col("k.p.y").alias("cy"))
