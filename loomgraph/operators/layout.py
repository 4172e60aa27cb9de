"""Boxes: grid layout, bounds, minimap and viewport queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import style
from loomgraph.operators import geometry, hierarchy, numbering
from loomgraph.schema import PADDING
from loomgraph.shared import durable

COLUMNS, START, STEP_X, STEP_Y = 8, 20.0, 220.0, 60.0


def grid_layout(visible: DataFrame, nodes: DataFrame, *, order: str = "pos") -> DataFrame:
    """Boxes of the visible nodes on a grid of eight columns, in order; ids without a node take no place."""
    placed = numbering.with_row_numbers(visible.join(nodes.select("id", "type"), "id").select("id", "type", order), order, name="i")
    size = style.node_size(F.col("type"))
    return placed.select(
        F.col("id").alias("node_id"),
        (F.lit(START) + F.lit(STEP_X) * (F.col("i") % COLUMNS)).alias("x"),
        (F.lit(START) + F.lit(STEP_Y) * F.floor(F.col("i") / COLUMNS)).alias("y"),
        size["width"].alias("width"),
        size["height"].alias("height"),
    )


def world_bounds(boxes: DataFrame) -> DataFrame:
    """One row: min_x, min_y, max_x, max_y."""
    return boxes.agg(
        F.min("x").alias("min_x"),
        F.min("y").alias("min_y"),
        F.max(F.col("x") + F.col("width")).alias("max_x"),
        F.max(F.col("y") + F.col("height")).alias("max_y"),
    )


def _extent(low: Column, high: Column) -> Column:
    return F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def fit_scale(bounds: DataFrame, view_width: float, view_height: float, padding: float = 50.0) -> DataFrame:
    """Bounds with the scale that fits them into a view, at most 1."""
    wide = (F.lit(view_width) - 2 * padding) / _extent(F.col("min_x"), F.col("max_x"))
    high = (F.lit(view_height) - 2 * padding) / _extent(F.col("min_y"), F.col("max_y"))
    return bounds.withColumn("scale", F.least(wide, high, F.lit(1.0)))


def _minimap_scale(boxes: DataFrame, width: float, height: float, inset: float) -> DataFrame:
    """One row: min_x, min_y, scale."""
    return world_bounds(boxes).select(
        F.col("min_x"),
        F.col("min_y"),
        F.least(
            (F.lit(width) - 2 * inset) / _extent(F.col("min_x"), F.col("max_x")),
            (F.lit(height) - 2 * inset) / _extent(F.col("min_y"), F.col("max_y")),
        ).alias("scale"),
    )


def minimap_viewport(
    boxes: DataFrame, x: float, y: float, view_width: float, view_height: float, width: float = 150.0, height: float = 100.0, inset: float = 4.0
) -> DataFrame:
    """One row: what a viewport covers of the minimap of ``boxes``."""
    return _minimap_scale(boxes, width, height, inset).select(
        (F.lit(inset) + (F.lit(x) - F.col("min_x")) * F.col("scale")).alias("x"),
        (F.lit(inset) + (F.lit(y) - F.col("min_y")) * F.col("scale")).alias("y"),
        (F.lit(view_width) * F.col("scale")).alias("width"),
        (F.lit(view_height) * F.col("scale")).alias("height"),
    )


def minimap_rectangles(boxes: DataFrame, width: float = 150.0, height: float = 100.0, inset: float = 4.0) -> DataFrame:
    """Boxes projected onto a minimap, at least 2 by 1 large."""
    bounds = _minimap_scale(boxes, width, height, inset)
    return boxes.crossJoin(F.broadcast(bounds)).select(  # one row
        "node_id",
        (F.lit(inset) + (F.col("x") - F.col("min_x")) * F.col("scale")).alias("x"),
        (F.lit(inset) + (F.col("y") - F.col("min_y")) * F.col("scale")).alias("y"),
        F.greatest(F.lit(2.0), F.col("width") * F.col("scale")).alias("width"),
        F.greatest(F.lit(1.0), F.col("height") * F.col("scale")).alias("height"),
    )


def in_viewport(boxes: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Boxes that meet one viewport, touching included."""
    return boxes.filter(
        (F.col("x") <= x + width) & (F.col("x") + F.col("width") >= x) & (F.col("y") <= y + height) & (F.col("y") + F.col("height") >= y)
    )


def _celled(rows: DataFrame, levels: Column, cell: float, prefix: str) -> DataFrame:
    """``rows`` once for each of their ``levels`` and each cell of it that they touch."""
    edge = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    out = rows.withColumn("level", F.explode(levels))
    across = F.explode(F.sequence(edge(F.col("x")), edge(F.col("x") + F.col("width"))))
    down = F.explode(F.sequence(edge(F.col("y")), edge(F.col("y") + F.col("height"))))
    out = out.withColumn("cell_x", across).withColumn("cell_y", down)
    out = out.withColumn("first_x", edge(F.col("x"))).withColumn("first_y", edge(F.col("y")))
    return out.select("level", "cell_x", "cell_y", *[F.col(c).alias(prefix + c) for c in (*rows.columns, "first_x", "first_y")])


def viewport_candidates(boxes: DataFrame, viewports: DataFrame, cell: float = 500.0) -> DataFrame:
    """Boxes and viewports that share a cell of the coarser of their levels, and are compared."""
    own = F.coalesce(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("width", "height") / F.lit(cell)))), F.lit(0)).cast("int")
    boxes, viewports = boxes.withColumn("own", own), viewports.withColumn("own", own)
    met = lambda df: F.array(*[F.lit(r.own) for r in df.select("own").distinct().collect()]).cast("array<int>")  # noqa: E731  a few levels
    of_boxes, of_views, mine = met(boxes), met(viewports), F.array("own")
    same_or_coarser = F.filter(of_boxes, lambda level: level >= F.col("own"))
    coarser = F.filter(of_views, lambda level: level > F.col("own"))
    keys = ["level", "cell_x", "cell_y"]
    at_boxes = _celled(boxes, mine, cell, "b_").join(_celled(viewports, same_or_coarser, cell, "v_"), keys)
    at_views = _celled(boxes, coarser, cell, "b_").join(_celled(viewports, mine, cell, "v_"), keys)
    return at_boxes.unionByName(at_views)


def viewport_join(boxes: DataFrame, viewports: DataFrame, cell: float = 500.0) -> DataFrame:
    """(viewport_id, node_id): boxes that meet each of many viewports.

    Both sides are dealt to the cells of grids, so the join has an equality key. A rectangle has a
    level at which cells are as large as it, so it lies in four of them at most. Boxes at their own level meet
    the viewports of that level and of finer ones, viewports at their own level the finer boxes; so a huge
    viewport brings only itself to the boxes, not all others. A pair that shares several cells is kept in
    the first of them only.
    """
    meets = (
        (F.col("b_x") <= F.col("v_x") + F.col("v_width"))
        & (F.col("b_x") + F.col("b_width") >= F.col("v_x"))
        & (F.col("b_y") <= F.col("v_y") + F.col("v_height"))
        & (F.col("b_y") + F.col("b_height") >= F.col("v_y"))
    )
    first = (F.col("cell_x") == F.greatest("b_first_x", "v_first_x")) & (F.col("cell_y") == F.greatest("b_first_y", "v_first_y"))
    both = viewport_candidates(boxes, viewports, cell).filter(meets & first)
    return both.select(F.col("v_viewport_id").alias("viewport_id"), F.col("b_node_id").alias("node_id"))


def upsert_boxes(boxes: DataFrame, changed: DataFrame) -> DataFrame:
    """``boxes`` with those of ``changed`` put in place of rows of the same id."""
    return boxes.join(changed, "node_id", "left_anti").unionByName(changed)


def fitted_containers(boxes: DataFrame, nodes: DataFrame, visible: DataFrame) -> DataFrame:
    """Boxes of all containers of visible children grown to hold them, with padding and a least size.

    From the deepest containers up, so that a container holds its children as they have grown; each level is written before the next.
    """
    shown = visible.select("id").distinct().withColumn("visible", F.lit(True))
    facts = nodes.join(shown, "id", "left").select(
        F.col("id").alias("node_id"), "container_id", "type", F.size("ancestors").alias("depth"), F.coalesce("visible", F.lit(False)).alias("visible")
    )
    placed = durable(boxes.join(facts, "node_id"))
    deepest = placed.agg(F.max("depth")).first()[0]
    if deepest is None:
        return boxes.limit(0)
    fitted, below = None, placed.filter(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):
        grown = durable(_fitted_level(placed.filter(F.col("depth") == depth), below.filter("visible")))
        fits = grown.filter("fits").select(*boxes.columns)
        fitted = fits if fitted is None else fitted.unionByName(fits)
        below = grown
    return boxes.limit(0) if fitted is None else fitted


def _fitted_level(containers: DataFrame, kids: DataFrame) -> DataFrame:
    """``containers`` with the boxes that hold ``kids``, and whether there are any (``fits``)."""
    spans = kids.groupBy(F.col("container_id").alias("node_id")).agg(
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("bottom"),
    )
    least = style.node_size(F.col("type"))
    x = F.least(F.col("x"), F.col("left") - PADDING["left"])
    y = F.least(F.col("y"), F.col("top") - PADDING["top"])
    right = F.greatest(F.col("x") + least["width"] - PADDING["right"], F.col("right"))
    bottom = F.greatest(F.col("y") + least["height"] - PADDING["bottom"], F.col("bottom"))
    fits = F.col("left").isNotNull()
    width = F.greatest(least["width"], F.ceil(right - x + PADDING["right"]).cast("double"))
    height = F.greatest(least["height"], F.ceil(bottom - y + PADDING["bottom"]).cast("double"))
    kept = lambda new, c: F.when(fits, new).otherwise(F.col(c)).alias(c)
    return containers.join(spans, "node_id", "left").select(
        "node_id", kept(x, "x"), kept(y, "y"), kept(width, "width"), kept(height, "height"), "container_id", "type", "depth", "visible", fits.alias("fits")
    )


def displayed_below(nodes: DataFrame, shown_ids: DataFrame, node_id: str) -> DataFrame:
    """Ids of a shown node and of what is shown below it with everything in between shown too."""
    ids = shown_ids.select("id").distinct()
    below = hierarchy.subtree(nodes, node_id).join(ids, "id", "left_semi").select("id", "ancestors")
    start = F.array_position("ancestors", F.lit(node_id))
    between = below.filter(F.col("id") != node_id).select(
        "id", F.explode(F.slice("ancestors", F.greatest(start, F.lit(1)).cast("int"), F.size("ancestors"))).alias("between")
    )
    broken = between.join(ids.withColumnRenamed("id", "between"), "between", "left_anti").select("id").distinct()
    return below.join(broken, "id", "left_anti").select("id")


def offsets_from(boxes: DataFrame, below: DataFrame, node_id: str) -> DataFrame:
    """(node_id, dx, dy): where the boxes of ``below`` lie relative to that of ``node_id``."""
    top = boxes.filter(F.col("node_id") == node_id).select(F.col("x").alias("x0"), F.col("y").alias("y0"))  # one row
    kept = boxes.join(below.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return kept.crossJoin(F.broadcast(top)).select(
        "node_id", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy")
    )


def moved_subtree(boxes: DataFrame, nodes: DataFrame, shown_ids: DataFrame, node_id: str, dx: float, dy: float) -> DataFrame:
    """Boxes after dragging a node together with what is displayed below it."""
    below = displayed_below(nodes, shown_ids, node_id).select(F.col("id").alias("node_id"), F.lit(True).alias("moved"))
    shift = lambda c, by: F.when(F.col("moved"), F.col(c) + by).otherwise(F.col(c)).alias(c)
    return boxes.join(below, "node_id", "left").select("node_id", shift("x", dx), shift("y", dy), "width", "height")


def absolute_boxes(boxes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Boxes placed relative to their containers, moved to the coordinates of the root."""
    chain = nodes.select(F.col("id").alias("node_id"), F.explode("ancestors").alias("above"))
    offsets = boxes.select(F.col("node_id").alias("above"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    total = chain.join(offsets, "above").groupBy("node_id").agg(F.sum("ox").alias("ox"), F.sum("oy").alias("oy"))
    shift = lambda c: (F.col(c) + F.coalesce(f"o{c}", F.lit(0.0))).alias(c)
    return boxes.join(total, "node_id", "left").select("node_id", shift("x"), shift("y"), "width", "height")


def flatten_layout(boxes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of a nested layout in the coordinates of the root: ``edges`` with ``points`` and both boxes.

    ``boxes`` are relative to their containers. ``edges`` is (container_id, source, target, section) with a
    section relative to its container; without one the route is the line between the centres. Points that
    repeat are left out; so are edges without a box at either end or with fewer than two points.
    """
    absolute = absolute_boxes(boxes, nodes)
    box = F.struct("x", "y", "width", "height")
    at = absolute.select(F.col("node_id").alias("container_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    ends = edges.join(absolute.select(F.col("node_id").alias("source"), box.alias("source_box")), "source")
    ends = ends.join(absolute.select(F.col("node_id").alias("target"), box.alias("target_box")), "target").join(at, "container_id", "left")
    middle = lambda b: F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))
    moved = geometry.shifted(F.col("section"), F.coalesce("cx", F.lit(0.0)), F.coalesce("cy", F.lit(0.0)))
    line = F.array(middle(F.col("source_box")), middle(F.col("target_box")))
    points = geometry.without_repeats(F.when(F.col("section").isNull(), line).otherwise(moved))
    return ends.withColumn("points", points).filter(F.size("points") >= 2).drop("section", "cx", "cy")
