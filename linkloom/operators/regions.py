"""Where codes may be drawn on a page as many small rectangles: from the page's drawings to its best few regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import meta
from linkloom.operators.boxes import TOP_REGIONS, box, fold, height, top_regions, width
from linkloom.operators.codes import grid_components

# Results depend on these numbers being exactly so.
CELL, THINNEST, LARGEST_MARK, LEAST_CELLS, MOST_DRAWINGS = 10.0, 0.15, 14.0, 8, 8000
SQUARE_SHAPE, SQUARE_SIDE, REGION_SHAPE, REGION_SIDE, COVERED = (0.72, 1.4), (16, 280), (0.55, 1.85), 16, 0.6


def mark_cells(marks: DataFrame, page: list[str]) -> DataFrame:
    """Grid cells that each mark (box) touches, both its edges included: page, cx, cy, each once."""
    cells = lambda lo, hi: F.sequence((F.col(f"box.{lo}") / CELL).cast("long"), (F.col(f"box.{hi}") / CELL).cast("long"))
    return marks.select(*page, F.explode(cells("x0", "x1")).alias("cx"), "box").select(*page, "cx", F.explode(cells("y0", "y1")).alias("cy")).distinct()


def drawing_regions(drawings: DataFrame, page: str, most: int = TOP_REGIONS) -> DataFrame:
    """The regions of each page that most likely are codes, from its drawings (page, ord from 0, box): page, rank, box.

    Drawings near to square and of some size are regions by themselves; small marks are rasterised to a grid, and
    8-neighbour clusters of 8 cells or more are regions. In this order, clusters by their first cells, a region stays
    unless a kept one covers 60 % of it; those of a code's usual size come first. Only a page's first 8000 drawings
    count. Null boxes are no drawings; of equal ones the first stays.
    """
    b = F.col("box")
    shortest, shape = F.least(width(b), height(b)), width(b) / F.greatest(F.lit(1.0), height(b))
    seen = drawings.where((F.col("ord") < MOST_DRAWINGS) & (shortest > THINNEST)).withColumn("square", shape.between(*SQUARE_SHAPE) & shortest.between(*SQUARE_SIDE))
    squares = seen.where("square").select(page, F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), "box")
    marks = seen.where(~F.col("square") & (F.greatest(width(b), height(b)) <= LARGEST_MARK))
    clusters = grid_components(mark_cells(marks, [page]), page, LEAST_CELLS)
    edges = box(*(F.col(c) * CELL for c in ("x0", "y0")), *((F.col(c) + 1) * CELL for c in ("x1", "y1")))
    every = squares.unionByName(clusters.select(page, F.lit(1).alias("kind"), F.col("component").cast("long").alias("ord"), edges.alias("box")))
    fits = shape.between(*REGION_SHAPE) & (shortest >= REGION_SIDE)
    held = every.where(fits).groupBy(page).agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "box"))).alias("r"))
    kept = fold(F.transform("r", lambda r: r["box"]), lambda k, x: meta.overlap_area(x, k) / meta.area(x) >= COVERED, lambda k, _: k)
    return top_regions(held.select(page, F.posexplode(kept).alias("ord", "box")), [page], most).select(page, "rank", "box")
