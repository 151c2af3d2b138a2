"""Runs of dark and light, finder patterns, and connected cells, for codes drawn on pages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A finder's unit, the share of it that each outer run may have, and the dark places of a line.
UNIT, LEAST, MOST, DARK = (1.25, 48.0), 0.45, 1.7, 8


def run_lengths(bits: DataFrame, line: list[str], order: str = "x", value: str = "bit") -> DataFrame:
    """Runs of equal values along each line: line, run, value, start, length."""
    w = Window.partitionBy(*line).orderBy(order)
    marked = bits.withColumn("__new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    return marked.withColumn("run", F.sum("__new").over(w)).groupBy(*line, "run").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count("*").alias("length"))


def finder_centres(runs: DataFrame, line: str, of: tuple[str, ...] = (), every: int = 2, value: str = "bit") -> DataFrame:
    """Where five runs, the first dark, have a finder's proportions: of, line, centre, unit.

    The unit is a third of the middle run, which has 3 places or more. Only every second line is looked at, and only
    lines with enough dark places.
    """
    w = Window.partitionBy(*of, line).orderBy("run")
    dark = F.sum(F.when(F.col(value) == 1, F.col("length")).otherwise(0)).over(Window.partitionBy(*of, line))
    five = [F.col("length"), *(F.lead("length", k).over(w) for k in range(1, 5))]
    found = runs.where(F.col(line) % every == 0).select("*", *(c.alias(f"n{k}") for k, c in enumerate(five)), dark.alias("dark")).withColumn("unit", F.col("n2") / 3.0)
    near = [F.col(f"n{k}").between(LEAST * F.col("unit"), MOST * F.col("unit")) for k in (0, 1, 3, 4)]
    keep = reduce(and_, near, (F.col(value) == 1) & (F.col("dark") >= DARK) & (F.col("n2") >= 3) & F.col("unit").between(*UNIT))
    return found.where(keep).select(*of, line, (F.col("start") + F.col("n0") + F.col("n1") + F.col("n2") / 2.0).alias("centre"), "unit")


def cells_of(marks: DataFrame, page: list[str], side: float = 10.0) -> DataFrame:
    """Distinct grid cells of small marks (page, x, y)."""
    return marks.select(*page, F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")).distinct()


def _components(cells: set[tuple[int, int]], least: int) -> list[tuple[int, ...]]:
    """Cells and corners of the 8-neighbour components, in the order of their first cells."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        group, todo = [start], [start]
        while todo:
            x, y = todo.pop()
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
            group += near
        if len(group) >= least:
            xs, ys = zip(*group, strict=True)
            out.append((len(group), min(xs), min(ys), max(xs), max(ys)))
    return out


def grid_components(cells: DataFrame, page: str, least: int = 1) -> DataFrame:
    """8-neighbour components of a page's cells: page, component, cells and corners. A page is one group of bounded size: its grid.

    Pages come sorted and many are done at once, as most are small.
    """
    names = [page, "component", "n_cells", "x0", "y0", "x1", "y1"]
    kind = cells.schema[page].dataType.simpleString()

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
            out = [(p, k, *c) for p, group in groupby(rows, key=lambda r: r[0]) for k, c in enumerate(_components({r[1:] for r in group}, least))]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        held, types = [], None
        for batch in batches:
            types = [batch.column(0).type, pa.int32(), pa.int32(), *[pa.int64()] * 4]
            held += zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            last = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != held[-1][0]), -1) + 1
            if last:
                yield done(held[:last], types)
                held = held[last:]
        if held:
            yield done(held, types)

    own = cells.select(page, F.col("cx").cast("long"), F.col("cy").cast("long")).repartition(page).sortWithinPartitions(page)
    return own.mapInArrow(components, f"{page} {kind}, component int, n_cells int, x0 long, y0 long, x1 long, y1 long")
