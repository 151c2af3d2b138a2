"""Finder patterns on pictures given as dark places (x, y): found along rows, confirmed along both axes, grouped to codes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import meta
from linkloom.functions.urls import let
from linkloom.operators.boxes import LARGEST_OF_ONE, PAD_OF_MORE, PAD_OF_ONE, box, cluster_finders, fold, height, width
from linkloom.operators.codes import DARK, LEAST, MOST, UNIT

# Results depend on these numbers being exactly so. Shares of a unit: outer runs, a third of the middle one, and how far finders of one code lie apart.
RUN_SHARES, MIDDLE_SHARES, RING, SMALLEST = (0.4, 1.8), (0.55, 1.8), (8.0, 72.0), 16
#: Places of a line in one block of the run index.
BLOCK = 64
#: Drawn things in one partition of by_picture.
DEALT = 10_000


def by_picture(things: DataFrame, of: list[str]) -> DataFrame:
    """What is drawn on pictures, all of a picture in one partition, and about DEALT things in each.

    Dark places made of these lie with their picture, and no later step shuffles them: lines, blocks and joins are all
    within a picture. So a table of things is shuffled once and not its places, of which there are hundreds for each, and
    with as many partitions as there are things, a task's places stay in memory at any size. The things are counted first.
    """
    parts = max(things.sparkSession.sparkContext.defaultParallelism, -(-things.count() // DEALT))
    return things.repartition(parts, *of)


def _runs_of(mask: Column) -> Column:
    """The runs of ones in a mask of 32 bits, held as a long, lowest first: array<struct<low, n>>."""
    bit = lambda m: F.bit_count(m.bitwiseAND(-m) - 1)  # noqa: E731  # the place of the lowest one
    less = lambda m: m.bitwiseAND(m - 1)  # noqa: E731  # without it
    state = lambda first, last, runs: F.struct(first.alias("first"), last.alias("last"), runs.alias("runs"))
    one = lambda x: F.array(let(bit(x["first"]), lambda low: F.struct(low.alias("low"), (bit(x["last"]) - low + 1).alias("n"))))
    edges = state(mask.bitwiseAND(F.bitwise_not(F.shiftleft(mask, 1))), mask.bitwiseAND(F.bitwise_not(F.shiftright(mask, 1))), F.array().cast("array<struct<low:int,n:int>>"))
    return let(edges, lambda x: F.aggregate(F.sequence(F.lit(1), F.bit_count(x["first"])), x, lambda x, _: state(less(x["first"]), less(x["last"]), F.concat(x["runs"], one(x))), lambda x: x["runs"]))


def dark_runs(dark: DataFrame, line: list[str], along: str) -> DataFrame:
    """Runs of dark places on each line: line, start, length. Rows of dark that repeat are one place.

    Places are put together as the bits of 32 before anything is shuffled; runs that meet where two such blocks do are one.
    """
    place = F.col(along).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int"))
    blocks = dark.where(place.isNotNull()).groupBy(*line, F.shiftright(place, 5).alias("__block")).agg(F.bit_or(bit).alias("__mask"))
    runs = blocks.select(*line, "__block", F.explode(_runs_of(F.col("__mask"))).alias("__r"))
    start = F.col("__block") * 32 + F.col("__r.low")
    w = Window.partitionBy(*line).orderBy("start")
    met = runs.select(*line, start.alias("start"), (start + F.col("__r.n")).alias("stop")).withColumns({"__before": F.lag("stop").over(w), "__after": F.lead("start").over(w)})
    begin = F.last(F.when(~F.col("__before").eqNullSafe(F.col("start")), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = met.withColumn("__begin", begin).where(~F.col("__after").eqNullSafe(F.col("stop")))
    return whole.select(*line, F.col("__begin").alias("start"), (F.col("stop") - F.col("__begin")).alias("length"))


def five_runs(runs: DataFrame, line: list[str]) -> DataFrame:
    """Each dark run with the next two and the gaps between them: line, start, stop, n0 to n4."""
    w = Window.partitionBy(*line).orderBy("start")
    start, n = (lambda k: F.lead("start", k).over(w)), (lambda k: F.lead("length", k).over(w))
    sizes = [F.col("length"), start(1) - F.col("start") - F.col("length"), n(1), start(2) - start(1) - n(1), n(2)]
    found = runs.select(*line, "start", *(c.alias(f"n{k}") for k, c in enumerate(sizes))).where("n4 is not null")
    return found.withColumn("stop", F.col("start") + sum((F.col(f"n{k}") for k in range(1, 5)), F.col("n0")))


def row_hits(dark: DataFrame, of: list[str], every: int = 2) -> DataFrame:
    """Where three dark runs of a row have a finder's proportions: of, y, start, x (the centre), unit. Only every second row is looked at, if enough of it is dark."""
    runs = dark_runs(dark.where(F.col("y") % every == 0), [*of, "y"], "x")
    enough = F.sum("length").over(Window.partitionBy(*of, "y"))
    found = five_runs(runs.withColumn("__dark", enough).where(F.col("__dark") >= DARK), [*of, "y"]).withColumn("unit", F.col("n2") / 3.0)
    near = [F.col(f"n{k}").between(LEAST * F.col("unit"), MOST * F.col("unit")) for k in (0, 1, 3, 4)]
    keep = reduce(and_, near, (F.col("n2") >= 3) & F.col("unit").between(*UNIT))
    return found.where(keep).select(*of, "y", "start", (F.col("start") + F.col("n0") + F.col("n1") + F.col("n2") / 2.0).alias("x"), "unit")


def _of_some_unit() -> Column:
    """Whether there is a unit at all for which five runs have a finder's shares, with a little room for rounding; of other runs the index need not know."""
    outer, middle = [F.col(f"n{k}") for k in (0, 1, 3, 4)], F.col("n2") / 3.0
    least = F.greatest(*(n / RUN_SHARES[1] for n in outer), middle / MIDDLE_SHARES[1])
    most = F.least(*(n / RUN_SHARES[0] for n in outer), middle / MIDDLE_SHARES[0])
    return least <= most * 1.000001


def _confirms(runs: Column, place: Column, unit: Column) -> Column:
    """Whether five runs have the shares of a finder of this unit, and a dark one of them holds the place."""
    outer = [runs[f"n{k}"].between(RUN_SHARES[0] * unit, RUN_SHARES[1] * unit) for k in (0, 1, 3, 4)]
    inside = [place >= runs["start"], place < runs["stop"], (runs["n2"] / 3.0).between(MIDDLE_SHARES[0] * unit, MIDDLE_SHARES[1] * unit), *outer]
    ends = [runs["start"] + sum((runs[f"n{k}"] for k in range(1, n)), runs["n0"]) for n in (1, 2, 3, 4)]
    return reduce(and_, [*inside, (place < ends[0]) | place.between(ends[1], ends[2] - 1) | (place >= ends[3])])


def confirmed(finders: DataFrame, dark: DataFrame, of: list[str]) -> DataFrame:
    """The finders (of, x, y, unit) whose middle is dark, with the pattern on the row and on the column through it.

    Both axes have an index of runs; a finder meets the patterns of its line that reach into the block of places that it
    lies in, so no finder is compared with all patterns of a line. The middle is dark where it lies in a dark run of the
    row's pattern. Finders are put beside the index and meet it in a window of one block, as a union keeps places where
    they are: finders and dark places that both come from one table of by_picture are not shuffled, and nothing is
    broadcast. A block is reached by few patterns (at most three cover a place).
    """
    left = finders.withColumns({"__x": F.bround("x").cast("long"), "__y": F.bround("y").cast("long")})
    left = left.where(reduce(and_, (F.col(c).isNotNull() for c in (*of, "__x", "__y"))))
    for line, along in (("y", "x"), ("x", "y")):
        patterns = five_runs(dark_runs(dark.where(F.col(line).isNotNull()), [*of, line], along), [*of, line]).where((F.col("n2") >= 3) & _of_some_unit())
        blocks = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("stop") - 1) / BLOCK)))
        index = patterns.select(*of, F.col(line).cast("long").alias("__line"), blocks.alias("__block"), F.struct("start", "stop", *(f"n{k}" for k in range(5))).alias("__p"))
        place, unit = F.col(f"__{along}"), F.col("unit")
        asked = left.withColumns({"__line": F.col(f"__{line}"), "__block": F.floor(place / BLOCK), "__asked": F.lit(True)})
        near = F.collect_list("__p").over(Window.partitionBy(*of, "__line", "__block"))
        met = asked.unionByName(index, allowMissingColumns=True).withColumn("__near", near)
        left = met.where(F.col("__asked") & F.exists("__near", lambda p: _confirms(p, place, unit))).drop("__line", "__block", "__asked", "__p", "__near")
    return left.drop("__x", "__y")


def group_finders(finders: Column) -> Column:
    """Finders struct<x, y, unit> in order as groups: each goes to the first group of which any member lies at a code's distance, else it begins one."""

    def near(group: Column, one: Column) -> Column:
        f = F.get(one, 0)
        far = lambda o: F.sqrt(F.pow(f["x"] - o["x"], 2) + F.pow(f["y"] - o["y"], 2))
        unit = lambda o: F.greatest(F.lit(1.0), f["unit"], o["unit"])
        return F.exists(group, lambda o: (far(o) > RING[0] * unit(o)) & (far(o) <= RING[1] * unit(o)))

    return fold(F.transform(finders, lambda f: F.array(f)), near, lambda group, one: F.concat(group, one))


def group_box(group: Column, wide: float, high: float) -> Column:
    """The box around a group, with a margin of so many of its median unit; null where it is too small, or too large for one finder."""
    of = lambda c: F.transform(group, lambda f: f[c])
    n, units = F.size(group), F.sort_array(of("unit"))
    median = (F.get(units, F.floor((n - 1) / 2).cast("int")) + F.get(units, F.floor(n / 2).cast("int"))) / 2

    def padded(pad: Column) -> Column:
        low = lambda c: F.greatest(F.lit(0.0), F.floor(F.array_min(of(c)) - pad).cast("double"))
        top = lambda c, most: F.least(F.lit(float(most)), F.ceil(F.array_max(of(c)) + pad).cast("double"))
        return box(low("x"), low("y"), top("x", wide), top("y", high))

    fits = lambda b: (width(b) >= SMALLEST) & (height(b) >= SMALLEST) & ((n > 1) | (meta.area(b) <= LARGEST_OF_ONE * wide * high))
    return let(let(F.when(n >= 2, PAD_OF_MORE).otherwise(PAD_OF_ONE) * median, padded), lambda b: F.when(fits(b), b))


def by_area(boxes: Column) -> Column:
    """Boxes, the smallest first; of equal ones the first."""
    numbered = F.transform(boxes, lambda b, i: F.struct(meta.area(b).alias("area"), i.alias("i"), b.alias("box")))
    return F.transform(F.array_sort(numbered), lambda x: x["box"])


def code_boxes(finders: DataFrame, of: list[str], wide: float, high: float) -> DataFrame:
    """Boxes of the codes of a picture from its finders (of, ord, x, y, unit): of, rank (from 1, the smallest box first), box. A picture's finders are one array."""
    own = finders.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "unit"))).alias("f"))
    boxes = F.filter(F.transform(group_finders(F.col("f")), lambda g: group_box(g, wide, high)), lambda b: b.isNotNull())
    return own.select(*of, F.posexplode(by_area(boxes)).alias("rank", "box")).withColumn("rank", F.col("rank") + 1)


def locate(dark: DataFrame, of: list[str], wide: int, high: int) -> DataFrame:
    """Boxes of the codes on pictures of one size, from their dark places (of, x, y): hits along rows, clusters of hits, confirmed ones, groups.

    Of a picture narrower or lower than 8 there are none. Repeated places count once; pictures are told apart by of,
    which is not null.
    """
    hits = row_hits(dark, of)
    found = hits.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("y", "start", "x", "unit"))).alias("hits"))
    clusters = found.select(*of, F.posexplode(cluster_finders(F.col("hits"))).alias("ord", "c")).select(*of, "ord", "c.x", "c.y", "c.unit")
    return code_boxes(confirmed(clusters, dark, of) if min(wide, high) >= 8 else clusters.limit(0), of, wide, high)
