"""Boxes on pages: arithmetic, what is near what, folds by place, and the best few of a page. Boxes are struct<x0, y0, x1, y1> of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import meta
from linkloom.functions.urls import let

# Results depend on these numbers being exactly so.
SAME_CENTRE, SAME_SHARE, FOUND_SHARE = 0.45, 0.4, 0.72
PAD_SHARE, PAD_LEAST, CLIP_SHARE, CLIP_LEAST, SMALLEST = 0.22, 6.0, 0.14, 8, 8
FINDER_RADIUS, FINDER_REACH, FINDER_HITS = 6.0, 3.4, 3
PAD_OF_ONE, PAD_OF_MORE, LARGEST_OF_ONE = 36.0, 8.0, 0.28
TOP_REGIONS, TOP_PICTURES, TOP_CHUNKS = 8, 8, 6


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def meet(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def padded(b: Column, page: Column) -> Column:
    """A box with a margin on each side, within the page; null if less than 8 is left of it."""
    dx, dy = F.greatest(F.lit(PAD_LEAST), width(b) * PAD_SHARE), F.greatest(F.lit(PAD_LEAST), height(b) * PAD_SHARE)
    wide = meet(box(b["x0"] - dx, b["y0"] - dy, b["x1"] + dx, b["y1"] + dy), page)
    return let(wide, lambda w: F.when(F.least(width(w), height(w)) >= SMALLEST, w))


def shifted(b: Column, x: Column, y: Column, scale: Column) -> Column:
    """A box of an enlarged piece of a picture, in the picture's own place and size; a scale of 0 is none."""
    by = F.when(scale == 0, 1.0).otherwise(scale)
    return box(b["x0"] / by + x, b["y0"] / by + y, b["x1"] / by + x, b["y1"] / by + y)


def clipped(b: Column, wide: Column, high: Column) -> Column:
    """A box in whole pixels with a margin, within the picture; null if it is narrower or lower than 8."""
    whole = box(*(F.bround(b[k]) for k in ("x0", "y0", "x1", "y1")))

    def margin(w: Column) -> Column:
        pad = F.floor(F.greatest(F.lit(float(CLIP_LEAST)), F.greatest(F.lit(1.0), width(w), height(w)) * CLIP_SHARE))
        return box(F.greatest(F.lit(0.0), w["x0"] - pad), F.greatest(F.lit(0.0), w["y0"] - pad), F.least(wide.cast("double"), w["x1"] + pad), F.least(high.cast("double"), w["y1"] + pad))

    return let(whole, lambda w: let(margin(w), lambda c: F.when((width(c) >= SMALLEST) & (height(c) >= SMALLEST), c)))


def quad_box(corners: Column, wide: Column, high: Column) -> Column:
    """The box of four corners array<struct<x, y>> or more, within the picture; null for fewer, or if it is narrower or lower than 8."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    around = box(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys)))

    def inside(b: Column) -> Column:
        x0, y0 = F.greatest(F.lit(0.0), F.least(wide - 1.0, b["x0"])), F.greatest(F.lit(0.0), F.least(high - 1.0, b["y0"]))
        return box(x0, y0, F.greatest(x0 + 1, F.least(wide.cast("double"), b["x1"])), F.greatest(y0 + 1, F.least(high.cast("double"), b["y1"])))

    return let(around, lambda b: F.when((F.size(corners) >= 4) & (width(b) >= SMALLEST) & (height(b) >= SMALLEST), inside(b)))


def on_page(b: Column, clip: Column, wide: Column, high: Column) -> Column:
    """A box in the pixels of a rendered piece of a page, in the page's own units; the whole piece where there is no box."""
    at = lambda k, side, n: clip[f"{k}0"] + b[side] / n * (clip[f"{k}1"] - clip[f"{k}0"])
    placed = box(at("x", "x0", wide), at("y", "y0", high), at("x", "x1", wide), at("y", "y1", high))
    return let(placed, lambda p: F.when(b.isNull() | (wide < 1) | (high < 1) | (width(p) <= 0) | (height(p) <= 0), clip).otherwise(p))


def same_box(a: Column, b: Column) -> Column:
    """Two boxes in pixels in one place: their centres are near for their size, or they share much of the smaller."""
    side = lambda c, f: F.greatest(F.lit(1.0), f(c))
    far = F.sqrt(F.pow((a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2, 2) + F.pow((a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2, 2))
    largest = F.greatest(side(a, width), side(a, height), side(b, width), side(b, height))
    least = F.least(side(a, width) * side(a, height), side(b, width) * side(b, height))
    return (far <= SAME_CENTRE * largest) | (meta.overlap_area(a, b) / least >= SAME_SHARE)


def already_found(b: Column, placed: Column) -> Column:
    """Whether one of the boxes placed is the same code as b, or covers most of it."""
    return F.exists(placed, lambda p: meta.same_spot(b, p) | (meta.overlap_area(b, p) / F.greatest(F.lit(1.0), meta.area(b)) >= FOUND_SHARE))


def fold(items: Column, same: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """Items in order, each merged into the first kept one that is the same, or kept itself."""

    def step(kept: Column, x: Column) -> Column:
        first = F.array_position(F.transform(kept, lambda k: same(k, x)), True)
        return let(first, lambda i: F.when(i == 0, F.array_append(kept, x)).otherwise(F.transform(kept, lambda k, j: F.when(j + 1 == i, merge(k, x)).otherwise(k))))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def unique_boxes(boxes: Column) -> Column:
    """Boxes in order without those that are in one place with a kept one."""
    return fold(boxes, same_box, lambda kept, _: kept)


def cluster_finders(hits: Column) -> Column:
    """Hits struct<x, y, unit> in order as clusters struct<x, y, unit, n>, means that each near hit moves; those of 3 hits or more."""
    counted = F.transform(hits, lambda h: F.struct(h["x"].cast("double").alias("x"), h["y"].cast("double").alias("y"), h["unit"].cast("double").alias("unit"), F.lit(1.0).alias("n")))
    near = lambda k, h: F.sqrt(F.pow(h["x"] - k["x"], 2) + F.pow(h["y"] - k["y"], 2)) <= F.greatest(F.lit(FINDER_RADIUS), FINDER_REACH * F.greatest(h["unit"], k["unit"]))
    mean = lambda k, h, c: ((k[c] * k["n"] + h[c]) / (k["n"] + 1)).alias(c)
    moved = lambda k, h: F.struct(mean(k, h, "x"), mean(k, h, "y"), mean(k, h, "unit"), (k["n"] + 1).alias("n"))
    return F.filter(fold(counted, near, moved), lambda c: c["n"] >= FINDER_HITS)


def finder_box(finders: DataFrame, group: list[str], wide: float, high: float) -> DataFrame:
    """The box of each group of finders (x, y, unit), with a margin of so many of its median unit; none where it is too small, or too large for one finder."""
    found = finders.groupBy(*group).agg(F.count("*").alias("n"), F.median("unit").alias("unit"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")))
    pad = F.when(F.col("n") >= 2, PAD_OF_MORE).otherwise(PAD_OF_ONE) * F.col("unit")
    low = lambda c: F.greatest(F.lit(0.0), F.floor(F.col(c) - pad).cast("double"))
    top = lambda c, most: F.least(F.lit(most), F.ceil(F.col(c) + pad).cast("double"))
    boxes = found.select(*group, "n", "unit", box(low("min_x"), low("min_y"), top("max_x", wide), top("max_y", high)).alias("box"))
    fits = (width(F.col("box")) >= 16) & (height(F.col("box")) >= 16) & ((F.col("n") > 1) | (meta.area(F.col("box")) <= LARGEST_OF_ONE * wide * high))
    return boxes.where(fits)


def prefer_hit(old: Column, new: Column) -> Column:
    """Of two readings struct<payload, png, box> of one code the better: a clearly smaller box with a picture, or the larger picture."""
    bytes_of = lambda h: F.coalesce(F.octet_length(h["png"]), F.lit(0))
    side = lambda h: F.greatest(F.lit(1.0), meta.area(h["box"]))
    tighter = F.coalesce((side(new) < 0.85 * side(old)) & (bytes_of(new) > 0), F.lit(False))
    return F.when(tighter | (bytes_of(new) > bytes_of(old)), new).otherwise(old)


def merge_hits(hits: Column, rank: Callable[[Column], Column]) -> Column:
    """Hits struct<payload, png, box> of a page in order, one for each code: in one place, or of one text where a place is unknown.

    The payload that ranks higher and the larger picture stay, at the place of the first hit.
    """
    read = F.filter(F.transform(hits, lambda h: h.withField("payload", F.trim(h["payload"]))), lambda h: h["payload"] != "")
    bytes_of = lambda h: F.coalesce(F.octet_length(h["png"]), F.lit(0))

    def same(k: Column, h: Column) -> Column:
        unplaced = k["box"].isNull() | h["box"].isNull()
        return F.when(unplaced, F.lower(k["payload"]) == F.lower(h["payload"])).otherwise(meta.same_spot(k["box"], h["box"]))

    def merged(k: Column, h: Column) -> Column:
        payload = F.when(rank(h["payload"]) > rank(k["payload"]), h["payload"]).otherwise(k["payload"])
        return k.withField("payload", payload).withField("png", F.when(bytes_of(h) > bytes_of(k), h["png"]).otherwise(k["png"]))

    return fold(read, same, merged)


def _ranked(rows: DataFrame, page: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*page).orderBy(*order))).where(F.col("rank") <= most)


def top_regions(regions: DataFrame, page: list[str], most: int = TOP_REGIONS) -> DataFrame:
    """The regions (ord, box) of each page that most likely are codes: near to square, of a code's usual size first, then by how far the side is from 100."""
    side, shape = F.least(width(F.col("box")), height(F.col("box"))), width(F.col("box")) / F.greatest(F.lit(1.0), height(F.col("box")))
    likely = F.when(side.between(36, 220), 0).otherwise(1)
    return _ranked(regions.where(shape.between(0.55, 1.85) & (side >= 16)), page, [likely, F.abs(side - 100), F.col("ord")], most)


def uncovered(boxes: Column, share: float = 0.6) -> Column:
    """Boxes in order without those that a kept one covers by so much."""
    return fold(boxes, lambda kept, b: meta.is_covered(b, kept, share), lambda kept, _: kept)


#: How many of a page's or picture's things are looked at, by kind.
CAPS = {"picture": 120, "decoded": 8, "chunk": 6, "finder": 4, "drawing": 4, "unique": 6}


def first_of(things: DataFrame, page: list[str], kind: str = "kind", order: str = "ord") -> DataFrame:
    """The first things (ord) of each kind of a page, as many as the kind allows (CAPS): rank counts them. Kinds without a cap are not looked at."""
    most = F.create_map(*(F.lit(x) for k, n in CAPS.items() for x in (k, n)))[F.col(kind)]
    ranked = things.withColumn("rank", F.row_number().over(Window.partitionBy(*page, kind).orderBy(order)))
    # the largest cap as a number, so that rows beyond it go before the shuffle
    return ranked.where((F.col("rank") <= max(CAPS.values())) & (F.col("rank") <= most))


def top_pictures(pictures: DataFrame, page: list[str], page_area: float, most: int = TOP_PICTURES) -> DataFrame:
    """The pictures (ord, box) of each page to look into first: square ones of a code's size, the largest first, then others, the smallest first."""
    b = F.col("box")
    side, shape = F.least(width(b), height(b)), width(b) / F.greatest(F.lit(1.0), height(b))
    square = b.isNotNull() & shape.between(0.7, 1.45) & side.between(24, 280)
    other = F.when(b.isNull(), 0.0).otherwise(width(b) * height(b) / F.lit(max(page_area, 1.0)))
    return _ranked(pictures, page, [F.when(square, 0).otherwise(1), F.when(square, -side).otherwise(other), F.col("ord")], most)


def largest_picture(pictures: DataFrame, page: list[str], page_area: float) -> DataFrame:
    """The largest picture (ord, box) of each page that is neither small nor the whole page; of equal ones the first."""
    b = F.col("box")
    fits = (F.least(width(b), height(b)) >= 64) & (meta.area(b) / F.lit(max(page_area, 1.0))).between(0.04, 0.96)
    return pictures.where(fits).groupBy(*page).agg(F.max_by(F.struct("ord", "box"), F.struct(meta.area(b), -F.col("ord"))).alias("p")).select(*page, "p.ord", "p.box")


def add_chunks(pages: DataFrame, chunks: DataFrame, page: list[str], most: int = TOP_CHUNKS) -> DataFrame:
    """page_text with the first few recognised chunks (ord, text) of the page after it, a line each."""
    own = _ranked(chunks.where(F.trim("text") != ""), page, [F.col("ord")], most).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    text = F.concat_ws("\n", F.col("page_text"), F.array_join(F.col("c.text"), "\n"))
    return pages.join(own, page, "left").withColumn("page_text", F.when(F.col("c").isNull(), F.col("page_text")).otherwise(text)).drop("c")
