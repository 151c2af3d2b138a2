"""File, page and picture metadata as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import lexicon as lex

DATE = r"(\d{2}-\d{2}-\d{2})(\d{2}(?!\d))?"
# Results depend on these numbers being exactly so.
HEADER_END, FOOTER_START = 0.12, 0.88
FOOTER_TOP, FOOTER_LEFT = 0.78, 0.7
GAP_SHARE, DEFAULT_SIZE = 0.18, 10.0
CODE = r"[A-Z0-9]{3}"


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def file_date(name: Column) -> Column:
    """The first dd-dd-dd or dd-dd-dddd of a file name, as it is written; empty if there is none."""
    return F.regexp_extract(file_stem(name), DATE, 0)


def file_last4(name: Column) -> Column:
    """The last four digits of a file name beside its date."""
    stem = file_stem(name)
    first = F.regexp_extract(stem, DATE, 0)
    rest = F.when(first == "", stem).otherwise(F.concat(F.substr(stem, F.lit(1), F.instr(stem, first) - 1), F.substr(stem, F.instr(stem, first) + F.char_length(first))))
    return F.right(F.regexp_replace(rest, r"\D", ""), F.lit(4))


def valid_form(code: Column) -> Column:
    """A form code: three characters, a letter among them, and no common abbreviation."""
    return (F.char_length(code) == 3) & ~code.isin(*lex.FORM_STOP) & code.rlike("[A-Z]")


def footer_ids(text: Column) -> Column:
    """struct<client_id, form_type> of a footer: a number beside a code, else each by itself."""
    year = "(?:19|20)"
    pairs = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(rf"\b\d{{4}}(?:\s+\d{{4}})?\s*[/|]?\s*{CODE}\b"), 0), lambda m: F.struct(F.substr(m, F.lit(1), F.lit(4)).alias("client_id"), F.right(m, F.lit(3)).alias("form_type"))),
        lambda p: ~p["client_id"].rlike(f"^{year}") & valid_form(p["form_type"]),
    )
    numbers = F.regexp_extract_all(text, F.lit(r"\b\d{4}\b"), 0)
    client = F.coalesce(F.try_element_at(F.filter(numbers, lambda n: ~n.rlike(f"^{year}")), F.lit(1)), F.try_element_at(numbers, F.lit(1)), F.lit(""))
    form = F.coalesce(F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(rf"\b{CODE}\b"), 0), valid_form), F.lit(-1)), F.lit(""))
    return F.coalesce(F.try_element_at(pairs, F.lit(1)), F.struct(client.alias("client_id"), form.alias("form_type")))


def location_class(y0: Column, y1: Column, height: Column) -> Column:
    return F.when(y1 <= HEADER_END * height, "header").when(y0 >= FOOTER_START * height, "footer").otherwise("body")


def picture_source(width: Column, height: Column, page_area: Column) -> Column:
    """logo: a small picture that is long, flat or narrow; image: any other, or one without a place."""
    aspect, small = width / height, width * height < 0.15 * page_area
    return F.when(small & ((aspect >= 1.7) | (aspect <= 0.6) | (F.least(width, height) < 90)), "logo").otherwise("image")


def may_hide_code(width: Column, height: Column, page_area: Column) -> Column:
    share = width * height / page_area
    return share.between(0.04, 0.96) & (F.least(width, height) >= 70) & (F.greatest(width, height) >= 120)


def page_zoom(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1.8), F.least(F.lit(3.2), 3000 / F.greatest(width, height)))


def region_zoom(width: Column, height: Column, target: float = 480.0) -> Column:
    return F.greatest(F.lit(1.8), F.least(F.lit(14.0), target / F.greatest(F.lit(1.0), F.least(width, height))))


def gap_is_space(prev_text: Column, prev_x1: Column, text: Column, x0: Column, size: Column, prev_size: Column) -> Column:
    """Whether a blank belongs between two spans of a line."""
    wide = x0 - prev_x1 > GAP_SHARE * F.coalesce(size, prev_size, F.lit(DEFAULT_SIZE))
    quote = prev_text.rlike("['’‘`]$") | text.rlike("^['’‘`]")
    return F.when(prev_text.endswith(".") & text.rlike("^[A-Z]"), True).when(quote, False).otherwise(wide)


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two rectangles struct<x0, y0, x1, y1> share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def area(r: Column) -> Column:
    return (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])


def is_covered(a: Column, by: Column, share: float = 0.72) -> Column:
    return overlap_area(a, by) >= share * area(a)


def same_spot(a: Column, b: Column, share: float = 0.45) -> Column:
    """Two codes in one place: they overlap by so much of the smaller, or its centre lies in the larger."""
    small, large = F.when(area(a) <= area(b), a).otherwise(b), F.when(area(a) <= area(b), b).otherwise(a)
    x, y = (small["x0"] + small["x1"]) / 2, (small["y0"] + small["y1"]) / 2
    return (overlap_area(a, b) >= share * area(small)) | (x.between(large["x0"], large["x1"]) & y.between(large["y0"], large["y1"]))


def footer_by_place(spans: Column, width: Column, height: Column, page_text: Column, recognised: Column | None = None) -> Column:
    """struct<client_id, form_type> of a page from its spans struct<text, x0, y0, x1, y1>: those of its lowest 22 %.

    The left 70 % decide where they hold an id, then the whole width, then the last five lines of page_text; where the
    footer has next to no text, what was recognised there.
    """
    low = F.filter(spans, lambda s: s["y1"] > height * FOOTER_TOP)
    text_of = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), "\n")
    left, full = text_of(F.filter(low, lambda s: s["x0"] < width * FOOTER_LEFT)), text_of(low)
    lines = F.filter(F.transform(F.split(F.coalesce(page_text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 4), F.lit(5)), "\n")
    bare = F.char_length(F.regexp_replace(F.concat(left, full), r"\s+", "")) < 8
    seen = F.when(bare, F.coalesce(recognised, F.lit(""))).otherwise("") if recognised is not None else F.lit("")

    def first(found: Column) -> Column:
        of = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform(found, lambda f: f[c]), lambda x: x != ""), F.lit(1)), F.lit("")).alias(c)
        return F.struct(of("client_id"), of("form_type"))

    return F.get(F.transform(F.array(F.transform(F.array(left, full, last, seen), footer_ids)), first), 0)


def last_pages(pages: DataFrame) -> DataFrame:
    """The last page of each file, whose footer holds for all of it."""
    columns = [c for c in pages.columns if c != "file_idx"]
    return pages.groupBy("file_idx").agg(F.max_by(F.struct(*columns), "page_number").alias("p")).select("file_idx", "p.*")


def longest_text(*texts: Column) -> Column:
    """The longest of several readings of a page, of equal ones the first."""
    best = F.coalesce(texts[0], F.lit(""))
    for t in texts[1:]:
        best = F.when(F.char_length(F.coalesce(t, F.lit(""))) > F.char_length(best), t).otherwise(best)
    return best


def annotation_payloads(annots: Column, fields: Column) -> Column:
    """What annotations struct<uri, content, title, subject> hold, one after the other, then the values of form fields; empty ones are left out."""
    held = F.flatten(F.transform(F.coalesce(annots, F.slice(annots, 1, 0)), lambda a: F.array(a["uri"], a["content"], a["title"], a["subject"])))
    return F.filter(F.concat(F.coalesce(held, F.array().cast("array<string>")), F.coalesce(fields, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))


def is_sparse(page_text: Column, n_links: Column) -> Column:
    """Whether a page holds so little text, and no link, that it is to be read as a picture."""
    return (n_links == 0) & (F.char_length(F.regexp_replace(F.coalesce(page_text, F.lit("")), r"\s+", "")) < 120)


def looks_like_code(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """Whether a picture of so many pixels, in a box of a page or none, has a code's shape and size."""
    square = lambda w, h: (w / F.greatest(h, F.lit(1.0))).between(0.78, 1.28)
    return (square(width, height) & (F.least(width, height) <= 520)) | F.coalesce(square(box_width, box_height) & (F.least(box_width, box_height) < 130), F.lit(False))


def mostly_blank(n_dark: Column, n_pixels: Column) -> Column:
    """Whether so few pixels of a picture are dark (below 90) that nothing is on it."""
    return F.coalesce(n_dark / F.nullif(n_pixels, F.lit(0)) < 0.003, F.lit(True))
