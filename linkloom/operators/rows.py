"""Link occurrences of pages: union of sources, caps, fragments, places in the text."""

from __future__ import annotations

import unicodedata
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import meta, urls
from linkloom.functions.exact import exact_round

PAGE = ["file_idx", "page_number"]
#: Order of the sources on a page; what annotations hold is named a hyperlink.
STAGES = ("hyperlink", "text", "annotation", "qr", "image")


def text_occurrences(pages: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """Links of page_text: PAGE, source, ord, url. Pages that cannot hold any are passed over by a cheap test."""
    # the test stands inside: as a filter it would have the page's text made twice
    found = pages.select(*PAGE, F.posexplode(urls.urls_in(F.col("page_text"), tlds)).alias("ord", "url"))
    return found.select(*PAGE, F.lit("text").alias("source"), "ord", "url")


def hyperlink_occurrences(pages: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """Links of the array uris, cleaned; pieces that are no link stay out."""
    cleaned = F.transform("uris", lambda u, i: F.struct(i.alias("ord"), urls.clean_link(u, tlds).alias("url")))
    # exploding makes the link a column of its own; as an alias, its long expression would be copied into every filter
    return pages.select(*PAGE, F.lit("hyperlink").alias("source"), F.inline(F.filter(cleaned, lambda x: x["url"].isNotNull())))


def admitted(raw: Column, tlds: tuple[str, ...] = ()) -> Column:
    """The links that a piece of text stands for: a payment link alone; all links in it; failing that, itself where it begins like a link."""

    def of(text: Column) -> Column:
        return urls.let(F.struct(text.alias("text"), urls.extract_urls_anyhow(text, tlds).alias("found"), urls.clean(text, tlds).alias("whole")), chosen)

    def chosen(x: Column) -> Column:
        paid = F.array(F.regexp_replace(F.regexp_extract(x["text"], r"^\S+", 0), r"[.,;:!?)\]}>\"']+$", ""))
        alone = F.when(x["whole"].rlike(r"(?i)^(?:https?://|ftp://|www\.)"), F.array(x["whole"])).otherwise(F.slice(x["found"], 1, 0))
        return F.when(F.lower(x["text"]).startswith("upi://"), paid).when(F.size(x["found"]) > 0, x["found"]).otherwise(alone)

    links = urls.let(F.trim(urls.sanitize(F.coalesce(raw, F.lit("")), tlds)), of)
    return F.filter(links, lambda u: F.lower(u).startswith("upi://") | urls.looks_like_url(u, tlds))


def annotation_occurrences(pages: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """Links of the annotations struct<uri, content, title, subject, y0, y1> and form fields of pages (annots, fields, height): hyperlinks that come after the page's text, each with the location of its rectangle."""
    none, place = F.array().cast("array<string>"), lambda a: F.coalesce(meta.location_class(a["y0"], a["y1"], F.col("height")), F.lit("body"))
    of = lambda held, location: F.transform(held, lambda p: F.struct(p.alias("payload"), location.alias("location")))
    noted = F.flatten(F.transform("annots", lambda a: of(meta.annotation_payloads(F.array(a), none), place(a))))
    held = F.concat(F.coalesce(noted, F.array().cast("array<struct<payload:string,location:string>>")), of(F.coalesce("fields", none), F.lit("body")))
    each = pages.select(*PAGE, F.posexplode(F.filter(held, lambda h: h["payload"] != "")).alias("nth", "h"))
    found = each.select(*PAGE, "nth", "h.location", F.posexplode(admitted(F.col("h.payload"), tlds)).alias("k", "url"))
    return found.select(*PAGE, F.lit("hyperlink").alias("source"), F.struct("nth", "k").alias("__at"), "url", "location", F.lit(STAGES.index("annotation")).alias("stage")).withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("__at"))).drop("__at")


def payload_occurrences(payloads: DataFrame) -> DataFrame:
    """Decoded codes (PAGE, ord, payload), kept as they are, links or not."""
    return payloads.where(F.trim("payload") != "").select(*PAGE, F.lit("qr").alias("source"), "ord", F.trim("payload").alias("url"))


def recognised_occurrences(texts: DataFrame, source: str = "image", tlds: tuple[str, ...] = ()) -> DataFrame:
    """Links of recognised text (PAGE, ord, text), after misread ends are put right."""
    fixed = urls.repair_ocr(F.col("text"))
    return texts.select(*PAGE, "ord", F.explode(urls.extract_urls_anyhow(fixed, tlds)).alias("url")).select(*PAGE, F.lit(source).alias("source"), "ord", "url")


def union_occurrences(*parts: DataFrame) -> DataFrame:
    """All occurrences with seq, their order on the page: by source in the order of STAGES, or by the stage that a part states, then by ord. A location that a part knows stays."""
    rank = F.create_map(*(F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)))[F.col("source")]
    staged = [p if "stage" in p.columns else p.withColumn("stage", rank) for p in parts]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), staged)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy(*PAGE).orderBy("stage", "ord", "url"))).drop("ord", "stage")


def cap_occurrences(rows: DataFrame) -> DataFrame:
    """Of a link's text and hyperlink rows on a page, the first max(number of text, number of hyperlink) rows; all others stay."""
    key = [*PAGE, urls.link_key(F.col("url"))]
    seen = F.col("source").isin("text", "hyperlink")
    cap = F.greatest(*(F.count_if(F.col("source") == s).over(Window.partitionBy(*key)) for s in ("text", "hyperlink")))
    nth = F.row_number().over(Window.partitionBy(*key, seen).orderBy("seq"))
    return rows.withColumn("__keep", ~seen | (nth <= cap)).where("__keep").drop("__keep")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def begins_longer(pages: pd.Series) -> pd.Series:
    """Whether each link of a page is the beginning, up to a slash, of a longer one of the page."""

    def of(keys: list[str]) -> list[bool]:
        heads = set()
        for key in keys:
            parts, own = key.split("/"), key.rstrip("/")
            heads |= {h for n in range(1, max(2, len(parts))) if (h := "/".join(parts[:n])) != own}
        return [k.rstrip("/") in heads for k in keys]

    return pd.Series([of(list(keys)) for keys in pages], dtype=object)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def stand_alone(texts: pd.Series, asked: pd.Series, pages: pd.Series, bounded: pd.Series) -> pd.Series:
    """Which rows of a page stay, given its text, its links in order and which of them are bounded: all others, and of a bounded link as many as stand by themselves. All stay where no text is asked for."""

    def of(text: str | None, keys: list[str], flags: list[bool]) -> list[bool]:
        links = list(dict.fromkeys(k for k, f in zip(keys, flags, strict=True) if f))
        left = dict(zip(links, standing(text, links), strict=True))
        out = []
        for key, flag in zip(keys, flags, strict=True):
            out.append(not flag or left[key] > 0)
            if flag:
                left[key] -= 1
        return out

    return pd.Series([of(t, list(k), list(f)) if a else [True] * len(k) for t, a, k, f in zip(texts, asked, pages, bounded, strict=True)], dtype=object)


def standing(text: str | None, links: list[str]) -> list[int]:
    """How often each link stands by itself in a text: no letter, digit or one of ./@-_ before it and no slash after it.

    One automaton of all links and one pass over the text; of matches of one link that overlap the first counts.
    """
    counts, free, automaton = [0] * len(links), [0] * len(links), ahocorasick.Automaton()
    for k, link in enumerate(links):
        if link:
            automaton.add_word(link, k)
    if not text or not len(automaton):
        return counts
    automaton.make_automaton()
    for last, k in automaton.iter(text):
        start = last + 1 - len(links[k])
        before = text[start - 1] if start else " "
        if start >= free[k] and before not in "./@_-" and unicodedata.category(before)[0] not in "LN" and text[last + 1 : last + 2] != "/":
            counts[k] += 1
            free[k] = last + 1
    return counts


# marked so, they are run once and never copied into the conditions that the optimizer makes of later steps
begins_longer, stand_alone = begins_longer.asNondeterministic(), stand_alone.asNondeterministic()


def drop_embedded_hosts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows whose link begins a longer one of the page stay only as often as the page's text has them alone.

    A page's rows are one array, told apart by sets of their beginnings, never compared pair by pair; the page's text is
    read once for all its links, and only where a longer link exists.
    """
    others = [c for c in rows.columns if c not in PAGE]
    by_seq = lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")
    own = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*others)), by_seq).alias("__rows"))
    own = own.withColumn("__keys", F.transform("__rows", lambda r: urls.link_key(r["url"])))
    own = own.withColumn("__bounded", F.zip_with("__rows", begins_longer("__keys"), lambda r, longer: longer & (r["source"] != "qr")))
    text = F.when(F.exists("__bounded", lambda x: x), F.lower(urls.sanitize(F.coalesce("__text", F.lit("")))))
    own = own.join(pages.select(*PAGE, F.col("page_text").alias("__text")), PAGE, "left").withColumn("__text", text)
    # the text is mentioned twice, so it stays a column: Spark cannot run a Python function on an argument with lambdas
    own = own.select(*PAGE, "__rows", stand_alone(F.col("__text"), F.col("__text").isNotNull(), F.col("__keys"), F.col("__bounded")).alias("__stays"))
    kept = F.filter(F.zip_with("__rows", "__stays", lambda r, stays: F.when(stays, r)), lambda r: r.isNotNull())
    return own.select(*PAGE, F.inline(kept)).select(*rows.columns)


def keep_final(rows: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """The last filter: codes and upi links as they are, others cleaned once more and still links."""
    free = (F.col("source") == "qr") | F.lower("url").startswith("upi://")
    kept = F.array_compact(F.array(F.when(free, F.col("url")).otherwise(urls.clean_link(F.col("url"), tlds))))
    return rows.select(*(c for c in rows.columns if c != "url"), F.explode(kept).alias("url"))


def ordinal(rows: DataFrame) -> DataFrame:
    """k: how many rows with the same link come before on the page."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, urls.link_key(F.col("url"))).orderBy("seq")) - 1)


def locate(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """location and font_size of the k-th row of a link: those of the k-th span that holds it; body and null if none does. A location that a row has already stays."""
    own = ordinal(rows).join(pages.select(*PAGE, "height", "spans"), PAGE, "left")
    span = F.try_element_at(F.filter("spans", lambda s: F.contains(F.lower(s["text"]), urls.link_key(F.col("url")))), (F.col("k") + 1).cast("int"))
    own = own.withColumn("__span", span)
    place = meta.location_class(F.col("__span.y0"), F.col("__span.y1"), F.col("height"))
    known = F.col("location") if "location" in rows.columns else F.lit(None)
    # a link that is set in pieces has the smallest size of the page's spans
    pieces = F.replace(F.lower(F.array_join(F.transform("spans", lambda s: s["text"]), "")), F.lit(" "), F.lit(""))
    smallest = F.when(F.contains(pieces, F.replace(urls.link_key(F.col("url")), F.lit(" "), F.lit(""))), F.array_min(F.filter(F.transform("spans", lambda s: s["size"]), lambda x: x > 0)))
    size = F.when(F.col("__span").isNull(), smallest).otherwise(F.col("__span.size"))
    size = exact_round(size, 2)
    return own.withColumn("location", F.coalesce(known, F.when(F.col("__span").isNull(), "body").otherwise(place))).withColumn("font_size", size).drop("__span", "k", "height", "spans")


def join_spans(spans: DataFrame) -> DataFrame:
    """page_text of each page from its spans (PAGE, line, ord, text, x0, x1, size): blanks by the gap rule, lines by newlines."""
    w = Window.partitionBy(*PAGE, "line").orderBy("ord")
    space = meta.gap_is_space(F.lag("text").over(w), F.lag("x1").over(w), F.col("text"), F.col("x0"), F.col("size"), F.lag("size").over(w))
    piece = F.concat(F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), F.col("text"))
    pieces = spans.withColumn("piece", piece).groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    lines = pieces.select(*PAGE, "line", F.array_join(F.col("p.piece"), "").alias("text"))
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).select(*PAGE, F.array_join(F.col("l.text"), "\n").alias("page_text"))


def greedy_intervals(found: Column) -> Column:
    """Of array<struct<start, stop>>, those that the sweep keeps: by start, the longest first, each from the last kept stop on."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["stop"] - a["stop"])).cast("int"))
    empty = F.slice(found, 1, 0)
    return F.aggregate(ordered, empty, lambda kept, x: F.when((F.size(kept) == 0) | (x["start"] >= F.try_element_at(kept, F.lit(-1))["stop"]), F.array_append(kept, x)).otherwise(kept))


def distinct_links(rows: DataFrame, order_col: str = "seq") -> DataFrame:
    """One row per link: its key and the spelling that comes first."""
    return rows.where(F.trim("url") != "").groupBy(urls.link_key(F.col("url")).alias("url_key")).agg(F.min_by(F.trim("url"), order_col).alias("url"), F.count("*").alias("n_rows"))


def best_payload(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of the payloads read in one place, the best: with a scheme, with a dot, the longest, the first."""
    return hits.groupBy(*keys).agg(F.max_by("payload", F.struct(urls.payload_rank(F.col("payload")), -F.col("seq"))).alias("payload"), F.count("*").alias("n_hits"))


def with_file_meta(rows: DataFrame, files: DataFrame) -> DataFrame:
    """File-level columns beside each row: name, date, last four digits, client and form (files: file_idx, file_name, footer_text)."""
    name, ids = F.col("file_name"), meta.footer_ids(F.coalesce("footer_text", F.lit("")))
    own = files.select("file_idx", "file_name", meta.file_date(name).alias("file_date"), meta.file_last4(name).alias("last4"), ids["client_id"].alias("client_id"), ids["form_type"].alias("form_type"))
    return rows.join(own, "file_idx")


def extract(pages: DataFrame, *others: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """All links of pages (PAGE, page_text, uris): PAGE, seq, source, url, and location where others have one.

    Links of the pages themselves come clean already, and cleaning a clean link changes nothing, so the last filter is
    for the rows of others.
    """
    every = union_occurrences(hyperlink_occurrences(pages, tlds), text_occurrences(pages, tlds), *others)
    found = drop_embedded_hosts(cap_occurrences(every), pages)
    return keep_final(found, tlds) if others else found
