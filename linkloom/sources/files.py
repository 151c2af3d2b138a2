"""Files and pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import let
from linkloom.operators.numbering import number_rows

MAX_BYTES, MAX_FILES = 50 << 20, 25


def discover(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files under a folder with the suffix, in the order of their paths: file_idx, file_name, path, length. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")
    named = found.dropDuplicates(["path"]).withColumn("file_name", F.substring_index("path", "/", -1))
    return number_rows(named, ["path"], "file_idx").orderBy("path")


def upload_reason(name: Column, length: Column, position: Column) -> Column:
    """Why an upload is refused; null if it is taken."""
    return (
        F.when(position > MAX_FILES, "too many files").when(~F.lower(name).endswith(".pdf"), "not a PDF").when(F.coalesce(length, F.lit(0)) <= 0, "empty")
        .when(length > MAX_BYTES, "too large")
    )


def admit_uploads(offered: DataFrame) -> DataFrame:
    """Files as a client offers them (ord, name, kind, size): PDFs of a size that is taken, one of each name and size, the first; with the reason where one is refused."""
    reason = (
        F.when(~(F.lower("name").endswith(".pdf") | (F.col("kind") == "application/pdf")), F.concat("name", F.lit(" is not a PDF.")))
        .when(F.col("size") > MAX_BYTES, F.concat("name", F.lit(" is larger than 50 MB.")))
    )
    judged = offered.withColumn("reason", reason)
    first = judged.where("reason is null").groupBy("name", "size").agg(F.min_by(F.struct("ord", "kind", "reason"), "ord").alias("x")).select("x.ord", "name", "x.kind", "size", "x.reason")
    return first.unionByName(judged.where("reason is not null").select("ord", "name", "kind", "size", "reason"))


#: Named entities that links or their surroundings need. Every other one becomes U+FFFD, which is neither a blank nor part of a host.
ENTITIES = {" ": "nbsp|ensp|emsp|thinsp", ".": "period", "/": "sol", ":": "colon", "@": "commat", "<": "lt|LT", ">": "gt|GT", '"': "quot|QUOT", "'": "apos", "": "shy"}
#: What a page does not show; a part that is never closed reaches to the page's end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
QUOTED = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>"""
TAG = rf"<[/!?a-zA-Z]{QUOTED}|<[/!?a-zA-Z][^>]*>"
#: Tags inside running text, which show no gap. All others end the text before them.
INLINE = rf"(?i)</?(?:abbr|acronym|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?=[\s/>]){QUOTED}"
#: Between blocks: the address pattern ends there, and sanitize() joins nothing over it, as it is no blank to its rules.
BLOCK = "\u2029"
HREF = r"""(?i)(?<=[\s"'])href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def _decoded(text: Column) -> Column:
    """Text with its entities put right, each once: cut at its ampersands, so its cost goes with their number."""
    pattern = r"^(?:#([0-9]+|[xX][0-9a-fA-F]+);?|([a-zA-Z][a-zA-Z0-9]*);)"
    named = lambda p, k: F.regexp_extract(p, pattern, k)

    def numeric(number: Column) -> Column:
        code = F.when(number.rlike("^[xX]"), F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).try_cast("int")
        return F.when(code == 160, " ").when(code.between(32, 126), F.chr(code)).otherwise("\ufffd")

    def mark(x: Column) -> Column:
        out = F.when(x["whole"] == "", "&").when(x["number"] != "", numeric(x["number"])).when(F.lower(x["name"]) == "amp", "&")
        for shown, names in ENTITIES.items():
            out = out.when(x["name"].isin(*names.split("|")), shown)
        return F.concat(out.otherwise("\ufffd"), F.substr(x["piece"], F.char_length(x["whole"]) + 1))

    read = lambda p: let(F.struct(p.alias("piece"), named(p, 0).alias("whole"), named(p, 1).alias("number"), named(p, 2).alias("name")), mark)
    return let(F.split(text, "&"), lambda pieces: F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), read), "")))


def spread(pages: DataFrame) -> DataFrame:
    """Pages dealt out to all cores where they come in fewer files than there are cores: reading links takes far longer than the shuffle of so few. Larger inputs stay as they are."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    few = not pages.isStreaming and 0 < len(pages.inputFiles()) < cores
    return pages.repartition(cores) if few else pages


def html_pages(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as pages to extract from: the page's address and its hrefs as hyperlinks, all that it shows as text.

    An href without a scheme, // or www. names a place on the page's own host, so it is no link by itself.
    """
    shown = F.regexp_replace("html", HIDDEN, " ")
    written = F.flatten(F.transform(F.regexp_extract_all(shown, F.lit(TAG), 0), lambda tag: F.regexp_extract_all(tag, F.lit(HREF), 0)))
    hrefs = F.transform(written, lambda h: F.trim(_decoded(_href(h))))
    whole = F.filter(F.transform(hrefs, lambda h: F.regexp_replace(h, "^//", "https://")), lambda h: h.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*://|www\.)"))
    text = _decoded(F.regexp_replace(F.regexp_replace(shown, INLINE, ""), TAG, BLOCK))
    uris = F.concat(F.array("url"), F.coalesce(whole, F.array().cast("array<string>")))
    return pages.select(F.col("page_id").alias("file_idx"), F.lit(1).alias("page_number"), text.alias("page_text"), uris.alias("uris"))


def html_footers(pages: DataFrame) -> DataFrame:
    """Web pages (page_id, url, html) as pages whose text is the first footer alone."""
    footer = F.regexp_extract("html", r"(?s)<footer[^>]*>(.*?)</footer>", 1)
    plain = F.regexp_replace(F.regexp_replace(footer, r"<[^>]*>", " "), r"&[a-z]+;", " ")
    return pages.select(F.col("page_id").alias("file_idx"), F.lit(1).alias("page_number"), plain.alias("page_text"), F.array("url").alias("uris"))


def _href(written: Column) -> Column:
    return F.regexp_replace(written, r"(?i)^href\s*=\s*[\"']?|[\"']$", "")


def html_links(pages: DataFrame) -> DataFrame:
    """href values of web pages as they are written, in page order: in double or single quotes, or in none."""
    tags = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAG), 0)
    written = F.flatten(F.transform(tags, lambda tag: F.regexp_extract_all(tag, F.lit(HREF), 0)))
    return pages.select("page_id", F.posexplode(F.transform(written, _href)).alias("ord", "href"))
