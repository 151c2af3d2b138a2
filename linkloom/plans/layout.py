"""Registered queries on the layout of pages, the client and the report's ends, beside those of the catalogue, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import meta, urls
from linkloom.operators import boxes, report, rows
from linkloom.plans.catalogue import ORACLE_SQL, QUERIES, RESULTS, STATS, _results, pages_of, query, table
from linkloom.sources import files

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Boxes made of the columns of lineitem.
B = "l_orderkey, l_linenumber, (l_partkey % 90)::DOUBLE AS x0, (l_suppkey % 90)::DOUBLE AS y0, l_partkey % 90 + l_quantity::DOUBLE * 4 AS x1, l_suppkey % 90 + 20.0 + l_tax::DOUBLE * 1000 AS y1"


def _boxes(spark, sf_dir):
    x, y = F.col("l_partkey") % 90, F.col("l_suppkey") % 90
    b = boxes.box(x, y, x + F.col("l_quantity") * 4, y + 20.0 + F.col("l_tax") * 1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", b.alias("box"))


def _in_order(found, item):
    """Items of each order in the order of their lines."""
    both = found.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))).alias("items"))
    return both.select("l_orderkey", F.transform("items", lambda x: x["item"]).alias("items"))


@query(f"""WITH b AS (SELECT {B} FROM lineitem), p AS (SELECT *, greatest(6.0, (x1 - x0) * 0.22) AS dx, greatest(6.0, (y1 - y0) * 0.22) AS dy,
  round_even(x0, 0) AS rx0, round_even(y0, 0) AS ry0, round_even(x1, 0) AS rx1, round_even(y1, 0) AS ry1 FROM b), c AS (SELECT *, floor(greatest(8.0, greatest(1.0, rx1 - rx0, ry1 - ry0) * 0.14)) AS m FROM p)
SELECT l_orderkey, l_linenumber, greatest(x0 - dx, 0.0) AS pad_x0, least(y1 + dy, 120.0) AS pad_y1, greatest(0.0, rx0 - m) AS clip_x0, least(200.0, rx1 + m) AS clip_x1, least(150.0, ry1 + m) AS clip_y1,
  x0 / 2 + 5 AS shift_x0, y1 / 2 + 7 AS shift_y1, 10 + x0 / 400 * 300 AS page_x0, 20 + y1 / 200 * 100 AS page_y1,
  CASE WHEN floor(y0 + 100) - floor(x0) < 8 THEN NULL ELSE greatest(0.0, least(199.0, floor(x0))) END AS quad_x0 FROM c""")
def box_math(spark, sf_dir):
    b, n = F.col("box"), F.lit
    page, clip = boxes.box(n(0.0), n(0.0), n(300.0), n(120.0)), boxes.box(n(10.0), n(20.0), n(310.0), n(120.0))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(corner(b["x0"], b["y0"]), corner(b["x0"] + 50, b["y0"] + 1), corner(b["x0"] + 50, b["y0"] + 100), corner(b["x0"] + 0.5, b["y0"] + 90))
    made = _boxes(spark, sf_dir).withColumns({
        "pad": boxes.padded(b, page), "clip": boxes.clipped(b, n(200), n(150)), "shift": boxes.shifted(b, n(5.0), n(7.0), n(2.0)), "page": boxes.on_page(b, clip, n(400), n(200)), "quad": boxes.quad_box(quad, n(200), n(150)),
    })
    out = [F.col(f"{k}.{c}").alias(f"{k}_{c}") for k, c in (("pad", "x0"), ("pad", "y1"), ("clip", "x0"), ("clip", "x1"), ("clip", "y1"), ("shift", "x0"), ("shift", "y1"), ("page", "x0"), ("page", "y1"), ("quad", "x0"))]
    return made.select("l_orderkey", "l_linenumber", *out)


SAME = """(sqrt(((k.x0 + k.x1 - b.x0 - b.x1) / 2) ** 2 + ((k.y0 + k.y1 - b.y0 - b.y1) / 2) ** 2) <= 0.45 * greatest(1.0, k.x1 - k.x0, k.y1 - k.y0, b.x1 - b.x0, b.y1 - b.y0)
  OR greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0))
     / least(greatest(1.0, k.x1 - k.x0) * greatest(1.0, k.y1 - k.y0), greatest(1.0, b.x1 - b.x0) * greatest(1.0, b.y1 - b.y0)) >= 0.4)"""


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x0, y0, x1, y1) AS n, x0, y0, x1, y1 FROM (SELECT {B} FROM lineitem)),
r AS (SELECT l_orderkey, n, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM b WHERE n = 1
  UNION ALL SELECT r.l_orderkey, b.n, CASE WHEN len(list_filter(r.kept, lambda k: {SAME})) > 0 THEN r.kept ELSE list_append(r.kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) END FROM r JOIN b ON b.l_orderkey = r.l_orderkey AND b.n = r.n + 1)
SELECT l_orderkey, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1 FROM (SELECT l_orderkey, unnest(arg_max(kept, n)) AS u FROM r GROUP BY l_orderkey)""")
def unique_boxes(spark, sf_dir):
    return _in_order(_boxes(spark, sf_dir), F.col("box")).select("l_orderkey", F.inline(boxes.unique_boxes(F.col("items"))))


@query("""WITH RECURSIVE h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, unit) AS n, x, y, unit FROM (
  SELECT l_orderkey, l_linenumber, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 40)::DOUBLE AS y, 1.5 + (l_quantity / 10)::DOUBLE AS unit FROM lineitem)),
r AS (SELECT l_orderkey, n, [{'x': x, 'y': y, 'unit': unit, 'n': 1.0::DOUBLE}] AS kept FROM h WHERE n = 1
  UNION ALL SELECT s.l_orderkey, s.n, CASE WHEN s.i IS NULL OR s.i = 0 THEN list_append(s.kept, {'x': s.x, 'y': s.y, 'unit': s.unit, 'n': 1.0::DOUBLE})
    ELSE list_transform(s.kept, lambda k, j: CASE WHEN j = s.i THEN {'x': (k.x * k.n + s.x) / (k.n + 1), 'y': (k.y * k.n + s.y) / (k.n + 1), 'unit': (k.unit * k.n + s.unit) / (k.n + 1), 'n': k.n + 1} ELSE k END) END
  FROM (SELECT r.l_orderkey, h.n, r.kept, h.x, h.y, h.unit, list_position(list_transform(r.kept, lambda k: sqrt((h.x - k.x) ** 2 + (h.y - k.y) ** 2) <= greatest(6.0, 3.4 * greatest(h.unit, k.unit))), true) AS i
    FROM r JOIN h ON h.l_orderkey = r.l_orderkey AND h.n = r.n + 1) s)
SELECT l_orderkey, round(c.x, 6) AS x, round(c.y, 6) AS y, round(c.unit, 6) AS unit, c.n AS n FROM (SELECT l_orderkey, unnest(arg_max(kept, n)) AS c FROM r GROUP BY l_orderkey) WHERE c.n >= 3""")
def finder_clusters(spark, sf_dir):
    hit = F.struct((F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"), (1.5 + F.col("l_quantity") / 10).alias("unit"))
    found = _in_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hit.alias("hit")), F.col("hit")).select("l_orderkey", F.inline(boxes.cluster_finders(F.col("items"))))
    return found.select("l_orderkey", *(F.round(c, 6).alias(c) for c in ("x", "y", "unit")), "n")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, median(1.5 + l_quantity / 10)::DOUBLE AS unit, min(l_partkey % 900)::DOUBLE AS ax, min(l_suppkey % 700)::DOUBLE AS ay, max(l_partkey % 900)::DOUBLE AS bx, max(l_suppkey % 700)::DOUBLE AS by_ FROM lineitem GROUP BY l_orderkey),
b AS (SELECT l_orderkey, n, unit, greatest(0.0, floor(ax - p)) AS x0, greatest(0.0, floor(ay - p)) AS y0, least(1000.0, ceil(bx + p)) AS x1, least(800.0, ceil(by_ + p)) AS y1 FROM (SELECT *, CASE WHEN n >= 2 THEN 8.0 ELSE 36.0 END * unit AS p FROM g))
SELECT * FROM b WHERE x1 - x0 >= 16 AND y1 - y0 >= 16 AND (n > 1 OR (x1 - x0) * (y1 - y0) <= 0.28 * 800000)""")
def finder_box(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 900).cast("double").alias("x"), (F.col("l_suppkey") % 700).cast("double").alias("y"), (1.5 + F.col("l_quantity") / 10).alias("unit"))
    return boxes.finder_box(lines, ["l_orderkey"], 1000.0, 800.0).select("l_orderkey", "n", "unit", "box.*")


@query(f"""WITH b AS (SELECT {B}, l_suppkey FROM lineitem), s AS (SELECT *, least(x1 - x0, y1 - y0) AS side, (x1 - x0) / greatest(1.0, y1 - y0) AS shape FROM b)
SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ord, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN side BETWEEN 36 AND 220 THEN 0 ELSE 1 END, abs(side - 100), l_orderkey * 10 + l_linenumber) AS rank
  FROM s WHERE shape BETWEEN 0.55 AND 1.85 AND side >= 16) WHERE rank <= 8""")
def region_top8(spark, sf_dir):
    found = _boxes(spark, sf_dir).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return boxes.top_regions(found, ["l_suppkey"]).select("l_suppkey", "ord", "rank")


@query(f"""WITH b AS (SELECT {B}, l_suppkey FROM lineitem), s AS (SELECT *, least(x1 - x0, y1 - y0) AS side, (x1 - x0) / greatest(1.0, y1 - y0) AS shape FROM b), q AS (SELECT *, shape BETWEEN 0.7 AND 1.45 AND side BETWEEN 24 AND 280 AS square FROM s)
SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS ord, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN square THEN 0 ELSE 1 END, CASE WHEN square THEN -side ELSE (x1 - x0) * (y1 - y0) / 480000 END, l_orderkey * 10 + l_linenumber) AS rank FROM q) WHERE rank <= 8""")
def picture_top8(spark, sf_dir):
    found = _boxes(spark, sf_dir).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return boxes.top_pictures(found, ["l_suppkey"], 480000.0).select("l_suppkey", "ord", "rank")


@query(f"""WITH b AS (SELECT {B} FROM lineitem) SELECT l_orderkey, l_linenumber AS ord, area FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY (x1 - x0) * (y1 - y0) DESC, l_linenumber) AS n
  FROM b WHERE least(x1 - x0, y1 - y0) >= 64 AND (x1 - x0) * (y1 - y0) / 100000 BETWEEN 0.04 AND 0.96) WHERE n = 1""")
def largest_picture(spark, sf_dir):
    found = boxes.largest_picture(_boxes(spark, sf_dir).withColumn("ord", F.col("l_linenumber")), ["l_orderkey"], 100000.0)
    return found.select("l_orderkey", "ord", meta.area(F.col("box")).alias("area"))


@query("""WITH t AS (SELECT conv_id, text, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, role) AS n FROM conversations WHERE trim(text) <> ''),
p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY n) FILTER (WHERE n <= 6) AS chunks FROM t GROUP BY conv_id)
SELECT DISTINCT c.conv_id, 'page ' || c.conv_id || CASE WHEN p.chunks IS NULL THEN '' ELSE chr(10) || p.chunks END AS page_text FROM conversations c LEFT JOIN p USING (conv_id)""")
def page_text_chunks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select("conv_id").distinct().withColumn("page_text", F.concat(F.lit("page "), F.col("conv_id").cast("string")))
    chunks = turns.select("conv_id", F.struct("turn", "text", "role").alias("ord"), "text")
    return boxes.add_chunks(pages, chunks, ["conv_id"]).select("conv_id", "page_text")


@query("""SELECT page_id, CASE WHEN length(b) > length(a) AND length(b) >= length(c) THEN b WHEN length(c) > greatest(length(a), length(b)) THEN c ELSE a END AS page_text
FROM (SELECT page_id, url AS a, repeat('x', (page_id % 60)::INT) AS b, repeat('y', (page_id % 70)::INT) AS c FROM pages)""")
def longest_text(spark, sf_dir):
    repeat = lambda c, n: F.repeat(F.lit(c), (F.col("page_id") % n).cast("int"))
    return pages_of(spark, sf_dir).select("page_id", meta.longest_text(F.col("url"), repeat("x", 60), repeat("y", 70)).alias("page_text"))


@query("""SELECT page_id, ord, payload FROM (SELECT page_id, unnest(range(len(l))) AS ord, unnest(l) AS payload FROM (SELECT page_id, list_filter(
  [CASE WHEN page_id % 2 = 0 THEN url END, CASE WHEN page_id % 3 = 0 THEN 'note' END, '', NULL, 'second', NULL, NULL, 'subject', CASE WHEN page_id % 5 = 0 THEN 'field' END], lambda x: x IS NOT NULL AND x <> '') AS l FROM pages))""")
def annotation_payloads(spark, sf_dir):
    k, no = F.col("page_id"), F.lit(None).cast("string")
    note = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, ("uri", "content", "title", "subject"), strict=True)))
    annots = F.array(note(F.when(k % 2 == 0, F.col("url")), F.when(k % 3 == 0, "note"), F.lit(""), no), note(F.lit("second"), no, no, F.lit("subject")))
    return pages_of(spark, sf_dir).select("page_id", F.posexplode(meta.annotation_payloads(annots, F.array(F.when(k % 5 == 0, "field")))).alias("ord", "payload"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN c ELSE '4444' END AS client_id, CASE WHEN p_partkey % 3 = 0 THEN 'A1B' WHEN p_partkey % 3 = 1 THEN 'Z9Z' ELSE 'C3D' END AS form_type
FROM (SELECT p_partkey, (2100 + p_partkey % 7000)::VARCHAR AS c FROM part)""")
def footer_by_place(spark, sf_dir):
    """Ids at the left, ids of which the code is at the right, and a footer that holds none, so the last lines decide."""
    k, client = F.col("p_partkey") % 3, (2100 + F.col("p_partkey") % 7000).cast("string")
    span = lambda text, x0, y0: F.struct(text.alias("text"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + 50.0).alias("x1"), F.lit(y0 + 10.0).alias("y1"))
    left = F.when(k == 0, F.concat(client, F.lit(" / A1B"))).when(k == 2, client).otherwise("page of pages here")
    spans = F.array(span(F.lit("9999 / Q1Q"), 10.0, 100.0), span(left, 10.0, 900.0), span(F.when(k == 2, "C3D").otherwise("right"), 800.0, 900.0))
    found = meta.footer_by_place(spans, F.lit(1000.0), F.lit(1000.0), F.lit("5555 / Y8Y\n\na\nb\nc\nd\n4444 / Z9Z"))
    return table(spark, sf_dir, "part").select("p_partkey", found["client_id"].alias("client_id"), found["form_type"].alias("form_type"))


@query("SELECT o_custkey AS file_idx, max(o_orderkey) AS page_number, arg_max(o_orderstatus, o_orderkey) AS footer FROM orders GROUP BY o_custkey")
def footer_last_page(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_idx"), F.col("o_orderkey").alias("page_number"), F.col("o_orderstatus").alias("footer"))
    return meta.last_pages(pages)


@query("""WITH h AS (SELECT page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host, url FROM pages)
SELECT page_id, 0 AS ord, CASE WHEN page_id % 2 = 0 THEN url ELSE host END AS payload, 5 AS png_bytes FROM h UNION ALL SELECT page_id, 1, 'PAY', 3 FROM h""")
def hit_merge(spark, sf_dir):
    """Two codes of a page: one read three times in one place and once, by its text, without a place; another read twice."""
    b = lambda x: boxes.box(F.lit(x), F.lit(10.0), F.lit(x + 40.0), F.lit(50.0))
    hit = lambda payload, png, place: F.struct(payload.alias("payload"), F.lit(png).cast("binary").alias("png"), place.alias("box"))
    none, host = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"), urls.host_of(F.col("url"))
    full = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(host)
    hits = F.array(hit(host, "123", b(10.0)), hit(F.lit("PAY"), "123", b(300.0)), hit(full, "12345", b(12.0)), hit(F.lit(" "), "1", b(500.0)), hit(F.lit("ac"), "", b(20.0)), hit(F.lit("pay"), "12", none))
    merged = boxes.merge_hits(hits, urls.payload_rank)
    return pages_of(spark, sf_dir).select("page_id", F.posexplode(merged).alias("ord", "h")).select("page_id", "ord", "h.payload", F.octet_length("h.png").alias("png_bytes"))


@query("""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\v\\f]+', '', 'g')) < 120 AND doc_id % 4 <> 0 AS sparse FROM documents""")
def sparse_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", meta.is_sparse(F.col("text"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("sparse"))


@query("""SELECT page_id, unnest(CASE page_id % 3 WHEN 0 THEN ['upi://pay?pa=a@b'] WHEN 1 THEN ['www.acme.com/p' || page_id::VARCHAR, 'shop.org'] ELSE [] END) AS url FROM pages""")
def candidate_links(spark, sf_dir):
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, " upi://pay?pa=a@b. ").when(k % 3 == 1, F.concat(F.lit("pay at www.acme.com/p"), k.cast("string"), F.lit(" or shop.org"))).otherwise("no link here")
    return pages_of(spark, sf_dir).select("page_id", F.explode(rows.admitted(raw)).alias("url"))


@query("""SELECT l_orderkey, l_linenumber, (l_quantity BETWEEN 0.78 * 30 AND 1.28 * 30) OR (l_partkey % 200 BETWEEN 0.78 * (50 + l_suppkey % 100) AND 1.28 * (50 + l_suppkey % 100) AND least(l_partkey % 200, 50 + l_suppkey % 100) < 130) AS like_code,
  l_suppkey % 100 / 10000.0 < 0.003 AS blank FROM lineitem""")
def picture_tests(spark, sf_dir):
    q, w, h = F.col("l_quantity"), (F.col("l_partkey") % 200).cast("double"), (50 + F.col("l_suppkey") % 100).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", meta.looks_like_code(q, F.lit(30.0), w, h).alias("like_code"), meta.mostly_blank(F.col("l_suppkey") % 100, F.lit(10000)).alias("blank"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN least(8 + (l_quantity * 62)::BIGINT // 50, 68) WHEN 1 THEN least(72 + (l_quantity * 22)::BIGINT // 50, 94) WHEN 2 THEN 96 ELSE 100 END::INT AS percent FROM lineitem""")
def job_progress(spark, sf_dir):
    phase = F.element_at(F.array(*map(F.lit, ("extract", "verify", "report", "done"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    # quantities are whole numbers, so the share is that of so many done of 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", report.progress(phase, F.col("l_quantity"), F.lit(50)).alias("percent"))


@query(f"""WITH {RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_idx ORDER BY page_number DESC, seq DESC) AS last FROM r)
SELECT file_idx, page_number, seq, url FROM n WHERE last <= 8 ORDER BY file_idx DESC, page_number, seq LIMIT 10""")
def recent_running(spark, sf_dir):
    return report.recent_running(_results(spark, sf_dir)).select("file_idx", "page_number", "seq", "url")


@query("SELECT count(*) AS n_rows, least(count(*), 120) AS n_shown, CASE WHEN count(*) > 120 THEN (count(*) - 120)::VARCHAR || ' more' ELSE '' END AS note FROM pages")
def more_note(spark, sf_dir):
    return report.more_note(_results(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey AS ord, 'f' || (o_custkey % 50)::VARCHAR || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.pdf' END AS name, o_custkey % 9 * 10000000 AS size, CASE WHEN o_orderkey % 14 = 0 THEN 'application/pdf' ELSE '' END AS kind FROM orders),
j AS (SELECT *, CASE WHEN name NOT LIKE '%.pdf' AND kind <> 'application/pdf' THEN name || ' is not a PDF.' WHEN size > 52428800 THEN name || ' is larger than 50 MB.' END AS reason FROM o)
SELECT ord, name, kind, size, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT min(ord), name, arg_min(kind, ord), size, NULL FROM j WHERE reason IS NULL GROUP BY name, size""")
def client_uploads(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".pdf"))
    offered = table(spark, sf_dir, "orders").select(k.alias("ord"), name.alias("name"), F.when(k % 14 == 0, "application/pdf").otherwise("").alias("kind"), (F.col("o_custkey") % 9 * 10000000).alias("size"))
    return files.admit_uploads(offered)


@query("""SELECT o_orderkey, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown,
  CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 10240 THEN printf('%.1f', floor(n / 102.4 + 0.5) / 10) || ' KB' ELSE round(n / 1024.0)::BIGINT::VARCHAR || ' KB' END AS size
FROM (SELECT o_orderkey, '<b class="' || o_orderpriority || '">&' AS t, o_orderkey % 40000 - 5 AS n FROM orders)""")
def client_texts(spark, sf_dir):
    text = F.concat(F.lit('<b class="'), F.col("o_orderpriority"), F.lit('">&'))
    return table(spark, sf_dir, "orders").select("o_orderkey", report.escape_html(text).alias("shown"), report.format_bytes(F.col("o_orderkey") % 40000 - 5).alias("size"))


@query(f"""WITH {RESULTS}, s AS (SELECT {STATS} FROM r), f AS (SELECT page_id % 20 AS file_idx, count(*) AS n, CASE WHEN page_id % 20 = 3 THEN 'file3 is broken' END AS error FROM pages GROUP BY ALL)
SELECT urls_found AS total_urls, header_urls, footer_urls, qr_urls, image_urls, working_urls, failed_urls, (SELECT count(*) FROM f) AS files_processed, coalesce((SELECT string_agg(error, chr(10)) FROM f), '') AS warnings,
  (SELECT count(error) FROM f) AS n_warnings, (SELECT sum(n)::BIGINT FROM f WHERE error IS NULL) AS pages_scanned, round_even((urls_found * 0.25)::DECIMAL(18, 2), 1)::DOUBLE AS processing_time_seconds FROM s""")
def result_totals(spark, sf_dir):
    read = pages_of(spark, sf_dir).groupBy((F.col("page_id") % 20).alias("file_idx")).agg(F.count("*").alias("n_pages")).withColumn("error", F.when(F.col("file_idx") == 3, "file3 is broken"))
    # made up: a quarter of a second for each link
    return report.result_totals(_results(spark, sf_dir), read, F.col("total_urls") / 4)


@query("SELECT 'extracted_urls.xlsx' AS report_name UNION ALL SELECT 'Scan 1.v2_urls.xlsx'")
def report_names(spark, sf_dir):
    many = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file_name"))
    return report.report_name(many).unionByName(report.report_name(spark.range(1).select(F.lit("Scan 1.v2.pdf").alias("file_name"))))


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'footer' ELSE 'body' END AS location, CASE page_id % 4 WHEN 0 THEN 9.5 WHEN 1 THEN 7.0 WHEN 2 THEN 6.0 END::DOUBLE AS font_size FROM pages""")
def link_places(spark, sf_dir):
    """A link in a span of the body, in one of the footer, in two pieces, and in none."""
    k, url = F.col("page_id") % 4, F.col("url")
    span = lambda text, size, y: F.struct(text.alias("text"), F.lit(size).alias("size"), F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"))
    cut = lambda a, b: F.concat(F.substr(url, F.lit(1), F.lit(8)), F.lit(" ")) if a else F.substr(url, F.lit(9))  # noqa: E731, ARG005
    spans = F.array(span(F.when(k == 2, cut(True, 0)).otherwise("see"), 6.0, 400.0), span(F.when(k == 2, cut(False, 0)).when(k == 0, url).otherwise("text"), 9.5, 420.0), span(F.when(k == 1, F.upper(url)).otherwise("end"), 7.0, 790.0))
    own = pages_of(spark, sf_dir).select(F.col("page_id").alias("file_idx"), F.lit(1).alias("page_number"), "url", F.lit(1).alias("seq"), F.lit(800.0).alias("height"), spans.alias("spans"))
    return rows.locate(own.select("file_idx", "page_number", "url", "seq"), own).select(F.col("file_idx").alias("page_id"), "location", "font_size")


@query(f"WITH {RESULTS} SELECT seq, CASE WHEN status = 'Working' THEN 'good' WHEN status <> '' THEN 'bad' ELSE 'plain' END AS style FROM r")
def status_style(spark, sf_dir):
    return _results(spark, sf_dir).select("seq", report.status_style(F.col("status")).alias("style"))


@query("SELECT page_id, 'qr' AS source, trim(p) AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' {\"pay\": 1} ' WHEN 1 THEN ' ' ELSE url END AS p FROM pages) WHERE trim(p) <> ''")
def code_payloads(spark, sf_dir):
    k = F.col("page_id")
    read = pages_of(spark, sf_dir).select(k.alias("file_idx"), F.lit(1).alias("page_number"), F.lit(0).alias("ord"), F.when(k % 3 == 0, ' {"pay": 1} ').when(k % 3 == 1, " ").otherwise(F.col("url")).alias("payload"))
    return rows.payload_occurrences(read).select(F.col("file_idx").alias("page_id"), "source", "url")


@query(f"""WITH {RESULTS} SELECT seq, file_name, '09-02-26' AS file_date, '6' || lpad(file_idx::VARCHAR, 3, '0') AS last4, (3000 + file_idx)::VARCHAR AS client_id, 'A2J' AS form_type
FROM (SELECT file_idx, seq, '09-02-26 55' || '6' || lpad(file_idx::VARCHAR, 3, '0') || '.pdf' AS file_name FROM r)""")
def file_meta_rows(spark, sf_dir):
    found = _results(spark, sf_dir).select("file_idx", "seq")
    idx = F.col("file_idx")
    name = F.concat(F.lit("09-02-26 556"), F.lpad(idx.cast("string"), 3, "0"), F.lit(".pdf"))
    footers = found.select("file_idx").distinct().select("file_idx", name.alias("file_name"), F.concat((3000 + idx).cast("string"), F.lit(" A2J")).alias("footer_text"))
    return rows.with_file_meta(found, footers).select("seq", "file_name", "file_date", "last4", "client_id", "form_type")


@query("SELECT event_id AS seq, (row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1)::INT AS k FROM events")
def link_ordinals(spark, sf_dir):
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "ACME").otherwise("acme"), (F.col("event_id") % 3).cast("string"), F.lit(".com"))
    found = table(spark, sf_dir, "events").select(F.lit(0).alias("file_idx"), F.col("user_id").alias("page_number"), F.col("event_id").alias("seq"), url.alias("url"))
    return rows.ordinal(found).select("seq", "k")


@query("""SELECT page_id, ord, url FROM (SELECT page_id, unnest(range(len(l))) AS ord, unnest(l) AS url FROM (SELECT page_id,
  CASE page_id % 3 WHEN 0 THEN ['www.acme.com', 'www.shop.org'] WHEN 1 THEN ['www.acme.com/p' || page_id::VARCHAR] ELSE [] END AS l FROM pages))""")
def recognised_links(spark, sf_dir):
    k = F.col("page_id")
    text = F.when(k % 3 == 0, "go to www.acme.corn\nor | www.shop.ogr").when(k % 3 == 1, F.concat(F.lit("www.acme.c0m/p"), k.cast("string"))).otherwise("nothing\nhere")
    found = pages_of(spark, sf_dir).select("page_id", F.posexplode(urls.extract_urls_anyhow(urls.repair_ocr(text))).alias("ord", "url"))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), "url")


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\v\\f]+', '', 'g'))::INT AS n FROM documents")
def compact_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.compact_length(F.col("text")).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'file.pdf' ELSE 'Scan_' || o_orderkey::VARCHAR || '_' || replace(o_orderpriority, ' ', '_') || '.pdf' END AS name FROM orders""")
def safe_names(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, " ._. ").otherwise(F.concat(F.lit("Scan (("), k.cast("string"), F.lit(")) "), F.col("o_orderpriority"), F.lit(".pdf")))
    return table(spark, sf_dir, "orders").select("o_orderkey", urls.safe_name(name).alias("name"))
