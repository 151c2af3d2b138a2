"""Registered queries on what is drawn on pages and pictures, each with its DuckDB counterpart: patterns of finders, their groups, regions, annotation links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import meta, registry
from linkloom.functions.exact import exact_round
from linkloom.operators import boxes, finders, numbering, regions, report, rows
from linkloom.streaming import jobs
from linkloom.plans.catalogue import ORACLE_SQL, QUERIES, RESULTS, STATS, _results, pages_of, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

SIDE = 180
#: Every event draws a finder of unit 2 or 3 on one of its user's pictures.
EVENTS = "e AS (SELECT event_id, user_id * 4 + event_id % 4 AS pic, 2 + event_id % 2 AS u, (value * 100)::BIGINT % 150 AS cx, event_id * 37 % 150 AS cy FROM events)"
DRAWN = """px AS (SELECT DISTINCT pic, cx + i AS x, cy + j AS y FROM e, range(21) a(i), range(21) b(j) WHERE i < 7 * u AND j < 7 * u AND greatest(abs(i // u - 3), abs(j // u - 3)) <> 2),
ry AS (SELECT pic, y AS line, min(x) AS start, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY pic, y ORDER BY x) AS g FROM px) GROUP BY pic, y, g),
rx AS (SELECT pic, x AS line, min(y) AS start, count(*) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY pic, x ORDER BY y) AS g FROM px) GROUP BY pic, x, g)""" + "".join(
    f""",
f{k} AS (SELECT *, start + n0 + n1 + n2 + n3 + n4 AS stop FROM (SELECT pic, line, start, n AS n0, lead(start) OVER w - start - n AS n1, lead(n) OVER w AS n2,
  lead(start, 2) OVER w - lead(start) OVER w - lead(n) OVER w AS n3, lead(n, 2) OVER w AS n4, sum(n) OVER (PARTITION BY pic, line) AS dark FROM r{k} WINDOW w AS (PARTITION BY pic, line ORDER BY start)) WHERE n4 IS NOT NULL)"""
    for k in "yx"
)


def _holds(kind, line, along):
    shares = " AND ".join(f"f.n{k} BETWEEN 0.4 * unit AND 1.8 * unit" for k in (0, 1, 3, 4))
    return f"EXISTS (SELECT 1 FROM f{kind} f WHERE f.pic = c.pic AND f.line = round_even({line}, 0) AND round_even({along}, 0) >= f.start AND round_even({along}, 0) < f.stop AND f.n2 >= 3 AND f.n2 / 3.0 BETWEEN 0.55 * unit AND 1.8 * unit AND {shares})"


CONFIRMED = f"EXISTS (SELECT 1 FROM px WHERE px.pic = c.pic AND px.x = round_even(c.x, 0) AND px.y = round_even(c.y, 0)) AND {_holds('y', 'c.y', 'c.x')} AND {_holds('x', 'c.x', 'c.y')}"


def _events(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 4 + F.col("event_id") % 4).alias("pic"), (2 + F.col("event_id") % 2).alias("u"), (cents % 150).alias("cx"), (F.col("event_id") * 37 % 150).alias("cy"))


def _drawn(events):
    side = lambda: F.explode(F.sequence(F.lit(0), (7 * F.col("u") - 1).cast("int")))
    places = events.withColumn("i", side()).withColumn("j", side())
    ring = lambda c: F.abs(F.floor(F.col(c) / F.col("u")) - 3)
    return places.where(F.greatest(ring("i"), ring("j")) != 2).select("pic", (F.col("cx") + F.col("i")).alias("x"), (F.col("cy") + F.col("j")).alias("y"))


@query(f"""WITH {EVENTS}, {DRAWN}, c AS (SELECT event_id, pic, cx + 3.5 * u + event_id % 3 AS x, cy + 3.5 * u - event_id % 5 AS y, u::DOUBLE AS unit FROM e)
SELECT event_id, pic, x::DOUBLE AS x, y::DOUBLE AS y FROM c WHERE {CONFIRMED}""")
def finder_confirmed(spark, sf_dir):
    """Every event claims a finder where it has drawn one, or a little beside it; those stay that both axes confirm."""
    own = finders.by_picture(_events(spark, sf_dir), ["pic"])
    claims = own.select("event_id", "pic", (F.col("cx") + 3.5 * F.col("u") + F.col("event_id") % 3).alias("x"), (F.col("cy") + 3.5 * F.col("u") - F.col("event_id") % 5).alias("y"), F.col("u").cast("double").alias("unit"))
    return finders.confirmed(claims, _drawn(own), ["pic"]).select("event_id", "pic", "x", "y")


def _grouped(source, wide, high):
    """SQL from ordered finders (pic, n, x, y, unit) in the relation source to their boxes by area."""
    far, unit = "sqrt((o.x - s.x) ** 2 + (o.y - s.y) ** 2)", "greatest(1.0, s.unit, o.unit)"
    return f"""g AS (SELECT pic, n, [[{{'x': x, 'y': y, 'unit': unit}}]] AS groups FROM {source} WHERE n = 1
  UNION ALL SELECT pic, n, CASE WHEN coalesce(i, 0) = 0 THEN list_append(groups, [one]) ELSE list_transform(groups, lambda m, j: CASE WHEN j = i THEN list_append(m, one) ELSE m END) END FROM (
    SELECT g.pic, s.n, g.groups, {{'x': s.x, 'y': s.y, 'unit': s.unit}} AS one, list_position(list_transform(g.groups, lambda m: len(list_filter(m, lambda o: {far} > 8.0 * {unit} AND {far} <= 72.0 * {unit})) > 0), true) AS i
    FROM g JOIN {source} s ON s.pic = g.pic AND s.n = g.n + 1)),
grp AS (SELECT pic, unnest(range(len(groups))) AS k, unnest(groups) AS m FROM (SELECT pic, arg_max(groups, n) AS groups FROM g GROUP BY pic)),
mem AS (SELECT pic, k, len(m) AS n, unnest(m) AS f FROM grp),
pad AS (SELECT pic, k, any_value(n) AS n, min(f.x) AS ax, max(f.x) AS dx, min(f.y) AS ay, max(f.y) AS dy, median(f.unit) * CASE WHEN any_value(n) >= 2 THEN 8.0 ELSE 36.0 END AS p FROM mem GROUP BY pic, k),
b AS (SELECT pic, k, n, greatest(0.0, floor(ax - p)) AS x0, greatest(0.0, floor(ay - p)) AS y0, least({wide}.0, ceil(dx + p)) AS x1, least({high}.0, ceil(dy + p)) AS y1 FROM pad)
SELECT pic, row_number() OVER (PARTITION BY pic ORDER BY (x1 - x0) * (y1 - y0), k)::INT AS rank, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM b
WHERE x1 - x0 >= 16 AND y1 - y0 >= 16 AND (n > 1 OR (x1 - x0) * (y1 - y0) <= 0.28 * {wide} * {high})"""


CORNERS = ("x0", "y0", "x1", "y1")


@query(f"""WITH RECURSIVE {EVENTS}, f AS (SELECT pic, row_number() OVER (PARTITION BY pic ORDER BY event_id) AS n, cx * 5.0 AS x, cy * 5.0 AS y, 0.5::DOUBLE + event_id % 3 AS unit FROM e), {_grouped("f", 800, 800)}""")
def finder_groups(spark, sf_dir):
    """Finders at the events' places, grouped in the order of the events, as boxes by area."""
    own = _events(spark, sf_dir).select("pic", F.col("event_id").alias("ord"), (F.col("cx") * 5.0).alias("x"), (F.col("cy") * 5.0).alias("y"), (0.5 + F.col("event_id") % 3).alias("unit"))
    return finders.code_boxes(own, ["pic"], 800.0, 800.0).select("pic", "rank", *(F.col(f"box.{c}").alias(c) for c in CORNERS))


@query(f"""WITH RECURSIVE {EVENTS}, {DRAWN},
h AS (SELECT pic, row_number() OVER (PARTITION BY pic ORDER BY line, start) AS n, start + n0 + n1 + n2 / 2.0::DOUBLE AS x, line::DOUBLE AS y, n2 / 3.0::DOUBLE AS unit FROM fy
  WHERE line % 2 = 0 AND dark >= 8 AND n2 >= 3 AND n2 / 3.0 BETWEEN 1.25 AND 48 AND least(n0, n1, n3, n4) >= 0.45 * (n2 / 3.0) AND greatest(n0, n1, n3, n4) <= 1.7 * (n2 / 3.0)),
k AS (SELECT pic, n, [{{'x': x, 'y': y, 'unit': unit, 'n': 1.0::DOUBLE}}] AS kept FROM h WHERE n = 1
  UNION ALL SELECT s.pic, s.n, CASE WHEN coalesce(s.i, 0) = 0 THEN list_append(s.kept, {{'x': s.x, 'y': s.y, 'unit': s.unit, 'n': 1.0::DOUBLE}})
    ELSE list_transform(s.kept, lambda m, j: CASE WHEN j = s.i THEN {{'x': (m.x * m.n + s.x) / (m.n + 1), 'y': (m.y * m.n + s.y) / (m.n + 1), 'unit': (m.unit * m.n + s.unit) / (m.n + 1), 'n': m.n + 1}} ELSE m END) END
  FROM (SELECT k.pic, h.n, k.kept, h.x, h.y, h.unit, list_position(list_transform(k.kept, lambda m: sqrt((h.x - m.x) ** 2 + (h.y - m.y) ** 2) <= greatest(6.0, 3.4 * greatest(h.unit, m.unit))), true) AS i
    FROM k JOIN h ON h.pic = k.pic AND h.n = k.n + 1) s),
c AS (SELECT pic, ord, c.x AS x, c.y AS y, c.unit AS unit FROM (SELECT pic, unnest(range(len(kept))) AS ord, unnest(kept) AS c FROM (SELECT pic, list_filter(arg_max(kept, n), lambda m: m.n >= 3) AS kept FROM k GROUP BY pic))),
f AS (SELECT pic, row_number() OVER (PARTITION BY pic ORDER BY ord) AS n, x, y, unit FROM c WHERE {CONFIRMED}), {_grouped("f", SIDE, SIDE)}""")
def finder_boxes(spark, sf_dir):
    """From the dark places of pictures to the boxes of their codes: hits, clusters, confirmation, groups."""
    return finders.locate(_drawn(finders.by_picture(_events(spark, sf_dir), ["pic"])), ["pic"], SIDE, SIDE).select("pic", "rank", *(F.col(f"box.{c}").alias(c) for c in CORNERS))


#: Rectangles drawn on pages of four orders: squares where the quantity is large, small marks else.
RECTS = """t AS (SELECT l_orderkey // 4 AS page, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ord, l_quantity::DOUBLE AS q, l_linenumber AS m,
  (l_partkey % 110)::DOUBLE AS x0, ((l_suppkey * 7 + l_linenumber * 13) % 110)::DOUBLE AS y0, (l_partkey % 15)::DOUBLE AS h FROM lineitem),
d AS (SELECT page, ord, x0, y0, x0 + CASE WHEN q > 35 THEN q ELSE q % 15 END AS x1, y0 + CASE WHEN q > 35 THEN q * (0.8::DOUBLE + (m % 4) * 0.15::DOUBLE) ELSE h END AS y1 FROM t)"""


@query(f"""WITH RECURSIVE {RECTS},
s AS (SELECT *, least(x1 - x0, y1 - y0) AS side, (x1 - x0) / greatest(1.0, y1 - y0) AS shape, greatest(x1 - x0, y1 - y0) AS long FROM d WHERE ord < 8000 AND least(x1 - x0, y1 - y0) > 0.15),
k AS (SELECT *, shape BETWEEN 0.72 AND 1.4 AND side BETWEEN 16 AND 280 AS square FROM s),
c AS (SELECT DISTINCT page, cx, cy FROM (SELECT page, unnest(range(floor(x0 / 10)::BIGINT, floor(x1 / 10)::BIGINT + 1)) AS cx, y0, y1 FROM k WHERE NOT square AND long <= 14), LATERAL (SELECT unnest(range(floor(y0 / 10)::BIGINT, floor(y1 / 10)::BIGINT + 1)) AS cy)),
reach AS (SELECT page, cx, cy, cx AS ox, cy AS oy FROM c UNION SELECT r.page, n.cx, n.cy, r.ox, r.oy FROM reach r JOIN c n ON n.page = r.page AND abs(n.cx - r.cx) <= 1 AND abs(n.cy - r.cy) <= 1),
low AS (SELECT page, cx, cy, min((ox, oy)) AS root FROM reach GROUP BY page, cx, cy),
every AS (SELECT page, 0 AS kind, ord::BIGINT AS ord, x0, y0, x1, y1 FROM k WHERE square
  UNION ALL SELECT page, 1, row_number() OVER (PARTITION BY page ORDER BY root), min(cx) * 10.0, min(cy) * 10.0, (max(cx) + 1) * 10.0, (max(cy) + 1) * 10.0 FROM low GROUP BY page, root HAVING count(*) >= 8),
fit AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY kind, ord) AS n, {{'x0': x0::DOUBLE, 'y0': y0::DOUBLE, 'x1': x1::DOUBLE, 'y1': y1::DOUBLE}} AS b FROM every
  WHERE (x1 - x0) / greatest(1.0, y1 - y0) BETWEEN 0.55 AND 1.85 AND least(x1 - x0, y1 - y0) >= 16),
fold AS (SELECT page, n, [b] AS kept FROM fit WHERE n = 1 UNION ALL SELECT f.page, f.n, CASE WHEN len(list_filter(kept, lambda o:
    greatest(0.0, least(o.x1, f.b.x1) - greatest(o.x0, f.b.x0)) * greatest(0.0, least(o.y1, f.b.y1) - greatest(o.y0, f.b.y0)) / ((f.b.x1 - f.b.x0) * (f.b.y1 - f.b.y0)) >= 0.6)) > 0 THEN kept ELSE list_append(kept, f.b) END
  FROM fold JOIN fit f ON f.page = fold.page AND f.n = fold.n + 1),
o AS (SELECT page, unnest(range(len(kept))) AS ord, unnest(kept) AS b FROM (SELECT page, arg_max(kept, n) AS kept FROM fold GROUP BY page)),
r AS (SELECT page, b, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN least(b.x1 - b.x0, b.y1 - b.y0) BETWEEN 36 AND 220 THEN 0 ELSE 1 END, abs(least(b.x1 - b.x0, b.y1 - b.y0) - 100), ord)::INT AS rank FROM o)
SELECT page, rank, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM r WHERE rank <= 8""")
def drawing_regions(spark, sf_dir):
    """From the rectangles of pages to the regions that may be codes."""
    own, q = table(spark, sf_dir, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 4)), F.col("l_quantity").cast("double")
    nth = F.row_number().over(Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    x0, y0 = F.col("l_partkey") % 110, (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 110
    wide, high = F.when(q > 35, q).otherwise(q % 15), F.when(q > 35, q * (0.8 + F.col("l_linenumber") % 4 * 0.15)).otherwise(F.col("l_partkey") % 15)
    drawn = own.select("page", nth.alias("ord"), boxes.box(x0, y0, x0 + wide, y0 + high).alias("box"))
    return regions.drawing_regions(drawn, "page").select("page", "rank", *(F.col(f"box.{c}").alias(c) for c in CORNERS))


@query("""SELECT page_id, seq, 'hyperlink' AS source, url, location FROM (
  SELECT page_id, 1 AS seq, url, 'body' AS location FROM pages WHERE url NOT LIKE '%://blog.%'
  UNION ALL SELECT page_id, 2, 'https://acme.com/n' || page_id::VARCHAR, CASE page_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' ELSE 'body' END FROM pages WHERE url NOT LIKE '%://blog.%'
  UNION ALL SELECT page_id, 3, 'shop' || page_id::VARCHAR || '.org', 'body' FROM pages WHERE page_id % 2 = 0 AND url NOT LIKE '%://blog.%')""")
def annotation_links(spark, sf_dir):
    """Links of annotations and form fields are hyperlinks like those of the page, after them, each with the place of its rectangle."""
    k = F.col("page_id")
    y0 = F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 760.0)
    note = F.struct(F.concat(F.lit("https://acme.com/n"), k.cast("string")).alias("uri"), *(F.lit(None).cast("string").alias(c) for c in ("content", "title", "subject")), y0.alias("y0"), (y0 + 12).alias("y1"))
    field = F.when(k % 2 == 0, F.concat(F.lit("Visit shop"), k.cast("string"), F.lit(".org today")))
    pages = pages_of(spark, sf_dir).where("url NOT LIKE '%://blog.%'").select(k.alias("file_idx"), F.lit(1).alias("page_number"), F.array("url").alias("uris"), F.array(note).alias("annots"), F.array(field).alias("fields"), F.lit(800.0).alias("height"), F.lit("").alias("page_text"), F.array().cast("array<struct<text:string,y0:double,y1:double,size:double>>").alias("spans"))
    found = rows.extract(pages, rows.annotation_occurrences(pages))
    return rows.locate(found, pages).select(F.col("file_idx").alias("page_id"), "seq", "source", "url", "location")


@query("""SELECT page_id, 0 AS ord, url, lower(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), ':', 1)) AS host, 6 AS start, 2 AS n_alone,
  (round_even((page_id % 1000)::DECIMAL(10, 0) / 8, 0))::DOUBLE AS eighth FROM pages""")
def sql_links(spark, sf_dir):
    """A query written in SQL over the registered functions: addresses by LATERAL, how often each stands alone, and a rounding."""
    registry.register(spark)
    # twice in the text, once as the head of a longer address
    text = "concat('Visit ', p.url, ' or ', p.url, ' not ', p.url, '/')"
    return spark.sql(
        f"SELECT p.page_id, u.ord, u.url, u.host, u.start, standalone_count({text}, u.url) AS n_alone, exact_round((p.page_id % 1000) / 8, 0) AS eighth "
        f"FROM {{pages}} p, LATERAL extract_urls({text}) u WHERE u.ord = 0",
        pages=pages_of(spark, sf_dir),
    )


@query("SELECT event_id, format('{:.0f}', value / 8)::DOUBLE AS whole, format('{:.1f}', value / 8)::DOUBLE AS tenth, format('{:.2f}', value / 8)::DOUBLE AS hundredth FROM events")
def exact_rounding(spark, sf_dir):
    """Doubles rounded by their exact values, half to even."""
    x = F.col("value") / 8
    return table(spark, sf_dir, "events").select("event_id", exact_round(x, 0).alias("whole"), exact_round(x, 1).alias("tenth"), exact_round(x, 2).alias("hundredth"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def row_numbers(spark, sf_dir):
    """Numbers without gaps over a whole table in one order."""
    return numbering.number_rows(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "n")


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus || '.pdf' AS file_name, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS new FROM orders)
SELECT o_orderkey, (sum(new) OVER (ORDER BY o_orderkey))::BIGINT AS island, CASE WHEN new = 1 THEN file_name END AS shown FROM m""")
def whole_file_islands(spark, sf_dir):
    """Runs of equal file names over a whole table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(".pdf")).alias("file_name"))
    return report.merge_file_cells(orders, "file_name", ["o_orderkey"]).select("o_orderkey", "island", "shown")


@query("""WITH d AS (SELECT user_id % 50 AS job, event_id AS nth, event_id % 4 AS n_pages, event_type = 'error' AS failed, 1 + event_id % 11 AS n FROM events),
l AS (SELECT job, nth, unnest(range(greatest(1, n - 7), n + 1)) AS i FROM d WHERE NOT failed),
r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY nth DESC, i) AS k FROM l),
n AS (SELECT job, string_agg('a' || nth || '.com/' || i, ' ' ORDER BY k) AS recent FROM r WHERE k <= 10 GROUP BY job)
SELECT job::VARCHAR AS job, files_done, files_failed, pages_scanned, coalesce(recent, '') AS recent FROM (
  SELECT job, count(*) AS files_done, count_if(failed)::BIGINT AS files_failed, coalesce(sum(greatest(n_pages, 1)) FILTER (WHERE NOT failed), 0)::BIGINT AS pages_scanned FROM d GROUP BY job) LEFT JOIN n USING (job)""")
def job_states(spark, sf_dir):
    """Every event is a file that is done, of one of fifty jobs: files done and failed, pages scanned, and the ten newest links."""
    links = F.transform(F.sequence(F.lit(1), (1 + F.col("event_id") % 11).cast("int")), lambda i: F.struct(F.concat(F.lit("a"), F.col("event_id"), F.lit(".com/"), i).alias("url"), i.alias("page"), F.lit("text").alias("source")))
    done = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("job"), F.col("event_id").alias("nth"), (F.col("event_id") % 4).cast("int").alias("n_pages"), F.when(F.col("event_type") == "error", "broken").alias("error"), links.alias("links"))
    return jobs.jobs_done(done).withColumn("recent", F.array_join(F.transform("recent", lambda x: x["url"]), " "))


READ = "f AS (SELECT page_id % 20 AS file_idx, count(*) AS n, page_id % 20 = 3 AS failed FROM pages GROUP BY ALL)"


def _files(spark, sf_dir):
    return pages_of(spark, sf_dir).groupBy((F.col("page_id") % 20).alias("file_idx")).agg(F.count("*").alias("n_pages")).withColumn("error", F.when(F.col("file_idx") == 3, "file3 is broken"))


@query(f"""WITH {RESULTS}, s AS (SELECT {STATS} FROM r), {READ}
SELECT * EXCLUDE (files, pages), (SELECT count(*) FROM f) AS files_done, (SELECT sum(n) FILTER (WHERE NOT failed) FROM f)::BIGINT AS pages_scanned, 30::BIGINT AS files_total, 'verify' AS phase FROM s""")
def job_stats_full(spark, sf_dir):
    """All twelve counts of a job while its links are checked."""
    return report.full_stats(_results(spark, sf_dir), _files(spark, sf_dir), 30, "verify")


@query(f"""WITH {RESULTS}, s AS (SELECT {STATS} FROM r), {READ}, l AS (SELECT * FROM r ORDER BY file_idx DESC, page_number DESC, seq DESC LIMIT 10)
SELECT 'job-1' AS job_id, 'running' AS status, least(8 + (SELECT count(*) FROM f) * 62 // 30, 68)::INT AS progress, 'Reading' AS message, urls_found, working_urls,
  (SELECT string_agg(url, ' ' ORDER BY file_idx DESC, page_number DESC, seq DESC) FROM l) AS recent FROM s""")
def job_snapshot_full(spark, sf_dir):
    """What a client is told of a job that still reads files."""
    told = report.snapshot(_results(spark, sf_dir), _files(spark, sf_dir), "job-1", 30, "extract", "Reading")
    return told.select("job_id", "status", "progress", "message", "stats.urls_found", "stats.working_urls", F.array_join(F.transform("recent", lambda r: r["url"]), " ").alias("recent"))


BOX = "l_orderkey, l_linenumber, (l_partkey % 90)::DOUBLE AS x0, (l_suppkey % 90)::DOUBLE AS y0, l_partkey % 90 + l_quantity::DOUBLE AS x1, l_suppkey % 90 + 20.0::DOUBLE AS y1"


def _lines(spark, sf_dir):
    x, y = F.col("l_partkey") % 90, F.col("l_suppkey") % 90
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", boxes.box(x, y, x + F.col("l_quantity"), y + 20.0).alias("box"))


@query(f"""WITH b AS (SELECT {BOX}, (x1 - x0) * (y1 - y0) AS area FROM lineitem), p AS (SELECT l_orderkey, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area}}) AS placed FROM b WHERE l_linenumber = 1 GROUP BY l_orderkey)
SELECT b.l_orderkey, b.l_linenumber, len(list_filter(coalesce(placed, []), lambda p: greatest(0.0, least(p.x1, x1) - greatest(p.x0, x0)) * greatest(0.0, least(p.y1, y1) - greatest(p.y0, y0)) >= 0.45 * least(area, p.area)
  OR CASE WHEN area <= p.area THEN (x0 + x1) / 2 BETWEEN p.x0 AND p.x1 AND (y0 + y1) / 2 BETWEEN p.y0 AND p.y1 ELSE (p.x0 + p.x1) / 2 BETWEEN x0 AND x1 AND (p.y0 + p.y1) / 2 BETWEEN y0 AND y1 END
  OR greatest(0.0, least(p.x1, x1) - greatest(p.x0, x0)) * greatest(0.0, least(p.y1, y1) - greatest(p.y0, y0)) / greatest(1.0, area) >= 0.72)) > 0 AS found,
  greatest(1.8, least(14.0, 480.0 / greatest(1.0, least(x1 - x0, y1 - y0))))::DOUBLE AS zoom FROM b LEFT JOIN p USING (l_orderkey) WHERE l_linenumber > 1""")
def already_found(spark, sf_dir):
    """Whether a code of an order's first line lies where another line's region is, so that it need not be read again; and how far to enlarge that region."""
    own = _lines(spark, sf_dir)
    placed = own.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.collect_list("box").alias("placed"))
    asked = own.where("l_linenumber > 1").join(placed, "l_orderkey", "left").withColumn("placed", F.coalesce("placed", F.slice(F.array("box"), 1, 0)))
    zoom = meta.region_zoom(boxes.width(F.col("box")), boxes.height(F.col("box")))
    return asked.select("l_orderkey", "l_linenumber", boxes.already_found(F.col("box"), F.col("placed")).alias("found"), zoom.alias("zoom"))


@query(f"""WITH b AS (SELECT {BOX}, l_suppkey % 7 AS n, (x1 - x0) * (y1 - y0) AS area FROM lineitem), o AS (SELECT * FROM b WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY x0, y0, x1, n) = 1)
SELECT b.l_orderkey, b.l_linenumber, b.x0, b.y0, b.x1, b.n, CASE WHEN (greatest(1.0, b.area) < 0.85 * greatest(1.0, o.area) AND b.n > 0) OR b.n > o.n THEN 'new' ELSE 'old' END AS better FROM b JOIN o USING (l_orderkey) WHERE b.l_linenumber > 1""")
def preferred_hit(spark, sf_dir):
    """Of an order's first reading and each other one, which shows the code better."""
    own = _lines(spark, sf_dir).withColumn("n", F.col("l_suppkey") % 7)
    hit = lambda name: F.struct(F.lit(name).alias("payload"), F.expr("cast(repeat('x', cast(n as int)) as binary)").alias("png"), F.col("box"))
    first = own.where("l_linenumber = 1").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("box.x0", "box.y0", "box.x1", "n"))).where("k = 1").select("l_orderkey", hit("old").alias("old"))
    both = own.where("l_linenumber > 1").select("l_orderkey", "l_linenumber", "box", "n", hit("new").alias("new")).join(first, "l_orderkey")
    return both.select("l_orderkey", "l_linenumber", "box.x0", "box.y0", "box.x1", "n", boxes.prefer_hit(F.col("old"), F.col("new"))["payload"].alias("better"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'qr' ELSE 'image' END AS source, CASE page_id % 3 WHEN 0 THEN '{"pay": ' || page_id || '}' WHEN 1 THEN 'https://acme.com/p' || page_id ELSE 'upi://pay?pa=' || page_id END AS url
FROM pages UNION ALL SELECT page_id, 'qr', 'no link' FROM pages WHERE page_id % 2 = 0""")
def final_filter(spark, sf_dir):
    """The last filter over rows that callers add: codes and payment links as they are, other rows cleaned once more, and gone where they are no links."""
    k = F.col("page_id")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"pay": '), k, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit("https://acme.com/p"), k, F.lit(".)"))).otherwise(F.concat(F.lit("upi://pay?pa="), k))
    own = pages_of(spark, sf_dir).select("page_id", F.when(k % 3 == 0, "qr").otherwise("image").alias("source"), text.alias("url"))
    more = pages_of(spark, sf_dir).select("page_id", F.when(k % 2 == 0, "qr").otherwise("image").alias("source"), F.lit("no link").alias("url"))
    return rows.keep_final(own.unionByName(more))


@query("SELECT l_orderkey, l_linenumber, greatest(1.8, least(3.2, 3000 / greatest(100 + l_quantity::DOUBLE * 30, 400.0 + l_suppkey % 900)))::DOUBLE AS zoom FROM lineitem")
def page_zooms(spark, sf_dir):
    """How far pages of some sizes are enlarged before they are read."""
    wide, high = 100 + F.col("l_quantity") * 30, 400.0 + F.col("l_suppkey") % 900
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", meta.page_zoom(wide, high).alias("zoom"))


KINDS = ("picture", "decoded", "chunk", "finder", "drawing", "unique", "other")


@query("""WITH t AS (SELECT user_id, event_id AS ord, (['picture', 'decoded', 'chunk', 'finder', 'drawing', 'unique', 'other'])[(event_id % 7 + 1)::INT] AS kind FROM events)
SELECT user_id, ord, kind, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ord) AS rank FROM t)
WHERE rank <= CASE kind WHEN 'picture' THEN 120 WHEN 'decoded' THEN 8 WHEN 'chunk' THEN 6 WHEN 'finder' THEN 4 WHEN 'drawing' THEN 4 WHEN 'unique' THEN 6 ELSE 0 END""")
def page_caps(spark, sf_dir):
    """The first things of each kind on a page, as many as are looked at."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 7 + 1).cast("int"))
    return boxes.first_of(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), kind.alias("kind")), ["user_id"])


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'Cannot reach the server.' WHEN 'click' THEN 'Upload failed' ELSE event_type || ' failed' END AS message FROM events""")
def user_messages(spark, sf_dir):
    kind = F.col("event_type")
    error = F.when(kind == "error", "TypeError: Failed to fetch").when(kind == "click", "").otherwise(F.concat(kind, F.lit(" failed")))
    return table(spark, sf_dir, "events").select("event_id", report.user_message(error, "Upload failed").alias("message"))
