"""Finders and regions against plain versions of their rules, and the hyperlinks that annotations hold."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkloom.operators import finders, regions, rows
from linkloom.plans import scan


def stamp(picture, x, y, u):
    ring = np.array([[1] * 7, [1, 0, 0, 0, 0, 0, 1], [1, 0, 1, 1, 1, 0, 1], [1, 0, 1, 1, 1, 0, 1], [1, 0, 1, 1, 1, 0, 1], [1, 0, 0, 0, 0, 0, 1], [1] * 7])
    picture[y : y + 7 * u, x : x + 7 * u] = np.kron(ring, np.ones((u, u), int))


def dark_of(spark, pictures):
    return spark.createDataFrame([(k, int(x), int(y)) for k, p in enumerate(pictures) for y, x in zip(*np.nonzero(p), strict=True)], "pic int, x int, y int")


def test_three_finders_make_one_box(spark):
    whole, noise, lone = np.zeros((120, 120), int), np.zeros((120, 120), int), np.zeros((120, 120), int)
    for x, y in ((20, 20), (70, 20), (20, 70)):
        stamp(whole, x, y, 2)
    noise[::2, :] = 1  # rows alone hold no pattern
    stamp(lone, 40, 40, 2)
    lone[40:54, 52:60] = 1  # the row through it is spoilt
    got = finders.locate(dark_of(spark, [whole, noise, lone]), ["pic"], 120, 120).collect()
    # median unit 2, so a margin of 16 around the centres: 27 and 77 across; 26 and 76 down, the means of the even rows
    assert [(r.pic, r.rank) for r in got] == [(0, 1)]
    b = got[0].box
    assert (b.x0, b.y0, b.x1, b.y1) == (11.0, 10.0, 93.0, 92.0)


def test_patterns_across_blocks_of_places(spark):
    """A finder whose run of places crosses the edge of a block is confirmed as any other."""
    for x in range(finders.BLOCK - 15, finders.BLOCK + 2, 3):
        p = np.zeros((160, 160), int)
        stamp(p, x, x, 2)
        claim = spark.createDataFrame([(0, x + 7.0, x + 7.0, 2.0)], "pic int, x double, y double, unit double")
        assert finders.confirmed(claim, dark_of(spark, [p]), ["pic"]).count() == 1
        assert finders.confirmed(claim.withColumn("unit", F.lit(9.0)), dark_of(spark, [p]), ["pic"]).count() == 0


def test_groups_depend_on_the_order_and_any_member(spark):
    def groups(found):
        out = []
        for f in found:
            for g in out:
                if any(8 * max(1, f[2], o[2]) < ((f[0] - o[0]) ** 2 + (f[1] - o[1]) ** 2) ** 0.5 <= 72 * max(1, f[2], o[2]) for o in g):
                    g.append(f)
                    break
            else:
                out.append([f])
        return out

    r = random.Random(6)
    found = [[(float(r.randint(0, 400)), float(r.randint(0, 400)), r.choice([0.5, 1.0, 2.0])) for _ in range(r.randint(1, 9))] for _ in range(40)]
    df = spark.createDataFrame([(k, [tuple(f) for f in fs]) for k, fs in enumerate(found)], "k int, f array<struct<x:double,y:double,unit:double>>")
    got = {r.k: [[tuple(f) for f in g] for g in r.g] for r in df.select("k", finders.group_finders(F.col("f")).alias("g")).collect()}
    assert got == {k: groups(fs) for k, fs in enumerate(found)}


def test_equal_boxes_keep_their_order_and_empty_input(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 2.0, 9.0), (5.0, 5.0, 7.0, 7.0), (0.0, 0.0, 9.0, 2.0)],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [tuple(b) for b in df.select(finders.by_area(F.col("b")).alias("b")).first().b] == [(5.0, 5.0, 7.0, 7.0), (0.0, 0.0, 2.0, 9.0), (0.0, 0.0, 9.0, 2.0)]
    assert finders.locate(spark.createDataFrame([], "pic int, x int, y int"), ["pic"], 50, 50).count() == 0


def test_regions(spark):
    box = "page int, ord int, box struct<x0:double,y0:double,x1:double,y1:double>"
    marks = [(0, k, (10.0 * (k % 5) + 1, 10.0 * (k // 5) + 201, 10.0 * (k % 5) + 12, 10.0 * (k // 5) + 212)) for k in range(25)]  # a code of small marks, each over several cells
    drawn = [*marks, (0, 30, (300.0, 300.0, 400.0, 400.0)), (0, 31, (302.0, 302.0, 401.0, 401.0)), (0, 32, (0.0, 0.0, 600.0, 3.0)), (0, 33, (500.0, 500.0, 512.0, 512.0)), (0, 8001, (100.0, 600.0, 200.0, 700.0)), (1, 0, None)]
    got = [(r.rank, tuple(r.box)) for r in regions.drawing_regions(spark.createDataFrame(drawn, box), "page").orderBy("rank").collect()]
    # the large square first, its near copy is covered; the lone mark has four cells; the long rule is no square
    assert got == [(1, (300.0, 300.0, 400.0, 400.0)), (2, (0.0, 200.0, 60.0, 260.0))]


def test_annotations_are_hyperlinks(spark):
    schema = "file_idx int, page_number int, page_text string, uris array<string>, annots array<struct<uri:string,content:string,title:string,subject:string,y0:double,y1:double>>, fields array<string>, height double, spans array<struct<text:string,y0:double,y1:double,size:double>>"
    note = ("https://acme.com/a", "see shop.org", None, "", 5.0, 20.0)
    pages = spark.createDataFrame([(0, 1, "Visit acme.com/a now", ["https://acme.com/a"], [note, (None, None, None, None, None, None)], ["x.net/form", None], 800.0, []), (0, 2, None, None, None, None, None, None)], schema)
    found = rows.extract(pages, rows.annotation_occurrences(pages))
    got = [(r.seq, r.source, r.url, r.location) for r in rows.locate(found, pages).orderBy("page_number", "seq").collect()]
    # the hyperlink stands twice, once for the page's own link and once for the note
    assert got == [(1, "hyperlink", "https://acme.com/a", "body"), (2, "text", "acme.com/a", "body"), (3, "hyperlink", "https://acme.com/a", "header"), (4, "hyperlink", "shop.org", "header"), (5, "hyperlink", "x.net/form", "body")]


def test_runs_meet_across_blocks_of_bits(spark):
    r = random.Random(3)
    places = {(k, x) for k in range(6) for a in r.sample(range(-200, 400), 9) for x in range(a, a + r.choice([1, 2, 31, 32, 33, 64, 130]))}
    want = sorted((k, x, next(n for n in range(1, 999) if (k, x + n) not in places)) for k, x in places if (k, x - 1) not in places)
    dark = spark.createDataFrame([*places, *list(places)[:50], (0, None)], "y int, x int")
    assert sorted((r.y, r.start, r.length) for r in finders.dark_runs(dark, ["y"], "x").collect()) == want


def test_dark_places_are_never_broadcast(spark):
    """Places are exploded from few rows, so Spark takes them for small; broadcast, they would fill the driver."""
    drawn = spark.range(3).select(F.col("id").alias("pic"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(9))))
    claim = spark.createDataFrame([(0, 7.0, 7.0, 2.0)], "pic long, x double, y double, unit double")
    for df in (finders.confirmed(claim, drawn, ["pic"]), finders.locate(drawn, ["pic"], 50, 50)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pictures_that_are_dealt_out_are_shuffled_once(spark):
    """Of what is drawn, not of its places: hundreds of these for each thing would fill the disks."""
    r = random.Random(8)
    things = [(k, r.randint(0, 90), r.randint(0, 90), r.choice([2, 3])) for k in range(4) for _ in range(5)]
    drawn = finders.by_picture(spark.createDataFrame(things, "pic long, x0 int, y0 int, u int"), ["pic"])
    side = lambda: F.explode(F.sequence(F.lit(0), F.col("u") * 7 - 1))
    ring = lambda c: F.abs(F.floor(F.col(c) / F.col("u")) - 3)
    dark = drawn.withColumn("i", side()).withColumn("j", side()).where(F.greatest(ring("i"), ring("j")) != 2).select("pic", (F.col("x0") + F.col("i")).alias("x"), (F.col("y0") + F.col("j")).alias("y"))
    claims = drawn.select("pic", (F.col("x0") + 3.5 * F.col("u")).alias("x"), (F.col("y0") + 3.5 * F.col("u")).alias("y"), F.col("u").cast("double").alias("unit"))
    for found in (finders.confirmed(claims, dark, ["pic"]), finders.locate(dark, ["pic"], 120, 120)):
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0
    # the same as of places that come in no order, some without a row or a column, and of claims some of which have no place
    holes = spark.createDataFrame([(0, None, 9), (0, 9, None), (None, 9, 9)], "pic long, x int, y int")
    loose = spark.createDataFrame([*map(tuple, dark.collect())], "pic long, x int, y int").unionByName(holes)
    asked = spark.createDataFrame([*map(tuple, claims.collect()), (0, None, 9.0, 2.0), (0, 9.0, None, 2.0), (None, 9.0, 9.0, 2.0), (0, 9.0, 9.0, None)], claims.schema)
    want = sorted(map(tuple, finders.confirmed(claims, dark, ["pic"]).collect()))
    assert want and want == sorted(map(tuple, finders.confirmed(asked, loose, ["pic"]).collect()))
    assert sorted(finders.locate(dark, ["pic"], 120, 120).collect()) == sorted(finders.locate(loose.where("pic is not null"), ["pic"], 120, 120).collect())


def test_the_queries_on_events_shuffle_only_events(spark, sf_dir):
    for name in ("finder_confirmed", "finder_boxes"):
        plan = scan.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_a_light_middle_is_no_finder(spark):
    """Places inside a pattern of either axis that are not dark themselves."""
    p = np.zeros((40, 40), int)
    stamp(p, 8, 8, 2)
    claims = spark.createDataFrame([(0, float(x), float(y), 2.0) for x in range(6, 24) for y in range(6, 24)], "pic int, x double, y double, unit double")
    got = {(int(r.x), int(r.y)) for r in finders.confirmed(claims, dark_of(spark, [p]), ["pic"]).collect()}
    both = [x for x in range(8, 22) if p[15, x]]
    middle = range(12, 18)  # rows and columns through the middle square have the pattern
    assert got == {(x, y) for x in middle for y in middle if p[y, x] and x in both}
