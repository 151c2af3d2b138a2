"""Golden cases of the link and metadata functions."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import meta, urls

FOUND = {
    "www.acmebank.com.Step 1": ["www.acmebank.com"],
    "DICK'S.com/ScoreCardTerms": ["DICKS.com/ScoreCardTerms"],
    "DICKS . com / ScoreCard": ["DICKS.com/ScoreCard"],
    "information.contact": [],
    "linea.de": [],
    "https://linea.de": ["https://linea.de"],
    "see acme.com and acme.com": ["acme.com", "acme.com"],
    "bob@acme.com": [],
    "Total.COM": [],
    "https://foo.in": [],
    "http://192.168.1.1/x": ["http://192.168.1.1/x"],
    "https://acme.com/v1.2": ["https://acme.com/v1"],
    "https://acme.com?x=1": [],
    "https://blog.example.com/a": ["example.com/a"],
    "Visit https://acme.com/ for details": ["https://acme.com/for"],
    "https://acme.com/info.html.": ["https://acme.com/info"],
    "(https://acme.com/pay).": ["https://acme.com/pay"],
    "www.acme.co.uk/x, www.acme.org": ["www.acme.co.uk/x", "www.acme.org"],
    "https://acme.berlin/x": ["https://acme.berlin/x"],
    "from acme.supply and www.acme.co.casa": ["acme.supply", "www.acme.co.casa"],
    "https://my-rings.acme.diamonds": ["https://my-rings.acme.diamonds"],
    "acme.airforce:8080/x": ["acme.airforce:8080/x"],
    "acme.com/doc1.Apples.Pears.Plums.Cherries": ["acme.com/doc1"],
    "www.acme.com/doc1" + ".Plum" * 40: ["www.acme.com/doc1"],
    "": [],
    "no link here": [],
}


def test_extracted_links(spark):
    df = spark.createDataFrame([(k,) for k in FOUND], "t string")
    got = {r.t: r.u for r in df.select("t", F.transform(urls.extract_urls(F.col("t")), lambda x: x["url"]).alias("u")).collect()}
    assert got == FOUND


def test_ports_and_queries_before_the_path(spark):
    cases = {"acme.com?x=/y": "acme.com/y?x=", "https://acme.com:80/x": "https://acme.com:80/x", "https://acme.com:pay/x": "https://acme.com/x", "acme.com#a/b": "acme.com/b#a", "mailto:a@b.com": "mailto:a@b.com", "https://acme.com/x?u=http://b.org:a/c": "https://acme.com/x?u=http://b.org:a/c"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", urls.clean(F.col("u")).alias("c")).collect()} == cases


def test_thousands_of_labels_in_one_token(spark):
    """A frame of the stack for each label would end the executor."""
    n = 5000
    found = {"see " + "ab1.x2-y." * n + "com now": [], "foo.com" + ".zzz" * n: ["foo.com"], "see a" + ".1" * n + ".com now": [], "foo.com/x" + ".5%" * n: ["foo.com/x"], "acme.foo.7x.c1.d_": ["acme.foo"]}
    df = spark.createDataFrame([(k,) for k in found], "t string")
    assert {r.t: r.u for r in df.select("t", urls.urls_in(F.col("t")).alias("u")).collect()} == found


def test_null_text_has_no_links(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(F.explode(urls.extract_urls(F.col("t")))).count() == 0


def test_starts_are_places_in_the_sanitised_text(spark):
    df = spark.createDataFrame([("pay at acme.com/a or www.acme.org today",)], "t string")
    row = df.select(urls.sanitize(F.col("t")).alias("s"), urls.extract_urls(F.col("t")).alias("u")).first()
    assert [row.s[x.start : x.start + len(x.url)] for x in row.u] == [x.url for x in row.u] == ["acme.com/a", "www.acme.org"]


def test_recognised_text(spark):
    df = spark.createDataFrame([("visit jcp.corn/now",), ("dsg.syl.com",)], "t string")
    fixed = df.select(urls.repair_ocr(F.col("t")).alias("r"), urls.snap_host(F.col("t"), F.array().cast("array<string>"), {"syl": "syf"}).alias("s")).collect()
    assert fixed[0].r == "visit jcp.com/now" and fixed[1].s == "dsg.syf.com"


@pytest.mark.parametrize(("name", "date", "last4"), [("09-02-26 5560531101016173.pdf", "09-02-26", "6173"), ("01-02-2024 1234.pdf", "01-02-2024", "1234"), ("01-02-2024123.pdf", "01-02-20", "4123"), ("ab12.pdf", "", "12"), ("statement.pdf", "", "")])
def test_file_names(spark, name, date, last4):
    row = spark.createDataFrame([(name,)], "n string").select(meta.file_date(F.col("n")), meta.file_last4(F.col("n"))).first()
    assert tuple(row) == (date, last4)


@pytest.mark.parametrize(("text", "client", "form"), [("5433 3662 A2J", "5433", "A2J"), ("6709 / HJJ", "6709", "HJJ"), ("2024 ABC 6709 HJJ", "6709", "HJJ"), ("OFF 1234 x", "1234", "OFF"), ("", "", "")])
def test_footer_ids(spark, text, client, form):
    row = spark.createDataFrame([(text,)], "t string").select(meta.footer_ids(F.col("t")).alias("x")).first().x
    assert (row.client_id, row.form_type) == (client, form)


def test_default_ports_go(spark):
    cases = {"https://A.com:443/x": "https://a.com/x", "http://a.com:80": "http://a.com", "http://a.com:443/": "http://a.com:443/", "https://a.com:4433/": "https://a.com:4433/"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.s for r in df.select("u", urls.strip_default_port(F.col("u")).alias("s")).collect()} == cases


def test_dots_are_decided_by_the_labels_beside_them(spark):
    cases = {
        "acme . com": "acme.com", "Visit acme.com. Then": "Visit acme.com. Then", "see acme. the end": "see acme. the end", "acme.com.The next": "acme.com. The next",
        "the . acme": "the . acme", "a1 .\n b2": "a1.b2", "x" + " " * 60 + ".com": "x" + " " * 60 + ".com", ". com": ". com", "one. .two": "one. .two", "www . acme . co.uk": "www.acme.co.uk",
        "a.": "a.", "...": "...", "": "", "my-com.in x": "my-com.in x", "l'été.com": "l'été.com".replace("'", ""),
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t, r.s) for r in df.select("t", "want", urls.sanitize(F.col("t")).alias("s")).collect() if r.s != r.want] == []


def test_standing_links_equal_a_pattern():
    import random
    import re

    from linkloom.operators.rows import standing

    r = random.Random(2)
    links = ["a.com", "a.com/x", "b.org", "a.com/x/y", "é.fr", "com"]
    for _ in range(300):
        text = "".join(r.choice([*links, " ", "/", ".", "é", "1", "-", ",", "²", "़"]) for _ in range(r.randint(0, 30)))
        want = [sum(1 for m in re.finditer(re.escape(x), text) if not (m.start() and (text[m.start() - 1] in "./@_-" or text[m.start() - 1].isalnum())) and text[m.end() : m.end() + 1] != "/") for x in links]
        assert standing(text, links) == want
    assert standing(None, ["a"]) == [0] and standing("a", []) == [] and standing("a", [""]) == [0]


def test_no_link_is_lost_before_it_is_cleaned(spark):
    """Only matches without a scheme and without a whole label that is a top-level domain are left out before cleaning."""
    tails = ["", ".Step", ".5", ".net.5", "/a.pdf", ":8080/x", ":x/y", ".The", ".co.uk.Now", "-x.example.net", "?q=1", "/Total", ".foo.bar", ".co.KR"]
    tokens = [f"{h}{t}" for h in ("acme.com", "ACME.Com", "acme.corn", "foo.Bar", "https://1.2.3.4", "https://acme.zzz", "blog.acme.in", "shop.co.uk", "a.KIM") for t in tails]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    every = F.filter(F.transform(F.regexp_extract_all("t", F.lit(urls.ADDRESS), 0), lambda m: F.struct(m.alias("m"), urls.clean(m).alias("u"))), lambda x: urls.looks_like_url(x["u"]) & ~F.coalesce(F.substr(x["m"], F.char_length(x["u"]) + 1).rlike("^/[A-Za-z0-9]"), F.lit(False)))
    got = df.select("t", F.transform(urls._judged(F.col("t"), ()), lambda x: x["url"]).alias("got"), F.transform(every, lambda x: x["u"]).alias("want")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got] and sum(len(r.got) for r in got) > 40
