"""Row algebra, status and report on small fixtures."""

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import functions as F

from linkloom.__main__ import main
from linkloom.operators import report, rows, status
from linkloom.sources import files, workbook
from linkloom.streaming import progress

ROW = "file_idx int, page_number int, seq int, source string, url string"


def kept(df):
    return [(r.url, r.source) for r in df.orderBy("file_idx", "page_number", "seq").collect()]


def made(spark, *items):
    return spark.createDataFrame([(0, 1, k, s, u) for k, (u, s) in enumerate(items)], ROW)


def test_cap(spark):
    assert kept(rows.cap_occurrences(made(spark, ("A", "hyperlink"), ("a", "text"), ("a", "text")))) == [("A", "hyperlink"), ("a", "text")]
    every = (("a", "text"), ("a", "image"), ("a", "image"), ("a", "qr"))
    assert kept(rows.cap_occurrences(made(spark, *every))) == list(every)


def test_embedded_hosts(spark):
    pages = spark.createDataFrame([(0, 1, "acme.com/pay only")], "file_idx int, page_number int, page_text string")
    assert kept(rows.drop_embedded_hosts(made(spark, ("acme.com", "image"), ("acme.com/pay", "text")), pages)) == [("acme.com/pay", "text")]
    both = (("acme.com", "text"), ("https://acme.com/pay", "text"))
    assert kept(rows.drop_embedded_hosts(made(spark, *both), pages)) == list(both)
    alone = spark.createDataFrame([(0, 1, "acme.com or acme.com/pay")], "file_idx int, page_number int, page_text string")
    assert len(kept(rows.drop_embedded_hosts(made(spark, ("acme.com", "text"), ("acme.com", "image"), ("acme.com/pay", "text")), alone))) == 2


def test_places_of_links(spark):
    span = "array<struct<text:string,size:double,x0:double,y0:double,x1:double,y1:double>>"
    pages = spark.createDataFrame([(0, 1, 100.0, [("go a.com", 9.0, 0.0, 1.0, 5.0, 9.0), ("x", 8.0, 0.0, 50.0, 5.0, 60.0), ("A.com", 7.0, 0.0, 90.0, 5.0, 99.0)])], f"file_idx int, page_number int, height double, spans {span}")
    got = rows.locate(made(spark, ("a.com", "text"), ("a.com", "text"), ("a.com", "text")), pages).orderBy("seq").collect()
    assert [(r.location, r.font_size) for r in got] == [("header", 9.0), ("footer", 7.0), ("body", 7.0)]


PROBES = [
    ("a", [(0, True, 404, None)], "Working"), ("b", [(0, False, 404, None)], "Not Working- error 404"), ("c", [(0, True, 503, None)], "Not Working- error 503"),
    ("d", [(0, False, None, "read timed out"), (1, False, None, "timed out")], "Not Working- error Timeout port 443"),
    ("e", [(0, False, 503, None), (1, False, None, "timed out")], "Not Working- error 503"), ("f", [(0, True, None, "SSLError")], "Working"),
    ("g", [(0, False, None, "SSLError")], "Not Working- error SSL Error port 443"), ("h", [(0, False, 500, None), (1, False, 200, None)], "Working"),
]


def test_status(spark):
    probes = spark.createDataFrame([(k, pos, f"https://{k}", dns, code, e) for k, ps, _ in PROBES for pos, dns, code, e in ps], "url_key string, pos int, candidate string, dns_ok boolean, http_code int, error_text string")
    own = spark.createDataFrame([(k.upper(),) for k, _, _ in PROBES] + [("upi://x",), ("ftp://acme.com/x",), ("",), ("z",)], "url string")
    got = {r.url: r.status for r in status.attach_status(own, probes).collect()}
    assert got == {k.upper(): s for k, _, s in PROBES} | {"upi://x": "Working", "ftp://acme.com/x": "Not Working- error FTP URLs are not HTTP-checked", "": "", "z": "Not Working- error Empty URL"}


def test_unusable_port_fails_only_its_row(spark):
    assert spark.createDataFrame([("https://a.com:99999/x",)], "u string").select(status.error_text(F.lit("Timeout"), F.col("u"), F.lit(None).cast("int"))).first()[0] == "Not Working- error Timeout"


def test_empty_results(spark):
    none = spark.createDataFrame([], "file_idx int, file_name string, page_number int, seq int, source string, location string, url string, status string")
    assert report.job_stats(none).first().urls_found == 0
    assert report.preview(none).count() == 0


def test_workbook(spark):
    df = spark.createDataFrame([("f.pdf", 2, "x<y"), ("f.pdf", 1, None), ("g.pdf", 1, "0012")], "Filename string, seq int, URL string")
    books = {(r.Filename, r.part): r for r in workbook.workbooks(df, "Filename", ["seq"], rows_per_book=1).collect()}
    assert sorted(books) == [("f.pdf", 0), ("f.pdf", 1), ("g.pdf", 0)]
    sheet = zipfile.ZipFile(io.BytesIO(books["f.pdf", 1].content)).read("xl/worksheets/sheet1.xml").decode()
    assert "x&lt;y" in sheet


def test_discovery(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.file_name for r in files.discover(spark, str(tmp_path)).orderBy("file_idx").collect()] == ["a.pdf", "b.pdf"]


WHOLE_PAGE = """<html><head><style>a{b:url(style.com/x)}</style><script>var x = "https://script.com/x";</script></head><body><!-- https://hidden.com/x -->
<nav><a href="/about">About</a><a class=x href='http://nav.com/a?x=1&amp;y=2'>Go</a><a href=//cdn.com/lib title="a > b">Lib</a><a data-href="https://data.com/x">D</a></nav>
<article><p>Read www.body.com/doc, or mail bob@mail.com.</p><p>This ends here.</p><ul><li>list.com/one</li><li>www.bo<b>ld.org</b>/two</li></ul><p>Slash &#104;ttps://glue.com/</p><p>After it caf&eacute;.com</p></article>
<footer>&copy; first.com</footer><footer>second.com</footer></body></html>"""


def test_links_of_whole_web_pages(spark):
    pages = spark.createDataFrame([(1, "https://own.com/p", WHOLE_PAGE), (2, "https://bare.com/p", "acme.com/a"), (3, "https://none.com/p", None)], "page_id int, url string, html string")
    got = {}
    for r in rows.extract(files.html_pages(pages)).orderBy("file_idx", "seq").collect():
        got.setdefault((r.file_idx, r.source), []).append(r.url)
    assert got == {
        (1, "hyperlink"): ["https://own.com/p", "http://nav.com/a?x=1&y=2", "https://cdn.com/lib"],
        (1, "text"): ["www.body.com/doc", "list.com/one", "www.bold.org/two", "https://glue.com/", "first.com", "second.com"],
        (2, "hyperlink"): ["https://bare.com/p"], (2, "text"): ["acme.com/a"], (3, "hyperlink"): ["https://none.com/p"],
    }


def test_stream_of_pages(spark, sf_dir, tmp_path):
    pages = files.html_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    pages.write.parquet(str(tmp_path / "in"))
    stream = progress.links_per_source(progress.page_stream(spark, str(tmp_path / "in"), pages.schema))
    q = stream.writeStream.format("memory").queryName("links").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.source: r.n_urls for r in spark.table("links").collect()} == {"hyperlink": 38, "text": 50}


def test_sheet_is_merged_coloured_and_holds_pictures():
    picture = workbook.png_bytes(np.full((401, 300, 3), 7, np.uint8))
    assert struct.unpack(">II", picture[16:24]) == (100, 134)  # the last block of lines is a part of one
    columns = ["Filename", "Client ID", "QR Code Attachment", "URL", "Status"]
    rows = [("a.pdf", "0012", "", "x.com", "Working"), ("a.pdf", "0012", "", "<y>", "Not Working- error 404"), ("b.pdf", "0013", "", "z.com", "")]
    with zipfile.ZipFile(io.BytesIO(workbook.book_bytes(columns, rows, [None, picture, None]))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    for name, content in parts.items():
        if not name.endswith(".png"):
            ElementTree.fromstring(content)
    assert parts["xl/media/p1.png"] == picture
    sheet = parts["xl/worksheets/sheet1.xml"].decode()
    assert re.findall('<mergeCell ref="(.*?)"', sheet) == ["A2:A3", "B2:B3"]
    assert '<autoFilter ref="A1:E4"/>' in sheet and sheet.count('s="2"') == sheet.count('s="3"') == 1
    assert sheet.count(">a.pdf<") == 1 and ">0012<" in sheet and ">&lt;y&gt;<" in sheet
    assert b"<xdr:row>2</xdr:row>" in parts["xl/drawings/drawing1.xml"] and b"<xdr:col>2</xdr:col>" in parts["xl/drawings/drawing1.xml"]


def test_command_line(spark, sf_dir, tmp_path, capsys):
    main([f"{sf_dir}/pages.parquet", str(tmp_path / "out")])
    said = capsys.readouterr().out.splitlines()
    assert said[-1].endswith("site(s), 0 working") and " URL(s) across " in said[0]
    links = spark.read.parquet(str(tmp_path / "out/links"))
    assert said[-1].startswith(f"{links.count()} URL(s) on {links.select('page_number').distinct().count()} page(s)")
    books = spark.read.parquet(str(tmp_path / "out/workbooks"))
    assert books.agg(F.sum("n_rows")).first()[0] == links.count()
