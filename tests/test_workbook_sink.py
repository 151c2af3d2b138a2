"""Workbooks as a sink: split by size, committed as a whole, nothing left by jobs that fail."""

import io
import re
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.sources import workbook


def cells(path):
    with zipfile.ZipFile(io.BytesIO(Path(path).read_bytes())) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    return [re.findall(r"<t [^>]*>([^<]*)</t>", row) for row in re.findall(r"<row.*?</row>", sheet)]


@pytest.fixture
def results(spark):
    rows = [("big.pdf", k, f"a{k}.com") for k in range(25)] + [("other/x.pdf", 1, "b.com"), ("other_x.pdf", 1, "c.com"), (None, 1, "d.com")]
    return spark.createDataFrame(rows, "Filename string, seq int, URL string").repartition(5)


def test_files_are_split_by_size_and_in_order(results, tmp_path):
    out = str(tmp_path / "books")
    workbook.write_workbooks(results, out, "Filename", ["seq"], rows_per_book=10)
    found = sorted(p.name for p in Path(out).iterdir())
    assert len(found) == 6 and all(n.endswith(".xlsx") for n in found)
    big = [cells(f"{out}/{n}")[1:] for n in found if n.startswith("big.pdf")]
    assert [len(b) for b in big] == [10, 10, 5]
    assert [r[1] for b in big for r in b] == [f"a{k}.com" for k in range(25)]
    same = workbook.workbooks(results, "Filename", ["seq"], rows_per_book=10).select("Filename", "part", "n_rows").collect()
    assert sorted((str(r.Filename), r.part, r.n_rows) for r in same) == [("None", 0, 1), ("big.pdf", 0, 10), ("big.pdf", 1, 10), ("big.pdf", 2, 5), ("other/x.pdf", 0, 1), ("other_x.pdf", 0, 1)]


def test_failed_jobs_leave_no_file(results, tmp_path):
    out = tmp_path / "books"
    broken = results.withColumn("URL", F.when(F.col("Filename").startswith("other/"), F.raise_error(F.lit("lost"))).otherwise(F.col("URL")))
    with pytest.raises(Exception, match="lost"):
        workbook.write_workbooks(broken, str(out), "Filename", ["seq"], rows_per_book=10)
    assert not out.exists() or not list(out.iterdir())


def test_a_task_that_fails_while_it_writes(spark, results, tmp_path, monkeypatch):
    out = tmp_path / "books"
    # a mark that no sheet can hold is met after other workbooks of the task are written
    rows = workbook._parts(results, "Filename", ["seq"], 10).coalesce(1).sortWithinPartitions(F.desc("Filename"), "__part", "__n")
    spark.dataSource.register(workbook.WorkbookSource)
    options = {"path": str(out), "by": "Filename", "columns": "\x1f".join(["Filename", "no such column"])}
    with pytest.raises(Exception, match="no such column"):
        rows.write.format("workbook").options(**options).mode("append").save()
    assert not out.exists() or not list(out.iterdir())


def test_modes(results, tmp_path):
    out = str(tmp_path / "books")
    workbook.write_workbooks(results.where("Filename = 'big.pdf'"), out, "Filename", ["seq"])
    workbook.write_workbooks(results.where("Filename = 'other_x.pdf'"), out, "Filename", ["seq"])
    assert len(list(Path(out).iterdir())) == 2
    workbook.write_workbooks(results.where("Filename = 'other_x.pdf'"), out, "Filename", ["seq"], mode="overwrite")
    assert [p.name[:11] for p in Path(out).iterdir()] == ["other_x.pdf"]
    workbook.write_workbooks(results.limit(0), out, "Filename", ["seq"])
    assert len(list(Path(out).iterdir())) == 1


def test_small_pictures_keep_their_edges():
    picture = np.zeros((401, 7), np.uint8)
    picture[-1] = 255
    png = workbook.png_bytes(picture)
    assert int.from_bytes(png[16:20], "big") == 3 and int.from_bytes(png[20:24], "big") == 134
