"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from linkloom.plans import catalogue
from linkloom.plans.scan import ORACLE_SQL, QUERIES

TABLES = "orders lineitem part events documents pages conversations".split()


def rows_of(df):
    show = lambda v: None if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(str([show(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(want) == rows_of(got)


def test_the_others_run(spark, sf_dir):
    for name in QUERIES:
        if name not in ORACLE_SQL:
            assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_line_makes_components(spark, sf_dir):
    con, cells = duckdb.connect(), {}
    for page, x, y in con.execute(f"select distinct l_suppkey, l_partkey % 300 // 10, floor(l_quantity * 6 / 10)::bigint from '{sf_dir}/lineitem.parquet'").fetchall():
        cells.setdefault(page, set()).add((x, y))
    want = []
    for page, left in cells.items():
        while left:
            todo, part = [left.pop()], []
            while todo:
                x, y = todo.pop()
                part.append((x, y))
                near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            xs, ys = zip(*part, strict=True)
            want.append((page, len(part), min(xs), min(ys), max(xs), max(ys)))
    assert sorted(map(tuple, QUERIES["grid_components_every_line"](spark, sf_dir).collect())) == sorted(want)


def test_repeated_turns_stay(spark, tmp_path):
    rows = [("c", 1, "user", "b c"), ("c", 1, "user", "a d"), ("c", 0, "user", "e"), ("c", 1, "user", "a d")]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["span_join"](spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.page_text) for r in got] == [("c", "e\na d\na d\nb c")]


def test_a_link_of_two_pages_has_two_results(spark, tmp_path):
    """Equal links on pages that are probed by themselves: each page's results decide its own row."""
    pages = [(k, f"https://acme{k % 3}.com/a", "") for k in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("status_fold", "status_join"):
        want, got = con.execute(catalogue.ORACLE_SQL[name]).df(), catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert sorted(want.columns) == sorted(got.columns)
        assert rows_of(want) == rows_of(got)


def test_footers_of_blogs_with_a_hyphen(spark, tmp_path):
    hosts = ["blog.adult-x.example.net", "blog.cheap-pills.example.net", "blog.acme-site.example.net", "acme.org", "myblog.example.net"]
    pages = [(k, f"https://{h}/a", f"<p>Text</p><footer>&copy; {h} all rights</footer>") for k, h in enumerate(hosts)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want, got = con.execute(catalogue.ORACLE_SQL["footer_bare_hosts"]).df(), catalogue.QUERIES["footer_bare_hosts"](spark, str(tmp_path)).toPandas()
    assert rows_of(want) == rows_of(got)
