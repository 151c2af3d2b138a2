"""Jobs as streams with state, progress while a stream runs, numbers and runs over ranges, exact rounding, registered functions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from linkloom.functions import registry
from linkloom.functions.exact import exact_round
from linkloom.operators import numbering, report, rows
from linkloom.sources import files
from linkloom.streaming import jobs, metrics


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_job_stream_equals_batch(rocks, sf_dir, tmp_path):
    links = "transform(sequence(1, cast(event_id % 11 as int) + 1), i -> named_struct('url', concat('a', event_id, '.com/', i), 'page', cast(i as int), 'source', 'text'))"
    done = rocks.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "cast(user_id % 5 as string) job", "event_id nth", "cast(ts as timestamp) done_at", "cast(event_id % 4 as int) n_pages", "case when event_type = 'error' then 'broken' end error", f"case when event_id % 7 > 0 then {links} end links"
    )
    done.repartitionByRange(5, "nth").write.parquet(str(tmp_path / "in"))
    # long after all others: the watermark passes the quiet time of the other jobs, which are closed
    late = rocks.createDataFrame([("late", 10**9)], "job string, nth long").selectExpr("job", "nth", "timestamp'2031-01-01 00:00:00' done_at", "1 n_pages", "cast(null as string) error", "cast(null as array<struct<url:string,page:int,source:string>>) links")
    stream = rocks.readStream.schema(jobs.FILE_DONE).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def run():
        out = []
        q = jobs.job_updates(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        assert q.exception() is None
        return out

    first = run()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    # the stream starts again from its checkpoint
    second = run()
    updates = [r for r in first if r.phase == "extract"]
    got = {}
    for r in sorted(updates, key=lambda r: r.files_done):
        got[r.job] = (r.files_done, r.files_failed, r.pages_scanned, [tuple(x) for x in r.recent])
    want = {r.job: (r.files_done, r.files_failed, r.pages_scanned, [tuple(x) for x in r.recent]) for r in jobs.jobs_done(done).collect()}
    assert got == want
    closed = {r.job for r in [*first, *second] if r.phase == "done"}
    assert closed == set(want)


def test_progress_while_a_stream_runs(spark, tmp_path):
    pages = [(0, n, f"Visit acme{n}.com/a and b{n}.org/x or c.net/{n}"[: 20 + 12 * (n % 3)], [f"https://h{n}.com/"]) for n in range(1, 6)]
    schema = "file_idx int, page_number int, page_text string, uris array<string>"
    for n, p in enumerate(pages):
        spark.createDataFrame([p], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    listener = metrics.Progress()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    q = metrics.watched_links(stream).writeStream.foreachBatch(lambda df, n: seen.append((n, df.count(), len(listener.records())))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    running = q.isActive
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    records = listener.records(q.id)
    q.stop()
    spark.streams.removeListener(listener)
    # records came while the stream ran, and batch by batch
    assert running and len(records) == 5
    assert max(n for _, _, n in seen) >= 1
    found = rows.hyperlink_occurrences(spark.createDataFrame(pages, schema)).unionByName(rows.text_occurrences(spark.createDataFrame(pages, schema)))
    curve = [r.urls_so_far for r in report.progress_curve(found).orderBy("page_number").collect()]
    assert sorted(r["urls_found_so_far"] for r in records)[-1] == curve[-1]
    assert [r["urls_found_so_far"] for r in records] == sorted(r["urls_found_so_far"] for r in records)


def test_observation_of_a_batch(spark):
    pages = spark.createDataFrame([(0, 1, "see acme.com/x", ["https://b.org"]), (0, 7, None, None)], "file_idx int, page_number int, page_text string, uris array<string>")
    seen, found = Observation("pages"), Observation("links")
    out = metrics.observe_links(rows.text_occurrences(metrics.observe_pages(pages, seen)), found)
    assert out.count() == 1
    assert seen.get == {"pages_done": 2, "last_page": 7}
    assert found.get["urls_found"] == found.get["text_urls"] == 1


def test_numbers_have_no_gaps(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k:02}.pdf").write_bytes(b"x" * (k + 1))
    got = files.discover(spark, str(tmp_path)).collect()
    assert sorted((r.file_idx, r.file_name) for r in got) == [(k, f"{k:02}.pdf") for k in range(30)]
    df = spark.createDataFrame([(None if k % 9 == 0 else k % 40, k) for k in range(500)], "a int, b int").repartition(7)
    numbered = sorted((r.n, r.a, r.b) for r in numbering.number_rows(df, ["a", "b"]).collect())
    assert [x[0] for x in numbered] == list(range(500))
    assert [x[1:] for x in numbered] == sorted(((None if k % 9 == 0 else k % 40, k) for k in range(500)), key=lambda x: (x[0] is not None, x))
    assert numbering.number_rows(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("kinds", [1, 2, 30])
def test_runs_across_ranges(spark, kinds):
    r = random.Random(kinds)
    values = [None if kinds == 30 and r.random() < 0.2 else f"f{r.randrange(kinds)}" for _ in range(60) for _ in range(1)]
    values = [v for v in values for _ in range(r.choice([1, 2, 20]))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, file_name string").repartition(5)
    got = {x.k: (x.island, x.shown) for x in report.merge_file_cells(df, "file_name", ["k"]).collect()}
    island, want = 0, {}
    for k, v in enumerate(values):
        new = k == 0 or v != values[k - 1]
        island += new
        want[k] = (island, v if new else None)
    assert got == want


def test_rounding_equals_python(spark):
    r = np.random.default_rng(1)
    ties = (2 * r.integers(-(10**6), 10**6, 300_000) + 1) / 200
    large = np.ldexp(r.random(200_000), r.integers(-60, 60, 200_000))
    x = np.concatenate([r.integers(-(10**9), 10**9, 300_000) / 1000, ties, r.normal(0, 1e3, 200_000), large, [0.0, -0.0, 0.5, 1.5, 2.5, 2.675, -2.675, 1e300, -1e300, 1e16, 5e-324, 0.05, 4503599627370497.5 / 10]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", *(exact_round(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2, 5))).toPandas()
    for d in (0, 1, 2, 5):
        want = [round(v, d) for v in got.x.tolist()]
        assert all(a == b and math.copysign(1, a) == math.copysign(1, b) for a, b in zip(got[f"d{d}"], want, strict=True))
    odd = spark.sql("SELECT double('NaN') AS x UNION ALL SELECT double('Infinity') UNION ALL SELECT NULL").select(exact_round(F.col("x"), 2).alias("y")).collect()
    assert sorted(str(r.y) for r in odd) == ["None", "inf", "nan"]


def test_registered_functions(spark):
    registry.register(spark)
    registry.register(spark)
    docs = spark.createDataFrame([(1, "Visit https://acme.com/a. and X.org, me@mail.com, x.org/y x.zzz"), (2, None), (3, "")], "id int, t string")
    got = spark.sql("SELECT d.id, u.*, standalone_count(d.t, u.url) AS n FROM {docs} d, LATERAL extract_urls(d.t) u ORDER BY id, ord", docs=docs).collect()
    assert [tuple(r) for r in got] == [(1, 0, "https://acme.com/a", "acme.com", 6, 1), (1, 1, "X.org", "x.org", 30, 1), (1, 2, "x.org/y", "x.org", 50, 1)]
    assert [r.host for r in spark.sql("SELECT host FROM extract_urls('a.zzz b.com', tlds => 'zzz')").collect()] == ["a.zzz", "b.com"]
    assert spark.sql("SELECT exact_round(2.675D, 2) AS a, exact_round(NULL, 2) AS b").first()[0] == 2.67
    for wrong in ("SELECT * FROM extract_urls(3)", "SELECT u.* FROM VALUES ('x') AS d(t), LATERAL extract_urls('a', tlds => d.t) u"):
        with pytest.raises(AnalysisException):
            spark.sql(wrong).collect()


def test_snapshot_of_a_job(spark):
    found = spark.createDataFrame([(0, 1, k, "text", "header", f"a{k}.com", "Working" if k % 2 else "") for k in range(12)], "file_idx int, page_number int, seq int, source string, location string, url string, status string")
    read = spark.createDataFrame([(3, None), (0, None), (None, "broken")], "n_pages int, error string")
    r = report.snapshot(found, read, "j1", 6, "extract", "Reading").first()
    assert (r.job_id, r.status, r.progress, r.message, r.error) == ("j1", "running", 39, "Reading", None)
    assert (r.stats.files_total, r.stats.files_done, r.stats.pages_scanned, r.stats.urls_found, r.stats.header_urls, r.stats.phase) == (6, 3, 4, 12, 12, "extract")
    assert [x.seq for x in r.recent] == list(range(11, 1, -1))
    assert report.snapshot(found, read, "j1", 6, "verify").first().progress == 72 + 6 * 22 // 12
    assert report.snapshot(found.limit(0), read.limit(0), "j1", 0, "done", error="no file").first().status == "failed"
    totals = report.result_totals(found, read, 1.25, most_warnings=1).first()
    assert (totals.processing_time_seconds, totals.n_warnings, totals.warnings, totals.pages_scanned) == (1.2, 1, "broken", 4)
