"""python -m linkloom PAGES OUT: the links of web pages (Parquet with page_id, url, html), as a table and as workbooks.

With --probes (Parquet with url_key, pos, candidate, dns_ok, http_code, error_text) links have a status. One line for each
site is printed, up to --lines of them, then the totals.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import report, rows, status
from linkloom.sources import files, workbook


def links(spark: SparkSession, pages: str, probes: str | None = None) -> DataFrame:
    """Result rows of pages: a site is a file, and its pages are numbered by page_id."""
    own = spark.read.parquet(pages)
    sites = own.select("page_id", F.coalesce(F.nullif(F.lower(urls.host_of(F.col("url"))), F.lit("")), F.lit("unknown")).alias("file_name"))
    found = rows.extract(files.html_pages(files.spread(own))).drop("page_number").withColumnRenamed("file_idx", "page_id").join(sites, "page_id")
    found = status.attach_status(found, spark.read.parquet(probes)) if probes else found.withColumn("status", F.lit(""))
    return found.select("file_name", F.col("page_id").alias("page_number"), "seq", "source", F.lit("body").alias("location"), "url", "status")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    parser.add_argument("pages")
    parser.add_argument("out")
    parser.add_argument("--probes")
    parser.add_argument("--lines", type=int, default=100)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    links(spark, args.pages, args.probes).write.mode("overwrite").parquet(f"{args.out}/links")
    found = spark.read.parquet(f"{args.out}/links").withColumn("file_idx", F.col("file_name"))
    shown = report.result_columns(found.withColumns({c: F.lit("") for c in ("file_date", "last4", "client_id", "form_type")}))
    workbook.workbooks(shown, "Filename", ["file_idx", "Page Number", "seq"]).write.mode("overwrite").parquet(f"{args.out}/workbooks")
    for r in report.file_summary(found).orderBy(F.desc("n_urls"), "file_name").limit(args.lines).collect():
        print(f"{r.file_name}: {r.n_urls} URL(s) across {r.n_pages} page(s), {r.n_working} working")
    total = report.job_stats(found).first()
    print(f"{total.urls_found} URL(s) on {total.pages} page(s) of {total.files} site(s), {total.working_urls} working")


if __name__ == "__main__":
    main()
